"""A small JPEG 2000 writer for tests: one layer, LRCP, reversible, one precinct a resolution."""

import struct

import numpy as np

from emberline.sources import jp2, mq


def split(x, first):
    """Forward 5/3 along the last axis: (low, high)."""
    n = x.shape[-1]
    odd = first & 1
    if n == 1:
        return (x[..., :0], x * 2) if odd else (x, x[..., :0])
    x = x.astype(np.int64)
    mirror = lambda k: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    y = x.copy()
    for k in range(1 - odd, n, 2):
        y[..., k] -= (x[..., mirror(k - 1)] + x[..., mirror(k + 1)]) >> 1
    for k in range(odd, n, 2):
        y[..., k] += (y[..., mirror(k - 1)] + y[..., mirror(k + 1)] + 2) >> 2
    return y[..., odd::2], y[..., 1 - odd :: 2]


class Out:
    def __init__(self):
        self.data, self.acc, self.n = bytearray(), 0, 0

    def bit(self, b):
        self.acc, self.n = self.acc << 1 | b, self.n + 1
        if self.n == (7 if self.data[-1:] == b"\xff" else 8):
            self.data.append(self.acc)
            self.acc = self.n = 0

    def bits(self, v, n):
        for k in range(n - 1, -1, -1):
            self.bit(v >> k & 1)

    def end(self):
        while self.n:
            self.bit(0)
        if self.data[-1:] == b"\xff":
            self.data.append(0)
        return bytes(self.data)


class Tree:
    def __init__(self, grid):
        self.levels = [np.array(grid)]
        while self.levels[-1].size > 1:
            g = self.levels[-1]
            h, w = -(-g.shape[0] // 2), -(-g.shape[1] // 2)
            self.levels.append(np.array([[g[2 * j : 2 * j + 2, 2 * i : 2 * i + 2].min() for i in range(w)] for j in range(h)]))
        self.at = [np.zeros(g.shape, int) for g in self.levels]
        self.known = [np.zeros(g.shape, bool) for g in self.levels]

    def put(self, out, x, y, limit):
        low = 0
        for k in range(len(self.levels) - 1, -1, -1):
            j, i = y >> k, x >> k
            self.at[k][j, i] = max(self.at[k][j, i], low)
            while not self.known[k][j, i] and self.at[k][j, i] < limit:
                if self.at[k][j, i] == self.levels[k][j, i]:
                    out.bit(1)
                    self.known[k][j, i] = True
                else:
                    out.bit(0)
                    self.at[k][j, i] += 1
            low = self.at[k][j, i]


def passes_code(out, n):
    if n == 1:
        out.bit(0)
    elif n == 2:
        out.bits(2, 2)
    elif n <= 5:
        out.bits(3, 2), out.bits(n - 3, 2)
    elif n <= 36:
        out.bits(15, 4), out.bits(n - 6, 5)
    else:
        out.bits(511, 9), out.bits(n - 37, 7)


def encode(image, levels=2, tile=None, block=4, precision=16, mct=0):
    """image: components x rows x columns."""
    nc, h, w = image.shape
    tw, th = tile or (w, h)
    exponents = [precision + 3] * (3 * levels + 1)
    guard = 2
    siz = struct.pack(">HIIIIIIIIH", 0, w, h, 0, 0, tw, th, 0, 0, nc) + bytes([precision - 1, 1, 1]) * nc
    cod = struct.pack(">BBHBBBBBB", 0, 0, 1, mct, levels, block - 2, block - 2, 0, 1)
    qcd = bytes([guard << 5]) + bytes(e << 3 for e in exponents)
    out = b"\xff\x4f" + b"".join(struct.pack(">HH", m, len(b) + 2) + b for m, b in ((0xFF51, siz), (0xFF52, cod), (0xFF5C, qcd)))
    most = [guard + e - 1 for e in exponents]
    across = -(-w // tw)
    for t in range(across * -(-h // th)):
        x0, y0 = t % across * tw, t // across * th
        x1, y1 = min(x0 + tw, w), min(y0 + th, h)
        parts = image[:, y0:y1, x0:x1].astype(np.int64) - (1 << (precision - 1))
        if mct:
            r, g, b = parts[:3]
            parts = np.concatenate([np.stack([(r + 2 * g + b) >> 2, b - g, r - g]), parts[3:]])
        bands = []
        for c in range(nc):
            now, made = parts[c], {}
            for r in range(levels, 0, -1):
                bx, by = -(-x0 >> (levels - r)), -(-y0 >> (levels - r))
                low, high = split(now.T, by)
                low, high = low.T, high.T
                now, made[r, 1] = split(low, bx)
                made[r, 2], made[r, 3] = split(high, bx)
            made[0, 0] = now
            bands.append(made)
        body = b""
        for r in range(levels + 1):
            if -(-x1 >> (levels - r)) <= -(-x0 >> (levels - r)) or -(-y1 >> (levels - r)) <= -(-y0 >> (levels - r)):
                continue
            for c in range(nc):
                bits, data = Out(), b""
                bits.bit(1)
                for b in range(1, 4) if r else (0,):
                    box = jp2._band_box((x0, y0, x1, y1), levels, r, b)
                    values = bands[c][r, b]
                    if not values.size:
                        continue
                    cx, cy = box[0] >> block, box[1] >> block
                    nx, ny = -(-box[2] >> block) - cx, -(-box[3] >> block) - cy
                    cut = {}
                    for j in range(ny):
                        for i in range(nx):
                            ax, ay = max((cx + i) << block, box[0]), max((cy + j) << block, box[1])
                            ex, ey = min((cx + i + 1) << block, box[2]), min((cy + j + 1) << block, box[3])
                            cut[i, j] = values[ay - box[1] : ey - box[1], ax - box[0] : ex - box[0]]
                    m = most[0 if not r else 3 * r - 3 + b]
                    planes = {k: int(np.abs(v).max()).bit_length() for k, v in cut.items()}
                    inclusion = Tree([[0 if planes[i, j] else 1 for i in range(nx)] for j in range(ny)])
                    zero = Tree([[m - planes[i, j] for i in range(nx)] for j in range(ny)])
                    for j in range(ny):
                        for i in range(nx):
                            inclusion.put(bits, i, j, 1)
                            p = planes[i, j]
                            if not p:
                                continue
                            zero.put(bits, i, j, 1 << 30)
                            coder = mq.Encoder(jp2.START)
                            v = cut[i, j]
                            jp2.Block(v.shape[1], v.shape[0], b, v).run(coder, p, 3 * p - 2)
                            made = coder.finish()
                            passes_code(bits, 3 * p - 2)
                            extra = (3 * p - 2).bit_length() - 1
                            width = max(3, len(made).bit_length() - extra)
                            bits.bits((1 << (width - 2)) - 2, width - 2)
                            bits.bits(len(made), width + extra)
                            data += made
                body += bits.end() + data
        out += struct.pack(">HHHIBB", 0xFF90, 10, t, 14 + len(body), 0, 1) + b"\xff\x93" + body
    return out + b"\xff\xd9"
