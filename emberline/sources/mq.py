"""The adaptive binary arithmetic coder of JPEG 2000 (ISO/IEC 15444-1, annex C), both ways."""

from __future__ import annotations

# Fixed values of the standard's table C.2: Qe, next state after the more probable symbol, after the less probable one, and whether the sense switches.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]


class Contexts:
    def __init__(self, start: list[int]):
        self.state, self.sense = list(start), [0] * len(start)


class Decoder(Contexts):
    def __init__(self, data: bytes, start: list[int]):
        super().__init__(start)
        self.data, self.at, self.a = data + b"\xff\xff", 0, 0x8000
        self.c, self.left = self.data[0] << 16, 0
        self._byte()
        self.c <<= 7
        self.left -= 7

    def _byte(self) -> None:
        d, at = self.data, self.at
        following = d[at + 1] if at + 1 < len(d) else 0xFF
        if d[at] == 0xFF and following > 0x8F:
            self.c += 0xFF00
            self.left = 8
            return
        self.at = at + 1
        self.left = 7 if d[at] == 0xFF else 8
        self.c += following << (16 - self.left)

    def bit(self, context: int, value: int | None = None) -> int:
        qe, more, less, switch = STATES[self.state[context]]
        sense = self.sense[context]
        self.a -= qe
        low = (self.c >> 16) < qe
        if not low:
            self.c -= qe << 16
            if self.a & 0x8000:
                return sense
        improbable = low != (self.a < qe)
        if low:
            self.a = qe
        if improbable:
            if switch:
                self.sense[context] = 1 - sense
            self.state[context] = less
        else:
            self.state[context] = more
        while not self.a & 0x8000:
            if not self.left:
                self._byte()
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
        return 1 - sense if improbable else sense


class Encoder(Contexts):
    """The counterpart, for files of our own making (tests, fixtures)."""

    def __init__(self, start: list[int]):
        super().__init__(start)
        self.out, self.a, self.c, self.left = bytearray(b"\0"), 0x8000, 0, 12

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1  # a carry
            self.c &= 0x7FFFFFF
        stuffed = self.out[-1] == 0xFF
        shift = 20 if stuffed else 19
        self.out.append(self.c >> shift & 0xFF)
        self.c &= (1 << shift) - 1
        self.left = 7 if stuffed else 8

    def bit(self, context: int, value: int) -> int:
        qe, more, less, switch = STATES[self.state[context]]
        self.a -= qe
        if value == self.sense[context]:
            if self.a & 0x8000:
                self.c += qe
                return value
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            self.state[context] = more
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            if switch:
                self.sense[context] = 1 - self.sense[context]
            self.state[context] = less
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
            if not self.left:
                self._byte()
        return value

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.left
            self._byte()
        out = bytes(self.out[1:])
        return out[:-1] if out.endswith(b"\xff") else out
