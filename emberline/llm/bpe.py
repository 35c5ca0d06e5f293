"""Byte-level BPE ids for whole Arrow batches of texts.

The ids are those of the tokenizers library with the same vocabulary. The
pattern that cuts texts into pieces before the merges is applied with numpy to
all texts of a batch at once, and each different piece is merged only once
while a direct-mapped cache holds it: prose repeats its words.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from . import vectext

LETTER, DIGIT, BLANK = 1, 2, 3
SPECIAL = "<|endoftext|>"
CACHE_SLOTS, STORE_MOST = 1 << 20, 1 << 23


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: letter, digit, white space or 0."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for number, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = number
    return out


@functools.cache
def doubtful() -> np.ndarray:
    """Code points that two Unicode versions class differently: texts with one go to the tokenizers library itself."""
    table = classes()
    other = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        other[c] = LETTER if kind == "L" else DIGIT if kind == "N" else 0
    return np.where(table == BLANK, 0, table) != other


@functools.cache
def _point_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 0x110000, dtype=np.uint64) | np.uint64(1)


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces begin, for code points of texts that begin at the offsets.

    A piece is a contraction, or a run of letters, digits or other signs with
    one space before it at most, or white space; the last blank of white space
    before something else stands apart, or joins what follows if it is a space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~edge[1:n])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        room = np.searchsorted(offsets, quote, "right")
        room = offsets[np.minimum(room, len(offsets) - 1)] - quote
        short = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 3) & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((short, 2), (long & ~short, 3)):
            at = quote[found]
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary, given as ranks (a .tiktoken file) with its cutting pattern and as the tokenizers library's file."""

    def __init__(self, ranks_path: str, pattern: str, tokenizer_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer_path = tokenizer_path
        self._clear()

    @functools.cached_property
    def exact(self) -> Tokenizer:
        """The tokenizers library's own; most tasks meet no text that needs it."""
        return Tokenizer.from_file(self.tokenizer_path)

    def _clear(self) -> None:
        self.key = np.zeros(CACHE_SLOTS, np.uint64)
        self.at = np.zeros(CACHE_SLOTS, np.int64)
        self.count = np.zeros(CACHE_SLOTS, np.int32)
        self.store = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another with `tail` zeros after each, and where each text's ids begin (one more than texts)."""
        if self.used > STORE_MOST:
            self._clear()
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = np.searchsorted(lead, offsets)
        starts = piece_starts(points, at)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        h = vectext.span_hashes(_point_values()[points], starts, ends)
        h[h == 0] = 1
        slot = (h & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)
        hit = self.key[slot] == h
        where, count = self.at[slot], self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            a, b = lead[starts[miss[first]]].tolist(), lead[ends[miss[first]]].tolist()
            one = self.bpe._core_bpe.encode_single_piece
            made = [one(raw[i:j]) for i, j in zip(a, b, strict=True)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            base = self._keep(np.fromiter((x for ids in made for x in ids), np.int32, int(sizes.sum())))
            places = base + np.cumsum(sizes) - sizes
            where[miss], count[miss] = places[back], sizes[back]
            s = (new & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)
            self.key[s], self.at[s], self.count[s] = new, places, sizes
        text = np.searchsorted(at, starts, "right") - 1
        n = len(offsets) - 1
        total = int(count.sum())
        before = np.cumsum(count) - count
        out = np.zeros(total + tail * n, np.int32)
        out[np.arange(total) + np.repeat(text * tail, count)] = self.store[np.arange(total) + np.repeat(where - before, count)]
        begins = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(text, weights=count, minlength=n).astype(np.int64) + tail, out=begins[1:])
        return out, begins

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_flat(raw, np.array([0, len(raw)]))[0]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """encode_flat(), but for the texts that hold the vocabulary's end-of-text string or doubtful code points, which the tokenizers library encodes."""
        raw = data.tobytes()
        special = SPECIAL.encode()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if special not in raw and not doubtful()[points].any():
            return self.encode_flat(data, offsets, tail)
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        odd = np.array([special in t or bool(doubtful()[np.frombuffer(t.decode().encode("utf-32-le"), np.uint32)].any()) for t in texts])
        plain = [b"" if o else t for o, t in zip(odd, texts, strict=True)]
        ids, begins = self.encode_flat(np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in plain])]))
        end = np.zeros(tail, np.int32)
        out = [np.concatenate([np.array(self.exact.encode(t.decode(), add_special_tokens=False).ids, np.int32) if o else ids[begins[k] : begins[k + 1]], end]) for k, (o, t) in enumerate(zip(odd, texts, strict=True))]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
