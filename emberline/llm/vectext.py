"""Texts of a whole Arrow batch as flat numpy arrays.

The classifiers and the packer look at each character of each text. They do it
for all texts of a batch at once: one array of UTF-8 bytes with the offsets of
the texts, and from it the words with a hash each.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the rolling hash, and its inverse modulo 2**64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, so that sums over bytes hash well.
BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than texts) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up = np.full(size, MULTIPLIER, np.uint64)
        up[0] = 1
        down = np.full(size, INVERSE, np.uint64)
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of 64-bit values; equal spans have equal hashes wherever they stand."""
    n = len(values)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run also ends at each break."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[breaks] = True
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    start = mask & (~before | edge[:-1])
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    end = mask & (~after | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def give_back() -> None:
    """Free memory goes back to the system, where the C library can: workers live on, and what one stage has freed else counts against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def batches(frames, most_bytes: int = 1_500_000, text: str = "text"):
    """Cut the Arrow batches of a partition into pieces of about so many bytes of text, so that memory stays bounded; one text is never cut."""
    for batch in frames:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
            give_back()


def pieces(texts: pa.Array | pa.ChunkedArray, most_bytes: int = 1_000_000):
    """(data, offsets) of stretches of a column, so that a sample's temporary arrays stay small."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for part in batches([pa.record_batch([texts], ["text"])], most_bytes):
        yield flat(part.column(0))
