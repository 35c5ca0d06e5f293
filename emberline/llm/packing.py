"""Sum-of-squares online packing of token sequences into fixed windows.

Each document's tokens are cut into whole windows and one rest. The rest goes
to the fill level at which the sum, over levels, of the squared counts of
partially filled windows grows least; a level array holds these counts. Every
input partition packs its own documents in one pass, so there is no shuffle and
a lost task is simply run again.

Windows still open at the end of a partition (or once `most_open` are open) are
filled up from each other by cutting, and the very last rest is cut at powers
of two, for which a batch needs no padding.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import vectext
from .bpe import Encoder
from .common import F, fresh_name, quoted, whole_text

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A task numbers its sequences from its partition number times this.
STRIDE = 1 << 40


class Packer:
    """Packs rests of documents; a piece is (document key, start, ids, document's token count)."""

    def __init__(self, width: int = 1024, first_id: int = 0, most_open: int = 4096):
        self.width, self.next_id, self.most_open = width, first_id, most_open
        self.level = np.zeros(width, np.int64)
        self.windows: dict[int, list[tuple[int, list]]] = {}
        self.open = 0
        self.done: list[tuple] = []

    def _emit(self, piece: tuple, sequence: int, offset: int) -> None:
        key, start, ids, total = piece
        self.done.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def best_level(self, size: int) -> int:
        """The fill level (0: a new window) for a rest of this size: least growth of the sum of squares, then fullest."""
        width, count = self.width, self.level
        fits = width - size
        after = np.zeros(fits + 1, np.int64)
        after[:fits] = 2 * count[size:width] + 1  # the level that is reached gains a window; a full window has no level
        growth = after.copy()
        growth[1:] += 1 - 2 * count[1 : fits + 1]  # the level that is left loses one
        growth[1:][count[1 : fits + 1] == 0] = np.iinfo(np.int64).max
        return fits - int(np.argmin(growth[::-1]))

    def add(self, key, ids: np.ndarray) -> None:
        total, width = len(ids), self.width
        whole = total // width * width
        for start in range(0, whole, width):
            self._emit((key, start, ids[start : start + width], total), self._new_id(), 0)
        size = total - whole
        if not size:
            return
        at = self.best_level(size)
        if at:
            name, pieces = self.windows[at].pop()
            self.level[at] -= 1
            self.open -= 1
        else:
            name, pieces = self._new_id(), []
        pieces.append((key, whole, ids[whole:].copy(), total))
        if at + size == width:
            self._close(name, pieces)
            return
        self.windows.setdefault(at + size, []).append((name, pieces))
        self.level[at + size] += 1
        self.open += 1
        if self.open >= self.most_open:
            self.flush()

    def _close(self, name: int, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self._emit(piece, name, offset)
            offset += len(piece[2])

    def flush(self) -> None:
        """Close all open windows: fill the fullest from the emptiest by cutting."""
        left = [w for at in sorted(self.windows, reverse=True) for w in self.windows[at]]
        self.windows, self.open = {}, 0
        self.level[:] = 0
        low, high = 0, len(left) - 1
        spare: list[tuple] = []  # pieces of dissolved windows
        while low <= high:
            name, pieces = left[low]
            low += 1
            room = self.width - sum(len(p[2]) for p in pieces)
            while room and (spare or low <= high):
                if not spare:
                    spare = left[high][1]
                    high -= 1
                key, start, ids, total = spare.pop()
                pieces.append((key, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((key, start + room, ids[room:], total))
                room -= min(room, len(ids))
            if room:  # the last one
                spare = pieces[::-1]
                break
            self._close(name, pieces)
        size = self.width
        left_over = sum(len(p[2]) for p in spare)
        while left_over:
            if size > left_over:
                size //= 2
                continue
            name, offset = self._new_id(), 0
            while offset < size:
                key, start, ids, total = spare.pop()
                take = min(size - offset, len(ids))
                self._emit((key, start, ids[:take], total), name, offset)
                if take < len(ids):
                    spare.append((key, start + take, ids[take:], total))
                offset += take
            left_over -= size

    def taken(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


@functools.cache
def _encoder(ranks_path: str, pattern: str, tokenizer_path: str) -> Encoder:
    return Encoder(ranks_path, pattern, tokenizer_path)


def pack(
    documents: DataFrame,
    ranks_path: str,
    pattern: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 1024,
    end_id: int = 0,
    most_open: int = 4096,
) -> DataFrame:
    """Pieces of documents in sequences of at most `width` tokens.

    Returns a row per piece: the id column, start, length, ids_crc32,
    doc_tokens, sequence_id and offset. A document's ids are those of its text
    and one `end_id`. `width` must be a power of two.

    Null text is the empty text (one token); a null id stays null; repeated rows
    are packed each on its own; an empty table gives no rows; further columns
    are not looked at. A text of any length is encoded whole.
    """
    if width < 2 or width & (width - 1):
        raise ValueError("width must be a power of two")
    if end_id != 0:
        raise ValueError("documents end with id 0")
    frame = documents.select(F.col(quoted(id_column)).alias("key"), whole_text(text_column).alias("text"))
    kind = frame.schema["key"].dataType.simpleString()
    arrow = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(frames):
        encoder = _encoder(ranks_path, pattern, tokenizer_path)
        packer = Packer(width, TaskContext.get().partitionId() * STRIDE, most_open)

        def rows():
            done = packer.taken()
            keys = pa.array([r[0] for r in done], key_type)
            rest = [pa.array([r[i] for r in done], pa.int64()) for i in range(1, 7)]
            return pa.RecordBatch.from_arrays([keys, *rest], names=["key", *arrow.names])

        key_type = pa.int64()
        for batch in vectext.batches(frames, 500_000):
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            ids, begins = encoder.encode_texts(*vectext.flat(batch.column(1)), 1)
            for k, key in enumerate(keys):
                packer.add(key, ids[begins[k] : begins[k + 1]])
            if packer.done:
                yield rows()
        packer.flush()
        if packer.done:
            yield rows()

    out = frame.mapInArrow(run, f"key {kind}, {SCHEMA}")
    name = fresh_name(SCHEMA.replace(",", " ").split(), id_column) if id_column.lower() in SCHEMA.split() else id_column
    return out.withColumnRenamed("key", name)
