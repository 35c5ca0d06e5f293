"""SimHash near-duplicates through a byte-position inverted index.

Fingerprints of 64 bits that differ in at most 3 bits share at least 5 of their
8 bytes at equal positions. The index is over positional bytes; since single
bytes give long lists, an entry is a triple of positional bytes: of 6 positions
such a pair shares at least 3, so one of 20 triples brings it together. In each
list the shared positional bytes of a pair are tallied, pairs under the
guaranteed minimum go, and the rest are verified by the bits that differ.

Only different fingerprints are indexed, each with its least document, and a
list gives a spanning forest of its links, never all pairs. Fingerprints of
lists longer than `longest` are compared through finer entries, for which 3 of
the 16 half-bytes are masked out: a pair differs in 3 half-bytes at most, so it
meets in one of 560 entries, and such a list holds at most 4096 different
fingerprints. No link is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from emberline.operators.components import connected

from . import vectext
from .common import F, fresh_name, quoted, stored, whole_text

BITS, BYTES = 3, 8
INDEXED = 6  # positions; of these a pair shares 6 - 3 at least
TRIPLES = list(itertools.combinations(range(INDEXED), INDEXED - BITS))
MASKS = list(itertools.combinations(range(16), BITS))


def _text_fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of UTF-8 texts, as unsigned 64-bit integers."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only, and white space is 9 to 13 and 32
        if len(words) > shingle:
            joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            made = [digest(s, seed) for s in joined]
        else:
            made = [digest(b" ".join(words), seed)] if words else []
        hashes += made
        sizes[k] = len(made)
    out = np.zeros(len(texts), np.uint64)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    h = np.array(hashes, np.uint64)
    # counts in four lanes of 16 bits, over stretches that no lane overflows in
    starts = np.cumsum(sizes) - sizes
    cuts = np.concatenate([np.arange(starts[k], starts[k] + sizes[k], 60000) for k in has])
    owner = np.concatenate([np.full(-(-sizes[k] // 60000), k) for k in has])
    lanes = np.uint64(0x0001000100010001)
    counts = np.zeros((len(texts), 64), np.int64)
    for bit in range(16):
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, cuts)
        for lane in range(4):
            np.add.at(counts[:, lane * 16 + bit], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = counts * 2 > sizes[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, fp) with fp the fingerprint's bits as a signed long."""
    frame = documents.select(F.col(quoted(id_column)).alias("doc"), whole_text(text_column).alias("text"))

    def run(frames):
        for batch in vectext.batches(frames):
            data, offsets = vectext.flat(batch.column(1))
            raw = data.tobytes()
            fp = _text_fingerprints([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc", "fp"])

    return frame.mapInArrow(run, f"doc {frame.schema['doc'].dataType.simpleString()}, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Positions at which two fingerprints have equal bytes, for their exclusive or."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def linked(x: np.ndarray, most: int) -> np.ndarray:
    """The count filter and the verification, for exclusive ors of pairs."""
    found = shared_bytes(x) >= BYTES - most
    found[found] = np.bitwise_count(x[found]) <= most
    return found


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least node that span the same components as the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new][new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _list_links(key: np.ndarray, fp: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists of rows in order of their key, as a forest."""
    left, right = [], []
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    rows = np.arange(len(key))
    end = np.repeat(start + size, size)
    for step in range(1, int(size.max(initial=1))):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        found = rows[linked(fp[rows] ^ fp[rows + step], most)]
        left.append(doc[found])
        right.append(doc[found + step])
        if sum(map(len, left)) > 4_000_000:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    if not left:
        return doc[:0], doc[:0]
    return forest(np.concatenate(left), np.concatenate(right))


def _links(index: DataFrame, most: int, longest: int) -> DataFrame:
    """(a, b, fp) of rows (key, fp, doc): a link of documents, or, with b null, document a with its fp from a list longer than `longest`."""

    def run(frames):
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        flooding = None  # the key of a long list whose rows pass on

        def made(a, b, fp=None):
            blank = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), blank if b is None else pa.array(b), blank if fp is None else pa.array(fp)], names=["a", "b", "fp"])

        def work(rows):
            key, fp, doc = rows
            size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))) if len(key) else np.zeros(0, np.int64)
            long = np.repeat(size > longest, size)
            if long.any():
                yield made(doc[long], None, fp[long])
            if len(key) and not long.all():
                a, b = _list_links(key[~long], fp[~long].view(np.uint64), doc[~long], most)
                if len(a):
                    yield made(a, b)

        for batch in frames:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if flooding is not None:
                n = int(np.searchsorted(rows[0], flooding, "right"))
                if n:
                    yield made(rows[2][:n], None, rows[1][:n])
                rows = [c[n:] for c in rows]
                if not len(rows[0]):
                    continue
                flooding = None
            kept = [np.concatenate([k, c]) for k, c in zip(kept, rows, strict=True)]
            if len(kept[0]) < 100_000:
                continue
            cut = int(np.searchsorted(kept[0], kept[0][-1], "left"))
            yield from work([c[:cut] for c in kept])
            kept = [c[cut:] for c in kept]
            if len(kept[0]) > longest:
                flooding = kept[0][-1]
                yield made(kept[2], None, kept[1])
                kept = [c[:0] for c in kept]
        yield from work(kept)

    dealt = index.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp", "doc").mapInArrow(run, "a long, b long, fp long")


def _byte(position: int):
    return F.expr(f"shiftrightunsigned(fp, {8 * position}) & 255")


def classes(prints: DataFrame, most: int = BITS, longest: int = 4096) -> DataFrame:
    """(fp, component) of (doc, fp): the least document of all fingerprints that links of at most `most` differing bits reach."""
    if not 0 <= most <= BITS:
        raise ValueError("the index guarantees links of up to 3 bits")
    least = stored(prints.groupBy("fp").agg(F.min("doc").alias("doc")), "prints")
    keys = F.array(*(sum((_byte(p) * (1 << 8 * i) for i, p in enumerate(ps)), F.lit(n << 24)) for n, ps in enumerate(TRIPLES)))
    found = stored(_links(least.where("doc is not null").select(F.explode(keys).alias("key"), "fp", "doc"), most, longest), "links")
    hot = found.where("b is null").select(F.col("fp"), F.col("a").alias("doc")).distinct()
    fine = F.array(*(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(_signed(~sum(15 << 4 * p for p in ps))))) for n, ps in enumerate(MASKS)))
    # two masked values may share a 64-bit key by chance; a list is then longer, and its pairs are verified all the same
    finer = _links(hot.select(F.explode(fine).alias("key"), "fp", "doc"), most, 1 << 30)
    edges = found.where("b is not null").select("a", "b").unionAll(finer.select("a", "b"))
    roots = connected(edges)
    return least.join(roots, least.doc == roots.node, "left").select("fp", F.coalesce("component", "doc").alias("component"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = BITS) -> DataFrame:
    """One row per document: the id column, fingerprint (16 hex digits) and component_id.

    Null text is the empty text, and texts without words have fingerprint zero,
    linked like any other. component_id is the least id of the component; rows
    with a null id get their class's id, null if it has no other. Repeated rows
    stay. An empty table gives no rows; further columns are not looked at. Ids
    are whole numbers.
    """
    prints = stored(fingerprints(documents.withColumn(id_column, F.col(quoted(id_column)).cast("long")), id_column, text_column), "fp")
    out = prints.join(classes(prints, most), "fp", "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    names = ["fingerprint", "component_id"]
    return out.select(F.col("doc").alias(fresh_name(names, id_column)), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = BITS) -> DataFrame:
    """The documents without all but the least id of each group; the columns stay as they are.

    Rows that share the kept id all stay, as do rows with a null id.
    """
    groups = near_duplicates(documents, id_column, text_column, most).where("component_id is not null").toDF("id_", "fingerprint_", "component_")
    gone = groups.where("id_ <> component_").select("id_").distinct()
    return documents.join(gone, F.col(quoted(id_column)) == gone.id_, "left_anti")
