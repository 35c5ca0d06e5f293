"""Secrets in texts: fixed patterns, and random strings that a token vocabulary betrays.

A vocabulary learnt from prose has long tokens for what people write and short
ones for random characters. A long run of key characters with few characters
per token is therefore a random string; where names or path parts beside it
hide that, so is a part of the run. Digests and identifiers are random too
but no secrets: left out are digests that are known (of nothing, or given),
digests that the text calls so ("sha1:", "commit"), UUIDs and plain numbers. All
else is decided by the ratio.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import vectext
from .common import F, quoted, whole_text

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Parts of a run: values of names, then path parts, then words with dashes or underscores between.
_PARTS = (re.compile(r"[^=]+"), re.compile(r"[^=/]+"), re.compile(r"[^=/_-]+"))
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE | re.ASCII)
#: What stands before a digest that the text calls one.
_CALLED = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|digest|checksum|commit|revision|etag|integrity)[\"']?[\x20:=\"'(-]{1,4}\Z", re.IGNORECASE | re.ASCII)
#: Digests of nothing at all, which stand wherever a file was empty.
NOTHING = tuple(hashlib.new(name).hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))
#: Hex digits of common digests: 128, 160, 224, 256, 384 and 512 bits.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in code points, each kind leftmost and without overlaps."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


class Scanner:
    def __init__(self, ranks_path: str, pattern: str, most_ratio: float, known: frozenset[str]):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most_ratio, self.known = most_ratio, known

    def is_plain(self, text: str, start: int, end: int) -> bool:
        """Too short, a number, a known digest or an identifier, as a whole."""
        run = text[start:end]
        plain = run.strip("=-_./+")
        if len(plain) < 20 or plain.isdigit() or plain.lower() in self.known or _UUID.fullmatch(plain):
            return True
        return bool(_DIGEST.fullmatch(plain) and _CALLED.search(text, max(0, start - 24), start + run.index(plain)))

    def is_random(self, run: str) -> bool:
        return len(run) <= self.most_ratio * len(self.bpe.encode_ordinary(run))

    def random_spans(self, text: str, start: int, end: int, level: int = 0) -> list[tuple[int, str, int]]:
        """A run that is random as a whole, else those of its parts between the signs of the next level that are."""
        run = text[start:end]
        if self.is_plain(text, start, end):
            return []
        if self.is_random(run):
            return [(start, "random", end)]
        out = []
        for m in _PARTS[level].finditer(text, start, end) if level < len(_PARTS) else ():
            out += self.random_spans(text, m.start(), m.end(), level + 1)
        return out

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """All spans in order of start, then of the kind as listed in KINDS."""
        out = base_spans(text)
        for m in _RUN.finditer(text):
            out += self.random_spans(text, m.start(), m.end())
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


@functools.cache
def _scanner(*args) -> Scanner:
    return Scanner(*args)


def scan(documents: DataFrame, ranks_path: str, pattern: str, most_ratio: float = 2.0, known_digests: tuple[str, ...] = NOTHING, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id column and spans, an array of (start, kind, end).

    Offsets count code points, the end exclusive. `most_ratio` is the largest
    number of characters per token of a random string. Null text is the empty
    text and has no spans; a null id stays null; repeated rows give repeated
    rows; an empty table gives no rows; texts are scanned whole.
    """
    frame = documents.select(F.col(quoted(id_column)).alias("doc"), whole_text(text_column).alias("text"))
    known = frozenset(k.lower() for k in known_digests)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(frames):
        scanner = _scanner(ranks_path, pattern, most_ratio, known)
        for batch in vectext.batches(frames):
            found = [[{"start": a, "kind": k, "end": b} for a, k, b in scanner.spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc", "spans"])

    out = frame.mapInArrow(run, f"doc {frame.schema['doc'].dataType.simpleString()}, spans array<struct<start:long,kind:string,end:long>>")
    return out.withColumnRenamed("doc", "spans_id" if id_column.lower() == "spans" else id_column)
