"""Byte ranges of a reader: joined so that few requests bring them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def joined(ranges: list[tuple[int, int]], gap: int = 0, limit: int | None = None) -> list[tuple[int, int]]:
    """Ranges (start, end) that cover those given: neighbours within `gap` are one, and then the closest, until there are at most `limit`."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    while limit and len(out) > limit:
        k = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[k - 1][1] = out[k][1]
        del out[k]
    return [tuple(r) for r in out]


def merged(ranges: DataFrame, by: list[str], gap: int = 0, start: str = "a", end: str = "b") -> DataFrame:
    """(by..., start, end) of ranges joined within a gap, as islands of a running maximum. An unknown start comes after all others and stands alone, an unknown end adds nothing to a range of the same start."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("new_", F.coalesce((F.col(start) - before > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*by, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


class Cache:
    """What a reader has of a file: ranges with their bytes, which answer requests that they cover."""

    def __init__(self):
        self.parts: list[tuple[int, bytes]] = []

    def put(self, at: int, data: bytes) -> None:
        self.parts.append((at, data))

    def get(self, a: int, b: int) -> bytes | None:
        for at, data in self.parts:
            if at <= a and b <= at + len(data):
                return data[a - at : b - at]
        return None

    def lacking(self, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges still to be read, without what is here at their ends."""
        out = []
        for a, b in ranges:
            for at, data in self.parts:
                end = at + len(data)
                if at <= a < end:
                    a = min(b, end)
                if at < b <= end:
                    b = max(a, at)
            if a < b:
                out.append((a, b))
        return out

    def forget(self) -> None:
        self.parts.clear()
