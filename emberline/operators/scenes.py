"""Which scenes and granules to read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of each group the first row in the order."""
    first = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("row_", F.row_number().over(first)).where("row_ = 1").drop("row_")


def newest_processing(scenes: DataFrame, id_column: str = "id", by: tuple[str, ...] = ("tile", "datetime")) -> DataFrame:
    """Of each tile and time the newest baseline (characters 29 to 32 of the id), then the newest product time (the last 15)."""
    return newest(scenes, list(by), [F.substring(id_column, 29, 4).desc(), F.substring(id_column, -15, 15).desc()])


def newest_ties(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows that have their group's largest value."""
    return rows.withColumn("max_", F.max(value).over(Window.partitionBy(*by))).where(F.col(value) == F.col("max_")).drop("max_")


def newest_granules(granules: DataFrame, id_column: str = "id") -> DataFrame:
    """Granules of each platform's orbit's newest baseline, and of each start time the newest processing; both are judged over all rows."""
    part = lambda a, n: F.substring(id_column, a, n)
    orbit = Window.partitionBy(part(1, 3), part(70, 7))
    start = Window.partitionBy(part(1, 3), part(17, 15)).orderBy(part(49, 15).desc())
    marked = granules.withColumns({"base_": F.max(part(-3, 3)).over(orbit), "row_": F.row_number().over(start)})
    return marked.where((part(-3, 3) == F.col("base_")) & (F.col("row_") == 1)).drop("base_", "row_")


def in_window(scenes: DataFrame, start: str, end: str, column: str = "t") -> DataFrame:
    """Sensing times as text (yyyymmddThhmmss) from a day to the end of another (yyyymmdd each)."""
    return scenes.where(F.col(column).between(start, end + "Z"))


def read_box(scenes: DataFrame, margin: float = 2_000.0, cell: float = 6_400.0) -> DataFrame:
    """The box to read (xmin, ymin, xmax, ymax) and the square's corner (sx, sy) of scenes with a raster box (pb0..pb3) and the request's extent (x0, y0, x1, y1), all in metres.

    The 100 km square is widened by the margin and rounded out to the raster's own cells.
    """
    out = scenes.withColumns({"sx": F.round("pb0", -5), "sy": F.round("pb3", -5)})
    text = {
        "xmin": f"greatest(x0, pb0 + floor((sx - {margin} - pb0) / {cell}) * {cell})",
        "ymin": f"greatest(y0, pb3 - ceil((pb3 - sy + {100_000 + margin}) / {cell}) * {cell})",
        "xmax": f"least(x1, pb0 + ceil((sx + {100_000 + margin} - pb0) / {cell}) * {cell})",
        "ymax": f"least(y1, pb3 - floor((pb3 - sy - {margin}) / {cell}) * {cell})",
    }
    return out.withColumns({k: F.expr(v.replace(f"{margin}", f"{margin}D").replace(f"{cell}", f"{cell}D").replace(f"{100_000 + margin}", f"{100_000 + margin}D")) for k, v in text.items()})


def overlapping(scenes: DataFrame, most_cloud: float = 100.0) -> DataFrame:
    """Scenes whose read box meets their own square, at most so cloudy."""
    return scenes.where(f"least(xmax, sx + 100000) > greatest(xmin, sx) and least(ymax, sy) > greatest(ymin, sy - 100000) and cloud <= {float(most_cloud)}D")


def probe_points(w: float, s: float, e: float, n: float, spark, count: int = 9) -> DataFrame:
    """(k, lon, lat) of a grid over a box."""
    k = F.col("id")
    return spark.range(count * count).select(k.cast("int").alias("k"), (F.lit(w) + F.lit(e - w) * (k % count) / (count - 1)).alias("lon"), (F.lit(s) + F.lit(n - s) * F.floor(k / count) / (count - 1)).alias("lat"))


def nearest_listed(squares: DataFrame, listed: DataFrame, by: str = "k") -> DataFrame:
    """Of the grid squares of each point (k, shift, tile) that are listed, that of the nearest zone; ties to the lesser tile."""
    known = squares.join(listed.select("tile").distinct(), "tile", "left_semi")
    return known.groupBy(by).agg(F.min_by("tile", F.struct(F.abs("shift").alias("far"), F.col("tile"))).alias("tile"))


def day_step(w: float, s: float, e: float, n: float, kind: str) -> int:
    """Days that one search of the catalogue spans, so that a page is about half full."""
    dx, dy = e - w, n - s
    if kind == "s2":
        return max(1, math.floor(830 / (dx * 1.11 * math.cos(math.radians((s + n) / 2)) + 2) / (dy * 1.11 + 2)))
    return max(1, math.floor(80 / (1 + dx * dy / 50)))
