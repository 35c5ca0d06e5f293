"""The daytime detector: hot spots in short-wave infrared, band B12 against B11 and B8A.

Pixels are rows (scene, row, col, b12, b11, b8a as digital numbers, cloudy), row
and col counted from the tile's origin. Background cells, squares, candidates and
the rings around them are joins and aggregates; only the candidates of a scene,
few, meet in one place to be grouped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import params

from . import labelling

CELL, SQUARE, RING = 320, 32, 3
LEAST_BACKGROUND = 10


def reflectance(dn: Column) -> Column:
    """0 stands for no data."""
    return F.when(dn == 0, F.lit(0.0)).otherwise((dn - 1000) / F.lit(10000.0))


def with_cloud(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with `cloudy` from a mask (scene, mrow, mcol, opaque, cirrus) of three times their size."""
    flags = mask.groupBy("scene", "mrow", "mcol").agg((F.max(F.greatest(F.col("opaque").cast("int"), F.col("cirrus").cast("int"))) > 0).alias("cloudy"))
    keyed = pixels.withColumns({"mrow": F.expr("row div 3"), "mcol": F.expr("col div 3")})
    return keyed.join(flags, ["scene", "mrow", "mcol"], "left").withColumn("cloudy", F.coalesce("cloudy", F.lit(False))).drop("mrow", "mcol")


def _celled(pixels: DataFrame, cell: int) -> DataFrame:
    return pixels.withColumns({"gx": F.expr(f"col div {int(cell)}"), "gy": F.expr(f"row div {int(cell)}")})


def cells(pixels: DataFrame, cell: int = CELL, thresholds: dict | None = None) -> DataFrame:
    """(scene, gx, gy, cnt, cld, nd, ndc, skip, nbg, median, threshold) of each background cell.

    median is the upper median of the dim data pixels, by digital number; a cell
    under too much cloud, or with under ten of them, has none, and no threshold
    that a pixel could pass.
    """
    t = thresholds or params.DAY
    placed = _celled(pixels, cell)
    key = ["scene", "gx", "gy"]
    cloudy, void = F.col("cloudy"), F.col("b12") == 0
    count = lambda c: F.sum(c.cast("int")).cast("long")
    counts = placed.groupBy(*key).agg(F.count("*").alias("cnt"), count(cloudy).alias("cld"), count(void).alias("nd"), count(void & ~cloudy).alias("ndc"))
    # the dim pixels as a histogram, so that a cell's median costs a row per digital number
    dim = placed.where((F.col("b12") != 0) & (reflectance(F.col("b12")) < t["b12_min"])).groupBy(*key, "b12").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*key).orderBy("b12").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dim = dim.withColumns({"upto": F.sum("n").over(up), "nbg": F.sum("n").over(Window.partitionBy(*key))})
    median = dim.where("upto > nbg div 2").groupBy(*key).agg(F.max("nbg").alias("nbg"), F.min("b12").alias("med_dn"))
    out = counts.join(median, key, "left").withColumn("nbg", F.coalesce("nbg", F.lit(0).cast("long")))
    most = F.lit(t["max_cloud_local"]) * F.col("cnt")
    skip = F.col("cld") > most
    good = ~skip & (F.col("cld") + F.col("ndc") <= most) & (F.col("nbg") >= LEAST_BACKGROUND)
    med = F.when(good, reflectance(F.col("med_dn")))
    return out.select(*key, "cnt", "cld", "nd", "ndc", skip.alias("skip"), "nbg", med.alias("median"), F.when(med.isNotNull(), F.greatest(med, F.lit(t["background_floor"])) * t["contrast_ratio"]).otherwise(float("inf")).alias("threshold"))


def clear_share(cell_rows: DataFrame) -> DataFrame:
    """(scene, clear): clear data pixels of those with data; null without any. Cells under too much cloud count as having data."""
    nd, ndc = (F.sum(F.when(F.col("skip"), 0).otherwise(F.col(c))) for c in ("nd", "ndc"))
    seen = F.sum("cnt") - nd
    return cell_rows.groupBy("scene").agg(F.when(seen > 0, (F.sum("cnt") - F.sum("cld") - ndc) / seen).alias("clear"))


def squares(pixels: DataFrame, cell_rows: DataFrame, cell: int = CELL, square: int = SQUARE) -> DataFrame:
    """(scene, qx, qy, cloud): the obscured share of each square."""
    placed = _celled(pixels, cell).join(cell_rows.select("scene", "gx", "gy", "skip"), ["scene", "gx", "gy"])
    hidden = (F.col("skip") | F.col("cloudy") | (F.col("b12") == 0)).cast("int")
    return placed.groupBy("scene", F.expr(f"col div {int(square)}").alias("qx"), F.expr(f"row div {int(square)}").alias("qy")).agg(F.avg(hidden).alias("cloud"))


def candidates(pixels: DataFrame, cell_rows: DataFrame, cell: int = CELL, thresholds: dict | None = None) -> DataFrame:
    """Pixels over b12_min and their cell's threshold, with v (B12's reflectance) and the cell's median; of scenes that have a possible peak."""
    t = thresholds or params.DAY
    bright = pixels.where(reflectance(F.col("b12")) > t["b12_min"])
    placed = _celled(bright, cell).join(cell_rows.select("scene", "gx", "gy", "median", "threshold"), ["scene", "gx", "gy"])
    found = placed.withColumn("v", reflectance(F.col("b12"))).where("v > threshold")
    peaks = found.where(F.col("v") >= t["peak_b12_min"]).select("scene").distinct()
    return found.join(peaks, "scene", "left_semi").drop("gx", "gy", "threshold")


def _group(diagonal: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"], kind="stable").reset_index(drop=True)
        label = labelling.labels(frame["row"].to_numpy(), frame["col"].to_numpy(), diagonal)
        return frame.assign(comp_row=frame["row"].to_numpy()[label], comp_col=frame["col"].to_numpy()[label])

    return run


def grouped(found: DataFrame, diagonal: bool = False) -> DataFrame:
    """The pixels with (comp_row, comp_col), the first pixel in raster order of their group within the scene."""
    kind = labelling.labelled_schema(found.schema)
    return found.groupBy("scene").applyInPandas(_group(diagonal), kind)


def rings(found: DataFrame, pixels: DataFrame, band: str, name: str, reach: int = RING, chosen: DataFrame | None = None) -> DataFrame:
    """(scene, row, col, name): for the chosen candidates, the largest digital number of the band among the data pixels around that are no candidates, 0 without any."""
    centres = (chosen if chosen is not None else found).select("scene", "row", "col")
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    around = centres.withColumn("o", F.explode(offsets)).select("scene", F.col("row").alias("c_row"), F.col("col").alias("c_col"), (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    around = around.join(found.select("scene", "row", "col"), ["scene", "row", "col"], "left_anti")
    met = around.join(pixels.select("scene", "row", "col", F.col(band).alias("dn")), ["scene", "row", "col"])
    best = met.groupBy("scene", "c_row", "c_col").agg(F.max("dn").alias(name)).toDF("scene", "row", "col", name)
    return centres.join(best, ["scene", "row", "col"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def _scene_detections(frame: pd.DataFrame, t: dict[str, float]) -> pd.DataFrame:
    """The detections among a scene's masked pixels (already grouped, with their rings)."""
    out = []
    for _, group in frame.sort_values(["row", "col"], kind="stable").groupby(["comp_row", "comp_col"], sort=True):
        v, row, col = group["v"].to_numpy(), group["row"].to_numpy(), group["col"].to_numpy()
        n, k = len(v), int(v.argmax())  # the first of equals
        p, avg = float(v[k]), float(v.sum() / n)
        if n > t["max_pixels"] or p < t["peak_b12_min"] or (n > t["large_pixels"] and p < t["large_b12_min"]):
            continue
        if (n > 1 and p < t["peakedness_min"] * avg and avg < t["saturation"]) or (n == 1 and p < t["single_pixel_min"]):
            continue
        one = group.iloc[k]
        if one["n8a"] - one["ring8a"] >= t["nir_excess"] * (p - one["ring12"]):
            continue
        inside = labelling.core(row, col, v, k, max(p * t["warm_fraction"], t["hot_floor"]))
        if len(inside) > t["warm_max_pixels"]:
            continue
        a = float(one["n11"])
        out.append({
            "scene": one["scene"], "row": int(row[k]), "col": int(col[k]), "max_b12": p, "avg_b12": avg, "peak_b11": a, "ratio": p / a if a > 1e-6 else float("inf"), "peakedness": p / avg,
            "pixels": len(inside), "radiance": float(np.maximum(v[inside] - float(one["median"]), 0).sum()), "saturated": bool(p >= t["saturation"]),
            "px": [{"row": int(r), "col": int(c), "b12": float(x)} for r, c, x in zip(row[inside], col[inside], v[inside], strict=True)],
        })
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _DETECTION.replace("px array<struct<row:int,col:int,b12:double>>", "px x").split(", ")])


_DETECTION = "scene long, row int, col int, max_b12 double, avg_b12 double, peak_b11 double, ratio double, peakedness double, pixels int, radiance double, saturated boolean, px array<struct<row:int,col:int,b12:double>>"


def selected(found: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Candidates after the B11 gate, in groups with a peak that passes it."""
    t = thresholds or params.DAY
    group = Window.partitionBy("scene", "comp_row", "comp_col")
    hot = F.col("v") >= t["peak_b12_min"]
    n11 = reflectance(F.col("b11"))
    first = grouped(found).withColumn("n11", n11).withColumn("peak", F.max(hot & (n11 > t["b11_min"])).over(group))
    return first.where(F.col("peak") & (F.col("n11") > t["b11_min"])).drop("peak", "comp_row", "comp_col")


def detections(pixels: DataFrame, cell: int = CELL, thresholds: dict | None = None, cell_rows: DataFrame | None = None) -> DataFrame:
    """One row per hot spot, as in _DETECTION; pixels counts the hot core, avg_b12 is over the whole group.

    Scenes are told apart by a whole number or a text in `scene`.
    """
    t = thresholds or params.DAY
    cell_rows = cell_rows if cell_rows is not None else cells(pixels, cell, t)
    found = candidates(pixels, cell_rows, cell, t)
    chosen = selected(found, t)
    b11, b12, n8a = F.col("n11"), F.col("v"), reflectance(F.col("b8a"))
    masked = chosen.withColumn("n8a", n8a).where((b11 > t["saturation"]) | (b12 > t["saturation"]) | ((b11 + F.col("n8a") > 0.01) & (b11 > F.col("n8a"))))
    masked = grouped(masked)
    key = ["scene", "row", "col"]
    for band, name in (("b12", "ring12"), ("b8a", "ring8a")):
        masked = masked.join(rings(found, pixels, band, name, chosen=masked), key).withColumn(name, reflectance(F.col(name)))
    schema = _DETECTION.replace("scene long", f"scene {pixels.schema['scene'].dataType.simpleString()}")
    return masked.groupBy("scene").applyInPandas(lambda frame: _scene_detections(frame, t), schema)


def in_metres(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """x, y of the peak's centre and of each core pixel's, for scenes (scene, ox, oy, res); of scenes with sx, sy, only hot spots of their own square."""
    out = found.join(scenes, "scene")
    out = out.withColumns({"x": F.expr("ox + (col + 0.5D) * res"), "y": F.expr("oy - (row + 0.5D) * res"), "px": F.expr("transform(px, p -> named_struct('x', ox + (p.col + 0.5D) * res, 'y', oy - (p.row + 0.5D) * res, 'b12', p.b12))")})
    return out.where("x >= sx and x < sx + 100000 and y > sy - 100000 and y <= sy") if {"sx", "sy"} <= set(scenes.columns) else out
