"""Detection from requests: a row per scene and box in, a row with clear share, error, hot spots and squares out.

Rasters come from a reader that the caller names; it runs on the executors, once
per scene however many boxes ask for it, and gives a window's arrays. A read that
fails becomes the row's error and never fails the query.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import params
from emberline.functions import geo
from emberline.functions.stages import applied
from emberline.operators import day, night
from emberline.sources import granule

HOTSPOT = "x double, y double, max_b12 double, avg_b12 double, peak_b11 double, ratio double, peakedness double, pixels int, radiance double, saturated boolean, px array<struct<x:double,y:double,b12:double>>"
_PIXEL = "request long, row int, col int, b12 int, b11 int, b8a int, cloudy boolean, ox double, oy double, res double, error string"


def box_error(w: float, s: float, e: float, n: float) -> str | None:
    if not all(map(math.isfinite, (w, s, e, n))):
        return "nonfinite box"
    return None if w < e and s < n else "empty box"


def window(xmin: float, ymin: float, xmax: float, ymax: float, ox: float, oy: float, res: float, width: int, height: int) -> tuple[int, int, int, int]:
    """Columns and rows (x0, y0, x1, y1) of a raster that a box in metres meets; empty where it misses it."""
    x0, x1 = max(0, math.floor((xmin - ox) / res)), min(width, math.ceil((xmax - ox) / res))
    y0, y1 = max(0, math.floor((oy - ymax) / res)), min(height, math.ceil((oy - ymin) / res))
    return x0, y0, x1, y1


def day_detect(requests: DataFrame, read: Callable[[str], dict], thresholds: str = "", cell: int = day.CELL, square: int = day.SQUARE) -> DataFrame:
    """(request columns, clear, error, hotspots, cells) of requests (scene, xmin, ymin, xmax, ymax).

    `read(scene)` gives ox, oy, res, b12, b11 and b8a (rows x columns) and cloudy
    (the same, or a third of the size), or raises. A row with a null among its five
    arguments gives nulls; thresholds that cannot be taken give every other row
    their error.
    """
    try:
        t, refused = params.day_thresholds(thresholds), None
    except params.ThresholdError as e:
        t, refused = params.DAY, str(e)
    numbered = requests.withColumn("request", F.monotonically_increasing_id())
    from emberline.session import stored

    numbered = stored(numbered, "requests")  # the numbers must stay as they are
    five = ["scene", "xmin", "ymin", "xmax", "ymax"]
    whole = numbered.where(" and ".join(f"{c} is not null" for c in five)).select("request", *five)

    def one(scene: str, rasters: dict | None, error: str | None, row) -> pd.DataFrame:
        error = box_error(row.xmin, row.ymin, row.xmax, row.ymax) or refused or error
        blank = {c.split()[0]: [None] for c in _PIXEL.split(", ")}
        if error:
            return pd.DataFrame({**blank, "request": [row.request], "error": [error]})
        height, width = rasters["b12"].shape
        x0, y0, x1, y1 = window(row.xmin, row.ymin, row.xmax, row.ymax, rasters["ox"], rasters["oy"], rasters["res"], width, height)
        if x1 <= x0 or y1 <= y0:
            return pd.DataFrame({**blank, "request": [row.request]})
        r, c = (a.ravel() for a in np.mgrid[y0:y1, x0:x1])
        cloud = rasters["cloudy"]
        cloudy = cloud[r, c] if cloud.shape == rasters["b12"].shape else cloud[r // 3, c // 3]
        bands = {b: rasters[b][y0:y1, x0:x1].ravel().astype(np.int32) for b in ("b12", "b11", "b8a")}
        return pd.DataFrame({"request": row.request, "row": r.astype(np.int32), "col": c.astype(np.int32), **bands, "cloudy": cloudy.astype(bool), "ox": rasters["ox"], "oy": rasters["oy"], "res": rasters["res"], "error": None})

    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in (c.split() for c in _PIXEL.split(", "))])

    def load(table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        scene, rasters, error = rows["scene"].iloc[0], None, None
        try:
            rasters = read(scene)
        except Exception as e:  # an error is an answer here
            error = str(e) or type(e).__name__
        return pa.concat_tables([pa.Table.from_pandas(one(scene, rasters, error, row), schema, preserve_index=False) for row in rows.itertuples()])

    pixels = stored(whole.groupBy("scene").applyInArrow(load, _PIXEL), "pixels")
    errors = pixels.where("error is not null").select("request", "error")
    seen = pixels.where("row is not null").withColumnRenamed("request", "scene")
    places = seen.select("scene", "ox", "oy", "res").distinct()
    rasters = seen.select("scene", "row", "col", "b12", "b11", "b8a", "cloudy")
    cell_rows = day.cells(rasters, cell, t)
    found = day.in_metres(day.detections(rasters, cell, t, cell_rows), places)
    names = [c.strip().split(" ")[0] for c in HOTSPOT.split(", ")]
    spots = found.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct(F.col("row"), F.col("col"), F.struct(*names).alias("h")))).alias("h")).select("scene", F.transform("h", lambda h: h.h).alias("hotspots"))
    sub = day.squares(rasters, cell_rows, cell, square).join(places, "scene")
    centre = F.struct(F.expr(f"ox + (qx * {square} + {square / 2}D) * res").alias("x"), F.expr(f"oy - (qy * {square} + {square / 2}D) * res").alias("y"), F.col("cloud"))
    cells = sub.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("qy", "qx", centre.alias("c")))).alias("c")).select("scene", F.transform("c", lambda c: c.c).alias("cells"))
    asked = whole.select("request").join(errors, "request", "left")
    answers = asked.join(day.clear_share(cell_rows).withColumnRenamed("scene", "request"), "request", "left").join(spots.withColumnRenamed("scene", "request"), "request", "left").join(cells.withColumnRenamed("scene", "request"), "request", "left")
    good = F.col("error").isNull()
    kinds = {"hotspots": spots.schema["hotspots"].dataType, "cells": cells.schema["cells"].dataType}
    answers = answers.select("request", "clear", "error", *[F.when(good, F.coalesce(c, F.array().cast(kinds[c]))).alias(c) for c in ("hotspots", "cells")])
    return numbered.join(answers, "request", "left").drop("request")


def sensing_time(name: str) -> datetime:
    """The middle of a granule's three minutes, from its name."""
    m = re.search(r"SL_1_RBT____(\d{8}T\d{6})_", name)
    if not m:
        raise ValueError("not an SL_1_RBT granule")
    return datetime.strptime(m[1], "%Y%m%dT%H%M%S").replace(tzinfo=timezone.utc) + timedelta(seconds=90)


NIGHT_HOTSPOT = ["lon", "lat", "pixels", "s5", "s6", "temperature", "rh", "confirmed", "saturated", "track", "px"]
_NIGHT = "request long, row int, col int, s5 float, s6 float, flag5 int, cloud int, lon double, lat double, th5 double, th6 double, s7 double, f1 double, th7 double, th1 double, track_offset double, corners array<double>, error string"


def night_detect(requests: DataFrame, read: Callable[[str], dict], thresholds: str = "") -> DataFrame:
    """(request columns, sza, clear, error, hotspots, squares) of requests (granule, w, s, e, n).

    `read(granule)` gives s5, s6, flag5, cloud, lon and lat (rows x columns) and the
    bands' thresholds th5 and th6, or raises. It may give s7 and f1 (the same shape)
    with th7 and th1, which confirm clusters; the track's column (track); and the tie
    grid (tie: lat, lon and two offsets), by which hot spots get their pixels'
    outlines. squares are of the thresholds' `square` degrees, named by their west
    and south edges; there are none if that is 0. A small box by day is not read. Rows
    of one granule are read together. Null arguments and refused thresholds are
    dealt with as in day_detect().
    """
    from emberline.session import stored

    try:
        t, refused = params.night_thresholds(thresholds), None
    except params.ThresholdError as e:
        t, refused = params.NIGHT, str(e)
    numbered = stored(requests.withColumn("request", F.monotonically_increasing_id()), "requests")
    five = ["granule", "w", "s", "e", "n"]
    whole = numbered.where(" and ".join(f"{c} is not null" for c in five)).select("request", *five)

    def checked(name: pd.Series, w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.DataFrame:
        said, seconds = [], []
        for g, a, b, c, d in zip(name, w, s, e, n, strict=True):
            error, at = refused, None
            if not all(map(math.isfinite, (a, b, c, d))):
                error = error or "nonfinite box"
            elif not (-180 <= a <= 180 and -180 <= c <= 180 and -90 <= b <= 90 and -90 <= d <= 90):
                error = error or "box outside lon/lat bounds"
            elif a == c or b >= d:
                error = error or "empty box"
            try:
                at = sensing_time(g).timestamp()
            except ValueError as x:
                error = error or str(x)
            said.append(error)
            seconds.append(at)
        return pd.DataFrame({"error": said, "at": seconds})

    check = F.pandas_udf(checked, "error string, at double")
    timed = whole.withColumn("c", check(*five)).select("*", F.col("c.error").alias("error"), F.col("c.at").alias("at")).drop("c")
    timed = timed.withColumns({"wide": F.expr("if(e > w, e - w, e - w + 360)"), "mid_lat": F.expr("(s + n) / 2")}).withColumn("mid_lon", F.expr("w + wide / 2"))
    timed = applied(timed, geo.zenith("at", "mid_lon", "mid_lat"), ["sza"])
    small = F.expr("wide < 10 and n - s < 10")
    timed = stored(timed.withColumn("by_day", F.col("error").isNull() & small & (F.col("sza") < t["sza_min"])), "timed")
    schema = pa.schema([(x, {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[k]) for x, k in (c.split() for c in _NIGHT.split(", "))])

    def load(table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        blank = {c.split()[0]: [None] for c in _NIGHT.split(", ")}
        try:
            g, error = read(rows["granule"].iloc[0]), None
        except Exception as e:  # an error is an answer here
            g, error = None, str(e) or type(e).__name__
        out = []
        for row in rows.itertuples():
            if error:
                out.append(pd.DataFrame({**blank, "request": [row.request], "error": [error]}))
                continue
            # the window holds the box and a margin of pixels for backgrounds and neighbours
            inside = (g["lat"] >= row.s) & (g["lat"] < row.n) & ((g["lon"] >= row.w) & (g["lon"] < row.e) if row.e > row.w else (g["lon"] >= row.w) | (g["lon"] < row.e))
            if not inside.any():
                continue
            r, c = np.nonzero(inside)
            r0, r1, c0, c1 = max(0, r.min() - 4), r.max() + 5, max(0, c.min() - 4), c.max() + 5
            part = {k: g[k][r0:r1, c0:c1] for k in ("s5", "s6", "flag5", "cloud", "lon", "lat")}
            rr, cc = (a.ravel().astype(np.int32) for a in np.mgrid[r0 : r0 + part["s5"].shape[0], c0 : c0 + part["s5"].shape[1]])
            flat = {k: v.ravel() for k, v in part.items()}
            for k in ("s7", "f1"):
                flat |= {k: g[k][r0:r1, c0:c1].ravel() if k in g else np.nan, "th" + k[1]: g.get("th" + k[1], np.inf)}
            corners = np.full(len(rr), None, object)
            hot = np.flatnonzero((flat["s5"] > g["th5"]) | (flat["flag5"] & night.SATURATED != 0)) if "tie" in g else []
            if len(hot):
                edges = granule.outlines(rr[hot], cc[hot], flat["lon"][hot], flat["lat"][hot], g["tie"])
                corners[hot] = pd.Series(edges.tolist()).to_numpy()
            out.append(pd.DataFrame({"request": row.request, "row": rr, "col": cc, **flat, "th5": g["th5"], "th6": g["th6"], "track_offset": float(g.get("track", 0.0)), "corners": corners, "error": None}))
        return pa.concat_tables([pa.Table.from_pandas(o, schema, preserve_index=False) for o in out]) if out else schema.empty_table()

    todo = timed.where("error is null and not by_day").select("request", *five)
    pixels = stored(todo.groupBy("granule").applyInArrow(load, _NIGHT), "pixels")
    seen = pixels.where("row is not null").withColumn("granule", F.col("request"))
    rasters = seen.select("granule", "row", "col", "s5", "s6", "flag5", "cloud", "lon", "lat", "s7", "f1", "th7", "th1", "corners")
    limits = [seen.select("granule", F.col(c).alias("threshold")).distinct() for c in ("th5", "th6")]
    hot = night.hot_pixels(rasters, limits[0])
    box = timed.select(F.col("request").alias("granule"), "w", "s", "e", "n")

    def inside(rows: DataFrame) -> DataFrame:
        return rows.join(box, "granule").where("lat >= s and lat < n and if(e > w, lon >= w and lon < e, lon >= w or lon < e)").drop("w", "s", "e", "n")

    clear = night.clear_share(inside(rasters), hot, int(t["cloud_bits"])).select(F.col("granule").alias("request"), "clear")
    offsets = seen.select("granule", "track_offset").distinct()
    found = inside(night.detections(rasters, *limits, t)).join(offsets, "granule").withColumn("track", F.col("track") - F.col("track_offset"))
    spots = found.groupBy("granule").agg(F.array_sort(F.collect_list(F.struct("comp_row", "comp_col", F.struct(*NIGHT_HOTSPOT).alias("h")))).alias("h"))
    spots = spots.select(F.col("granule").alias("request"), F.transform("h", lambda h: h.h).alias("hotspots"))
    side = t["square"]
    looked = night.squares(inside(rasters), hot, int(t["cloud_bits"]), side) if side > 0 else night.squares(inside(rasters), hot, 0, 1.0).where("false")
    square = F.struct(*[(F.col(q) * F.lit(side)).alias(c) for c, q in (("lon", "qx"), ("lat", "qy"))], "pixels", "clear")
    grid = looked.groupBy("granule").agg(F.array_sort(F.collect_list(F.struct("qy", "qx", square.alias("q")))).alias("q"))
    grid = grid.select(F.col("granule").alias("request"), F.transform("q", lambda q: q.q).alias("squares"))
    failed = pixels.where("error is not null").select("request", F.col("error").alias("failed"))
    answers = timed.select("request", "error", "sza").join(failed, "request", "left").join(clear, "request", "left").join(spots, "request", "left").join(grid, "request", "left")
    answers = answers.withColumn("error", F.coalesce("error", "failed"))
    kinds = {"hotspots": spots.schema["hotspots"].dataType, "squares": grid.schema["squares"].dataType}
    known = F.expr("sza is not null and not isnan(sza)")
    answers = answers.select("request", F.when(known, F.col("sza")).alias("sza"), "clear", "error", *[F.when(F.col("error").isNull(), F.coalesce(c, F.array().cast(k))).alias(c) for c, k in kinds.items()])
    return numbered.join(answers, "request", "left").drop("request")
