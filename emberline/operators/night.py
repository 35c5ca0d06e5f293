"""The night detector: hot spots in two short-wave bands, their temperature and radiant heat.

Pixels are rows (granule, row, col, s5, s6, flag5, cloud, lon, lat) with the
radiances null where there is no value. Band thresholds come from histograms of
the raw numbers; clusters of hot pixels are formed per granule.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import params

from . import labelling

SATURATED, ABSENT = 16, 2
#: Wavelengths of the two bands in µm.
L5, L6 = 1.613, 2.256
#: Fixed values of Planck's law in W m-2 sr-1 µm-1, of Stefan and Boltzmann, and a pixel's area in m².
C1, C2, SIGMA, AREA = 1.191042e8, 1.4387752e4, 5.670374e-8, 2.5e5
BISECTIONS = 40


def unpacked(raw: Column, scale: float, offset: float, fill: int) -> Column:
    return F.when(raw != fill, (raw * F.lit(scale) + F.lit(offset)).cast("float"))


def band_thresholds(histogram: DataFrame, cells: int, key: list[str], top: int = 65535) -> DataFrame:
    """(key..., threshold) of a histogram (key..., dn, n): the first of the levels above the commonest that no pixel holds, as many in a row as the share of the scene read asks for.

    `cells` is the number of pixels of the whole scene. Of equally common levels the
    lowest counts; without a gap the threshold is the top level, so nothing is hot.
    """
    up = Window.partitionBy(*key).orderBy("dn")
    whole = Window.partitionBy(*key)
    rows = histogram.where("n > 0").withColumns({"total": F.sum("n").over(whole), "next": F.lead("dn").over(up), "mode": F.max_by("dn", F.struct(F.col("n"), -F.col("dn"))).over(whole)})
    rows = rows.withColumn("gap", F.ceil(F.lit(float(cells)) / F.greatest(F.col("total"), F.lit(1))))
    free = F.coalesce(F.col("next"), F.lit(top + 1)) - F.col("dn") - 1
    found = rows.where((F.col("dn") >= F.col("mode")) & (free >= F.col("gap"))).groupBy(*key).agg(F.min("dn").alias("dn"))
    return rows.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce(F.col("dn") + 1, F.lit(top)).alias("threshold"))


def planck(length: float, kelvin: Column) -> Column:
    return F.lit(C1 / length**5) / F.expm1(F.lit(C2 / length) / kelvin)


def expected(kelvin: Column) -> Column:
    """The bands' ratio at a temperature, null where that is too low for either."""
    return F.try_divide(planck(L5, kelvin), planck(L6, kelvin))


def temperature(ratio: Column, t_min: float = 500.0, t_max: float = 5000.0) -> Column:
    """The temperature at which the bands' Planck radiances have this ratio, by bisection; null outside the limits."""
    inside = (ratio > expected(F.lit(t_min))) & (ratio < expected(F.lit(t_max)))

    def halve(a: Column, _: Column) -> Column:
        middle = (a["lo"] + a["hi"]) / 2
        low = expected(middle) < ratio
        return F.struct(F.when(low, middle).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(middle).alias("hi"), middle.alias("t"))

    start = F.struct(F.lit(t_min).alias("lo"), F.lit(t_max).alias("hi"), F.lit(None).cast("double").alias("t"))
    return F.when(inside, F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)["t"])


def radiant_heat(kelvin: Column, sum6: Column) -> Column:
    """Megawatts of a fire at a temperature whose excess in the longer band is `sum6`."""
    return F.lit(SIGMA) * F.pow(kelvin, F.lit(4)) * sum6 / planck(L6, kelvin) * F.lit(AREA) / F.lit(1e6)


def hot_pixels(pixels: DataFrame, limits: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Pixels whose S5 is over the granule's threshold, or saturated, and that are not absent."""
    joined = pixels.join(limits.select("granule", F.col("threshold").alias("th5")), "granule")
    over = F.coalesce(F.col("s5") > F.col("th5") * scale + offset, F.lit(False)) | (F.col("flag5").bitwiseAND(SATURATED) != 0)
    return joined.where((F.col("flag5").bitwiseAND(ABSENT) == 0) & over).drop("th5")


def clear_share(pixels: DataFrame, hot: DataFrame, bits: int) -> DataFrame:
    """(granule, pixels, clear): of the pixels with a value that are not hot, the share without a cloud test fired."""
    rest = pixels.where((F.col("flag5").bitwiseAND(ABSENT) == 0) & F.col("s5").isNotNull() & ~F.isnan("s5")).join(hot.select("granule", "row", "col"), ["granule", "row", "col"], "left_anti")
    return rest.groupBy("granule").agg(F.count("*").alias("pixels"), F.avg((F.col("cloud").bitwiseAND(bits) == 0).cast("int")).alias("clear"))


def squares(pixels: DataFrame, hot: DataFrame, bits: int, size: float = 0.02) -> DataFrame:
    """(granule, qx, qy, pixels, clear) on a grid of `size` degrees, of the same pixels."""
    rest = pixels.where((F.col("flag5").bitwiseAND(ABSENT) == 0) & F.col("s5").isNotNull()).join(hot.select("granule", "row", "col"), ["granule", "row", "col"], "left_anti")
    grid = [F.floor(F.col(c) / size).cast("long").alias(q) for c, q in (("lon", "qx"), ("lat", "qy"))]
    return rest.groupBy("granule", *grid).agg(F.count("*").alias("pixels"), F.avg((F.col("cloud").bitwiseAND(bits) == 0).cast("int")).alias("clear"))


def clusters(hot: DataFrame) -> DataFrame:
    """The hot pixels with (comp_row, comp_col) of their cluster; diagonal neighbours touch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"], kind="stable").reset_index(drop=True)
        label = labelling.labels(frame["row"].to_numpy(), frame["col"].to_numpy(), True)
        return frame.assign(comp_row=frame["row"].to_numpy()[label], comp_col=frame["col"].to_numpy()[label])

    return hot.groupBy("granule").applyInPandas(run, labelling.labelled_schema(hot.schema))


CLUSTER = ["granule", "comp_row", "comp_col"]


def confirmed(grouped: DataFrame, pixels: DataFrame, limits6: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(cluster, confirmed): a saturated pixel, or S6 over its threshold within a pixel of the cluster."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = grouped.select(*CLUSTER, "flag5", "row", "col", F.explode(around).alias("o"))
    near = near.select(*CLUSTER, "flag5", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    six = pixels.select("granule", "row", "col", "s6").join(limits6.select("granule", F.col("threshold").alias("th6")), "granule")
    hot6 = six.select("granule", "row", "col", F.coalesce(F.col("s6") > F.col("th6") * scale + offset, F.lit(False)).alias("hot6"))
    met = near.join(hot6, ["granule", "row", "col"], "left")
    return met.groupBy(*CLUSTER).agg(F.bool_or(F.coalesce("hot6", F.lit(False)) | (F.col("flag5").bitwiseAND(SATURATED) != 0)).alias("confirmed"))


def confirmed_thermal(grouped: DataFrame, thermal: DataFrame, th7: float, th1: float, to_f: Column | int = 0, to_an: Column | int = 0) -> DataFrame:
    """(cluster, thermal): the mid-infrared under the cluster is hot, at two pixels' steps around each pixel.

    thermal is (granule, krow, kcol, s7, f1) on the 1 km grid; S7 counts where it is
    under 306 K, its linear range, else F1 within 300 to 480 K.
    """
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-2, 0, 2) for j in (-2, 0, 2)))
    near = grouped.select(*CLUSTER, "row", "col", F.explode(steps).alias("o"))
    a, f = (x if isinstance(x, Column) else F.lit(x) for x in (to_an, to_f))
    near = near.select(*CLUSTER, F.floor((F.col("row") + F.col("o.i")) / 2).alias("krow"), (f - F.floor((a - (F.col("col") + F.col("o.j")) + 1) / 2)).alias("kcol"))
    met = near.join(thermal, ["granule", "krow", "kcol"], "left")
    hot = F.when(F.col("s7") < 306, F.col("s7") > th7).otherwise((F.col("f1") > th1) & F.col("f1").between(300, 480))
    return met.groupBy(*CLUSTER).agg(F.bool_or(F.coalesce(hot, F.lit(False))).alias("thermal"))


def thermal_hot(pixels: DataFrame) -> DataFrame:
    """(granule, row, col) of pixels (…, s7, f1, th7, th1) under which the mid-infrared is hot: S7 over its threshold where it is under 306 K, its linear range, else F1 over its own and within 300 to 480 K."""
    hot = F.when(F.col("s7") < 306, F.col("s7") > F.col("th7")).otherwise((F.col("f1") > F.col("th1")) & F.col("f1").between(300, 480))
    return pixels.where(hot).select("granule", "row", "col")


def confirmed_near(grouped: DataFrame, hot: DataFrame) -> DataFrame:
    """The clusters with a pixel of thermal_hot() at two pixels' steps around one of theirs; a kilometre's value stands under each of its four pixels."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-2, 0, 2) for j in (-2, 0, 2)))
    near = grouped.select(*CLUSTER, "row", "col", F.explode(steps).alias("o"))
    near = near.select(*CLUSTER, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return near.join(hot, ["granule", "row", "col"], "left_semi").select(*CLUSTER).distinct()


def background(grouped: DataFrame, pixels: DataFrame, wide: int = 2) -> DataFrame:
    """(cluster, bg5, bg6): upper medians of the values in the frame `wide` pixels around the cluster's bounding box."""
    box = grouped.groupBy(*CLUSTER).agg(F.min("row").alias("i0"), F.max("row").alias("i1"), F.min("col").alias("j0"), F.max("col").alias("j1"))
    area = box.withColumn("row", F.explode(F.sequence(F.col("i0") - wide, F.col("i1") + wide))).withColumn("col", F.explode(F.sequence(F.col("j0") - wide, F.col("j1") + wide)))
    frame = area.where("not (row between i0 and i1 and col between j0 and j1)").join(pixels.select("granule", "row", "col", "s5", "s6"), ["granule", "row", "col"])

    def upper(c: str) -> Column:
        good = F.array_sort(F.collect_list(F.when(~F.isnan(c), F.col(c))))  # a frame is a few pixels around a cluster
        return F.get(good, F.floor(F.size(good) / 2).cast("int")).alias("bg" + c[-1])

    return box.select(*CLUSTER).join(frame.groupBy(*CLUSTER).agg(upper("s5"), upper("s6")), CLUSTER, "left")


def detections(pixels: DataFrame, limits5: DataFrame, limits6: DataFrame, thresholds: dict | None = None, box: tuple[float, float, float, float] | None = None, thermal: DataFrame | None = None, th7: float = float("inf"), th1: float = float("inf"), track: float = 0.0) -> DataFrame:
    """(cluster, lon, lat, pixels, s5, s6, temperature, rh, confirmed, saturated, track) of each cluster with a temperature, or saturated.

    The place is the mean of the pixels' own, weighted by S5; it must be in the box
    (w, s, e, n), which may cross the antimeridian and holds its west and south edge.

    Where the pixels have the mid-infrared (s7, f1, with th7 and th1) it confirms
    clusters too. Where hot pixels have their `corners`, the result has px, an array
    of (heat, corners): a pixel's share of the radiant heat, by its excess in S6.
    """
    t = thresholds or params.NIGHT
    hot = hot_pixels(pixels, limits5)
    grouped = clusters(hot)
    sure = confirmed(grouped, pixels, limits6)
    if "s7" in pixels.columns:
        warm = confirmed_near(grouped, thermal_hot(pixels)).withColumn("warm", F.lit(True))
        sure = sure.join(warm, CLUSTER, "left").select(*CLUSTER, (F.col("confirmed") | F.col("warm").isNotNull()).alias("confirmed"))
    if thermal is not None:
        sure = sure.join(confirmed_thermal(grouped, thermal, th7, th1), CLUSTER).select(*CLUSTER, (F.col("confirmed") | F.col("thermal")).alias("confirmed"))
    first = Window.partitionBy(*CLUSTER).orderBy("row", "col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.coalesce(F.greatest(F.when(~F.isnan("s5"), F.col("s5")), F.lit(0.0)), F.lit(0.0)).cast("double") + 1e-9
    rows = grouped.join(background(grouped, pixels), CLUSTER).withColumns({"w": weight, "o": F.first("lon", ignorenulls=True).over(first)})
    turn = F.col("lon") - F.col("o") - 360 * F.round((F.col("lon") - F.col("o")) / 360)
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()

    def excess(c: str, bg: str, gain: float) -> Column:
        return (F.sum(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c).cast("double") - F.col(bg))) * gain).alias(c)

    over6 = F.when(F.col("s6").isNotNull() & ~F.isnan("s6"), F.col("s6").cast("double") - F.col("bg6")).otherwise(0.0) * t["s6_gain"]
    outlined = [F.array_sort(F.collect_list(F.struct("row", "col", over6.alias("more"), "corners"))).alias("px_")] if "corners" in pixels.columns else []
    sums = rows.groupBy(*CLUSTER).agg(
        F.count("*").cast("int").alias("pixels"), (F.max(F.col("flag5").bitwiseAND(SATURATED)) != 0).alias("saturated"),
        excess("s5", "bg5", t["s5_gain"]), excess("s6", "bg6", t["s6_gain"]),
        F.try_divide(F.sum(F.when(placed, F.col("w") * turn)), F.sum(F.when(placed, F.col("w")))).alias("dlon"), F.first("o").alias("o"),
        F.try_divide(F.sum(F.when(placed, F.col("w") * F.col("lat"))), F.sum(F.when(placed, F.col("w")))).alias("lat"),
        (F.sum(F.col("w") * F.col("col")) / F.sum("w") - track).alias("track"), *outlined,
    )
    wrapped = F.pmod(F.col("dlon") + F.col("o") + 540, F.lit(360.0)) - 180
    out = sums.withColumn("lon", wrapped)
    if box is not None:
        w, s, e, n = box
        across = ((F.col("lon") >= w) & (F.col("lon") < e)) if e > w else ((F.col("lon") >= w) | (F.col("lon") < e))
        out = out.where(across & (F.col("lat") >= s) & (F.col("lat") < n))
    kelvin = F.when(~F.col("saturated") & (F.col("s6") > 0), temperature(F.try_divide(F.col("s5"), F.col("s6")), t["t_min"], t["t_max"]))
    out = out.withColumn("temperature", kelvin).where(F.col("saturated") | F.col("temperature").isNotNull())
    out = out.withColumn("rh", radiant_heat(F.col("temperature"), F.col("s6")))
    px = [F.transform("px_", lambda p: F.struct((F.try_divide(p.more, F.col("s6")) * F.col("rh")).alias("heat"), p.corners.alias("corners"))).alias("px")] if outlined else []
    return out.join(sure, CLUSTER).select(*CLUSTER, "lon", "lat", "pixels", "s5", "s6", "temperature", "rh", "confirmed", "saturated", "track", *px)


def flares(hotspots: DataFrame, t_min: float = 1500.0, least_passes: int = 5, cell: float = 0.025) -> DataFrame:
    """Cells that stay hot: hot spots (granule, lon, lat, temperature, rh, confirmed) by cells of `cell` degrees, named by their centres, over t_min at the hottest and confirmed on more than least_passes passes of a platform's orbit."""
    centre = [F.round((F.floor(F.col(c) / cell) + 0.5) * cell, 4).alias(c) for c in ("lon", "lat")]
    orbit = F.concat(F.substring("granule", 1, 3), F.substring("granule", 70, 7))
    out = hotspots.groupBy(*centre).agg(F.count_distinct(F.when(F.col("confirmed"), orbit)).alias("passes"), F.count("*").alias("hotspots"), F.max("temperature").alias("max_temperature"), F.median("rh").alias("median_rh"))
    return out.where((F.col("max_temperature") > t_min) & (F.col("passes") > least_passes))
