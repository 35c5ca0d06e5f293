"""What a request is answered with: looks, spots, sites, and their GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.functions.stages import applied
from emberline.operators.linkage import brightest

#: How far past the box spots reach, in degrees of latitude, so that every link to the box's sites is seen.
MARGIN = {"s2": 0.005, "s3": 0.01}


def day_looks(scenes: DataFrame, need: DataFrame, squares: DataFrame, errors: DataFrame) -> DataFrame:
    """(scene, datetime, tile, error, cloud) of the scenes needed (with box x0, y0, x1, y1): the mean obscured share of the squares (scene, x, y, cloud) in the box, -1 without any."""
    wanted = scenes.join(need.select("scene").distinct(), "scene", "left_semi")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    share = wanted.join(squares, "scene").where(inside).groupBy("scene").agg(F.avg("cloud").alias("cloud"))
    out = wanted.join(share, "scene", "left").join(errors.groupBy("scene").agg(F.min("error").alias("error")), "scene", "left")
    return out.select("scene", "datetime", "tile", "error", F.coalesce("cloud", F.lit(-1.0)).alias("cloud"))


def spots(found: DataFrame, box: tuple[float, float, float, float], margin: float) -> DataFrame:
    """Hot spots within the margin of the box, each once."""
    return found.where(geo.near(F.col("lon"), F.col("lat"), box, margin)).distinct()


def night_looks(granules: DataFrame, need: DataFrame, cells: DataFrame, errors: DataFrame, sza_min: float = 90.0) -> DataFrame:
    """(granule, datetime, error, sza, clear) of granules needed: clear weighted by pixels. A granule by day, or without pixels in the box, is no look unless its read failed."""
    wanted = granules.join(need.select("granule").distinct(), "granule", "left_semi")
    sums = cells.groupBy("granule").agg(F.max("sza").alias("sza"), F.sum("pixels").alias("pixels"), F.try_divide(F.sum(F.col("pixels") * F.col("clear")), F.sum("pixels")).alias("clear"))
    out = wanted.join(sums, "granule", "left").join(errors.groupBy("granule").agg(F.min("error").alias("error")), "granule", "left")
    return out.where(F.col("error").isNotNull() | ((F.col("sza") >= sza_min) & (F.col("pixels") > 0))).select("granule", "datetime", "error", "sza", "clear")


def brightest_pixel(px: Column) -> Column:
    """The first of the outlines (arrays of heat, lon, lat × 4) with the most heat, null heat as 0."""
    heat = F.transform(px, lambda q: F.coalesce(F.get(q, F.lit(0)), F.lit(0.0)))
    return F.get(px, (F.array_position(heat, F.array_max(heat)) - 1).cast("int"))


def recentred(outline: Column, rh: Column, lon: Column, lat: Column) -> Column:
    """An outline moved so that its four corners centre on a place: [[rh, lon, lat × 4]] to 6 decimals."""
    def middle(first: int) -> Column:
        return sum((F.get(outline, F.lit(first + 2 * k)) for k in range(1, 4)), F.get(outline, F.lit(first))) / 4

    moved = F.transform(F.slice(outline, 2, 8), lambda v, k: F.round(v + F.when(k % 2 == 0, lon - middle(1)).otherwise(lat - middle(2)), 6))
    return F.array(F.concat(F.array(rh), moved))


def placed(hotspots: DataFrame) -> DataFrame:
    """Night hot spots (granule, track, lon, lat, rh, px) with their corrected place and their brightest pixel's outline around it."""
    lon, lat = geo.corrected(F.col("granule"), F.col("track"), F.col("lon"), F.col("lat"))
    out = hotspots.withColumns({"lon_": lon, "lat_": lat})
    out = out.withColumn("px", recentred(brightest_pixel(F.col("px")), F.col("rh"), F.col("lon_"), F.col("lat_")))
    return out.withColumns({"lon": F.col("lon_"), "lat": F.col("lat_")}).drop("lon_", "lat_")


def corners(df: DataFrame, x: str = "x", y: str = "y", half: float = 10.0) -> DataFrame:
    """lon0, lat0 … lon3, lat3 of a square of 2 × half metres around a place in a zone (zone, south)."""
    for k, (dx, dy) in enumerate(((-half, -half), (half, -half), (half, half), (-half, half))):
        df = applied(df, geo.utm_inverse(f"({x} + {dx}D)", f"({y} + {dy}D)", "zone", "south", f"lon{k}", f"lat{k}"), [f"lon{k}", f"lat{k}"])
    return df


def _collection(features: DataFrame, order: list[Column]) -> DataFrame:
    """(geojson): one row, the features' texts in order."""
    rows = features.select(F.struct(*order, F.col("f")).alias("r"))
    # an answer is one text, so its features meet in one place; a request's box bounds them
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.f), ","), F.lit("]}")).alias("geojson"))


def _feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def _newest_first(t: str) -> Column:
    return (-F.unix_micros(F.col(t).cast("timestamp"))).alias("t")


# The properties of the public answers, in order.
DAY_HOTSPOT = ["date", "scene", "lon", "lat", "max_b12", "avg_b12", "peak_b11", "ratio", "peakedness", "pixels", "radiance", "saturated"]
NIGHT_HOTSPOT = ["date", "datetime", "granule", "lon", "lat", "rh", "temperature", "pixels", "s5", "s6", "confirmed", "saturated"]


def _properties(kind: Column, names: list[str], *more: Column) -> Column:
    def one(c: str) -> Column:
        value = F.col(c)
        return F.least(value, F.lit(1e308)).alias(c) if c == "ratio" else (F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "datetime" else value.alias(c))

    return F.struct(kind.alias("kind"), *map(one, names), *more)


def hotspots_geojson(found: DataFrame, looks: DataFrame, box: tuple[float, float, float, float], kind: str) -> DataFrame:
    """A feature collection, newest first; of a time, looks before hot spots. Day hot spots carry `polygons` (arrays of corners) and `pixel_b12`."""
    w, s, e, n = box
    inside = found.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))
    if kind == "s2":
        geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("polygons", lambda p: F.array(p)).alias("coordinates"))
        spot = _feature(geometry, _properties(F.lit("hotspot"), DAY_HOTSPOT, F.col("pixel_b12")))
        look_names = ["date", "scene", "tile", "cloud", "error"]
    else:
        spot = _feature(_point(F.col("lon"), F.col("lat")), _properties(F.lit("hotspot"), NIGHT_HOTSPOT))
        look_names = ["date", "datetime", "granule", "clear", "sza", "error"]
    look = _feature(F.lit(None).cast("string"), _properties(F.when(F.col("error").isNull(), "look").otherwise("error"), look_names))
    rows = inside.select(_newest_first("datetime"), F.lit(1).alias("k"), spot.alias("f")).unionByName(looks.select(_newest_first("datetime"), F.lit(0).alias("k"), look.alias("f")))
    return _collection(rows, [F.col("t"), F.col("k")])


def sites_geojson(sites: DataFrame, detections: DataFrame, looks: DataFrame, names: list[str], value: str, tie: str, rounded: int | None = None) -> DataFrame:
    """A feature per site (site, id, lon, lat) with a detection: its looks [[date, cloud], …] and each date's brightest detection."""
    best = brightest(detections, ["site", "date"], value, tie)
    one = F.struct(F.col("date"), *[F.col(c) for c in names if c != "date"])
    listed = best.groupBy("site").agg(F.array_sort(F.collect_list(one)).alias("detections"))
    cloud = F.round("cloud", rounded) if rounded is not None else F.col("cloud")
    pair = F.struct(F.col("date").cast("string").alias("d"), F.format_string("[\"%s\",%s]", F.col("date").cast("string"), cloud.cast("string")).alias("x"))
    seen = looks.groupBy("site").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p.x), ","), F.lit("]")).alias("looks"))
    rows = sites.join(listed, "site").join(seen, "site", "left")
    body = F.to_json(F.struct("id"), {"ignoreNullFields": "false"})
    props = F.concat(
        F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"looks":'), F.coalesce("looks", F.lit("[]")), F.lit(',"detections":'), F.to_json("detections", {"ignoreNullFields": "false"}),
        F.lit(',"detection_count":'), F.size("detections").cast("string"), F.lit("}"),
    )
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.to_json(_point(F.col("lon"), F.col("lat"))), F.lit(',"properties":'), props, F.lit("}"))
    return _collection(rows.withColumn("body", body).select(text.alias("f")), [])


def site_names(places: DataFrame, prefix: str) -> DataFrame:
    """id of sites by their place: prefix:lat,lon to five decimals."""
    return places.withColumn("id", F.format_string(f"{prefix}:%.5f,%.5f", "lat", "lon"))
