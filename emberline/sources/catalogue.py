"""Catalogue pages: searches, pages of features as rows, listings, addresses.

Fetching is a function of a URL, so that tests and offline use read files; a
failed fetch fails the query, and so does a page that came back full.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.scenes import day_step

# The public catalogue's address and collections.
SEARCH = "https://stac.dataspace.copernicus.eu/v1/search"
COLLECTIONS = {"s2": "sentinel-2-l1c", "s3": "sentinel-3-sl-1-rbt-ntc"}
FIELDS = {
    "s2": "id,properties.datetime,properties.eo:cloud_cover,assets.B12.href,assets.B12.proj:code,assets.B12.proj:bbox",
    "s3": "id,properties.datetime,properties.sat:orbit_state,assets.S5_radiance_an.href",
}
FULL = "a catalogue search came back full: ask for less"


def searches(kind: str, box: tuple[float, float, float, float], start: date, end: date, most_cloud: float = 100) -> list[str]:
    """Addresses of searches that together span the days, each for so many that a page is about half full."""
    step = day_step(*box, kind)
    bounds = ",".join(f"{x:g}" for x in box)
    out, day = [], start
    while day <= end:
        last = min(day + timedelta(days=step - 1), end)
        cloud = f"&filter-lang=cql2-text&filter=eo%3Acloud_cover%3C%3D{most_cloud:g}" if kind == "s2" and most_cloud < 100 else ""
        out.append(f"{SEARCH}?collections={COLLECTIONS[kind]}&limit=1000&bbox={bounds}&datetime={day}T00:00:00Z/{last}T23:59:59Z{cloud}&fields={FIELDS[kind]}")
        day += timedelta(days=step)
    return out


def web_address(url: str, endpoint: str = "") -> str:
    """https form of s3:// and gs:// addresses."""
    scheme, sep, rest = url.partition("://")
    if not sep or scheme not in ("s3", "gs"):
        return url
    bucket, _, key = rest.partition("/")
    host = "storage.googleapis.com" if scheme == "gs" else (endpoint or os.environ.get("AWS_S3_ENDPOINT", "s3.amazonaws.com"))
    return f"https://{host}/{bucket}/{key}"


def source_name() -> str:
    """Which mirror bands are read from: the one with keys if there are keys."""
    return "eodata" if os.environ.get("AWS_ACCESS_KEY_ID") else "gcp"


def waits(tries: int = 8, limited: bool = False) -> Iterator[float]:
    """Seconds before each further try: doubling to 32, or up to 60 where the server limits requests."""
    for k in range(tries - 1):
        yield min(60.0, 4.0 * 2**k) if limited else min(32.0, 2.0**k)


def fetch(url: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of an address, tried again on passing failures."""
    pause = waits()
    while True:
        try:
            with urllib.request.urlopen(web_address(url), timeout=60) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code not in (408, 429) and e.code < 500:
                raise
            wait = next(pause, None)
            if wait is None:
                raise
            sleep(60.0 if e.code == 429 else wait)
        except (urllib.error.URLError, TimeoutError):
            if str(url).startswith("file:") or (wait := next(pause, None)) is None:
                raise
            sleep(wait)


def pages(spark: SparkSession, urls: list[str], get: Callable[[str], str] = fetch) -> DataFrame:
    """(url, body): each address is fetched once, by the executors."""
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"url": frame["url"], "body": [get(u) for u in frame["url"]]})

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)), "url").mapInPandas(run, "url string, body string")


PAGE = """struct<features:array<struct<id:string,bbox:array<double>,properties:struct<datetime:string,`eo:cloud_cover`:double,`sat:orbit_state`:string>,
    assets:struct<B12:struct<href:string,`proj:code`:string,`proj:bbox`:array<double>>,S5_radiance_an:struct<href:string>>>>,links:array<struct<rel:string>>>"""


def features(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The pages' features, one row each; fails where a page has a next one."""
    page = bodies.select(F.from_json(F.col(body), PAGE.replace("\n", " ")).alias("p"))
    full = F.exists(F.coalesce("p.links", F.array()), lambda link: F.coalesce(link.rel == "next", F.lit(False)))
    checked = page.where(F.when(full, F.raise_error(F.lit(FULL)).cast("boolean")).otherwise(True))
    return checked.select(F.explode("p.features").alias("f")).select("f.*")


def day_scenes(bodies: DataFrame) -> DataFrame:
    """(id, datetime, cloud, tile, b12, crs, pb0..pb3) of pages of daytime scenes."""
    f = features(bodies)
    return f.select(
        "id", F.to_timestamp("properties.datetime").alias("datetime"), F.col("properties.`eo:cloud_cover`").alias("cloud"), F.substring(F.split_part("id", F.lit("_"), F.lit(6)), 2, 5).alias("tile"),
        F.col("assets.B12.href").alias("b12"), F.col("assets.B12.`proj:code`").alias("crs"), *[F.get("assets.B12.`proj:bbox`", F.lit(k)).alias(f"pb{k}") for k in range(4)],
    )


def night_granules(bodies: DataFrame, night: bool = True) -> DataFrame:
    """(id, datetime, orbit, dir) of pages of granules; by night those of ascending passes."""
    f = features(bodies)
    out = f.select("id", F.to_timestamp("properties.datetime").alias("datetime"), F.col("properties.`sat:orbit_state`").alias("orbit"), F.regexp_replace("assets.S5_radiance_an.href", "/S5_radiance_an\\.nc$", "").alias("dir"))
    return out.where("orbit = 'ascending'") if night else out


def granule_name(listing: Column) -> Column:
    """The granule's folder in a listing's text, empty without one."""
    return F.regexp_extract(listing, "/GRANULE/(L1C_[^/<]+)/", 1)


def listed_products(listing: DataFrame, known: DataFrame, line: str = "value") -> DataFrame:
    """(scene, tile, t) of product names in listing lines that the store lacks; baselines 04 to 09."""
    name = F.regexp_extract(line, r"(S2[A-D]_MSIL1C_[0-9T]+_N0[4-9][^/]*)", 1)
    rows = listing.select(F.regexp_replace(name, r"\.SAFE$", "").alias("scene")).where("scene <> ''").distinct()
    rows = rows.select("scene", F.substring(F.split_part("scene", F.lit("_"), F.lit(6)), 2, 5).alias("tile"), F.split_part("scene", F.lit("_"), F.lit(3)).alias("t"))
    return rows.join(known.select("scene"), "scene", "left_anti")


def listing_days(today: date, known: set[date], first: date = date(2022, 1, 25), again: int = 7) -> list[date]:
    """Days to list, newest first: those not known, and the last week always."""
    days = [today - timedelta(days=k) for k in range((today - first).days + 1)]
    return [d for d in days if d > today - timedelta(days=again) or d not in known]


def seeds(points: DataFrame) -> DataFrame:
    """(lon, lat) means of each degree square between 84° south and north, most points first.

    Means are of decimals, so that they do not depend on the order of the points, and halves are rounded away from zero.
    """
    mean = lambda c: F.round(F.avg(F.col(c).try_cast("decimal(28,12)")), 3).cast("double").alias(c)
    at = points.where(F.col("lat").between(-84, 84)).groupBy(F.floor("lon").alias("x"), F.floor("lat").alias("y")).agg(mean("lon"), mean("lat"), F.count("*").alias("n"))
    return at.orderBy(F.desc("n"), "x", "y").select("lon", "lat")



def scene_refused(b12: Column) -> Column:
    """Why a scene cannot be read by the address of its B12, or null: its levels are known from baseline 4.00 on, and the other files are found by the layout of a SAFE folder."""
    baseline = F.regexp_extract(b12, r"_N(\d{1,4})", 1)
    old = (baseline == "") | (baseline.try_cast("int") < 400)
    return F.when(b12.isNotNull() & old, "needs baseline N0400 or later").when(b12.isNotNull() & ~b12.rlike(r"/IMG_DATA/[^/]*B12[^/]*$"), "b12 url not in SAFE form")


def band_addresses(b12: str) -> dict[str, str]:
    """The files of a scene beside its B12: B11 and B8A in the same folder, the mask among the quality files of the granule."""
    folder, slash, name = b12.rpartition("/IMG_DATA/")
    head, mark, tail = name.rpartition("B12")
    if not slash or not mark:
        raise ValueError("b12 url not in SAFE form")
    beside = {band.lower(): f"{folder}/IMG_DATA/{head}{band}{tail}" for band in ("B12", "B11", "B8A")}
    return beside | {"mask": f"{folder}/QI_DATA/MSK_CLASSI_B00.jp2"}
