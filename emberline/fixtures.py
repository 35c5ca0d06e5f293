"""Tables that the operators' queries run on, derived from the star-schema tables by integer and floor arithmetic.

Each is given as SQL that Spark and other engines read alike, so that a query and
its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# `//` in one dialect is `div` in the other
_DIV = " div "

FIXTURES = {
    "pebbles": """SELECT event_id, CAST(ts AS DATE) AS d, user_id,
        50000000 + (user_id % 15) * 12000 + ((event_id * 7919) % 4) * 1500 AS x,
        300000000 + (user_id div 15) * 12000 + ((event_id * 104729) % 3) * 1500 AS y,
        32 AS z, value AS v FROM events""",
    "raster": """SELECT CAST(label AS BIGINT) AS scene, CAST(rn - 1 AS INT) AS row, CAST(i - 1 AS INT) AS col,
        CAST(1000 + floor(abs(CAST(e AS DOUBLE)) * 20000) AS INT) AS b12,
        CAST(1000 + floor(abs(CAST(e AS DOUBLE)) * 14000) + ((rn - 1) * 31 + i * 17) % 900 AS INT) AS b11,
        CAST(1000 + floor(abs(CAST(f AS DOUBLE)) * 6000) AS INT) AS b8a,
        (((rn - 1) div 3) * 31 + ((i - 1) div 3) * 17) % 13 = 0 AS cloudy FROM (@elements)""",
    "products": """SELECT o_orderkey, CAST(o_custkey % 50 AS INT) AS tile, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS t,
        CAST(o_custkey % 2 AS INT) AS platform, o_orderpriority AS baseline, o_orderkey AS processed FROM orders""",
    "cell_rows": """SELECT DISTINCT l_orderkey % 200 AS scene, CAST(l_partkey % 16 AS INT) AS i, CAST(l_suppkey % 16 AS INT) AS j, l_returnflag AS flag FROM lineitem""",
    "points": """SELECT c_custkey, CAST(-180 AS DOUBLE) + CAST(c_custkey * 37 % 36000 AS DOUBLE) / 100 AS lon,
        CAST(-80 AS DOUBLE) + CAST(c_custkey * 53 % 16000 AS DOUBLE) / 100 AS lat FROM customer""",
    "histogram": """SELECT user_id % 7 AS granule, CAST(floor(value) AS INT) AS dn, count(*) AS n FROM events GROUP BY 1, 2""",
    "night_spots": """SELECT event_id, user_id % 40 AS site, CAST(event_id * 31 % 97 AS INT) AS granule, CAST(ts AS DATE) AS date, value AS rh,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE 500 + value * 3 END AS temperature, CAST(user_id AS DOUBLE) / 10 AS lon, CAST(event_id % 100 AS DOUBLE) / 10 AS lat,
        CAST(event_id % 9 + 1 AS INT) AS pixels, event_id % 3 <> 0 AS confirmed, event_id % 11 = 0 AS saturated FROM events""",
}

_SPARK_ELEMENTS = "SELECT label, rn, p + 1 AS i, element_at(embedding, p + 1) AS e, element_at(embedding, 64 - p) AS f FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) LATERAL VIEW explode(sequence(0, 63)) x AS p"
_OTHER_ELEMENTS = "SELECT label, rn, i, embedding[i] AS e, embedding[65 - i] AS f FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), (SELECT unnest(range(1, 65)) AS i)"
_TABLES = {"pebbles": "events", "raster": "embeddings", "products": "orders", "cell_rows": "lineitem", "points": "customer", "histogram": "events", "night_spots": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _TABLES[name]
    return spark.sql(FIXTURES[name].replace("@elements", _SPARK_ELEMENTS.replace("embeddings", "{embeddings}")).replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: table(spark, sf_dir, source)})


def fixture_sql(name: str) -> str:
    return FIXTURES[name].replace("@elements", _OTHER_ELEMENTS).replace(_DIV, " // ")


def with_fixtures(body: str, *names: str) -> str:
    """A query over fixtures, as one statement with the fixtures as common tables."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({fixture_sql(n)})" for n in names) + (", " if body.startswith("+") else " ") + body.lstrip("+ ")
