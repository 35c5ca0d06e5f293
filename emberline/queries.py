"""One query per operator over the fixture tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params
from emberline.fixtures import fixture, fixture_sql, table, with_fixtures
from emberline.functions import geo
from emberline.functions.stages import applied, as_sql
from emberline.operators import day, linkage, night, scenes, store
from emberline.plans import answers, service
from emberline.sources import catalogue, ranges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- sites ---------------------------------------------------------------

_NODE = "((z + 64) * 2097152 + x // 2000) * 2097152 + y // 2000"
_GRAPH = f"""
pb AS (SELECT *, {_NODE} AS n FROM pebbles),
nd AS (SELECT n, any_value(z) AS z, any_value(x // 2000) AS px, any_value(y // 2000) AS py FROM pb GROUP BY n),
ln AS (SELECT a.n AS a, b.n AS b, (b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py) AS d2 FROM nd a JOIN nd b
    ON a.z = b.z AND b.n > a.n AND abs(b.px - a.px) <= 2 AND abs(b.py - a.py) <= 2 WHERE (b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py) <= 4),
sides AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
reach(a, b) AS (SELECT n, n FROM nd UNION SELECT r.a, e.b FROM reach r JOIN sides e ON e.a = r.b),
comp AS (SELECT a AS n, min(b) AS c FROM reach GROUP BY a)"""
_GROWN = f"""{_GRAPH},
ranked AS (SELECT c, a, b, row_number() OVER (PARTITION BY c ORDER BY d2, a, b) AS r FROM ln JOIN comp ON comp.n = ln.a),
began AS (SELECT c, list(DISTINCT n) AS ns FROM comp GROUP BY c),
held AS (SELECT c, list({{'n': pb.n, 'd': d, 'x': x, 'y': y}}) AS ps FROM pb JOIN comp ON comp.n = pb.n GROUP BY c),
step(c, r, ns, gs) AS (
    SELECT c, CAST(0 AS BIGINT), ns, ns FROM began
    UNION ALL
    SELECT t.c, t.r + 1, t.ns, CASE WHEN i <> j AND len(list_filter(held.ps, lambda p: t.gs[list_position(t.ns, p.n)] = i AND len(list_filter(held.ps,
        lambda q: t.gs[list_position(t.ns, q.n)] = j AND q.d = p.d AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) > 9000000)) > 0)) = 0
        THEN list_transform(t.gs, lambda g: CASE WHEN g = j THEN i ELSE g END) ELSE t.gs END
    FROM (SELECT s.*, least(s.gs[list_position(s.ns, k.a)], s.gs[list_position(s.ns, k.b)]) AS i, greatest(s.gs[list_position(s.ns, k.a)], s.gs[list_position(s.ns, k.b)]) AS j
        FROM step s JOIN ranked k ON k.c = s.c AND k.r = s.r + 1) t JOIN held ON held.c = t.c),
site AS (SELECT unnest(ns) AS n, unnest(gs) AS s FROM (SELECT * FROM step QUALIFY r = max(r) OVER (PARTITION BY c)))"""


def _pebbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pebbles")


@query(with_fixtures(f"+{_GROWN} SELECT n AS node, s AS site FROM site", "pebbles"))
def site_linkage(spark, sf_dir):
    return linkage.sites(_pebbles(spark, sf_dir))


@query(with_fixtures(f"+{_GRAPH} SELECT n AS node, c AS component FROM comp", "pebbles"))
def site_components(spark, sf_dir):
    return linkage.components(_pebbles(spark, sf_dir))


@query(with_fixtures(f"+{_GRAPH} SELECT a, b, d2 FROM ln", "pebbles"))
def link_pairs(spark, sf_dir):
    return linkage.links(linkage.nodes(_pebbles(spark, sf_dir)))


@query(with_fixtures(f"+{_GROWN} SELECT s AS site, d AS date, event_id, v AS value FROM pb JOIN site ON site.n = pb.n QUALIFY row_number() OVER (PARTITION BY s, d ORDER BY v DESC, event_id) = 1", "pebbles"))
def site_daily_brightest(spark, sf_dir):
    pebbles = _pebbles(spark, sf_dir)
    placed = linkage.with_pixel(pebbles, linkage.DAY["pixel"]).join(linkage.sites(pebbles), "node")
    return linkage.brightest(placed.withColumnRenamed("d", "date"), ["site", "date"], "v", "event_id").select("site", "date", "event_id", F.col("v").alias("value"))


@query(with_fixtures(f"+{_GROWN} SELECT s AS site, min(z) AS z, CAST(round(sum(x) / count(*) / 4000) * 40 AS DOUBLE) AS x, CAST(round(sum(y) / count(*) / 4000) * 40 AS DOUBLE) AS y, count(*) AS pebbles FROM pb JOIN site ON site.n = pb.n GROUP BY s", "pebbles"))
def site_centroid(spark, sf_dir):
    pebbles = _pebbles(spark, sf_dir)
    return linkage.places(pebbles, linkage.sites(pebbles))


_GRANULES = "SELECT site, granule, min(date) AS date, sum(rh) AS rh, sum(rh * temperature) / nullif(sum(rh) FILTER (temperature IS NOT NULL), 0) AS temperature, CAST(sum(pixels) AS INT) AS pixels, CAST(count(*) AS INT) AS hotspots, bool_and(confirmed) AS confirmed, bool_or(saturated) AS saturated, sum(lon * rh) / nullif(sum(rh), 0) AS lon, sum(lat * rh) / nullif(sum(rh), 0) AS lat FROM night_spots GROUP BY site, granule"


@query(with_fixtures(f"SELECT site, granule, date, round(rh, 4) AS rh, round(temperature, 4) AS temperature, pixels, hotspots, confirmed, saturated, round(lon, 4) AS lon, round(lat, 4) AS lat FROM ({_GRANULES})", "night_spots"))
def night_site_detections(spark, sf_dir):
    return rounded(linkage.per_granule(fixture(spark, sf_dir, "night_spots")), "rh", "temperature", "lon", "lat", places=4)


_SQUARES = "SELECT CAST(event_id % 60 AS INT) AS scene, CAST(DATE '2024-01-01' + CAST(event_id % 60 % 20 AS INT) AS DATE) AS date, CAST(user_id % 40 * 640 + 320 AS DOUBLE) AS x, CAST(event_id % 30 * 640 + 300 AS DOUBLE) AS y, min(CAST(event_id % 7 AS DOUBLE) / 7) AS cloud FROM events GROUP BY ALL"
_SITES = "SELECT c_custkey AS site, CAST(c_custkey * 911 % 25600 AS DOUBLE) AS x, CAST(c_custkey * 577 % 19200 AS DOUBLE) AS y FROM customer"


@query(f"""SELECT site, date, round(min(cloud), 6) AS cloud FROM (SELECT site, scene, date, arg_min(cloud, ((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y), q.x, q.y)) AS cloud
    FROM ({_SITES}) t JOIN ({_SQUARES}) q ON abs(q.x - t.x) <= 320 AND abs(q.y - t.y) <= 320 GROUP BY ALL) GROUP BY site, date""")
def site_looks(spark, sf_dir):
    squares = table(spark, sf_dir, "events").select(
        F.expr("cast(event_id % 60 as int) as scene"), F.expr("date_add(date '2024-01-01', cast(event_id % 60 % 20 as int)) as date"), F.expr("cast(user_id % 40 * 640 + 320 as double) as x"), F.expr("cast(event_id % 30 * 640 + 300 as double) as y"), F.expr("cast(event_id % 7 as double) / 7 as cloud"),
    ).groupBy("scene", "date", "x", "y").agg(F.min("cloud").alias("cloud"))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.expr("cast(c_custkey * 911 % 25600 as double) as x"), F.expr("cast(c_custkey * 577 % 19200 as double) as y"))
    return rounded(linkage.square_under(sites, squares), "cloud")


# --- scenes and the store -----------------------------------------------

@query(with_fixtures("SELECT tile, t, o_orderkey, baseline FROM products QUALIFY row_number() OVER (PARTITION BY tile, t ORDER BY baseline DESC, processed DESC) = 1", "products"))
def scenes_newest(spark, sf_dir):
    rows = fixture(spark, sf_dir, "products")
    return scenes.newest(rows, ["tile", "t"], [F.desc("baseline"), F.desc("processed")]).select("tile", "t", "o_orderkey", "baseline")


_IDS = "SELECT 'S2A_MSIL1C_' || lpad(CAST(t AS VARCHAR), 6, '0') || '01T000000_N0' || lpad(CAST(400 + o_orderkey % 100 AS VARCHAR), 3, '0') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS id, CAST(tile AS VARCHAR) AS tile, CAST(t AS VARCHAR) AS datetime FROM products"


@query(with_fixtures(f"+named AS (SELECT *, substr(id, 29, 4) || right(id, 15) AS made FROM ({_IDS})), best AS (SELECT tile, datetime, max(made) AS made FROM named GROUP BY tile, datetime) SELECT id, tile, datetime FROM named SEMI JOIN best USING (tile, datetime, made)", "products"))
def scenes_newest_by_name(spark, sf_dir):
    rows = fixture(spark, sf_dir, "products").selectExpr("concat('S2A_MSIL1C_', lpad(cast(t as string), 6, '0'), '01T000000_N0', lpad(cast(400 + o_orderkey % 100 as string), 3, '0'), '_', lpad(cast(o_orderkey as string), 15, '0')) as id", "cast(tile as string) as tile", "cast(t as string) as datetime")
    return scenes.newest_processing(rows)


def _granule_text(cat: str) -> str:
    return f"{cat}('S3', CASE WHEN platform = 0 THEN 'A' ELSE 'B' END, repeat('_', 13), lpad(CAST(t AS VARCHAR(9)), 15, '0'), repeat('_', 17), lpad(CAST(o_orderkey AS VARCHAR(19)), 15, '0'), repeat('_', 6), lpad(CAST(tile AS VARCHAR(9)), 7, '0'), repeat('_', 4), lpad(CAST(o_orderkey % 3 AS VARCHAR(9)), 3, '0'))"


@query(with_fixtures(f"""+g AS (SELECT id, left(id, 3) AS craft, substr(id, 17, 15) AS sensed, substr(id, 49, 15) AS made, substr(id, 70, 7) AS orbit, CAST(right(id, 3) AS INT) AS baseline FROM (SELECT {_granule_text('concat')} AS id FROM products)),
    top AS (SELECT craft, orbit, max(baseline) AS baseline FROM g GROUP BY ALL), last AS (SELECT craft, sensed, max(made) AS made FROM g GROUP BY ALL) SELECT id FROM g SEMI JOIN top USING (craft, orbit, baseline) SEMI JOIN last USING (craft, sensed, made)""", "products"))
def granules_newest_baseline(spark, sf_dir):
    return scenes.newest_granules(fixture(spark, sf_dir, "products").selectExpr(f"{_granule_text('concat')} as id"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS t FROM orders WHERE strftime(o_orderdate, '%Y%m%dT%H%M%S') BETWEEN '19960101' AND '19961231' || 'Z'")
def window_filter_scenes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss").alias("t"))
    return scenes.in_window(rows, "19960101", "19961231")


_BOXES = "SELECT c_custkey AS scene, CAST(300000 AS DOUBLE) AS sx, CAST(4200000 AS DOUBLE) AS sy, CAST(290000 + c_custkey * 173 % 110000 AS DOUBLE) AS x0, CAST(4090000 + c_custkey * 199 % 110000 AS DOUBLE) AS y0 FROM customer"


@query(f"SELECT scene, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT *, x0 + 15000 AS x1, y0 + 12000 AS y1 FROM ({_BOXES})), range(16) a(i), range(16) b(j) WHERE i BETWEEN floor((x0 - sx) / 6400) AND floor((x1 - sx) / 6400) AND j BETWEEN floor((sy - y1) / 6400) AND floor((sy - y0) / 6400)")
def cells_needed(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as scene", "300000D as sx", "4200000D as sy", "cast(290000 + c_custkey * 173 % 110000 as double) as x0", "cast(4090000 + c_custkey * 199 % 110000 as double) as y0")
    return store.needed(rows.withColumns({"x1": F.col("x0") + 15000, "y1": F.col("y0") + 12000})).select("scene", "i", "j")


def _need_held(spark, sf_dir):
    rows = fixture(spark, sf_dir, "cell_rows")
    return rows.select("scene", "i", "j").distinct(), rows.where("flag = 'A'").select("scene", "i", "j")


_MISS = "SELECT DISTINCT scene, i, j FROM cell_rows n WHERE NOT EXISTS (SELECT 1 FROM cell_rows h WHERE h.flag = 'A' AND h.scene = n.scene AND h.i = n.i AND h.j = n.j)"


@query(with_fixtures(_MISS, "cell_rows"))
def cells_missing(spark, sf_dir):
    return store.missing(*_need_held(spark, sf_dir))


@query(with_fixtures("SELECT DISTINCT scene, i, j FROM cell_rows WHERE flag = 'A'", "cell_rows"))
def cells_held(spark, sf_dir):
    need, has = _need_held(spark, sf_dir)
    return store.held(has, need)


@query(with_fixtures(f"SELECT scene, min(i) - 1 AS i0, min(j) - 1 AS j0, max(i) + 1 AS i1, max(j) + 1 AS j1 FROM ({_MISS}) GROUP BY scene", "cell_rows"))
def cells_read_box(spark, sf_dir):
    return store.read_boxes(store.missing(*_need_held(spark, sf_dir)))


_SPOTS = "SELECT o_orderkey, o_custkey % 200 AS scene, CAST(o_orderkey * 37 % 105000 AS DOUBLE) + 297500 AS x, CAST(o_orderkey * 53 % 105000 AS DOUBLE) + 4097500 AS y, CAST(300000 AS DOUBLE) AS sx, CAST(4200000 AS DOUBLE) AS sy FROM orders"


@query(with_fixtures(f"SELECT o_orderkey, s.scene, s.i, s.j FROM (SELECT *, CAST(floor((x - sx) / 6400) AS INT) AS i, CAST(ceil((sy - y) / 6400) - 1 AS INT) AS j FROM ({_SPOTS})) s WHERE x >= sx AND x < sx + 100000 AND y > sy - 100000 AND y <= sy AND EXISTS (SELECT 1 FROM cell_rows c WHERE c.scene = s.scene AND c.i = s.i AND c.j = s.j)", "cell_rows"))
def hotspot_to_cell(spark, sf_dir):
    spots = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 200 as scene", "cast(o_orderkey * 37 % 105000 as double) + 297500 as x", "cast(o_orderkey * 53 % 105000 as double) + 4097500 as y", "300000D as sx", "4200000D as sy")
    return store.hotspots_to_cells(spots, fixture(spark, sf_dir, "cell_rows")).select("o_orderkey", "scene", "i", "j")


# a cell's squares: 100 of them, but for scenes divisible by 3 some are off the image, and scenes divisible by 4 have one share
_SQUARE_ROWS = """SELECT c AS scene, k, CAST(CASE WHEN c % 4 = 0 THEN 0.25 ELSE (c * 7 + k * 13) % 11 / 11.0 END AS DOUBLE) AS cloud FROM (SELECT c_custkey AS c FROM customer), (SELECT unnest(range(100)) AS k) WHERE NOT (c % 3 = 0 AND k % 7 = 0)"""


def _square_rows(customers):
    rows = customers.select(F.col("c_custkey").alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    share = F.when(F.col("scene") % 4 == 0, F.lit(0.25)).otherwise((F.col("scene") * 7 + F.col("k") * 13) % 11 / F.lit(11.0))
    rows = rows.where("not (scene % 3 = 0 and k % 7 = 0)").withColumn("cloud", share)
    one = [F.lit(x) for x in (300010.0, 4200030.0, 300000.0, 4200000.0)]
    i, j = F.lit(3), F.lit(5)
    rows = rows.withColumns({"x": store.grid_x(one[0], one[2], i, F.col("k")), "y": store.grid_y(one[1], one[3], j, F.col("k")), "i": i, "j": j})
    packs = store.by_cell(rows).withColumn("packed", store.packed(F.col("squares"), *one, i, j))
    return packs, (*one, i, j)


@query(f"SELECT scene, round(avg(cloud), 6) AS cloud, CASE WHEN count(*) = 100 AND min(cloud) = max(cloud) THEN NULL ELSE count(*) END AS kept, CASE WHEN count(*) = 100 AND min(cloud) = max(cloud) THEN NULL ELSE round(sum(round(cloud, 3)), 6) END AS total FROM ({_SQUARE_ROWS}) GROUP BY scene")
def squares_pack(spark, sf_dir):
    packs, _ = _square_rows(table(spark, sf_dir, "customer"))
    have = F.array_compact("packed")
    return packs.select("scene", F.round("cloud", 6).alias("cloud"), F.when(F.col("packed").isNotNull(), F.size(have).cast("long")).alias("kept"), F.round(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"SELECT scene, CAST(300330 + 640 * (30 + k % 10) AS DOUBLE) AS x, CAST(4199710 - 640 * (50 + k // 10) AS DOUBLE) AS y, round(cloud, 3) AS cloud FROM ({_SQUARE_ROWS})")
def squares_unpack(spark, sf_dir):
    packs, at = _square_rows(table(spark, sf_dir, "customer"))
    out = packs.select("scene", F.inline(store.unpacked(F.col("packed"), *at, F.col("cloud"))))
    return rounded(out, "cloud", places=3)


_STORE = "SELECT scene, i, j, CAST(scene % 10 AS INT) AS cell, max(flag) AS v, 'T' || scene % 20 AS tile FROM cell_rows WHERE flag <> 'R' GROUP BY scene, i, j"
_ARCHIVE = "SELECT scene, i, j, CAST(scene % 10 AS INT) AS cell, min(flag) AS v, 'T' || scene % 20 AS tile FROM cell_rows WHERE scene % 4 <> 1 OR i < 8 GROUP BY scene, i, j"


def _store_archive(spark, sf_dir):
    rows = fixture(spark, sf_dir, "cell_rows")

    def made(df, pick):
        return df.groupBy("scene", "i", "j").agg(F.expr("cast(scene % 10 as int) as cell"), pick.alias("v"), F.expr("concat('T', scene % 20) as tile"))

    return made(rows.where("flag <> 'R'"), F.max("flag")), made(rows.where("scene % 4 <> 1 or i < 8"), F.min("flag"))


@query(with_fixtures(f"SELECT DISTINCT cell FROM ({_STORE}) c WHERE NOT EXISTS (SELECT 1 FROM ({_ARCHIVE}) a WHERE a.scene = c.scene AND a.i = c.i AND a.j = c.j AND a.v = c.v)", "cell_rows"))
def changed_partitions(spark, sf_dir):
    return store.changed_partitions(*_store_archive(spark, sf_dir))


@query(with_fixtures(f"""+c AS ({_STORE}), a AS ({_ARCHIVE}), d AS (SELECT DISTINCT cell FROM c ANTI JOIN a USING (scene, i, j, v)), c2 AS (SELECT * FROM c SEMI JOIN d USING (cell))
    SELECT scene, i, j, cell, v, tile FROM (SELECT * FROM c2 UNION ALL BY NAME SELECT * FROM a SEMI JOIN d USING (cell) ANTI JOIN c2 USING (scene, i, j)) QUALIFY scene = max(scene) OVER (PARTITION BY tile)""", "cell_rows"))
def archive_merge(spark, sf_dir):
    return store.merged(*_store_archive(spark, sf_dir), ["tile"]).select("scene", "i", "j", "cell", "v", "tile")


_NOW = datetime(2001, 9, 1)


@query("SELECT o_orderkey, o_custkey AS k FROM orders a WHERE o_orderdate >= TIMESTAMP '2001-09-01' - INTERVAL 1500 DAY AND o_orderdate = (SELECT max(o_orderdate) FROM orders b WHERE b.o_custkey = a.o_custkey)")
def prune_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("made"))
    return service.pruned(rows, _NOW, 1500).select("o_orderkey", "k")


_KEPT = """SELECT o_custkey AS k, o_orderdate AS made, o_orderstatus = 'F' AS retry, o_orderkey % 9 <> 0 AS has, CAST(o_custkey % 60 AS DOUBLE) AS w, CAST(o_custkey % 40 AS DOUBLE) AS s FROM orders"""
_TOUCHES = "SELECT c_custkey AS k, TIMESTAMP '1995-01-01' + CAST(c_custkey * 3 % 2400 AS INT) * INTERVAL 1 DAY AS made, CAST(c_custkey * 7 % 61 AS DOUBLE) + 0.5 AS x0, CAST(c_custkey * 11 % 41 AS DOUBLE) + 0.5 AS y0 FROM customer"


@query(f"""WITH kept AS (SELECT k, max(made) FILTER (has) AS ka, max(CAST(made AS VARCHAR) || CASE WHEN retry THEN ' y' ELSE ' n' END) FILTER (has) LIKE '%y' AS kr, max(made) FILTER (NOT has) AS km, first(w) AS w, first(s) AS s, first(w) + 0.4 AS e, first(s) + 0.25 AS n FROM ({_KEPT}) GROUP BY k),
    met AS (SELECT kept.k, max(t.made) AS touch FROM kept JOIN ({_TOUCHES}) t ON t.k <> kept.k
        AND greatest(s - (t.y0 + 0.2), t.y0 - n) <= 0.1 AND greatest(w - (t.x0 + 0.2), t.x0 - e) * cos(radians(least(greatest(abs(s), abs(n)), 85))) <= 0.1 GROUP BY kept.k)
    SELECT k, coalesce(coalesce(ka > touch, ka IS NOT NULL) AND (NOT coalesce(kr, true) OR ka > TIMESTAMP '2001-09-01' - INTERVAL 1 HOUR), false) OR coalesce(km > ka AND km > TIMESTAMP '2001-09-01' - INTERVAL 2 MINUTE, false) AS fresh FROM kept LEFT JOIN met USING (k)""")
def answer_fresh(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").selectExpr("o_custkey as k", "o_orderdate as made", "o_orderstatus = 'F' as retry", "o_orderkey % 9 <> 0 as has", "cast(o_custkey % 60 as double) as w", "cast(o_custkey % 40 as double) as s")
    kept = kept.withColumns({"e": F.expr("w + 0.4D"), "n": F.expr("s + 0.25D"), "t1": F.lit(date(2001, 1, 1))})
    touches = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "timestamp '1995-01-01' + make_dt_interval(cast(c_custkey * 3 % 2400 as int)) as made", "cast(c_custkey * 7 % 61 as double) + 0.5D as x0", "cast(c_custkey * 11 % 41 as double) + 0.5D as y0")
    touches = touches.withColumns({"x1": F.expr("x0 + 0.2D"), "y1": F.expr("y0 + 0.2D")})
    return service.freshness(kept, touches, _NOW, 8).select("k", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query("""SELECT square, min(day) AS first, max(day) AS last FROM (SELECT o_custkey % 50 AS square, CAST(day AS DATE) AS day, datediff('day', DATE '1996-01-01', CAST(day AS DATE)) // 30 AS b
    FROM (SELECT DISTINCT o_custkey % 50 AS o_custkey FROM orders), generate_series(DATE '1996-01-01', DATE '1996-06-30', INTERVAL 1 DAY) g(day)) w
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey % 50 = w.square AND CAST(o.o_orderdate AS DATE) = w.day) GROUP BY square, b""")
def search_gaps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = orders.selectExpr("o_custkey % 50 as square").distinct()
    done = orders.selectExpr("o_custkey % 50 as square", "cast(o_orderdate as date) as day")
    return store.search_gaps(wanted, done, "1996-01-01", "1996-06-30")


@query("SELECT min(o_custkey) AS x0, min(o_orderkey) AS y0, max(o_custkey) AS x1, max(o_orderkey) AS y1 FROM orders")
def touched_box(spark, sf_dir):
    return store.touched(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("""SELECT g AS granule, i, j, CAST(sum(p) AS BIGINT) AS pixels, round(sum(p * c) / sum(p), 6) AS clear, count(*) AS slots FROM (SELECT event_id % 30 AS g, CAST(floor(round((user_id % 50) * 0.02 * 10, 6)) AS INT) AS i, CAST(floor(round((event_id % 45) * 0.02 * 10, 6)) AS INT) AS j,
    user_id % 50 AS a, event_id % 45 AS b, count(*) AS p, avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END) AS c FROM events GROUP BY ALL) GROUP BY g, i, j""")
def night_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.expr("event_id % 30 as granule"), F.expr("(user_id % 50) * 0.02D as lon"), F.expr("(event_id % 45) * 0.02D as lat")).agg(F.count("*").alias("pixels"), F.avg(F.when(F.col("event_id") % 4 == 0, 1.0).otherwise(0.0)).alias("clear"))
    return store.night_slots(rows).select("granule", "i", "j", "pixels", F.round("clear", 6).alias("clear"), F.size(F.array_compact("squares")).cast("long").alias("slots"))


# --- the day detector ----------------------------------------------------

SMALL = params.DAY | {"max_pixels": 4.0, "large_pixels": 2.0, "warm_max_pixels": 3.0, "peakedness_min": 1.05}
_CAL = "CASE WHEN {0} = 0 THEN CAST(0 AS DOUBLE) ELSE ({0} - 1000) / CAST(10000 AS DOUBLE) END"
_CELLS = f"""
cnts AS (SELECT scene, col // 32 AS gx, row // 32 AS gy, count(*) AS cnt, sum(cloudy::INT) AS cld, sum((b12 = 0)::INT) AS nd, sum((b12 = 0 AND NOT cloudy)::INT) AS ndc FROM raster GROUP BY ALL),
dim AS (SELECT scene, col // 32 AS gx, row // 32 AS gy, list(b12 ORDER BY b12) AS l FROM raster WHERE b12 <> 0 AND {_CAL.format('b12')} < 0.3 GROUP BY ALL),
cells AS (SELECT *, CASE WHEN NOT skip AND cld + ndc <= 0.75 * cnt AND nbg >= 10 THEN (l[nbg // 2 + 1] - 1000) / CAST(10000 AS DOUBLE) END AS median
    FROM (SELECT cnts.*, cld > 0.75 * cnt AS skip, coalesce(len(l), 0) AS nbg, l FROM cnts LEFT JOIN dim USING (scene, gx, gy))),
cand AS (SELECT r.*, {_CAL.format('b12')} AS v, median FROM raster r JOIN cells c ON c.scene = r.scene AND c.gx = r.col // 32 AND c.gy = r.row // 32
    WHERE {_CAL.format('b12')} > 0.3 AND median IS NOT NULL AND {_CAL.format('b12')} > greatest(median, 0.15) * 3),
hot AS (SELECT *, scene * 1000000 + row * 1000 + col AS p FROM cand WHERE scene IN (SELECT scene FROM cand WHERE v >= 0.5))"""


def _closure(name: str, source: str, near: str) -> str:
    """Common tables: name(p, c), each pixel's group by its first pixel, for pixels p of source adjacent as `near` says."""
    return f"""
{name}_e AS (SELECT a.p AS a, b.p AS b FROM {source} a JOIN {source} b ON a.scene = b.scene AND {near}),
{name}_r(a, b) AS (SELECT p, p FROM {source} UNION SELECT r.a, e.b FROM {name}_r r JOIN {name}_e e ON e.a = r.b),
{name} AS (SELECT a AS p, min(b) AS c FROM {name}_r GROUP BY a)"""


_SIDES = "abs(a.row - b.row) + abs(a.col - b.col) = 1"
_RING = "(SELECT coalesce(max(x.{band}), 0) FROM raster x WHERE x.scene = m.scene AND abs(x.row - m.row) <= 3 AND abs(x.col - m.col) <= 3 AND NOT EXISTS (SELECT 1 FROM hot h WHERE h.scene = x.scene AND h.row = x.row AND h.col = x.col))"


def _raster(spark, sf_dir):
    pixels = fixture(spark, sf_dir, "raster")
    return pixels, day.cells(pixels, 32, SMALL)


@query(with_fixtures(f"+{_CELLS} SELECT scene, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, cnt, CAST(cld AS BIGINT) AS cld, CAST(ndc AS BIGINT) AS ndc, skip, CAST(CASE WHEN skip IS NULL THEN 0 ELSE nbg END AS BIGINT) AS nbg, round(median, 6) AS median FROM cells", "raster"))
def day_background(spark, sf_dir):
    _, cells = _raster(spark, sf_dir)
    return cells.select("scene", F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), "cnt", "cld", "ndc", "skip", "nbg", F.round("median", 6).alias("median"))


@query(with_fixtures(f"+{_CELLS} SELECT scene, round((sum(cnt) - sum(cld) - sum(CASE WHEN skip THEN 0 ELSE ndc END)) / (sum(cnt) - sum(CASE WHEN skip THEN 0 ELSE nd END)), 6) AS clear FROM cells GROUP BY scene", "raster"))
def day_clear_share(spark, sf_dir):
    return rounded(day.clear_share(_raster(spark, sf_dir)[1]), "clear")


@query(with_fixtures(f"+{_CELLS} SELECT r.scene, CAST(col // 8 AS INT) AS qx, CAST(row // 8 AS INT) AS qy, round(avg((skip OR cloudy OR b12 = 0)::INT), 6) AS cloud FROM raster r JOIN cells c ON c.scene = r.scene AND c.gx = r.col // 32 AND c.gy = r.row // 32 GROUP BY ALL", "raster"))
def day_squares(spark, sf_dir):
    pixels, cells = _raster(spark, sf_dir)
    out = day.squares(pixels, cells, 32, 8)
    return out.select("scene", F.col("qx").cast("int").alias("qx"), F.col("qy").cast("int").alias("qy"), F.round("cloud", 6).alias("cloud"))


@query(with_fixtures(f"+{_CELLS} SELECT scene, row, col, round(v, 6) AS v, round(median, 6) AS median FROM hot", "raster"))
def day_candidates(spark, sf_dir):
    return rounded(day.candidates(*_raster(spark, sf_dir), 32, SMALL), "v", "median").select("scene", "row", "col", "v", "median")


@query(with_fixtures(f"+{_CELLS}, {_closure('grp', 'hot', _SIDES)} SELECT scene, row, col, CAST(c // 1000 % 1000 AS INT) AS comp_row, CAST(c % 1000 AS INT) AS comp_col FROM hot JOIN grp USING (p)", "raster"))
def day_components(spark, sf_dir):
    return day.grouped(day.candidates(*_raster(spark, sf_dir), 32, SMALL)).select("scene", "row", "col", "comp_row", "comp_col")


@query(with_fixtures(f"+{_CELLS} SELECT scene, row, col, CAST({_RING.format(band='b12')} AS INT) AS ring12 FROM hot m", "raster"))
def day_ring(spark, sf_dir):
    pixels, cells = _raster(spark, sf_dir)
    return day.rings(day.candidates(pixels, cells, 32, SMALL), pixels, "b12", "ring12")


_DETECTED = f"""{_CELLS}, {_closure('grp', 'hot', _SIDES)},
sel AS (SELECT * FROM (SELECT hot.*, {_CAL.format('b11')} AS n11, {_CAL.format('b8a')} AS n8a, max(v >= 0.5 AND {_CAL.format('b11')} > 0.2) OVER (PARTITION BY c) AS ok FROM hot JOIN grp USING (p)) WHERE ok AND n11 > 0.2),
msk AS (SELECT * FROM sel WHERE n11 > 1 OR v > 1 OR (n11 + n8a > 0.01 AND n11 > n8a)), {_closure('mgrp', 'msk', _SIDES)},
obj AS (SELECT c, count(*) AS n, arg_max(p, (v, -p)) AS pk, max(v) AS mx, avg(v) AS av FROM msk JOIN mgrp USING (p) GROUP BY c),
good AS (SELECT obj.*, m.n11, m.scene, m.row, m.col, m.median, {_RING.format(band='b12')} AS r12, {_RING.format(band='b8a')} AS r8a, m.n8a FROM obj JOIN msk m ON m.p = obj.pk
    WHERE n <= 4 AND mx >= 0.5 AND (n <= 2 OR mx >= 0.7) AND NOT (n > 1 AND mx < 1.05 * av AND av < 1) AND NOT (n = 1 AND mx < 0.65)),
lit AS (SELECT * FROM good WHERE n8a - {_CAL.format('r8a')} < 0.1 * (mx - {_CAL.format('r12')})),
inside AS (SELECT lit.c, m.* FROM lit JOIN mgrp g ON g.c = lit.c JOIN msk m ON m.p = g.p WHERE m.v > greatest(lit.mx * 0.5, 0.5) OR m.p = lit.pk),
core(c, p) AS (SELECT c, pk FROM lit UNION SELECT core.c, b.p FROM core JOIN inside a ON a.c = core.c AND a.p = core.p JOIN inside b ON b.c = core.c AND {_SIDES}),
sized AS (SELECT core.c, count(*) AS pixels, sum(greatest(m.v - lit.median, 0)) AS radiance FROM core JOIN msk m USING (p) JOIN lit ON lit.c = core.c GROUP BY core.c)"""


@query(with_fixtures(f"+{_DETECTED} SELECT scene, row, col, round(mx, 6) AS max_b12, round(av, 6) AS avg_b12, round(n11, 6) AS peak_b11, round(mx / n11, 6) AS ratio, round(mx / av, 6) AS peakedness, CAST(pixels AS INT) AS pixels, round(radiance, 6) AS radiance, mx >= 1 AS saturated FROM lit JOIN sized ON sized.c = lit.c WHERE pixels <= 3", "raster"))
def day_detections(spark, sf_dir):
    pixels, cells = _raster(spark, sf_dir)
    found = day.detections(pixels, 32, SMALL, cells)
    return rounded(found.drop("px"), "max_b12", "avg_b12", "peak_b11", "ratio", "peakedness", "radiance")


# --- the night detector --------------------------------------------------

@query(with_fixtures("""SELECT granule, CAST(coalesce(min(dn) FILTER (dn >= mode AND coalesce(next, 65536) - dn - 1 >= gap) + 1, 65535) AS INT) AS threshold FROM (
    SELECT *, lead(dn) OVER (PARTITION BY granule ORDER BY dn) AS next, ceil(200.0 * 40 / sum(n) OVER (PARTITION BY granule)) AS gap, first_value(dn) OVER (PARTITION BY granule ORDER BY n DESC, dn) AS mode FROM histogram) GROUP BY granule""", "histogram"))
def night_threshold(spark, sf_dir):
    return night.band_thresholds(fixture(spark, sf_dir, "histogram"), 8000, ["granule"])


_NIGHT = "night AS (SELECT scene AS granule, scene, row, col, CAST(b12 AS FLOAT) AS s5, CAST(b11 AS FLOAT) AS s6, CASE WHEN b12 > 9500 THEN 16 WHEN b12 % 50 = 0 THEN 2 ELSE 0 END AS flag5, CASE WHEN cloudy THEN 64 ELSE 0 END AS cloud, CAST(col AS DOUBLE) / 100 AS lon, CAST(row AS DOUBLE) / 100 AS lat, scene * 1000000 + row * 1000 + col AS p FROM raster), warm AS (SELECT * FROM night WHERE flag5 & 2 = 0 AND (s5 > 5000 OR flag5 & 16 <> 0))"
_ANY = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.p <> b.p"


def _night(spark, sf_dir):
    pixels = fixture(spark, sf_dir, "raster").selectExpr("scene as granule", "row", "col", "cast(b12 as float) as s5", "cast(b11 as float) as s6", "case when b12 > 9500 then 16 when b12 % 50 = 0 then 2 else 0 end as flag5", "case when cloudy then 64 else 0 end as cloud", "cast(col as double) / 100 as lon", "cast(row as double) / 100 as lat")
    limits = pixels.select("granule").distinct().withColumn("threshold", F.lit(5000))
    return pixels, limits


@query(with_fixtures(f"+{_NIGHT}, {_closure('grp', 'warm', _ANY)} SELECT granule, row, col, CAST(c // 1000 % 1000 AS INT) AS comp_row, CAST(c % 1000 AS INT) AS comp_col FROM warm JOIN grp USING (p)", "raster"))
def night_clusters(spark, sf_dir):
    pixels, limits = _night(spark, sf_dir)
    return night.clusters(night.hot_pixels(pixels, limits)).select("granule", "row", "col", "comp_row", "comp_col")


_FRAMED = f"""{_NIGHT}, {_closure('grp', 'warm', _ANY)},
box AS (SELECT granule, c, min(row) AS i0, max(row) AS i1, min(col) AS j0, max(col) AS j1 FROM warm JOIN grp USING (p) GROUP BY granule, c),
frame AS (SELECT c, list(s5 ORDER BY s5) AS l5, list(s6 ORDER BY s6) AS l6 FROM box JOIN night n ON n.granule = box.granule AND row BETWEEN i0 - 2 AND i1 + 2 AND col BETWEEN j0 - 2 AND j1 + 2 AND NOT (row BETWEEN i0 AND i1 AND col BETWEEN j0 AND j1) GROUP BY c)"""


@query(with_fixtures(f"+{_FRAMED} SELECT granule, CAST(c // 1000 % 1000 AS INT) AS comp_row, CAST(c % 1000 AS INT) AS comp_col, l5[len(l5) // 2 + 1] AS bg5, l6[len(l6) // 2 + 1] AS bg6 FROM box LEFT JOIN frame USING (c)", "raster"))
def night_background(spark, sf_dir):
    pixels, limits = _night(spark, sf_dir)
    return night.background(night.clusters(night.hot_pixels(pixels, limits)), pixels)


@query(with_fixtures(f"+{_NIGHT}, {_closure('grp', 'warm', _ANY)} SELECT w.granule, CAST(c // 1000 % 1000 AS INT) AS comp_row, CAST(c % 1000 AS INT) AS comp_col, bool_or(flag5 & 16 <> 0 OR EXISTS (SELECT 1 FROM night n WHERE n.granule = w.granule AND abs(n.row - w.row) <= 1 AND abs(n.col - w.col) <= 1 AND n.s6 > 5000)) AS confirmed FROM warm w JOIN grp USING (p) GROUP BY w.granule, c", "raster"))
def night_confirmed(spark, sf_dir):
    pixels, limits = _night(spark, sf_dir)
    return night.confirmed(night.clusters(night.hot_pixels(pixels, limits)), pixels, limits)


@query(with_fixtures(f"+{_NIGHT} SELECT granule, count(*) AS pixels, round(avg((cloud & 16320 = 0)::INT), 6) AS clear FROM night WHERE flag5 & 2 = 0 AND p NOT IN (SELECT p FROM warm) GROUP BY granule", "raster"))
def night_clear_share(spark, sf_dir):
    pixels, limits = _night(spark, sf_dir)
    return rounded(night.clear_share(pixels, night.hot_pixels(pixels, limits), 0x3FC0), "clear")


_B = "(1.191042e8 / pow({l}, 5) / (exp(1.4387752e4 / ({l} * {t})) - 1))"
_RATIO = f"({_B.format(l=1.613, t='t')} / {_B.format(l=2.256, t='t')})"


@query("SELECT c_custkey, CAST(600 + c_custkey * 7 % 4000 AS DOUBLE) AS temperature FROM customer")
def planck_temperature(spark, sf_dir):
    kelvin = F.expr("cast(600 + c_custkey * 7 % 4000 as double)")
    ratio = night.planck(night.L5, kelvin) / night.planck(night.L6, kelvin)
    rows = table(spark, sf_dir, "customer").select("c_custkey", ratio.alias("ratio"))
    return rows.select("c_custkey", F.round(night.temperature(F.col("ratio")), 5).alias("temperature"))


@query(f"SELECT c_custkey, round(5.670374e-8 * pow(t, 4) * 0.25 / {_B.format(l=2.256, t='t')} * 2.5e5 / 1e6, 5) AS rh FROM (SELECT c_custkey, CAST(600 + c_custkey * 7 % 4000 AS DOUBLE) AS t FROM customer)")
def radiant_heat(spark, sf_dir):
    kelvin = F.expr("cast(600 + c_custkey * 7 % 4000 as double)")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(night.radiant_heat(kelvin, F.lit(0.25)), 5).alias("rh"))


_FLARE_ROWS = "SELECT event_id, 'S3' || CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END || repeat('_', 66) || lpad(CAST(event_id % 50 AS VARCHAR), 7, '0') AS granule, CAST(user_id % 20 AS DOUBLE) / 50 AS lon, CAST(user_id % 7 AS DOUBLE) / 60 AS lat, 500 + value * 3 AS temperature, value AS rh, event_id % 3 <> 0 AS confirmed FROM events"


@query(f"SELECT round((floor(lon / 0.025::DOUBLE) + 0.5) * 0.025, 4) AS lon, round((floor(lat / 0.025::DOUBLE) + 0.5) * 0.025, 4) AS lat, count(DISTINCT granule[1:3] || granule[70:76]) FILTER (confirmed) AS passes, count(*) AS hotspots, round(max(temperature), 6) AS max_temperature, round(median(rh), 6) AS median_rh FROM ({_FLARE_ROWS}) GROUP BY 1, 2 HAVING max(temperature) > 1500 AND count(DISTINCT granule[1:3] || granule[70:76]) FILTER (confirmed) > 5")
def flare_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "concat('S3', case when event_id % 2 = 0 then 'A' else 'B' end, repeat('_', 66), lpad(cast(event_id % 50 as string), 7, '0')) as granule", "cast(user_id % 20 as double) / 50 as lon", "cast(user_id % 7 as double) / 60 as lat", "500 + value * 3 as temperature", "value as rh", "event_id % 3 <> 0 as confirmed")
    return rounded(night.flares(rows), "max_temperature", "median_rh")


# --- maps and sky --------------------------------------------------------

_FORWARD = geo.utm_forward("lon", "lat")
_ROUND_TRIP = [*_FORWARD, *geo.utm_inverse("x", "y", "u_zone", "lat < 0", "lon2", "lat2")]
_SQUARE = geo.grid_square("lon", "lat")
_SUN = geo.zenith("CAST(1700000000 + c_custkey * 3600 AS DOUBLE)", "lon", "lat")
_CM = geo.position_cm("lon", "lat")


@query(f"SELECT c_custkey, u_zone AS zone, round(x, 3) AS x, round(y, 3) AS y FROM {as_sql('(' + fixture_sql('points') + ')', _FORWARD)}")
def utm_forward(spark, sf_dir):
    out = applied(fixture(spark, sf_dir, "points"), _FORWARD, ["u_zone", "x", "y"])
    return out.select("c_custkey", F.col("u_zone").alias("zone"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"SELECT c_custkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({fixture_sql('points')})")
def utm_inverse(spark, sf_dir):
    out = applied(fixture(spark, sf_dir, "points"), _ROUND_TRIP, ["lon2", "lat2"])
    return out.select("c_custkey", (F.round("lon2", 7) + 0.0).alias("lon"), (F.round("lat2", 7) + 0.0).alias("lat"))


@query(f"SELECT c_custkey, tile, sx, sy FROM {as_sql('(' + fixture_sql('points') + ')', _SQUARE)}")
def mgrs_tile(spark, sf_dir):
    return applied(fixture(spark, sf_dir, "points"), _SQUARE, ["tile", "sx", "sy"]).select("c_custkey", "tile", "sx", "sy")


@query(f"SELECT c_custkey, z, x // 2000 AS px, y // 2000 AS py FROM {as_sql('(' + fixture_sql('points') + ')', _CM)}")
def pixel_of_place(spark, sf_dir):
    out = applied(fixture(spark, sf_dir, "points"), _CM, ["z", "x", "y"])
    return linkage.with_pixel(out, linkage.DAY["pixel"]).select("c_custkey", "z", "px", "py")


@query(f"SELECT c_custkey, round(sza, 6) AS sza FROM {as_sql('(' + fixture_sql('points') + ')', _SUN)}")
def sun_zenith(spark, sf_dir):
    return rounded(applied(fixture(spark, sf_dir, "points"), _SUN, ["sza"]).select("c_custkey", "sza"), "sza")


@query("SELECT event_id, CAST(ts + to_microseconds(CAST(CAST(user_id % 360 - 180 AS DOUBLE) / 15 * 3600e6 AS BIGINT)) - INTERVAL 12 HOUR AS DATE) AS night FROM events")
def night_date(spark, sf_dir):
    lon = F.expr("cast(user_id % 360 - 180 as double)")
    return table(spark, sf_dir, "events").select("event_id", geo.local_night(F.col("ts"), lon).alias("night"))


@query("""SELECT event_id, round(lon - (c1 + c2 * t + c3 * t * t) / (111320 * cos(radians(lat))), 7) AS lon, round(lat - (d1 + d2 * t + d3 * t * t) / 110540, 7) AS lat FROM (
    SELECT event_id, CAST(user_id AS DOUBLE) / 2 AS lon, CAST(event_id % 120 AS DOUBLE) / 2 AS lat, CAST(event_id % 1500 AS DOUBLE) / 1000 AS t,
    CASE event_id % 3 WHEN 0 THEN 153.7 WHEN 1 THEN -298.2 ELSE 0 END AS c1, CASE event_id % 3 WHEN 0 THEN 377.3 WHEN 1 THEN 6.8 ELSE 0 END AS c2, CASE event_id % 3 WHEN 0 THEN 573.6 WHEN 1 THEN -231.9 ELSE 0 END AS c3,
    CASE event_id % 3 WHEN 0 THEN 271.4 WHEN 1 THEN 309.3 ELSE 0 END AS d1, CASE event_id % 3 WHEN 0 THEN -1276.1 WHEN 1 THEN 226.6 ELSE 0 END AS d2, CASE event_id % 3 WHEN 0 THEN 17.9 WHEN 1 THEN 71.0 ELSE 0 END AS d3 FROM events)""")
def place_correction(spark, sf_dir):
    granule = F.expr("case event_id % 3 when 0 then 'S3A_x' when 1 then 'S3B_x' else 'S3C_x' end")
    lon, lat = geo.corrected(granule, F.expr("cast(event_id % 1500 as double)"), F.expr("cast(user_id as double) / 2"), F.expr("cast(event_id % 120 as double) / 2"))
    return table(spark, sf_dir, "events").select("event_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(with_fixtures("SELECT c_custkey FROM points WHERE lat BETWEEN 10 - 0.5 AND 30 + 0.5 AND lon BETWEEN -100 - 0.5 / cos(radians(lat)) AND 50 + 0.5 / cos(radians(lat))", "points"))
def spots_near(spark, sf_dir):
    return answers.spots(fixture(spark, sf_dir, "points"), (-100.0, 10.0, 50.0, 30.0), 0.5).select("c_custkey")


@query("""SELECT scene, coalesce(avg(cloud) FILTER (x BETWEEN 5000 AND 15000 AND y BETWEEN 3000 AND 12000), -1) AS cloud FROM (SELECT scene, x, y, cloud FROM (SELECT CAST(event_id % 60 AS INT) AS scene, CAST(user_id % 40 * 640 + 320 AS DOUBLE) AS x, CAST(event_id % 30 * 640 + 300 AS DOUBLE) AS y, CAST(event_id % 8 AS DOUBLE) / 8 AS cloud FROM events)) GROUP BY scene""")
def look_summary(spark, sf_dir):
    squares = table(spark, sf_dir, "events").selectExpr("cast(event_id % 60 as int) as scene", "cast(user_id % 40 * 640 + 320 as double) as x", "cast(event_id % 30 * 640 + 300 as double) as y", "cast(event_id % 8 as double) / 8 as cloud")
    wanted = squares.select("scene").distinct().selectExpr("scene", "timestamp '2024-01-01' as datetime", "'T' as tile", "5000D as x0", "15000D as x1", "3000D as y0", "12000D as y1")
    none = wanted.where("false").selectExpr("scene", "'' as error")
    return answers.day_looks(wanted, wanted, squares, none).select("scene", "cloud")


@query("""SELECT granule, max(CAST(60 + granule AS DOUBLE)) AS sza, round(sum(p * c) / sum(p), 6) AS clear FROM (SELECT event_id % 97 AS granule, CAST(event_id % 9 AS INT) AS p, CAST(event_id % 5 AS DOUBLE) / 5 AS c FROM events) GROUP BY granule HAVING max(60 + granule) >= 90 AND sum(p) > 0""")
def night_look_summary(spark, sf_dir):
    cells = table(spark, sf_dir, "events").selectExpr("event_id % 97 as granule", "cast(60 + event_id % 97 as double) as sza", "cast(event_id % 9 as int) as pixels", "cast(event_id % 5 as double) / 5 as clear")
    wanted = cells.select("granule").distinct().selectExpr("granule", "timestamp '2024-01-01' as datetime")
    return rounded(answers.night_looks(wanted, wanted, cells, wanted.where("false").selectExpr("granule", "'' as error")), "clear").select("granule", "sza", "clear")


# --- sources -------------------------------------------------------------

@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_PAGE = """SELECT '{{"features":[{{"id":"S2A_' || {n} || '","properties":{{"datetime":"2024-01-02T03:04:05Z","eo:cloud_cover":' || {n} % 90 || '.5}},"assets":{{"B12":{{"href":"s3://b/' || {n} || '","proj:code":"EPSG:32632","proj:bbox":[1.5,2.5,3.5,' || {n} || ']}}}}}}],"links":[{{"rel":"self"}}]}}' AS body FROM customer"""


@query("SELECT 'S2A_' || c_custkey AS id, TIMESTAMP '2024-01-02 03:04:05' AS datetime, c_custkey % 90 + 0.5::DOUBLE AS cloud, 's3://b/' || c_custkey AS b12, 'EPSG:32632' AS crs, 1.5::DOUBLE AS pb0, CAST(c_custkey AS DOUBLE) AS pb3 FROM customer")
def stac_extract(spark, sf_dir):
    bodies = spark.sql(_PAGE.format(n="c_custkey").replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return catalogue.day_scenes(bodies).select("id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "cloud", "b12", "crs", "pb0", "pb3")


_CALL = r"^FROM (s[23]_hotspots|s[23]_sites)\(([-0-9.]+), ?([-0-9.]+), ?([-0-9.]+), ?([-0-9.]+)(?:, ?''([0-9-]{10}|\.\.)'', ?''([0-9-]{10}|\.\.)'')?\)$"
_CALLS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FROM s2_hotspots(' WHEN 1 THEN 'FROM s3_sites(' WHEN 2 THEN 'SELECT s2_hotspots(' ELSE 'FROM s3_hotspots(' END || (event_id % 180) || ', ' || (user_id % 80) || ',' || (event_id % 180 + 1) || ', ' || (user_id % 80 + 1) || CASE event_id % 3 WHEN 0 THEN ', ''2024-01-01'', ''..''' WHEN 1 THEN '' ELSE ', ''x''' END || ')' AS q FROM events"


_TODAY = date(2024, 6, 1)


def _each(rows: DataFrame, column: str, read: Callable, schema: str) -> DataFrame:
    """event_id and what a function makes of each text, in Arrow batches."""

    def run(frames):
        for frame in frames:
            made = [(k, *found) for k, text in zip(frame["event_id"], frame[column], strict=True) if (found := read(text)) is not None]
            yield pd.DataFrame(made, columns=["event_id", *(f.split()[0] for f in schema.split(", "))])

    return rows.select("event_id", column).mapInPandas(run, f"event_id long, {schema}")


@query(f"""SELECT event_id, f, w, coalesce(TRY_CAST(nullif(a, '..') AS DATE), DATE '2024-03-03') AS a, coalesce(TRY_CAST(nullif(b, '..') AS DATE), DATE '2024-06-01') AS b
    FROM (SELECT event_id, {", ".join(f"regexp_extract(q, '{_CALL}', {k}) AS {n}" for k, n in ((1, "f"), (2, "w"), (6, "a"), (7, "b")))} FROM ({_CALLS})) WHERE f <> ''""")
def call_grammar(spark, sf_dir):
    rows = spark.sql(_CALLS.replace("FROM events", "FROM {events}").replace("''2024-01-01''", "\\'2024-01-01\\'").replace("''..''", "\\'..\\'").replace("''x''", "\\'x\\'"), events=table(spark, sf_dir, "events"))

    def read(text):
        call = params.read_call(text, _TODAY)
        return call and (call.function, call.written[0], call.start, call.end)

    return _each(rows, "q", read, "f string, w string, a date, b date")


@query("SELECT event_id, coalesce(TRY_CAST(nullif(x, '..') AS DATE), DATE '2024-02-01') AS day FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '..' WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN '2024-99-99' END AS x FROM events)")
def day_window(spark, sf_dir):
    text = F.expr("case event_id % 4 when 0 then '..' when 1 then date_format(ts, 'yyyy-MM-dd') when 2 then '2024-99-99' end").alias("x")
    return _each(table(spark, sf_dir, "events").select("event_id", text), "x", lambda t: (params.window_end(t, date(2024, 2, 1)),), "day date")


_RANGES = "SELECT l_suppkey % 40 AS f, l_orderkey * 100 AS a, l_orderkey * 100 + CAST(l_quantity AS BIGINT) * 20 AS b FROM lineitem"


@query(f"""SELECT f, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY f ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 500 THEN 0 ELSE 1 END AS new FROM ({_RANGES}))) GROUP BY f, island""")
def range_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 40 as f", "l_orderkey * 100 as a", "l_orderkey * 100 + cast(l_quantity as bigint) * 20 as b")
    return ranges.merged(rows, ["f"], 500)


@query(with_fixtures("SELECT round(avg(lon), 3) AS lon, round(avg(lat), 3) AS lat FROM points WHERE lat BETWEEN -84 AND 84 GROUP BY floor(lon), floor(lat)", "points"))
def seeds(spark, sf_dir):
    return catalogue.seeds(fixture(spark, sf_dir, "points"))


# listing lines of products: of a third the store has the scene, every fifth is no product, and baselines run from 02.00 to 11.99
_PRODUCT = "concat('S2', CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, '_MSIL1C_2024', lpad(CAST(o_orderkey % 1231 AS VARCHAR(9)), 4, '0'), 'T101031_N', lpad(CAST(200 + o_orderkey % 1000 AS VARCHAR(9)), 4, '0'), '_R022_T', lpad(CAST(o_custkey % 60 AS VARCHAR(9)), 2, '0'), 'UQC_', lpad(CAST(o_orderkey AS VARCHAR(19)), 15, '0'))"


@query(f"SELECT p AS scene, lpad(CAST(k % 60 AS VARCHAR), 2, '0') || 'UQC' AS tile, split(p, '_')[3] AS t FROM (SELECT DISTINCT {_PRODUCT} AS p, o_custkey AS k, 200 + o_orderkey % 1000 AS baseline FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0) WHERE baseline BETWEEN 400 AND 999")
def listed_products(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_PRODUCT} as p")
    lines = orders.selectExpr("concat('<Prefix>', if(o_orderkey % 5 = 0, 'Sentinel-2', p), '.SAFE/</Prefix>') as value")
    return catalogue.listed_products(lines, orders.where("o_orderkey % 3 = 0").selectExpr("p as scene"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'L1C_T' || page_id || '_A1' WHEN 1 THEN '' ELSE 'L1C_' || page_id END AS granule FROM pages")
def granule_folder(spark, sf_dir):
    text = F.expr("concat('x.SAFE/', case page_id % 3 when 0 then concat('GRANULE/L1C_T', page_id, '_A1/IMG') when 1 then concat('GRANULE/L2A_', page_id, '/') else concat('/GRANULE/L1C_', page_id, '/') end)")
    return table(spark, sf_dir, "pages").select("page_id", catalogue.granule_name(text).alias("granule"))


@query()
def geojson_hotspots(spark, sf_dir):
    rows = fixture(spark, sf_dir, "night_spots").selectExpr("date", "cast(date as timestamp) as datetime", "granule", "lon", "lat", "rh", "temperature", "pixels", "rh as s5", "rh as s6", "confirmed", "saturated")
    looks = rows.select("date", "datetime", "granule", F.lit(0.5).alias("clear"), F.lit(95.0).alias("sza"), F.lit(None).cast("string").alias("error")).distinct()
    return answers.hotspots_geojson(rows, looks, (0.0, 0.0, 1.0, 1.0), "s3")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# places lie in 40 by 30 tenths of a degree; of a cell's 25 slots some saw nothing, and some are lacking
_SITES_BY_NIGHT = "SELECT c_custkey AS site, CAST(2000 + c_custkey * 37 % 4000 AS DOUBLE) / 1000 AS lon, CAST(50000 + c_custkey * 53 % 3000 AS DOUBLE) / 1000 AS lat FROM customer"


@query(f"""SELECT site, CAST(ts + to_microseconds(CAST(round_even(lon / 15 * 3600e6, 0) AS BIGINT) - 43200000000) AS DATE) AS date, round(min(1 - CAST((event_id + k * 11) % 9 AS DOUBLE) / 8), 6) AS cloud
    FROM (SELECT event_id, ts, k, (event_id % 40 + 20) * 5 + k % 5 AS a, (event_id // 40 % 30 + 500) * 5 + k // 5 AS b FROM events, range(25) r(k) WHERE event_id % 60 >= 30 AND (event_id + k) % 13 <> 0 AND (event_id * 7 + k * 3) % 5 > 0)
    JOIN ({_SITES_BY_NIGHT}) ON CAST(floor(round(lon * 50, 6)) AS BIGINT) = a AND CAST(floor(round(lat * 50, 6)) AS BIGINT) = b GROUP BY ALL""")
def night_site_looks(spark, sf_dir):
    slots = F.expr("transform(sequence(0, 24), k -> if((event_id + k) % 13 <> 0, named_struct('pixels', (event_id * 7 + k * 3) % 5, 'clear', cast((event_id + k * 11) % 9 as double) / 8), null))")
    packs = table(spark, sf_dir, "events").select(F.col("ts").alias("t"), F.expr("cast(60 + event_id % 60 as double) as sza"), F.expr("cast(event_id % 40 + 20 as int) as i"), F.expr("cast(event_id div 40 % 30 + 500 as int) as j"), slots.alias("squares"))
    sites = spark.sql(_SITES_BY_NIGHT.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return rounded(linkage.slot_under(sites, packs), "cloud")


@query("""SELECT event_id % 30 AS granule, CAST(floor(CAST(user_id AS DOUBLE) * 0.013 / 0.02) AS BIGINT) AS qx, CAST(floor(CAST(event_id % 77 AS DOUBLE) * -0.017 / 0.02) AS BIGINT) AS qy, count(*) AS pixels, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS clear
    FROM events WHERE event_id % 11 <> 0 AND event_id % 17 <> 0 GROUP BY ALL""")
def night_squares(spark, sf_dir):
    """By the fixture every 17th pixel is absent, every 11th hot, and three of four fire a cloud test."""
    pixels = table(spark, sf_dir, "events").selectExpr(
        "event_id % 30 as granule", "cast(event_id as int) as row", "cast(user_id as int) as col", "cast(if(event_id % 11 = 0, 9, 1) as float) as s5", f"if(event_id % 17 = 0, {night.ABSENT}, 0) as flag5", "if(event_id % 4 = 0, 1, 64) as cloud",
        "cast(user_id as double) * 0.013D as lon", "cast(event_id % 77 as double) * -0.017D as lat",
    )
    limits = pixels.select("granule", F.lit(5.0).alias("threshold")).distinct()
    return rounded(night.squares(pixels, night.hot_pixels(pixels, limits), 64), "clear")


@query("""SELECT o_orderkey, CASE WHEN 200 + o_orderkey % 1000 < 400 THEN 'needs baseline N0400 or later' WHEN o_orderkey % 7 = 0 THEN 'b12 url not in SAFE form' END AS error FROM orders""")
def scene_preconditions(spark, sf_dir):
    address = f"concat('s3://store/', {_PRODUCT}, '.SAFE/GRANULE/L1C_A/', if(o_orderkey % 7 = 0, '', 'IMG_DATA/'), 'T32UQC_20240305T101031_B12.jp2') as b12"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", address).select("o_orderkey", catalogue.scene_refused(F.col("b12")).alias("error"))


_FOUND = "SELECT event_id, concat('S2A_MSIL1C_202403', lpad(CAST(1 + event_id % 28 AS VARCHAR(9)), 2, '0'), 'T101031_N0510_R022_T', lpad(CAST(1 + event_id % 40 AS VARCHAR(9)), 2, '0'), 'UQC_x') AS scene, CAST(user_id % 16 AS INT) AS i, CAST(event_id % 7 AS INT) AS j, CAST(300000 + event_id % 400 * 20 AS DOUBLE) AS x, CAST(4200000 + event_id * 20 AS DOUBLE) AS y FROM events"


@query(f"""WITH found AS ({_FOUND}), cells AS (SELECT DISTINCT scene, i, j FROM found WHERE event_id % 3 <> 0), ours AS (SELECT scene, x, y, event_id % 3 AS polygons FROM found SEMI JOIN cells USING (scene, i, j)),
    kept AS (SELECT scene, x, y + event_id % 2 AS y, -1 AS polygons FROM found WHERE event_id % 10 < 2 AND scene IN (SELECT scene FROM cells))
    SELECT scene, x, y, polygons, split_part(scene, '_', 6)[2:] AS tile, CAST(strptime(split_part(scene, '_', 3), '%Y%m%dT%H%M%S') AS DATE) AS date FROM (FROM ours UNION ALL FROM kept ANTI JOIN ours USING (scene, x, y))""")
def archive_detections(spark, sf_dir):
    found = spark.sql(_FOUND.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    cells = found.where("event_id % 3 <> 0").selectExpr("scene", "i", "j", "'c' as cell", "concat('EPSG:326', substring(scene, 40, 2)) as crs").distinct()
    hot = found.withColumn("px", F.expr("filter(transform(sequence(0, 2), k -> named_struct('x', x + 20 * k, 'y', y, 'b12', 1D)), (p, k) -> k < event_id % 3)")).drop("event_id")
    archive = found.where("event_id % 10 < 2").selectExpr("scene", "x", "y + event_id % 2 as y", "'kept' as geometry", "substring(scene, 40, 5) as tile", "to_date(substring(scene, 12, 8), 'yyyyMMdd') as date")
    polygons = F.expr("cast(case when geometry is null then 0 when geometry = 'kept' then -1 else size(split(geometry, '[)][)], [(][(]')) end as bigint)")
    return store.detections(hot, cells, archive).select("scene", "x", "y", polygons.alias("polygons"), "tile", "date")
