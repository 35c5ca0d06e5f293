import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberline.operators import linkage, scenes, store
from emberline.plans import answers, service
from emberline.sources import catalogue, ranges
from emberline.streaming import arrivals


def test_squares_pack_and_unpack(spark):
    one = [F.lit(x) for x in (300020.0, 4200040.0, 300000.0, 4200000.0)]
    i, j = F.lit(2), F.lit(7)
    rows = spark.range(100).select(F.lit("s").alias("scene"), F.lit(2).alias("i"), F.lit(7).alias("j"), F.col("id").alias("k"), (F.col("id") / 130).alias("cloud")).where("k <> 50")
    rows = rows.withColumns({"x": store.grid_x(one[0], one[2], i, F.col("k")), "y": store.grid_y(one[1], one[3], j, F.col("k"))})
    cell = store.by_cell(rows).withColumn("p", store.packed(F.col("squares"), *one, i, j))
    back = cell.select(F.inline(store.unpacked(F.col("p"), *one, i, j, F.col("cloud"))))
    want = {(r.x, r.y): round(r.cloud, 3) for r in rows.collect()}
    assert {(r.x, r.y): r.cloud for r in back.collect()} == want and len(want) == 99


def test_export_twice_changes_nothing(spark, tmp_path):
    cells = spark.createDataFrame([(f"s{k % 4}", k % 16, k % 5, f"c{k % 3}", f"T{k % 4}", "v1") for k in range(40)], "scene string, i int, j int, cell string, tile string, v string").distinct()
    path = str(tmp_path / "archive")
    for _ in range(2):
        store.export(cells, path, ["tile"], ["scene", "i", "j"])
    first = sorted(store.read_archive(spark, path).select("scene", "i", "j", "cell", "v").collect())
    assert first == sorted(cells.select("scene", "i", "j", "cell", "v").collect())
    store.export(cells.where("cell = 'c1'").withColumn("v", F.lit("v2")), path, ["tile"], ["scene", "i", "j"])
    got = store.read_archive(spark, path)
    assert got.count() == len(first) and got.where("v = 'v2'").count() == cells.where("cell = 'c1'").count()


def test_invariants_fail_loudly(spark):
    with pytest.raises(PySparkException, match="off its square"):
        store.check_cells(spark.createDataFrame([("s", 16, 0)], "scene string, i int, j int")).count()
    cells = spark.createDataFrame([("s", 0, 0, 0.0, 100000.0)], "scene string, i int, j int, sx double, sy double")
    hot = spark.createDataFrame([("s", 0, 0, 100.0, 99900.0)], "scene string, i int, j int, x double, y double")
    assert store.check_hotspots(hot, cells).count() == 1
    with pytest.raises(PySparkException, match="off its cell"):
        store.check_hotspots(hot.withColumn("x", F.lit(7000.0)), cells).count()


def test_seed_only_fills_an_empty_store(spark):
    archive = spark.createDataFrame([(1,), (2,)], "scene int")
    assert store.seed(archive.where("false"), archive).count() == 2
    assert store.seed(archive.limit(1), archive).count() == 1


def test_catalogue_pages(spark):
    body = json.dumps({"features": [{"id": "S2A_MSIL1C_20240101T000000_N0510_R1_T31UDQ_x", "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": 3}, "assets": {"B12": {"href": "h", "proj:code": "EPSG:32631", "proj:bbox": [1, 2, 3, 4]}}}], "links": []})
    rows = spark.createDataFrame([(body,)], "body string")
    (one,) = catalogue.day_scenes(rows).collect()
    assert one.tile == "31UDQ" and one.pb3 == 4 and one.cloud == 3
    full = spark.createDataFrame([(body.replace('"links": []', '"links": [{"rel": "next"}]'),)], "body string")
    with pytest.raises(PySparkException, match="came back full"):
        catalogue.day_scenes(full).collect()


def test_a_failed_fetch_fails_the_query(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no such page")
        return "{}"

    assert catalogue.pages(spark, ["a", "b"], get).count() == 2
    with pytest.raises(PySparkException, match="no such page"):
        catalogue.pages(spark, ["a", "bad"], get).collect()


def test_searches_cover_each_day_once():
    urls = catalogue.searches("s2", (0.0, 0.0, 1.0, 1.0), date(2024, 1, 1), date(2024, 12, 31), 40)
    spans = [u.split("datetime=")[1].split("&")[0] for u in urls]
    days = []
    for s in spans:
        a, b = (date.fromisoformat(x[:10]) for x in s.split("/"))
        days += [a + timedelta(days=k) for k in range((b - a).days + 1)]
    assert days == [date(2024, 1, 1) + timedelta(days=k) for k in range(366)]
    assert all("cloud_cover" in u for u in urls)
    assert catalogue.web_address("gs://b/k") == "https://storage.googleapis.com/b/k" and catalogue.web_address("s3://b/k", "e") == "https://e/b/k" and catalogue.web_address("https://x/y") == "https://x/y"


def test_ranges_join_by_gap_then_by_number():
    assert ranges.joined([(0, 5), (6, 9), (20, 30), (100, 110)], 1) == [(0, 9), (20, 30), (100, 110)]
    assert ranges.joined([(0, 5), (6, 9), (20, 30), (100, 110)], 0, 2) == [(0, 30), (100, 110)]
    cache = ranges.Cache()
    cache.put(10, b"abcdef")
    assert cache.get(11, 13) == b"bc" and cache.get(5, 12) is None and cache.lacking([(5, 12), (12, 20), (11, 13)]) == [(5, 10), (16, 20)]


def test_newest_granules_judge_both_rules_over_all_rows(spark):
    def name(start, made, orbit, base):
        return f"S3A{'_' * 13}{start:0>15}{'_' * 17}{made:0>15}{'_' * 6}{orbit:0>7}{'_' * 4}{base:0>3}"

    rows = [name(1, 1, 1, 1), name(1, 2, 1, 1), name(2, 1, 1, 2), name(3, 9, 2, 1)]
    got = {r.id for r in scenes.newest_granules(spark.createDataFrame([(x,) for x in rows], "id string")).collect()}
    assert got == {rows[2], rows[3]}


def test_service_keeps_answers_while_fresh(spark, tmp_path):
    made = []

    def plan(call):
        made.append(call)
        return spark.createDataFrame([(f"answer {len(made)}",)], "geojson string")

    own = service.Service(spark, str(tmp_path / "db"), {"s2_sites": plan, "s3_sites": plan})
    text = "FROM s2_sites(1, 2, 1.2, 2.1, '2024-01-01', '2024-02-01')"
    now = datetime(2025, 1, 1, 12)
    assert own.answer(text, now) == "answer 1"
    assert own.answer(text, now + timedelta(days=3)) == "answer 1"
    own.touch("another", now + timedelta(days=4), (1.1, 2.0, 1.1, 2.0))
    assert own.answer(text, now + timedelta(days=5)) == "answer 2"
    open_ = "FROM s3_sites(1, 2, 1.2, 2.1)"
    later = now + timedelta(days=6)  # after the touch of the box
    assert own.answer(open_, later) == "answer 3" and own.answer(open_, later + timedelta(minutes=30)) == "answer 3"
    assert own.answer(open_, later + timedelta(hours=2)) == "answer 4"
    with pytest.raises(PermissionError):
        own.answer("SELECT 1", now)
    with pytest.raises(ValueError, match="bbox"):
        own.answer("FROM s2_sites(1,2,9,9)", now)


def test_geojson_parses_and_is_ordered(spark):
    rows = [(date(2024, 1, d), datetime(2024, 1, d), f"g{d}", 0.5, 0.5, 1.0, None, 2, 1.0, 1.0, True, False) for d in (1, 3, 2)]
    found = spark.createDataFrame(rows, "date date, datetime timestamp, granule string, lon double, lat double, rh double, temperature double, pixels int, s5 double, s6 double, confirmed boolean, saturated boolean")
    looks = found.select("date", "datetime", "granule", F.lit(0.5).alias("clear"), F.lit(95.0).alias("sza"), F.lit(None).cast("string").alias("error"))
    out = json.loads(answers.hotspots_geojson(found, looks, (0, 0, 1, 1), "s3").first().geojson)
    assert [f["properties"]["granule"] for f in out["features"]] == ["g3", "g3", "g2", "g2", "g1", "g1"]
    assert out["features"][0]["properties"]["kind"] == "look" and out["features"][0]["geometry"] is None
    assert out["features"][1]["properties"]["temperature"] is None and out["features"][1]["geometry"]["coordinates"] == [0.5, 0.5]


def test_site_geojson(spark):
    sites = answers.site_names(spark.createDataFrame([(1, 10.0, 50.0)], "site long, lon double, lat double"), "live")
    found = spark.createDataFrame([(1, "2024-01-02", "b", 0.9), (1, "2024-01-02", "a", 0.9), (1, "2024-01-01", "c", 0.5)], "site long, date string, scene string, max_b12 double")
    looks = spark.createDataFrame([(1, "2024-01-01", 0.25)], "site long, date string, cloud double")
    (f,) = json.loads(answers.sites_geojson(sites, found, looks, ["date", "scene", "max_b12"], "max_b12", "scene").first().geojson)["features"]
    p = f["properties"]
    assert p["id"] == "live:50.00000,10.00000" and p["looks"] == [["2024-01-01", 0.25]] and p["detection_count"] == 2
    assert [d["scene"] for d in p["detections"]] == ["c", "a"]


def test_recentred_outline(spark):
    px = F.array(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0))), F.array(*map(F.lit, (3.0, 2.0, 0.0, 3.0, 0.0, 3.0, 1.0, 2.0, 1.0))))
    (row,) = spark.range(1).select(answers.recentred(answers.brightest_pixel(px), F.lit(7.0), F.lit(10.0), F.lit(20.0)).alias("o")).collect()
    assert row.o == [[7.0, 9.5, 19.5, 10.5, 19.5, 10.5, 20.5, 9.5, 20.5]]


def test_stream_appends_each_scene_once(spark, tmp_path):
    source, where = tmp_path / "in", str(tmp_path / "store")
    schema = "tile string, t string, datetime timestamp, scene string"
    for k, rows in enumerate(([("T", "1", datetime(2024, 1, 1), "a"), ("T", "1", datetime(2024, 1, 1), "a2")], [("T", "1", datetime(2024, 1, 2), "b"), ("U", "2", datetime(2024, 1, 2), "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = arrivals.once(spark.readStream.schema(schema).parquet(str(source)))
        arrivals.into_store(stream, where, str(tmp_path / "check"), ["tile", "t"]).awaitTermination()
        assert spark.read.parquet(where).count() == k + 1


def test_of_answers_of_one_time_one_to_be_made_again_counts(spark):
    now, made = datetime(2025, 1, 20), datetime(2025, 1, 10)
    rows = [(k, made, retry, True, 1.0, 2.0, 1.2, 2.1, date(2025, 1, 1)) for k, tries in (("a", (False, True)), ("b", (True, False)), ("c", (False, False)), ("d", (None, False))) for retry in tries]
    answers = spark.createDataFrame(rows, "k string, made timestamp, retry boolean, has boolean, w double, s double, e double, n double, t1 date")
    touched = spark.createDataFrame([], "k string, made timestamp, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.fresh for r in service.freshness(answers, touched, now, 8).collect()} == {"a": False, "b": False, "c": True, "d": False}


def test_detections_for_the_archive(spark):
    scene, other = "S2A_MSIL1C_20240305T101031_N0510_R022_T32UQC_x", "S2A_MSIL1C_20240306T101031_N0510_R022_T32UQC_x"
    cells = spark.createDataFrame([(scene, 0, 0, "c1", "EPSG:32632"), (other, 0, 0, "c1", "EPSG:32632")], "scene string, i int, j int, cell string, crs string")
    px = "array<struct<x:double,y:double,b12:double>>"
    hot = spark.createDataFrame([(scene, 0, 0, 500000.0, 0.0, [(500000.0, 0.0, 1.0), (500020.0, 0.0, 2.0)]), (scene, 0, 0, 500100.0, 0.0, None), (scene, 3, 3, 1.0, 1.0, [])], f"scene string, i int, j int, x double, y double, px {px}")
    archive = spark.createDataFrame([(scene, 500000.0, 0.0, "old"), (other, 7.0, 7.0, "kept"), ("gone", 1.0, 1.0, "gone")], "scene string, x double, y double, geometry string")
    got = {(r.scene, r.x): r for r in store.detections(hot, cells, archive).collect()}
    assert set(got) == {(scene, 500000.0), (scene, 500100.0), (other, 7.0)}
    one = got[scene, 500000.0]
    assert one.tile == "32UQC" and one.date == date(2024, 3, 5) and one.datetime == datetime(2024, 3, 5, 10, 10, 31) and one.cell == "c1"
    rings = [[tuple(map(float, p.split())) for p in r.split(", ")] for r in one.geometry.removeprefix("MULTIPOLYGON (((").removesuffix(")))").split(")), ((")]
    assert len(rings) == 2 and all(len(r) == 5 and r[0] == r[-1] for r in rings)
    degree = 10 / 0.9996 / 111319.49
    assert rings[0][0] == pytest.approx((9 - degree, -10 / 0.9996 / 110574.28), abs=2e-7) and rings[1][2][0] == pytest.approx(9 + 3 * degree, abs=2e-7)
    assert got[scene, 500100.0].geometry is None and got[other, 7.0].geometry == "kept"


def test_scenes_that_cannot_be_read(spark):
    good = "s3://eodata/a/S2A_MSIL1C_20240305T101031_N0510_R022_T32UQC_x.SAFE/GRANULE/L1C_y/IMG_DATA/T32UQC_20240305T101031_B12.jp2"
    rows = spark.createDataFrame([(good,), (good.replace("N0510", "N0301"),), ("x_N0500_B12.jp2",), ("B12.jp2",), (None,)], "b12 string")
    assert [r.e for r in rows.select(catalogue.scene_refused(F.col("b12")).alias("e")).collect()] == [None, "needs baseline N0400 or later", "b12 url not in SAFE form", "needs baseline N0400 or later", None]
    beside = catalogue.band_addresses(good)
    assert beside["b12"] == good and beside["b8a"].endswith("/IMG_DATA/T32UQC_20240305T101031_B8A.jp2") and beside["mask"].endswith("/L1C_y/QI_DATA/MSK_CLASSI_B00.jp2")
    with pytest.raises(ValueError, match="SAFE"):
        catalogue.band_addresses("x_B12.jp2")


def test_night_looks_of_sites(spark):
    slots = [(4, 0.25) if k == 12 else (0, 0.0) if k == 13 else None for k in range(25)]
    rows = [(datetime(2024, 1, 2, 22), 100.0, 20, 500, slots), (datetime(2024, 1, 2, 23), 100.0, 20, 500, [(1, 0.5)] * 25), (datetime(2024, 1, 2, 12), 80.0, 20, 500, [(1, 1.0)] * 25)]
    packs = spark.createDataFrame(rows, "t timestamp, sza double, i int, j int, squares array<struct<pixels:long,clear:double>>")
    sites = spark.createDataFrame([(1, 2.05, 50.05), (2, 2.07, 50.05), (3, 2.15, 50.05)], "site int, lon double, lat double")
    got = sorted(tuple(r) for r in linkage.slot_under(sites, packs).collect())
    assert got == [(1, date(2024, 1, 2), 0.5), (2, date(2024, 1, 2), 0.5)]
    assert linkage.slot_under(sites, packs.limit(1)).collect()[0].cloud == 0.75
