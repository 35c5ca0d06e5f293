"""Queries over whole tables, against brute force on small tables."""

import datetime as dt

import pytest

from emberline import queries as base
from emberline.sources import catalogue, ranges


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 341).selectExpr("id as c_custkey").write.parquet(f"{at}/customer.parquet")
    spark.range(400).selectExpr("id as event_id", "id * 7 % 90 as user_id").write.parquet(f"{at}/events.parquet")
    days = "timestamp '1996-01-01' + make_dt_interval(cast(id * 11 % 170 as int))"
    spark.range(300).selectExpr("id as o_orderkey", "50 + id % 40 as o_custkey", f"{days} as o_orderdate").write.parquet(f"{at}/orders.parquet")
    return at


def test_looks_of_all_sites(spark, tables):
    squares = {}
    for e in range(400):
        key = (e % 60, dt.date(2024, 1, 1) + dt.timedelta(e % 60 % 20), e * 7 % 90 % 40 * 640 + 320, e % 30 * 640 + 300)
        squares[key] = min(e % 7 / 7, squares.get(key, 9))
    want = {}
    for c in range(1, 341):
        x, y = c * 911 % 25600, c * 577 % 19200
        near = {}
        for (scene, day, qx, qy), cloud in squares.items():
            if abs(qx - x) <= 320 and abs(qy - y) <= 320:
                here = ((qx - x) ** 2 + (qy - y) ** 2, qx, qy, cloud)
                near[scene, day] = min(near.get((scene, day), here), here)
        for (_, day), best in near.items():
            want[c, day] = min(want.get((c, day), 9), round(best[3], 6))
    got = base.queries()["site_looks"](spark, tables).collect()
    assert {(r.site, r.date): r.cloud for r in got} == want and len(got) == len(want) and max(c for c, _ in want) > 300


def shares(c):
    return {k: 0.25 if c % 4 == 0 else (c * 7 + k * 13) % 11 / 11 for k in range(100) if not (c % 3 == 0 and k % 7 == 0)}


def test_squares_of_all_scenes(spark, tables):
    packs = {r.scene: r for r in base.queries()["squares_pack"](spark, tables).collect()}
    assert packs.keys() == set(range(1, 341))
    for c, r in packs.items():
        have = shares(c)
        flat = len(have) == 100 and len(set(have.values())) == 1
        assert r.cloud == pytest.approx(sum(have.values()) / len(have), abs=2e-6) and r.kept == (None if flat else len(have))
        assert flat or r.total == pytest.approx(sum(round(v, 3) for v in have.values()), abs=2e-6)
    rows = base.queries()["squares_unpack"](spark, tables).collect()
    want = {(c, 300330 + 640 * (30 + k % 10), 4199710 - 640 * (50 + k // 10)): round(v, 3) for c in range(1, 341) for k, v in shares(c).items()}
    assert {(r.scene, r.x, r.y): r.cloud for r in rows} == want and len(rows) == len(want)


def test_gaps_of_all_squares(spark, tables):
    start, done = dt.date(1996, 1, 1), {((50 + n % 40) % 50, n * 11 % 170) for n in range(300)}
    want = {}
    for square in range(40):
        for day in range(182):
            if (square, day) not in done:
                want.setdefault((square, day // 30), []).append(start + dt.timedelta(day))
    got = sorted((r.square, r.first, r.last) for r in base.queries()["search_gaps"](spark, tables).collect())
    assert got == sorted((s, days[0], days[-1]) for (s, _), days in want.items())


@pytest.mark.parametrize("order", [1, -1])
def test_seeds_are_exact_means(spark, order):
    lats = [64.26, 64.39, 64.38, 64.88][::order]  # 64.4775 on average, under which sums of doubles stay
    points = spark.createDataFrame([(-103.5, x) for x in lats], "lon double, lat double").coalesce(1)
    assert [tuple(r) for r in catalogue.seeds(points).collect()] == [(-103.5, 64.478)]


def test_unknown_ends_of_ranges(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 5, 200), (1, 100, None), (1, 100, 120), (1, None, 9000), (1, 300, 310), (1, 1000, None), (1, 1000, 1010)], "f int, a int, b int")
    got = sorted((r.a is None, r.a, r.b) for r in ranges.merged(rows, ["f"], 50).collect())
    assert got == [(False, 0, 200), (False, 300, 310), (False, 1000, 1010), (True, None, 9000)]
