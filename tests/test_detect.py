"""Requests end to end, from rasters or their failure to answers."""

import numpy as np
import pytest

from emberline.plans import detect

NIGHT, DAY = "S3A_SL_1_RBT____20250115T210000_x.SEN3", "S3A_SL_1_RBT____20250115T090000_x.SEN3"


def read_day(scene):
    if scene == "missing":
        raise FileNotFoundError("no such scene")
    b = {k: np.full((60, 60), v) for k, v in (("b12", 1200), ("b11", 1100), ("b8a", 1100))}
    b["b12"][10, 20], b["b11"][10, 20], b["b8a"][10, 20] = 9000, 5000, 1500
    return {"ox": 300000.0, "oy": 4200000.0, "res": 20.0, **b, "cloudy": np.zeros((20, 20), bool)}


def rows_day(spark, rows):
    return spark.createDataFrame(rows, "scene string, xmin double, ymin double, xmax double, ymax double")


def test_day_requests(spark):
    box = (300000.0, 4198800.0, 301200.0, 4200000.0)
    rows = [("a", *box), ("a", 300000.0, 4198800.0, 300200.0, 4200000.0), ("missing", *box), (None, *box), ("a", None, *box[1:]), ("a", 2.0, 1.0, 1.0, 2.0), ("a", 0.0, 0.0, 1.0, 1.0), ("a", float("nan"), *box[1:])]
    got = detect.day_detect(rows_day(spark, rows), read_day).collect()
    by = {}
    for r in got:
        by.setdefault((r.scene, r.xmin if r.xmin == r.xmin else "nan", r.xmax), r)
    whole = by["a", box[0], box[2]]
    assert whole.error is None and whole.clear == 1 and len(whole.cells) == 4
    (h,) = whole.hotspots
    assert (h.x, h.y, h.pixels) == (300410.0, 4199790.0, 1) and h.px[0].b12 == pytest.approx(0.8)
    assert by["a", 300000.0, 300200.0].hotspots == []
    assert by["missing", box[0], box[2]].error == "no such scene" and by["missing", box[0], box[2]].hotspots is None
    for key in ((None, box[0], box[2]), ("a", None, box[2])):
        assert by[key].error is None and by[key].hotspots is None and by[key].clear is None
    assert by["a", 2.0, 1.0].error == "empty box" and by["a", "nan", box[2]].error == "nonfinite box"
    miss = by["a", 0.0, 1.0]
    assert miss.error is None and miss.hotspots == [] and miss.cells == [] and miss.clear is None


def test_thresholds_that_cannot_be_taken(spark):
    (r,) = detect.day_detect(rows_day(spark, [("a", 300000.0, 4198800.0, 301200.0, 4200000.0)]), read_day, "b12_min=oops").collect()
    assert r.error == "invalid threshold value" and r.hotspots is None


def read_night(granule):
    if "missing" in granule:
        raise FileNotFoundError("no such granule")
    s5, s6 = np.ones((30, 30), np.float32), np.full((30, 30), 0.5, np.float32)
    s5[10, 12], s6[10, 12] = 1 + 10.0 * 0.6 / 0.89, 0.5 + 10.0 / 0.80
    lat, lon = np.mgrid[0:30, 0:30] * 0.005
    return {"s5": s5, "s6": s6, "flag5": np.zeros((30, 30), np.int32), "cloud": np.zeros((30, 30), np.int32), "lon": 10 + lon, "lat": 20 - lat, "th5": 5.0, "th6": 5.0}


def rows_night(spark, rows):
    return spark.createDataFrame(rows, "granule string, w double, s double, e double, n double")


def test_night_requests(spark):
    box = (10.0, 19.8, 10.2, 20.1)
    rows = [(NIGHT, *box), (NIGHT, 10.0, 19.99, 10.2, 20.1), (DAY, *box), ("missing_SL_1_RBT____20250115T210000_", *box), (None, *box), ("other", *box), (NIGHT, 1.0, 2.0, 1.0, 3.0), (NIGHT, 200.0, 2.0, 201.0, 3.0)]
    got = detect.night_detect(rows_night(spark, rows), read_night).collect()
    by = {(r.granule, r.w, r.s): r for r in got}
    r = by[NIGHT, 10.0, 19.8]
    assert r.error is None and r.sza > 90 and r.clear == 1
    (h,) = r.hotspots
    assert h.lon == pytest.approx(10.06) and h.lat == pytest.approx(19.95) and h.confirmed and 500 < h.temperature < 5000
    assert by[NIGHT, 10.0, 19.99].hotspots == []
    day = by[DAY, 10.0, 19.8]
    assert day.error is None and day.sza < 90 and day.hotspots == [] and day.clear is None
    missing = by["missing_SL_1_RBT____20250115T210000_", 10.0, 19.8]
    assert missing.error == "no such granule" and missing.hotspots is None
    assert by[None, 10.0, 19.8].error is None and by[None, 10.0, 19.8].sza is None
    assert by["other", 10.0, 19.8].error == "not an SL_1_RBT granule"
    assert by[NIGHT, 1.0, 2.0].error == "empty box" and by[NIGHT, 200.0, 2.0].error == "box outside lon/lat bounds"
    one = detect.night_detect(rows_night(spark, [(NIGHT, *box)] * 3 + [(None, *box)]), lambda g: (_ for _ in ()).throw(OSError("gone")), "").collect()
    assert sum(r.error is not None for r in one) == 3 and sum(r.sza is not None for r in one) == 3
    (bad,) = detect.night_detect(rows_night(spark, [(NIGHT, *box)]), read_night, "exact=2").collect()
    assert bad.error == "exact must be 0 or 1"
