"""Each gate of the detectors with a value that passes and one that does not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline import params
from emberline.operators import day, night

SIDE = 24


def scene(spark, spots, cloudy=(), base=(1200, 1100, 1100)):
    rows = []
    for r in range(SIDE):
        for c in range(SIDE):
            b12, b11, b8a = spots.get((r, c), base)
            rows.append((1, r, c, b12, b11, b8a, (r, c) in cloudy))
    return spark.createDataFrame(rows, "scene long, row int, col int, b12 int, b11 int, b8a int, cloudy boolean")


def found(spark, spots, thresholds="", **more):
    return day.detections(scene(spark, spots, **more), 320, params.day_thresholds(thresholds)).collect()


HOT = (9000, 5000, 1500)


def test_a_single_hot_pixel(spark):
    (one,) = found(spark, {(5, 6): HOT})
    assert (one.row, one.col, one.pixels, one.saturated) == (5, 6, 1, False)
    assert one.max_b12 == pytest.approx(0.8) and one.ratio == pytest.approx(2.0) and one.radiance == pytest.approx(0.78)


@pytest.mark.parametrize(
    ("spots", "thresholds", "n"),
    [
        ({(5, 6): (7600, 5000, 1500)}, "", 1),
        ({(5, 6): (7400, 5000, 1500)}, "", 0),  # a single pixel under single_pixel_min
        ({(5, 6): (9000, 3001, 1500)}, "", 1),
        ({(5, 6): (9000, 3000, 1500)}, "", 0),  # B11 not over b11_min
        ({(5, 6): (9000, 5000, 4990)}, "nir_excess=1", 1),
        ({(5, 6): (9000, 5000, 5010)}, "nir_excess=1", 0),  # B8A over B11
        ({(5, 6): (9000, 5000, 1879)}, "", 1),
        ({(5, 6): (9000, 5000, 1881)}, "", 0),  # as much light as heat
        ({(5, 6): HOT, (5, 7): HOT}, "", 0),  # a flat top
        ({(5, 6): HOT, (5, 7): HOT}, "peakedness_min=1", 1),
        ({(5, 6 + k): (12000 if k == 1 else 9000, 5000, 1500) for k in range(4)}, "max_pixels=4", 1),
        ({(5, 6 + k): (12000 if k == 1 else 9000, 5000, 1500) for k in range(5)}, "max_pixels=4", 0),
        ({(5, 6 + k): (12000 if k == 1 else 9000, 5000, 1500) for k in range(5)}, "warm_max_pixels=4", 0),  # too large a core
        ({(5, 6): HOT, (6, 7): HOT}, "", 2),  # corners do not touch
    ],
)
def test_gates(spark, spots, thresholds, n):
    assert len(found(spark, spots, thresholds)) == n


def test_a_cloudy_cell_has_no_hot_spots(spark):
    most = {(r, c) for r in range(SIDE) for c in range(19)}
    assert found(spark, {(5, 20): HOT}, cloudy=most) == []
    fewer = {(r, c) for r in range(SIDE) for c in range(17)}
    assert len(found(spark, {(5, 20): HOT}, cloudy=fewer)) == 1


def test_background_is_the_upper_median(spark):
    pixels = scene(spark, {(r, c): (1100 + (r * SIDE + c) % 4 * 100, 1100, 1100) for r in range(SIDE) for c in range(SIDE)})
    (cell,) = day.cells(pixels).collect()
    assert cell["median"] == pytest.approx(0.03) and cell["nbg"] == SIDE * SIDE
    assert day.clear_share(day.cells(pixels)).first().clear == 1


def test_no_data_counts_as_hidden(spark):
    pixels = scene(spark, {(r, c): (0, 0, 0) for r in range(SIDE) for c in range(12)})
    cells = day.cells(pixels)
    assert day.clear_share(cells).first().clear == 1
    assert {(s.qx, s.qy): s.cloud for s in day.squares(pixels, cells, 320, 12).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 0}


def test_empty_raster(spark):
    empty = scene(spark, {}).where("false")
    assert day.detections(empty).count() == 0 and day.squares(empty, day.cells(empty)).count() == 0


def test_cloud_mask_is_three_times_as_coarse(spark):
    pixels = scene(spark, {}).drop("cloudy")
    mask = spark.createDataFrame([(1, 0, 0, True, False), (1, 1, 0, False, True), (1, 2, 2, False, False)], "scene long, mrow int, mcol int, opaque boolean, cirrus boolean")
    got = {(r.row, r.col) for r in day.with_cloud(pixels, mask).where("cloudy").collect()}
    assert got == {(r, c) for r in range(6) for c in range(3)}


def granule(spark, hot, flag=None, side=12):
    flag = flag or {}
    rows = []
    for r in range(side):
        for c in range(side):
            s5, s6 = hot.get((r, c), (1.0, 0.5))
            rows.append(("S3A", r, c, float(s5), float(s6), flag.get((r, c), 0), 64 if c == 0 else 0, 10 + c / 100, 20 - r / 100))
    return spark.createDataFrame(rows, "granule string, row int, col int, s5 float, s6 float, flag5 int, cloud int, lon double, lat double")


def limits(spark, level=5):
    return spark.createDataFrame([("S3A", level)], "granule string, threshold int")


def ratio_at(kelvin):
    b = lambda l, t: 1.191042e8 / l**5 / np.expm1(1.4387752e4 / (l * t))  # noqa: E731, E741
    return b(1.613, kelvin) / b(2.256, kelvin)


def test_a_flare_has_its_temperature(spark):
    a6 = 10.0 / 0.80
    a5 = 10.0 * ratio_at(1800) / 0.89
    (one,) = night.detections(granule(spark, {(5, 5): (1 + a5, 0.5 + a6)}), limits(spark), limits(spark)).collect()
    assert one.temperature == pytest.approx(1800, abs=1) and one.confirmed and not one.saturated
    assert one.lon == pytest.approx(10.05) and one.lat == pytest.approx(19.95) and one.pixels == 1 and one.rh > 0
    assert night.detections(granule(spark, {(5, 5): (1 + a5, 0.5 + a6)}), limits(spark), limits(spark), box=(10.06, 19, 11, 21)).count() == 0


def test_saturated_clusters_have_no_temperature_and_cold_ones_go(spark):
    (one,) = night.detections(granule(spark, {}, {(3, 3): 16}), limits(spark), limits(spark)).collect()
    assert one.saturated and one.temperature is None and one.rh is None
    assert night.detections(granule(spark, {(5, 5): (9.0, 900.0)}), limits(spark), limits(spark)).count() == 0


def test_absent_pixels_are_not_hot_and_corners_touch(spark):
    assert night.hot_pixels(granule(spark, {(5, 5): (9, 9)}, {(5, 5): 2}), limits(spark)).count() == 0
    grouped = night.clusters(night.hot_pixels(granule(spark, {(5, 5): (9, 9), (6, 6): (9, 9), (6, 8): (9, 9)}), limits(spark)))
    assert grouped.select("comp_row", "comp_col").distinct().count() == 2


def test_band_threshold_is_the_first_gap(spark):
    rows = [(1, dn, n) for dn, n in {0: 5, 1: 9, 2: 4, 3: 2, 5: 1, 9: 1}.items()]
    histogram = spark.createDataFrame(rows, "granule int, dn int, n long")
    total = sum(r[2] for r in rows)
    assert night.band_thresholds(histogram, total, ["granule"]).first().threshold == 4
    assert night.band_thresholds(histogram, total * 2, ["granule"]).first().threshold == 6
    assert night.band_thresholds(histogram, total * 100_000, ["granule"]).first().threshold == 65535


def test_thermal_confirmation(spark):
    grouped = night.clusters(night.hot_pixels(granule(spark, {(4, 4): (9, 0.5)}), limits(spark)))
    thermal = spark.createDataFrame([("S3A", 2, 2, 305.0, 290.0), ("S3A", 3, 3, 310.0, 400.0)], "granule string, krow long, kcol long, s7 double, f1 double")
    shift = {"to_f": F.lit(0), "to_an": F.lit(0)}
    assert night.confirmed_thermal(grouped, thermal, 300.0, 500.0, **shift).first().thermal
    assert not night.confirmed_thermal(grouped, thermal, 306.0, 500.0, **shift).first().thermal
    assert night.confirmed_thermal(grouped, thermal, 306.0, 350.0, **shift).first().thermal
