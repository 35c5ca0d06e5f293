import math

from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.functions import geo
from emberline.functions.stages import applied


def test_known_places(spark):
    rows = spark.createDataFrame([(9.0, 0.0), (-73.9857, 40.7484), (151.2153, -33.8568), (2.2945, 48.8584)], "lon double, lat double")
    out = applied(rows, geo.utm_forward("lon", "lat"), ["u_zone", "x", "y"]).collect()
    assert out[0].u_zone == 32 and abs(out[0].x - 500000) < 1e-6 and abs(out[0].y) < 1e-6
    assert out[1].u_zone == 18 and abs(out[1].x - 585628) < 2 and abs(out[1].y - 4511322) < 5
    assert out[2].u_zone == 56 and out[2].y > 6_000_000
    tiles = applied(rows, geo.grid_square("lon", "lat"), ["tile"]).collect()
    assert tiles[1].tile == "18TWL" and tiles[3].tile == "31UDQ"


def test_round_trip_is_under_a_millimetre(spark):
    rows = [(float(lon), float(lat)) for lon in range(-179, 180, 13) for lat in range(-79, 84, 9)]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    stages = [*geo.utm_forward("lon", "lat"), *geo.utm_inverse("x", "y", "u_zone", "lat < 0", "lon2", "lat2")]
    for r in applied(frame, stages, ["lon2", "lat2"]).collect():
        assert abs(r.lat - r.lat2) * 111_000 < 1e-3
        assert abs(r.lon - r.lon2) * 111_000 * math.cos(math.radians(r.lat)) < 1e-3


@settings(max_examples=20, deadline=None)
@given(st.floats(-180, 179.99), st.floats(-79, 83))
def test_zone_is_within_bounds(lon, lat):
    zone = (math.floor((lon + 180) / 6) + 60) % 60 + 1
    assert 1 <= zone <= 60


def test_sun_stands_high_at_noon_and_low_at_midnight(spark):
    rows = spark.createDataFrame([(1718971200.0, 0.0, 23.4), (1718928000.0, 0.0, 23.4)], "s double, lon double, lat double")
    noon, midnight = applied(rows, geo.zenith("s", "lon", "lat"), ["sza"]).collect()
    assert noon.sza < 2 and midnight.sza > 120
