from datetime import date

import pytest

from emberline import params


def test_thresholds_are_parsed_and_checked():
    assert params.day_thresholds("b12_min=.4,max_pixels=10")["b12_min"] == 0.4
    for text, said in (("b12_min=oops", "invalid threshold value"), ("oops=1", "unknown threshold"), ("b12_min", "expected name=value"), ("b12_min=1,", "expected name=value"), ("warm_fraction=2", "at most 1"), ("max_pixels=1.5", "whole number"), ("b12_min=-1", "negative")):
        with pytest.raises(params.ThresholdError, match=said):
            params.day_thresholds(text)
    with pytest.raises(params.ThresholdError, match="exact must be 0 or 1"):
        params.night_thresholds("exact=2")
    assert params.night_thresholds("")["t_min"] == 500


def test_boxes_are_bounded():
    assert params.checked_box("s2", 0, 0, 0.44, 0.25)
    for box in ((0, 0, 0.45, 0.1), (1, 0, 0, 1), (0, 0, 0.1, float("nan"))):
        with pytest.raises(ValueError, match="bbox"):
            params.checked_box("s2", *box)
    assert params.checked_box("s3", 0, 0, 1, 1)


def test_calls_are_read_or_refused():
    today = date(2025, 6, 1)
    call = params.read_call("FROM s2_sites(1, 2,3, 4, '2025-01-01', '..')", today)
    assert call.function == "s2_sites" and call.box == (1, 2, 3, 4) and call.start == date(2025, 1, 1) and call.end == today
    assert params.read_call("FROM s3_hotspots(1,2,3,4)", today).start == date(2025, 3, 3)
    for text in ("FROM s2_sites(1,2,3)", "SELECT 1", "FROM s2_sites(1,2,3,4); DROP TABLE x", "FROM s4_sites(1,2,3,4)", "FROM s2_sites(1,2,3,4,'2025-01-01')", "FROM s2_sites(1-,2,3,4)"):
        assert params.read_call(text, today) is None
    assert params.window_end("2024-99-99", today) == today
