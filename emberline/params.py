"""Thresholds of both detectors, and how requests write them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, timedelta

# Defaults of the day detector.
DAY = {
    "b12_min": 0.30, "b11_min": 0.20, "peak_b12_min": 0.50, "contrast_ratio": 3.0, "background_floor": 0.15, "peakedness_min": 1.15,
    "saturation": 1.0, "hot_floor": 0.50, "max_pixels": 80.0, "large_pixels": 30.0, "large_b12_min": 0.70, "warm_fraction": 0.5,
    "warm_max_pixels": 100.0, "single_pixel_min": 0.65, "max_cloud_local": 0.75, "nir_excess": 0.1,
}
# Defaults of the night detector.
NIGHT = {"s5_gain": 0.89, "s6_gain": 0.80, "sza_min": 90.0, "cloud_bits": float(0x3FC0), "t_min": 500.0, "t_max": 5000.0, "exact": 1.0, "square": 0.02}

_FRACTIONS = ("max_cloud_local", "warm_fraction")
_COUNTS = ("max_pixels", "large_pixels", "warm_max_pixels")


class ThresholdError(ValueError):
    """A threshold that cannot be taken; its text is what a detector's error column says."""


def _parsed(text: str, defaults: dict[str, float]) -> dict[str, float]:
    out = dict(defaults)
    if not text:
        return out
    for item in text.split(","):
        name, sign, value = item.partition("=")
        if not sign:
            raise ThresholdError("expected name=value")
        if name not in defaults:
            raise ThresholdError("unknown threshold")
        try:
            out[name] = float(value)
        except ValueError:
            raise ThresholdError("invalid threshold value") from None
        if not math.isfinite(out[name]):
            raise ThresholdError("invalid threshold value")
    return out


def day_thresholds(text: str = "") -> dict[str, float]:
    """Defaults with those of `name=value,…` in their place, checked."""
    out = _parsed(text, DAY)
    for name, value in out.items():
        if value < 0:
            raise ThresholdError(f"{name} must not be negative")
        if name in _FRACTIONS and value > 1:
            raise ThresholdError(f"{name} must be at most 1")
        if name in _COUNTS and value != int(value):
            raise ThresholdError(f"{name} must be a whole number")
    return out


def night_thresholds(text: str = "") -> dict[str, float]:
    out = _parsed(text, NIGHT)
    for name in ("s5_gain", "s6_gain"):
        if out[name] <= 0:
            raise ThresholdError(f"{name} must be positive")
    if out["exact"] not in (0, 1):
        raise ThresholdError("exact must be 0 or 1")
    if not 0 < out["t_min"] < out["t_max"]:
        raise ThresholdError("t_min must be positive and under t_max")
    if not 0 <= out["sza_min"] <= 180:
        raise ThresholdError("sza_min must be within 0 and 180")
    if out["cloud_bits"] != int(out["cloud_bits"]) or not 0 <= out["cloud_bits"] <= 0xFFFF:
        raise ThresholdError("cloud_bits must be 16 bits")
    if out["square"] < 0:
        raise ThresholdError("square must not be negative")
    return out


#: The largest box of a request in degrees of longitude and latitude, and how long its products go on changing, in days.
LIMITS = {"s2": (0.44, 0.25, 8), "s3": (1.0, 1.0, 3)}


def checked_box(kind: str, w: float, s: float, e: float, n: float) -> tuple[float, float, float, float]:
    wide, high, _ = LIMITS[kind]
    if not all(map(math.isfinite, (w, s, e, n))) or not (e > w and n > s and e - w <= wide and n - s <= high):
        raise ValueError(f"bbox w, s, e, n, at most {wide:g} by {high:g} degrees")
    return w, s, e, n


_CALL = re.compile(
    r"FROM (?P<f>s[23]_(?:hotspots|sites))\((?P<w>[-0-9.]+), ?(?P<s>[-0-9.]+), ?(?P<e>[-0-9.]+), ?(?P<n>[-0-9.]+)"
    r"(?:, ?'(?P<a>[0-9-]{10}|\.\.)', ?'(?P<b>[0-9-]{10}|\.\.)')?\)"
)


@dataclass(frozen=True)
class Call:
    """A public request: function, box and window, and the key that its answer is kept under."""

    function: str
    box: tuple[float, float, float, float]
    start: date
    end: date
    version: str = ""
    written: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        return self.function[:2]

    @property
    def key(self) -> str:
        return " ".join([self.function, *(self.written or map(str, self.box)), self.start.isoformat(), self.end.isoformat(), self.version]).rstrip()


def window_end(text: str | None, default: date) -> date:
    """A date as written, or the default where it is open ('..'), left out or no date."""
    try:
        return date.fromisoformat(text) if text and text != ".." else default
    except ValueError:
        return default


def read_call(text: str, today: date, version: str = "") -> Call | None:
    """The request that a text makes, or None for anything else; the window is the last 90 days by default."""
    m = _CALL.fullmatch(text)
    if not m:
        return None
    try:
        box = tuple(float(m[c]) for c in "wsen")
    except ValueError:
        return None
    return Call(m["f"], box, window_end(m["a"], today - timedelta(days=90)), window_end(m["b"], today), version, tuple(m[c] for c in "wsen"))
