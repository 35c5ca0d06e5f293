"""Groups of adjacent pixels within a scene."""

from __future__ import annotations

import numpy as np
from pyspark.sql.types import StructField, StructType


def labels(row: np.ndarray, col: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """The index of the first pixel, in raster order, of each pixel's group; pixels may come in any order, each once.

    Neighbours are found by binary search among the pixels' raster keys, and
    groups by halving paths to the least index until nothing moves.
    """
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    wide = int(col.max()) + 3
    key = row.astype(np.int64) * wide + col + 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    a, b = [], []
    for step in (1, wide, *((wide - 1, wide + 1) if diagonal else ())):
        at = np.minimum(np.searchsorted(sorted_key, sorted_key + step), n - 1)
        found = np.flatnonzero(sorted_key[at] == sorted_key + step)
        a.append(found)
        b.append(at[found])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new][new]
        if (new == label).all():
            break
        label = new
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def labelled_schema(schema: StructType) -> StructType:
    """A pixel table's schema with comp_row and comp_col, the first pixel of each pixel's group."""
    return StructType([*schema.fields, StructField("comp_row", schema["row"].dataType), StructField("comp_col", schema["col"].dataType)])


def core(row: np.ndarray, col: np.ndarray, value: np.ndarray, peak: int, above: float) -> np.ndarray:
    """Indexes of the pixels over `above` that hang together, by sides, with the peak; the peak always belongs."""
    inside = value > above
    inside[peak] = True
    at = np.flatnonzero(inside)
    label = labels(row[at], col[at])
    return at[label == label[np.flatnonzero(at == peak)[0]]]
