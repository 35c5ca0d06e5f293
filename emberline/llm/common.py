"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import discard, stored  # noqa: F401


def fresh_name(columns: list[str], stem: str) -> str:
    """A column name that none of the columns has, letter case aside."""
    taken = {c.lower() for c in columns}
    return next(n for n in itertools.chain([stem], (f"{stem}_{i}" for i in itertools.count(1))) if n.lower() not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """The name of a top-level column, dots and backticks included, as col() takes it."""
    return "`" + re.sub("`", "``", name) + "`"


def whole_text(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def remainder(doc_id: str, modulus: int):
    """crc32 of the id written as text, modulo the modulus: the split into folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(quoted(doc_id)).cast("string")) % modulus, F.lit(0))
