"""Expressions in stages: each stage's columns may use those of the stages before.

The text is SQL that Spark and other engines read alike. A stage becomes a
projection of its own, so that a value used many times is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = dict[str, str]


def applied(df: DataFrame, stages: list[Stage], keep: list[str]) -> DataFrame:
    """df with the columns `keep` of the stages added; the others are temporary."""
    before = df.columns
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df.select(*before, *[c for c in keep if c not in before])


def as_sql(source: str, stages: list[Stage]) -> str:
    """The same as nested selects over a table or subquery."""
    for stage in stages:
        source = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in stage.items())} FROM {source})"
    return source
