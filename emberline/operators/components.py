"""Connected components of a graph given as edges, distributed.

Alternates two steps until nothing changes: every node links its larger
neighbours to its least one, then its least and itself to its smaller ones. The
edges end as stars around the least node of each component. A node's minimum is
taken with partial aggregation and joined back, so no task holds a node's
neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import checkpoint


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge, component being its least node.

    `edges` has two columns of any ordered type; loops, repeated and reversed
    edges and nulls do no harm (edges with a null are left out). No edges: no
    rows.
    """
    a, b = edges.columns
    now = checkpoint(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(_least(large).select("u", F.col("m").alias("v"))).distinct()
        now = checkpoint(small)
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
