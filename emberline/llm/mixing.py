"""Mixing sources to target weights by hierarchical budgets, in SQL functions only.

Weights run down a tree of levels (domain, language, source). A node's budget is
shared among its children by weight; what a child cannot use, because its whole
subtree has too few tokens, goes to its siblings first. Since a child's capacity
counts its whole subtree, only what no sibling can use is missing at the node
itself, where its own siblings have already taken it over.

Each leaf then takes a token prefix: its documents stand in the order of a
seeded hash, epoch after epoch, and are taken while they end within the budget.
Sums over hash buckets tell which buckets a prefix holds wholly, so that only
one bucket of a leaf is ordered, and no task sees a whole leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window

from .common import F, fresh_name, quoted, stored, whole_text

#: Hex digits of the order's hash that name a bucket.
BUCKET_DIGITS = 3
BROADCAST_ROWS = 20_000


def text_tokens(text: str = "text") -> Column:
    """Tokens of a text by its length: one for each 4 code points begun."""
    return F.ceil(F.length(whole_text(text)) / 4).cast("long")


def budgets(capacity: DataFrame, levels: list[str], weights: list[dict], total: int, default: int = 1) -> DataFrame:
    """(levels..., budget) of each leaf, for leaves (levels..., capacity) and a total of tokens.

    weights[k] gives whole-number weights of level k's values, `default` for the
    others; 0 means nothing. Sharing is in whole tokens, rounded down. Among
    siblings, those with the least capacity for their weight are served first;
    each gets its capacity or its share of what is left, whichever is less, so
    that shortages spread over the siblings still to come.
    """
    now = capacity.select(*levels).distinct().withColumn("budget", F.lit(int(total)))
    leaves = capacity.groupBy(*levels).agg(F.sum("capacity").cast("long").alias("capacity"))
    given = None
    for k, level in enumerate(levels):
        above = levels[:k]
        weight = F.lit(default)
        for value, w in weights[k].items():
            weight = F.when(F.col(level).eqNullSafe(F.lit(value)), F.lit(int(w))).otherwise(weight)
        nodes = leaves.groupBy(*levels[: k + 1]).agg(F.sum("capacity").cast("long").alias("capacity")).withColumn("weight", weight.cast("long"))
        nodes = nodes.where("weight > 0")
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(int(total)))
        else:
            same = reduce(lambda a, b: a & b, [F.col(f"n.{quoted(c)}").eqNullSafe(F.col(f"g.{quoted(c)}")) for c in above])
            nodes = nodes.alias("n").join(given.alias("g"), same).select("n.*", "g.budget")
        # one row per node of the tree: siblings are few, whatever the size of the corpus
        ratio = F.col("capacity") / F.col("weight")
        siblings = Window.partitionBy(*above, F.lit(0)).orderBy(ratio, F.col(level).asc_nulls_first())
        nodes = nodes.withColumn("left_weight", F.sum("weight").over(siblings.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # served in order of their ratio, all before the first that is not filled are filled
        nodes = nodes.withColumn("filled", F.expr("capacity * cast(left_weight as decimal(38,0)) <= weight * cast(greatest(budget - used, 0) as decimal(38,0))"))
        nodes = nodes.withColumn("open", F.max(F.when(~F.col("filled"), 1).otherwise(0)).over(siblings.rowsBetween(Window.unboundedPreceding, -1)))
        first = Window.partitionBy(*above, F.lit(0)).orderBy(ratio, F.col(level).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = (~F.col("filled")) & (F.coalesce("open", F.lit(0)) == 0)
        nodes = nodes.withColumn("rest", F.max(F.when(starts, F.col("budget") - F.col("used"))).over(first))
        nodes = nodes.withColumn("over", F.max(F.when(starts, F.col("left_weight"))).over(first))
        share = F.expr("cast(floor(weight * cast(greatest(rest, 0) as decimal(38,0)) / over) as long)")
        given = nodes.withColumn("budget", F.when(F.col("rest").isNull(), F.col("capacity")).otherwise(F.least("capacity", share))).select(*levels[: k + 1], "budget")
    return given


def mix(documents: DataFrame, levels: list[str], weights: list[dict], share: float, seed: int = 17, epochs: int = 2, tokens: Column | None = None, id_column: str = "doc_id", default: int = 1, keep_columns: list[str] | None = None) -> DataFrame:
    """Documents chosen for the mixture, with columns epoch (from 0) and tokens added.

    The total budget is `share` of the corpus's tokens. A document may appear in
    up to `epochs` epochs. Levels may hold nulls, which are values of their own;
    null text has no tokens; rows that repeat an id stand at one place of the
    order and are taken or left together; an empty table gives no rows. The
    added columns get other names where the documents have theirs. A leaf that
    has no budget still gives its documents without tokens that come first.
    """
    kept = keep_columns or documents.columns
    names = [fresh_name(documents.columns, n) for n in ("epoch", "tokens")]
    size = tokens if tokens is not None else text_tokens()
    slim = documents.select(*[F.col(quoted(c)).alias(f"level_{k}") for k, c in enumerate(levels)], F.col(quoted(id_column)).cast("string").alias("name"), size.alias("size"))
    path = [f"level_{k}" for k in range(len(levels))]

    def ordered(frame: DataFrame) -> DataFrame:
        """A row for each epoch, with its place in the leaf's order."""
        rows = frame.withColumn("epoch_", F.explode(F.array(*map(F.lit, range(epochs)))))
        rows = rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch_").cast("string"), F.coalesce("name", F.lit("null")))))
        return rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))

    sums = stored(ordered(slim).groupBy(*path, "epoch_", "bucket").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("rows")), "mix")
    total = sums.where("epoch_ = 0").agg(F.sum("size")).first()[0] or 0
    leaf = sums.groupBy(*path).agg(F.sum("size").cast("long").alias("capacity"))
    budget = budgets(leaf, path, weights, int(total * share), default)

    def same(a: str, b: str, columns: list[str]):
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])

    before = Window.partitionBy(*path).orderBy("epoch_", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    marks = marks.alias("m").join(budget.alias("b"), same("m", "b", path)).select("m.*", "b.budget")
    # the bucket in which a leaf's budget ends; none where the leaf is taken whole
    edge = marks.where("before <= budget and before + size > budget").groupBy(*path).agg(F.min(F.struct("epoch_", "bucket", "before", "budget")).alias("edge"))
    edge = stored(budget.select(*path).alias("b").join(edge.alias("e"), same("b", "e", path), "left").select("b.*", "e.edge"), "edge")
    few = edge.count() <= BROADCAST_ROWS
    sent = F.broadcast if few else (lambda frame: frame)
    within = ordered(slim).alias("r").join(sent(edge).alias("e"), same("r", "e", path)).select("r.*", "e.edge").where("epoch_ = edge.epoch_ and bucket = edge.bucket")
    within = within.groupBy(*path, "edge", "place", "name").agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy(*path, "edge").orderBy("place", F.col("name").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = within.withColumn("so_far", F.sum("size").over(so_far) + F.col("edge.before")).where("so_far <= edge.budget")
    last = within.groupBy(*path).agg(F.max("place").alias("place"))
    cuts = edge.alias("e").join(last.alias("l"), same("e", "l", path), "left").select("e.*", "l.place")
    # no place begins with a bucket's bare name, so that name ends a prefix just before the bucket
    cuts = cuts.select(*path, F.col("edge.epoch_").alias("last_epoch"), F.coalesce("place", "edge.bucket").alias("last_place"))
    # the documents' own columns travel in one struct, so that their names cannot clash with those used here
    whole = F.struct(*[F.col(quoted(c)) for c in kept]).alias("row_")
    rows = ordered(documents.select(whole, *[F.col(quoted(c)).alias(f"level_{k}") for k, c in enumerate(levels)], F.col(quoted(id_column)).cast("string").alias("name"), size.alias("size")))
    rows = rows.alias("r").join(sent(cuts).alias("e"), same("r", "e", path))
    rows = rows.where("last_epoch is null or epoch_ < last_epoch or (epoch_ = last_epoch and place <= last_place)")
    return rows.select("row_.*", F.col("epoch_").alias(names[0]), F.col("r.size").alias(names[1]))
