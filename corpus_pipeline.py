"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on all that the one before it kept, read from Parquet.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import queries as q
from emberline.llm.common import discard, quoted, stored, table
from emberline.session import give_back

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    from emberline.llm import quality as op

    chain = op.fit(docs, table(spark, sf_dir, "labels"))
    return op.keep(docs, chain)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike one stays; n_chars follows the text."""
    from pyspark.sql import functions as F

    from emberline.llm import line_dedup as op

    out = op.dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id."""
    from emberline.llm import simhash as op

    return op.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents fill the budgets of the tree; each is taken once at most, as repeats would undo the stages before."""
    return q.mixed(docs, share=0.9, epochs=1).select(*map(quoted, docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return q.packed(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]
#: The classifier and the packer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def _forget(spark: SparkSession) -> None:
    """Plans and generated classes of a finished stage leave the driver, which else keeps those of all stages."""
    gc.collect()
    give_back(spark)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = docs, stored(docs, f"stage-{name}")
            discard(before)
            _forget(spark)
    return docs
