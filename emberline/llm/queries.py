"""The queries of this subpackage, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, audio, chat, line_dedup, mixing, packing, quality, secret_scan, simhash, toxicity
from .common import F, fresh_name, quoted, table
from .oracles import SQL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
#: The tree of the mixture: domains are groups of sources by their number.
DOMAIN = "case when source rlike '^src[0-9]$' then 'web' when source rlike '^src1[0-4]$' then 'books' else 'other' end"
WEIGHTS = [{"web": 5, "books": 3, "other": 2}, {"en": 6, "de": 2, "fr": 2, "es": 2}, {"src0": 2}]


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    read = chat.read_back(chat.windows(talks.unionAll(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    target = F.array_join("targets", "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def packed(documents: DataFrame) -> DataFrame:
    return packing.pack(documents, RANKS, PATTERN, TOKENIZER)


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def mixed(documents: DataFrame, share: float, epochs: int) -> DataFrame:
    """The documents' own columns, and last domain, epoch and tokens, under other names where the documents have these."""
    domain = fresh_name(documents.columns, "domain")
    return mixing.mix(documents.withColumn(domain, F.expr(DOMAIN)), [domain, "lang", "source"], WEIGHTS, share, epochs=epochs)


def op6_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), share=0.6, epochs=2)
    domain, epoch, tokens = (F.col(quoted(c)).alias(name) for c, name in zip(out.columns[-3:], ("domain", "epoch", "tokens"), strict=True))
    return out.select("doc_id", domain, "lang", "source", epoch, tokens)


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.audio(table(spark, sf_dir, "documents")))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    base = F.filter("spans", lambda s: s.kind != "random")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
