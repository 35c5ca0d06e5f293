"""A bounded sample of labelled documents, for models that are trained on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window

from .common import F, quoted, whole_text


def labelled(documents: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, most_rows: int, most_chars: int = 20_000, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = None) -> pa.Table:
    """(doc, text, lang, y) of at most `most_rows` labelled documents outside the held-out fold.

    Half of the rows, where there are as many, come from each label. Which rows
    are taken depends on a hash of their id, and on lengths: texts are whole, and
    rows whose text no longer fits into `most_rows` times `most_chars` characters
    are passed over, so that the sample is bounded in bytes too.
    """
    fold = F.crc32(F.col(quoted(id_column)).cast("string")) % modulus
    rows = labels.select(F.col(quoted(id_column)).alias("doc"), F.col(quoted(label)).cast("int").alias("y"), fold.alias("fold"))
    rows = rows.where(f"doc is not null and y in (0, 1) and fold <> {int(left_out)}").groupBy("doc").agg(F.max("y").alias("y"))
    mixed = F.xxhash64(F.lit(11), "doc")
    each = [rows.where(F.col("y") == y).orderBy(mixed, "doc").limit(most_rows // 2) for y in (0, 1)]
    sample = each[0].unionAll(each[1])  # at most most_rows rows of 12 bytes
    lang = F.col(quoted(lang_column)).cast("string") if lang_column else F.lit(None).cast("string")
    texts = documents.select(F.col(quoted(id_column)).alias("doc"), F.struct(whole_text(text_column).alias("text"), lang.alias("lang")).alias("t"))
    lengths = texts.select("doc", F.length("t.text").alias("n")).join(F.broadcast(sample), "doc").groupBy("doc").agg(F.max("y").alias("y"), F.max("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(mixed, "doc"))
    sizes = lengths.withColumn("place", place).toArrow().sort_by([("place", "ascending"), ("y", "ascending")])
    room, taken = most_rows * most_chars, []
    for n in sizes["n"].to_pylist():
        taken.append(n <= room)
        room -= n * taken[-1]
    fit = F.broadcast(documents.sparkSession.createDataFrame(sizes.filter(pa.array(taken, pa.bool_())).select(["doc", "y"])))
    found = texts.join(fit, "doc").groupBy("doc").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return found.select("doc", "t.text", "t.lang", "y").toArrow().sort_by("doc")
