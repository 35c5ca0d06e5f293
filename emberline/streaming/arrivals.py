"""Scenes that arrive one by one, late or twice, merged into the store as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.store import lacking

#: Products land up to a week late, as the batch listing assumes.
LATE = "7 days"


def once(scenes: DataFrame, late: str = LATE, time: str = "datetime", key: tuple[str, ...] = ("tile", "t")) -> DataFrame:
    """The first arrival of each key; its state goes once the watermark has passed it."""
    return scenes.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def into_store(scenes: DataFrame, store_path: str, checkpoint: str, key: list[str], read: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each batch's rows whose key the store lacks; a batch that is run again appends nothing more."""

    def write(batch: DataFrame, _: int) -> None:
        rows = read(batch) if read else batch
        spark = batch.sparkSession
        try:
            there = spark.read.schema(rows.schema).parquet(store_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = spark.createDataFrame([], rows.schema)
        lacking(rows.dropDuplicates(key), there, key).write.mode("append").parquet(store_path)

    return scenes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
