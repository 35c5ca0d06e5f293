"""The service in front of the plans: requests, kept answers, and when an answer is still fresh.

Answers and touches are append-only tables in folders; the newest row of a key
wins, and pruning writes what is left to a new folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import params

ANSWERS = "k string, made timestamp, retry boolean, geojson string"
TOUCHED = "k string, made timestamp, x0 double, y0 double, x1 double, y1 double"


def freshness(answers: DataFrame, touched: DataFrame, now: datetime, days: int, reach: float = 0.1) -> DataFrame:
    """(k, fresh) of answers (k, made, retry, has, w, s, e, n, t1): whether the kept answer may be given.

    No other key has touched the box, widened by `reach`, since the answer was begun;
    and its window is closed and nothing failed, or it is under an hour old. Or the
    answer is being made again, for under two minutes. Boxes meet by the squares of
    a grid, not each with each.
    """
    at = F.lit(now).cast("timestamp")
    # of answers of one time, one that is to be made again counts
    last_try = F.max(F.when(F.col("has"), F.struct("made", F.coalesce("retry", F.lit(True)).alias("retry"))))
    last = answers.groupBy("k").agg(
        F.max(F.when(F.col("has"), F.col("made"))).alias("ka"), last_try["retry"].alias("kr"), F.max(F.when(~F.col("has"), F.col("made"))).alias("km"),
        *[F.first(c).alias(c) for c in ("w", "s", "e", "n", "t1")],
    )
    wide = F.lit(reach) / F.cos(F.radians(F.least(F.greatest(F.abs("s"), F.abs("n")), F.lit(85.0))))
    boxes = last.select("k", (F.col("w") - wide).alias("bw"), (F.col("s") - reach).alias("bs"), (F.col("e") + wide).alias("be"), (F.col("n") + reach).alias("bn"))

    def spread(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        cells = [F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int")) for a, b in ((x0, x1), (y0, y1))]
        return df.withColumn("cx", F.explode(cells[0])).withColumn("cy", F.explode(cells[1]))

    others = spread(touched.where("x0 <= x1 and y0 <= y1"), "x0", "y0", "x1", "y1").withColumnRenamed("k", "tk")
    met = spread(boxes, "bw", "bs", "be", "bn").join(others, ["cx", "cy"]).where("not (tk <=> k) and y0 <= bn and y1 >= bs and x0 <= be and x1 >= bw")
    newest = met.groupBy("k").agg(F.max("made").alias("touch"))
    hour, minutes = (at - F.expr("interval 1 hour")), (at - F.expr("interval 2 minutes"))
    closed = (F.col("t1") < F.date_sub(at.cast("date"), days)) & ~F.coalesce("kr", F.lit(True))
    kept = F.coalesce(F.col("ka") > F.col("touch"), F.col("ka").isNotNull()) & (closed | (F.col("ka") > hour))
    making = F.coalesce((F.col("km") > F.col("ka")) & (F.col("km") > minutes), F.lit(False))
    return last.join(newest, "k", "left").select("k", (kept | making).alias("fresh"))


def pruned(answers: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Answers that are the newest of their key and not older than some days."""
    newest = F.max("made").over(Window.partitionBy("k"))
    return answers.withColumn("newest", newest).where((F.col("made") >= F.lit(now - timedelta(days=days))) & (F.col("made") == F.col("newest"))).drop("newest")


def pruned_touches(touched: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    return touched.where(F.col("made") >= F.lit(now - timedelta(days=days)))


@dataclass
class Service:
    """Answers requests from kept answers while they are fresh, else through a plan per public function."""

    spark: SparkSession
    folder: str
    plans: dict[str, Callable[[params.Call], DataFrame]]
    version: str = ""

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def touch(self, key: str, now: datetime, box: tuple[float, float, float, float]) -> None:
        self._append("touched", TOUCHED, key, now, *box)

    def answer(self, text: str, now: datetime) -> str:
        call = params.read_call(text, now.date(), self.version)
        if call is None:
            raise PermissionError("not a public request")
        params.checked_box(call.kind, *call.box)
        kept = self._table("answers", ANSWERS).where(F.col("k") == call.key)
        w, s, e, n = call.box
        rows = kept.select("k", "made", "retry", F.col("geojson").isNotNull().alias("has"), F.lit(w).alias("w"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(n).alias("n"), F.lit(call.end).alias("t1"))
        good = freshness(rows, self._table("touched", TOUCHED), now, params.LIMITS[call.kind][2]).first()
        if good and good.fresh:
            found = kept.where("geojson is not null").orderBy(F.desc("made")).select("geojson").first()
            if found:
                return found.geojson
        self._append("answers", ANSWERS, call.key, now, None, None)
        made = self.plans[call.function](call).first().geojson
        self._append("answers", ANSWERS, call.key, now, False, made)
        return made
