"""ST-07, ST-08: work on micro-batches with bounded retries, each key settled once, and what never works set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import numbered
from ..session import exists, saved

#: An attempt: the pass it was made in, whether it worked, and from when on the key may be tried again.
ATTEMPT = "key long, attempt int, pass long, done boolean, value string, due_us long"


class Drain:
    """Works through keyed rows, the oldest first, and keeps a ledger of attempts in a folder.

    A pass writes its attempts in a folder of its own, which a repeat of the pass after a failure writes over, so no
    attempt counts twice and no key is settled twice: rows whose key is done, dead or not yet due are left out before
    the provider sees them. A failed key waits ``base * 2 ** attempts`` microseconds, at most ``cap``; after ``most``
    attempts it is dead and only listed. A provider gets (key, text, attempt) rows and returns (key, value); a null
    value, and a row it leaves out, is a failure.
    """

    def __init__(self, spark: SparkSession, path: str, provider: Callable[[DataFrame], DataFrame], most: int = 3, base: int = 50_000, cap: int = 2_000_000, limit: int = 10_000):
        self.spark, self.path, self.provider = spark, path, provider
        self.most, self.base, self.cap, self.limit = most, base, cap, limit

    def attempts(self, before: int | None = None) -> DataFrame:
        """All attempts, or those of the passes before one."""
        there = exists(self.spark, self.path)
        rows = self.spark.read.parquet(self.path) if there else self.spark.createDataFrame([], ATTEMPT)
        return rows if before is None else rows.where(F.col("pass") < before)

    def standing(self, before: int | None = None) -> DataFrame:
        """(key, attempts, done, value, due_us, dead) of every key that was tried."""
        made = self.attempts(before).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("attempts"), F.max("done").alias("done"), F.max("value").alias("value"), F.max("due_us").alias("due_us"))
        return made.withColumn("dead", ~F.col("done") & (F.col("attempts") >= self.most))

    def due(self, rows: DataFrame, number: int, now_us: int) -> DataFrame:
        """(key, attempt) of what is owed and due, at most ``limit`` keys, the oldest first. They are ranked by ranges, without their texts."""
        past = self.standing(number).select("key", "attempts", "done", "due_us", "dead")
        first = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("created_us").alias("created_us"))
        owed = first.join(past, "key", "left").where("NOT coalesce(done OR dead, false)").where(F.coalesce("due_us", F.lit(now_us)) <= now_us)
        ranked = numbered(owed.select("created_us", "key", F.coalesce("attempts", F.lit(0)).alias("attempt")), ["created_us", "key"], "_n", self.spark.createDataFrame([], "_n long"))
        return saved(ranked.where(F.col("_n") <= self.limit).select("key", "attempt"))

    def settle(self, rows: DataFrame, number: int, now_us: int) -> bool:
        """One pass over ``rows`` (key, text, created_us): an attempt at every key that is ``due``. Whether there was any."""
        chosen = self.due(rows, number, now_us)
        texts = rows.join(chosen, "key").groupBy("key", "attempt").agg(F.min_by("text", F.struct("created_us", "text")).alias("text"))
        owed = saved(texts.select("key", "text", "attempt"))
        told = self.provider(owed).groupBy("key").agg(F.max("value").alias("value"))
        wait = F.least(F.lit(self.cap), F.lit(self.base) * F.pow(F.lit(2.0), F.col("attempt"))).cast("long")
        out = owed.join(told, "key", "left").select("key", (F.col("attempt") + 1).cast("int").alias("attempt"), F.col("value").isNotNull().alias("done"), "value", (F.lit(now_us) + wait).alias("due_us"))
        out.write.mode("overwrite").parquet(f"{self.path}/pass={number}")
        return not chosen.isEmpty()

    def finish(self, rows: DataFrame, number: int) -> None:
        """Passes from ``number`` on, each when all waits are over, until every key is done or dead."""
        while self.settle(rows, number, number * self.cap):
            number += 1

    def batches(self, queue: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch's rows join the queue in the folder ``queue``, and one pass is made over all that is in it.

        Passes count from the batches' numbers, and batch n is at instant n times the cap, so every wait is over.
        """

        def apply(batch: DataFrame, number: int) -> None:
            batch.select("key", "text", "created_us").write.mode("overwrite").parquet(f"{queue}/batch={number}")
            self.settle(self.spark.read.parquet(queue), number, number * self.cap)

        return apply
