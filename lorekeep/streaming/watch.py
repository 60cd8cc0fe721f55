"""Streams: change rows through the policy rules, windows of the log, and the working tier as keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import policy
from ..operators.policy import Rule
from ..session import shared_folder
from ..sources.tables import micros


def change_stream(spark, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """S-14, ST-01, ST-03: change rows from a folder that files arrive in; a batch ends at the file limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_stream(rows: DataFrame, name: str, files: int, file_rows: int = 50_000) -> DataFrame:
    """A table written to the shared folder and read back as a stream of ``files`` / 2 batches.

    It is written in ``files`` files, or a multiple of them, so that none has many more than ``file_rows`` rows; a batch
    takes as many more.
    """
    path, times = shared_folder(rows.sparkSession, name), max(1, -(-rows.count() // (files * file_rows)))
    rows.repartition(files * times).write.parquet(path)
    return change_stream(rows.sparkSession, path, rows.schema, 2 * times)


def as_stream_in_time(rows: DataFrame, name: str, column: str, files: int) -> DataFrame:
    """As ``as_stream``, but later files hold later rows and come later, one a batch."""
    path, at = shared_folder(rows.sparkSession, name), micros_of(column)
    bounds = rows.select(F.percentile_approx(at, [k / files for k in range(1, files)], 1000)).first()[0] or []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows if low is None else rows.where(at > low)
        (part if high is None else part.where(at <= high)).coalesce(1).write.mode("append").parquet(path)
    return change_stream(rows.sparkSession, path, rows.schema, 1)


def policy_stream(mutations: DataFrame, session: DataFrame, rules: list[Rule]) -> DataFrame:
    """C-12, ST-04..06: outcomes of each mutation as it arrives; the order of arrival changes nothing.

    Rules over a trailing window need the whole session in order: see ``with_batches`` for those.
    """
    if any(r.match_kind == "error_rate" for r in rules):
        raise ValueError("a trailing window is not defined on rows in order of arrival")
    return policy.evaluate(policy.enrich(mutations, session, rules), rules)


def window_stream(events: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """ST-10: counts of tumbling windows; rows later than ``lateness`` behind the newest may be left out in append mode."""
    timed = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width).alias("w"), "client_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "client_id", "n")


def micros_of(c: str) -> Column:
    return micros(F.col(c).cast("timestamp_ntz"))


def working_stream(writes: DataFrame) -> DataFrame:
    """ST-09, D-06: the last write of each key as keyed state."""
    best = F.max_by("value", F.struct("updated_at", "value"))
    return writes.groupBy("session_id", "scratch_key").agg(F.count(F.lit(1)).alias("writes"), F.max("updated_at").alias("updated_at"), best.alias("value"))


def with_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], name: str):
    """ST-02, ST-07, ST-08: ``apply`` gets every micro-batch and its number; offsets live in the checkpoint, so a restart resumes.

    A batch may come twice after a failure, so ``apply`` must be idempotent by its number or by its keys.
    """
    location = shared_folder(stream.sparkSession, name)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", location).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", once: bool = True) -> DataFrame:
    """Run a stream to the end of its input and return what it wrote to the shared folder.

    Without ``once`` it runs until the source has nothing more, for sources whose limits hold from batch to batch only.
    """
    out, spark = shared_folder(stream.sparkSession, name), stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # complete mode hands over all of the result each time, and the last one stands
        batch.write.mode("overwrite").parquet(f"{out}/all" if mode == "complete" else f"{out}/batch={number}")

    state = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_folder(spark, f"{name}-offsets"))
    if once:
        state.trigger(availableNow=True).start().awaitTermination()
    else:
        running = state.trigger(processingTime="0 seconds").start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return spark.read.parquet(f"{out}/all" if mode == "complete" else out)
