"""S-16: an append-only store of row versions, read as of any instant inside its horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists

#: Columns that a version has beside the row: when it began, a number that orders versions of one instant, whether it ends the row.
AT, TURN, GONE = "_at_us", "_turn", "_gone"


class HorizonError(ValueError):
    """An instant before the horizon: what held then has been put together with what came after."""


class VersionStore:
    """Snapshots and change files in a folder; a read merges the last snapshot before its instant with the changes since.

    Nothing is rewritten: changes are appended, and ``compact`` adds a snapshot and a horizon, before which reads are
    refused from then on. Readers of an older listing keep theirs until ``vacuum``. Instants are microseconds.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def append(self, rows: DataFrame, at: Column, turn: Column | None = None, gone: Column | None = None) -> None:
        """Versions that begin ``at``; ``gone`` marks those that end their row. Equal instants go by ``turn``."""
        made = rows.withColumns({AT: at.cast("long"), TURN: (turn if turn is not None else F.lit(0)).cast("long"), GONE: F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)})
        made.repartitionByRange(AT).sortWithinPartitions(AT).write.mode("append").parquet(f"{self.path}/changes")

    def horizons(self) -> list[int]:
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/horizons").collect()) if exists(self.spark, f"{self.path}/horizons") else []

    def latest(self, versions: DataFrame) -> DataFrame:
        """The last version of each key; versions are combined where they lie before they move."""
        rest = [c for c in versions.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(AT, TURN))
        return versions.groupBy(*self.keys).agg(best.alias("_v")).select(*self.keys, *[F.col("_v")[c].alias(c) for c in rest])

    def versions_at(self, instant: int) -> DataFrame:
        horizons = self.horizons()
        if horizons and instant < horizons[0]:
            raise HorizonError(f"instant {instant} is before the horizon {horizons[0]}")
        base = max((h for h in horizons if h <= instant), default=None)
        changes = self.spark.read.parquet(f"{self.path}/changes").where(F.col(AT) <= instant)  # row groups are in order of time
        if base is None:
            return self.latest(changes)
        snapshot = self.spark.read.parquet(f"{self.path}/snapshots/{base}")
        return self.latest(changes.where(F.col(AT) > base).unionByName(snapshot))

    def read(self, instant: int) -> DataFrame:
        """The rows that held at ``instant``, those that began at that very instant included."""
        return self.versions_at(instant).where(~F.col(GONE)).drop(AT, TURN, GONE)

    def compact(self, horizon: int) -> None:
        """A snapshot as of ``horizon``, which becomes the first instant that can be asked for."""
        self.versions_at(horizon).where(~F.col(GONE)).write.parquet(f"{self.path}/snapshots/{horizon}")
        older = [h for h in self.horizons() if h > horizon]
        self.spark.createDataFrame([(h,) for h in (horizon, *older)], "horizon_us long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/horizons")
