"""Retention, the working tier, leases, sessions, standing of procedures, and counts over tiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved

SOON_DAYS = 7
INITIAL, SUCCESS, FAILURE = 0.5, 0.05, 0.10
OUTCOME_CLASSES = ("succeeded", "failed", "abandoned")


def live(rows: DataFrame, now: Column) -> DataFrame:
    """D-18: a reader never sees an expired row."""
    return rows.where(F.col("expires_at") > now)


def retention_report(clients: DataFrame, tables: list[DataFrame], now: Column, days: int = SOON_DAYS) -> DataFrame:
    """A-04, C-11, J-12: for every client the rows that expire in (now, now + days], and those that have."""
    rows = tables[0].select("client_id", "expires_at")
    for t in tables[1:]:
        rows = rows.unionAll(t.select("client_id", "expires_at"))
    end = F.timestamp_add("DAY", F.lit(days), now)
    counts = rows.groupBy("client_id").agg(F.count_if((F.col("expires_at") > now) & (F.col("expires_at") <= end)).alias("soon"), F.count_if(F.col("expires_at") <= now).alias("expired"))
    return clients.select("client_id", "slug").join(counts, "client_id", "left").select("client_id", "slug", F.coalesce("soon", F.lit(0)).alias("soon"), F.coalesce("expired", F.lit(0)).alias("expired"))


def latest(writes: DataFrame) -> DataFrame:
    """D-06: the last write of each (session_id, scratch_key); equal instants go to the greater value."""
    cols = [c for c in writes.columns if c not in ("session_id", "scratch_key")]
    return writes.groupBy("session_id", "scratch_key").agg(F.max_by(F.struct(*cols), F.struct("updated_at", "value")).alias("b")).select("session_id", "scratch_key", "b.*")


def purge(rows: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D-06: (what is left, how many went) after the sessions' rows are removed."""
    return rows.join(sessions.select("session_id"), "session_id", "left_anti"), rows.join(sessions.select("session_id"), "session_id", "left_semi").agg(F.count(F.lit(1)).alias("purged"))


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-05, D-22: merged sessions: the old end stays, ``in_progress`` replaces nothing, counters never fall."""
    cols = [c for c in old.columns if c != "session_id"]
    o, n = old.select("session_id", F.struct(*cols).alias("o")), new.select("session_id", F.struct(*cols).alias("n"))

    def merged(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "outcome":
            return F.when(b.isNull() | ((b == "in_progress") & a.isNotNull()), a).otherwise(b)
        if c.endswith("_count") or c == "cost_usd":
            return F.greatest(a, b)
        return F.coalesce(a, b)

    return o.join(n, "session_id", "full").select("session_id", *[merged(c).alias(c) for c in cols])


def current_leases(leases: DataFrame, now: Column) -> DataFrame:
    """S-29: the unsuperseded lease of each client, and whether it has expired."""
    return leases.where("superseded_at is null").select("client_id", "lease_id", "generation", (F.col("expires_at") < now).alias("expired"))


def acquire(leases: DataFrame, requests: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """D-09: (client_id, granted, generation): a client without a current lease, or with an expired one, gets the next generation."""
    held = current_leases(leases, now).select("client_id", F.col("expired").alias("_expired"))
    top = leases.groupBy("client_id").agg(F.max("generation").alias("_top"))
    joined = requests.select("client_id").distinct().join(held, "client_id", "left").join(top, "client_id", "left")
    granted = F.coalesce("_expired", F.lit(True))
    return joined.select("client_id", granted.alias("granted"), (F.coalesce("_top", F.lit(0)) + granted.cast("long")).alias("generation"))


def fenced(writes: DataFrame, leases: DataFrame) -> DataFrame:
    """D-10: writes (client_id, generation, ...) whose generation is the client's current one."""
    now = leases.where("superseded_at is null").select("client_id", "generation")
    return writes.join(now, ["client_id", "generation"], "left_semi")


def unguarded(writes: DataFrame, runs: DataFrame) -> DataFrame:
    """D-11: writes of clients without a running run."""
    return writes.join(runs.where("status = 'running'").select("client_id"), "client_id", "left_anti")


def admitted_outcomes(outcomes: DataFrame, retrievals: DataFrame) -> DataFrame:
    """D-08, J-30: the first outcome of each (procedure, session) that retrieved it before."""
    seen = retrievals.select("procedure_id", "session_id").distinct()
    own = outcomes.join(seen, ["procedure_id", "session_id"], "left_semi")
    return own.groupBy("procedure_id", "session_id").agg(F.min_by(F.struct("outcome_id", "outcome", "recorded_at"), F.struct("recorded_at", "outcome_id")).alias("b")).select("procedure_id", "session_id", "b.*")


def delta(outcome: Column, success: float = SUCCESS, failure: float = FAILURE) -> Column:
    """F-19; an abandoned session moves nothing."""
    return F.when(outcome == "succeeded", success).when(outcome == "failed", -failure).otherwise(0.0)


def clamp(x: Column) -> Column:
    """F-18."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


#: Standings are whole numbers of this part of one, so sums of steps are exact and rounded alike in any order.
UNIT = 1_000_000


def clamped(step: tuple[int, int, int], x: int) -> int:
    shift, low, high = step
    return max(low, min(high, x + shift))


def after(first: tuple[int, int, int], then: tuple[int, int, int]) -> tuple[int, int, int]:
    """Clamped steps (shift, low, high) one after the other are one clamped step."""
    return first[0] + then[0], max(then[1], min(then[2], first[1] + then[0])), max(then[1], min(then[2], first[2] + then[0]))


def standing_changes(outcomes: DataFrame, initial: float = INITIAL) -> DataFrame:
    """D-08, A-09: (procedure_id, outcome_id, prior_value, new_value) for every outcome that moved a procedure's standing.

    Each step is rounded to 6 places. Outcomes are dealt by ranges of (procedure, instant, id), so one procedure may
    have any number of them: each range adds up its first and last procedure to one clamped step, the steps of a
    procedure that ranges cut are put together on the driver, two for each range at most, and each range then starts
    from the standing that the ranges before have left.
    """
    moved = F.round(delta(F.col("outcome")) * UNIT).cast("long").alias("d")
    rows = outcomes.select("procedure_id", "recorded_at", "outcome_id", moved).where("d <> 0")
    order = ["procedure_id", "recorded_at", "outcome_id"]
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("procedure_id", "outcome_id", "d").withColumn("part", F.spark_partition_id()))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list = []
        for batch in batches:
            for own, d, part in zip(batch["procedure_id"], batch["d"], batch["part"]):
                if not ends or ends[-1][1] != own:
                    ends = [*ends[:1], (part, own, (0, 0, UNIT))]
                ends[-1] = (part, own, after(ends[-1][2], (d, 0, UNIT)))
        yield pd.DataFrame([(p, own, *step) for p, own, step in ends], columns=["part", "procedure_id", "shift", "low", "high"])

    start, entry = round(initial * UNIT), {}
    left: dict[int, int] = {}
    for r in sorted(ranged.mapInPandas(steps, "part int, procedure_id long, shift long, low long, high long").collect(), key=lambda r: r.part):
        entry[r.part, r.procedure_id] = left.get(r.procedure_id, start)
        left[r.procedure_id] = clamped((r.shift, r.low, r.high), entry[r.part, r.procedure_id])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        procedure, value = object(), start
        for batch in batches:
            before, now = [], []
            for own, d, part in zip(batch["procedure_id"], batch["d"], batch["part"]):
                if own != procedure:
                    procedure, value = own, entry.get((part, own), start)
                before.append(value)
                value = clamped((d, 0, UNIT), value)
                now.append(value)
            out = pd.DataFrame({"procedure_id": batch["procedure_id"], "outcome_id": batch["outcome_id"], "prior_value": before, "new_value": now})
            out = out[out["prior_value"] != out["new_value"]]
            yield out.assign(prior_value=out["prior_value"] / UNIT, new_value=out["new_value"] / UNIT)

    return ranged.mapInPandas(fold, "procedure_id long, outcome_id long, prior_value double, new_value double")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """A-09: every class for every procedure, with zeros."""
    counts = outcomes.groupBy("procedure_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME_CLASSES])
    return counts.select("procedure_id", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in OUTCOME_CLASSES])))


def tier_counts(tables: dict[str, list[DataFrame]]) -> DataFrame:
    """A-10: rows in each tier, a sum over its tables."""
    out = None
    for tier, frames in tables.items():
        for f in frames:
            n = f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(tier).alias("tier"), "n")
            out = n if out is None else out.unionAll(n)
    return out.groupBy("tier").agg(F.sum("n").alias("n"))


def highest_generation(leases: DataFrame, floor: int = 0) -> DataFrame:
    """A-11."""
    return leases.agg(F.coalesce(F.max("generation"), F.lit(floor)).cast("long").alias("generation"))
