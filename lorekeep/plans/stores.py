"""Queries over versions as of an instant, drains with retries, stated roots and ended sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chain, runs, upkeep
from ..operators.versions import VersionStore
from ..session import shared_folder
from ..sources.spool import Spool
from ..sources.tables import micros
from ..streaming import watch
from ..streaming.draining import Drain
from .applied import RUN, decisions, over_chain, run
from .pipelines import chained
from .registry import CLIENT, query

#: Three instants of the log, the 5th, 11th at noon and 20th of January 2024 in UTC, the first at the horizon.
MICROS = [1704412800000000, 1704974400000000, 1705708800000000]


@query(
    "s16_versions_at_instants",
    " UNION ALL ".join(
        f"""SELECT {m}::BIGINT AS instant_us, session_id, event_id, category FROM (SELECT * FROM ledger WHERE epoch_us(occurred_at) <= {m}
          QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, seq DESC) = 1) WHERE event_id % 7 <> 0"""
        for m in MICROS
    ),
)
def _(t):
    store = VersionStore(t.spark, shared_folder(t.spark, "versions"), ["session_id"])
    rows = t.ledger.select("session_id", "event_id", "category", "seq", micros("occurred_at").alias("us"))
    for part in range(3):  # writes come in any order, none is changed later
        own = rows.where(F.col("event_id") % 3 == part)
        store.append(own.select("session_id", "event_id", "category", F.col("us").alias("began"), "seq"), F.col("began"), F.col("seq"), F.col("event_id") % 7 == 0)
    store.compact(MICROS[0])
    found = [store.read(m).select(F.lit(m).cast("long").alias("instant_us"), "session_id", "event_id", "category") for m in MICROS]
    return reduce(DataFrame.unionAll, found)


@query(
    "a17_stated_roots",
    over_chain("""SELECT window_us, count(*) AS sessions, sha256('{"sessions":[' || string_agg('{"session_id":"' || session_id || '","terminal_chain_digest":"' || tip || '"}', ',' ORDER BY session_id::VARCHAR) || ']}') AS root_digest
      FROM (SELECT epoch_us(date_trunc('day', occurred_at)) AS window_us, session_id, arg_max(chain_digest, seq) AS tip FROM link GROUP BY ALL) GROUP BY window_us"""),
)
def _(t):
    tips = chain.hourly_tips(chained(t), 24).withColumn("window_us", watch.micros_of("window_start"))
    return chain.stated_root(tips.select("window_us", "session_id", "terminal_digest"), "window_us")


#: A provider that answers some keys at once, some at the third attempt, and some never.
def moody(rows: DataFrame) -> DataFrame:
    able = F.when(F.col("key") % 5 == 0, F.col("attempt") >= 2).when(F.col("key") % 7 == 0, F.lit(False)).otherwise(F.lit(True))
    return rows.where(able).select("key", F.sha2("text", 256).alias("value"))


@query(
    "st07_drained",
    """SELECT artifact_id AS key, CASE WHEN k = 0 THEN 3 WHEN k = 1 THEN 3 ELSE 1 END::INT AS attempts, k <> 1 AS done, k = 1 AS dead, CASE WHEN k <> 1 THEN sha256(body) END AS value
      FROM (SELECT artifact_id, body, CASE WHEN artifact_id % 5 = 0 THEN 0 WHEN artifact_id % 7 = 0 THEN 1 ELSE 2 END AS k FROM derived_artifact WHERE body IS NOT NULL)""",
)
def _(t):
    owed = t.derived_artifact.where("body is not null").select(F.col("artifact_id").alias("key"), F.col("body").alias("text"), micros("created_at").alias("created_us"))
    drain = Drain(t.spark, shared_folder(t.spark, "attempts"), moody, limit=1_000_000)
    queue = shared_folder(t.spark, "owed")
    watch.with_batches(watch.as_stream(owed, "owed-rows", 4), drain.batches(queue), "owed-offsets").awaitTermination()
    drain.finish(t.spark.read.parquet(queue), 2)  # what failed is tried again until it works or is dead
    return drain.standing().select("key", "attempts", "done", "dead", "value")


@query(
    "d22_ended_sessions",
    """SELECT session_id, CASE WHEN session_id % 3 = 0 THEN outcome ELSE 'succeeded' END AS outcome,
      epoch_us(ended_at) AS ended_us, CASE WHEN session_id % 2 = 0 AND session_id % 3 <> 0 THEN error_count + 2 ELSE error_count END AS error_count FROM session""",
)
def _(t):
    ends = t.session.where("session_id % 3 <> 0").withColumns({"outcome": F.lit("succeeded"), "error_count": F.when(F.col("session_id") % 2 == 0, F.col("error_count") + 2).otherwise(F.col("error_count") - 1)})
    return upkeep.upsert_sessions(t.session, ends).select("session_id", "outcome", micros("ended_at").alias("ended_us"), "error_count")


@query(
    "c06_dry_run",
    """SELECT 'would ' || disposition AS what, artifact_kind AS kind, count(*) AS n FROM final GROUP BY ALL
    UNION ALL SELECT 'stands', 'derived_artifact', count(*) FROM derived_artifact UNION ALL SELECT 'stands', 'client_binding', count(*) FROM client_binding
    UNION ALL SELECT 'stands', 'lineage_edge', count(*) FROM lineage_edge UNION ALL SELECT 'stands', 'embedding', count(*) FROM embedding
    UNION ALL SELECT 'stands', 'ledger', count(*) FROM ledger UNION ALL SELECT 'stands', 'session', count(*) FROM session UNION ALL SELECT 'stands', 'working_memory', count(*) FROM working_memory""",
    **RUN,
)
def _(t):
    """C-06: what a run would do, by kind, and every table as it stands: decisions are recorded, nothing is applied."""
    names = ("derived_artifact", "client_binding", "lineage_edge", "embedding", "ledger", "session", "working_memory")
    decided, _ = runs.planned(t.derived_artifact, *decisions(t))
    would = decided.groupBy(F.concat(F.lit("would "), "disposition").alias("what"), F.col("artifact_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    stands = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit("stands").alias("what"), F.lit(n).alias("kind"), "n") for n in names]
    return reduce(DataFrame.unionAll, stands, would)


@query("c05_purged_working", f"SELECT session_id, scratch_key, count(*) AS n FROM working_memory WHERE session_id NOT IN (SELECT session_id FROM session WHERE client_id = {CLIENT}) GROUP BY ALL")
def _(t):
    return run(t)["working_memory"].groupBy("session_id", "scratch_key").agg(F.count(F.lit(1)).alias("n"))


@query("s10_spool_after_writes", "SELECT event_id AS place, payload AS line FROM (SELECT event_id, payload, sum(strlen(payload) + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM ledger WHERE payload IS NOT NULL) WHERE tail <= 50000")
def _(t):
    spool = Spool(t.spark, shared_folder(t.spark, "spool"), 50_000)
    middle = t.ledger.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    lines = t.ledger.select(F.col("event_id").alias("place"), F.col("payload").alias("line"))
    spool.write(lines.where(F.col("place") <= middle))
    spool.write(lines.where(F.col("place") > middle))
    return spool.read()
