"""Structured Streaming queries, run to the end of what is there."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.changes import change_source
from ..streaming import trailing, watch
from .pipelines import POLICY, RULES, mutations
from .registry import query


@query("st01_policy_watch", "SELECT event_id, rule_id, action FROM met WHERE rule_id IN (1, 3, 4, 5, 6, 7)", **POLICY)
def _(t):
    static = [r for r in RULES if r.match_kind != "error_rate"]
    source = watch.as_stream(mutations(t).drop("expires_at"), "mutations", 8)
    return watch.drain(watch.policy_stream(source, t.session, static), "matches").select("event_id", "rule_id", "action")


@query("st09_working_state", "SELECT session_id, scratch_key, count(*) AS writes, arg_max(value, {'at': updated_at, 'v': value}) AS value FROM working_memory GROUP BY session_id, scratch_key")
def _(t):
    source = watch.as_stream(t.working_memory, "writes", 4)
    return watch.drain(watch.working_stream(source), "working", "complete").select("session_id", "scratch_key", "writes", "value")


@query("st10_window_counts", "SELECT epoch_us(date_trunc('hour', occurred_at)) AS window_us, client_id, count(*) AS n FROM ledger GROUP BY 1, 2")
def _(t):
    source = watch.as_stream(t.ledger.select("event_id", "client_id", F.col("occurred_at")), "ledger", 4)
    found = watch.drain(watch.window_stream(source), "windows", "complete")
    return found.select(watch.micros_of("window_start").alias("window_us"), "client_id", "n")


@query("st04_policy_in_order", "SELECT event_id, rule_id, action, governing FROM met", **POLICY)
def _(t):
    source = watch.as_stream(mutations(t).drop("expires_at"), "mutations", 8)
    found = watch.drain(trailing.trailing_stream(source, t.session, RULES, timedelta(days=4000)), "in-order")
    return found.select("event_id", "rule_id", "action", "governing")


@query(
    "st09_live_rows",
    """SELECT session_id, scratch_key, value FROM (SELECT session_id, scratch_key, max(updated_at) AS newest, arg_max(value, {'at': updated_at, 'v': value}) AS value
      FROM working_memory GROUP BY session_id, scratch_key) WHERE newest + INTERVAL '7 hours 30 seconds' > (SELECT max(updated_at) FROM working_memory) - INTERVAL 1 HOUR""",
)
def _(t):
    source = watch.as_stream_in_time(t.working_memory, "writes", "updated_at", 4)
    changes = watch.drain(trailing.live_stream(source, timedelta(hours=7, seconds=30)), "live")
    return trailing.standing(changes).select("session_id", "scratch_key", "value")


#: The log as a feed: after every thousandth event a promise that nothing before it is to come.
FEED = """SELECT epoch_us(occurred_at) AS recorded_us, event_id * 2 AS id, client_id, false AS resolved FROM ledger
  UNION ALL SELECT epoch_us(occurred_at), event_id * 2 + 1, NULL, true FROM ledger WHERE event_id % 1000 = 500"""


def feed(t) -> str:
    """Rows of the log and promises, written to the shared folder as a log grows: files follow its instants, the rows of a minute lie in reverse."""
    at = watch.micros_of("occurred_at").alias("recorded_us")
    rows = t.ledger.select(at, (F.col("event_id") * 2).alias("id"), "client_id", F.lit(False).alias("resolved"))
    promises = t.ledger.where("event_id % 1000 = 500").select(at, (F.col("event_id") * 2 + 1).alias("id"), F.lit(None).cast("long").alias("client_id"), F.lit(True).alias("resolved"))
    path = shared_folder(t.spark, "feed")
    ranged = rows.union(promises).repartitionByRange("recorded_us", "id").sortWithinPartitions(F.floor(F.col("recorded_us") / 60_000_000), F.desc("id"))
    ranged.write.option("maxRecordsPerFile", 100_000).parquet(path)
    return path


#: Batches of a trigger: Spark's own work for one takes longer than 4,000 rows.
AT_ONCE = 64


@query("st02_feed_to_last_promise", "SELECT id, client_id FROM feed WHERE NOT resolved AND (recorded_us, id) <= (SELECT max((recorded_us, id)) FROM feed WHERE resolved)", feed=FEED)
def _(t):
    source = change_source(t.spark, feed(t), "feed", limit=4000, batches=AT_ONCE)
    return watch.drain(source, "feed-rows", once=False).where("NOT resolved").select("id", "client_id")


@query("st02_polled_rows", "SELECT id, client_id FROM feed WHERE NOT resolved", feed=FEED)
def _(t):
    source = change_source(t.spark, feed(t), "poll", limit=4000, batches=AT_ONCE)
    return watch.drain(source, "poll-rows", once=False).where("NOT resolved").select("id", "client_id")
