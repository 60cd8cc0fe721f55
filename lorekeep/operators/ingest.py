"""Capture: event batches in NDJSON, rejects, spools, tool-call pairing, workspaces, and metric admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import in_ranges, numbered, with_base

#: Wire fields (fixed values), with those that may be left out last.
REQUIRED = ("agent_cli", "category", "client_id", "id", "machine_id", "occurred_at", "payload", "redacted", "session_id")
OPTIONAL = ("parent_event_id", "text_body")
CATEGORIES = (
    "approval", "attribution_superseded", "compaction", "cost_record", "error", "file_read", "file_write", "model_request", "model_response",
    "prompt", "recall", "response", "session_end", "session_start", "shell_command", "tool_call", "tool_result",
)


def parse_batch(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """S-08, S-09, P-10: (value, reason, event fields); reason is null for an accepted line, and no line fails the batch.

    Reasons in order: not_json, not_object, unknown_field, missing_field, bad_category, naive_instant. Blank lines are not
    records. Python is not needed: variants answer what a line has.
    """
    text = F.col(line_col)
    rows = lines.where(F.trim(text) != "").withColumn("_v", F.try_parse_json(text))
    keys = F.coalesce(F.json_object_keys(F.when(F.schema_of_variant("_v").startswith("OBJECT"), text)), F.array().cast("array<string>"))
    rows = rows.withColumn("_keys", keys)
    get = lambda f: F.try_variant_get("_v", f"$.{f}", "string")
    known = F.array(*[F.lit(f) for f in REQUIRED + OPTIONAL])
    reason = (
        F.when(F.col("_v").isNull(), "not_json")
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_object")
        .when(F.size(F.array_except("_keys", known)) > 0, "unknown_field")
        .when(F.size(F.array_except(F.array(*[F.lit(f) for f in REQUIRED]), F.col("_keys"))) > 0, "missing_field")
        .when(~F.coalesce(get("category").isin(*CATEGORIES), F.lit(False)), "bad_category")
        .when(~F.coalesce(get("occurred_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit(False)), "naive_instant")
    )
    fields = [get(f).alias(f) for f in REQUIRED + OPTIONAL]
    return rows.select(*[F.col(c) for c in lines.columns], reason.alias("reason"), *fields)


def to_line(events: DataFrame) -> Column:
    """S-09: the wire record of an event: its fields in order of name, optional ones only where they are not null."""
    present = [c for c in sorted(REQUIRED + OPTIONAL) if c in events.columns]
    return F.to_json(F.struct(*present))


def embedding_state(text: Column) -> Column:
    """P-14: text waits for a vector; an empty text is none."""
    return F.when(F.coalesce(text, F.lit("")) != "", "pending").otherwise("not_required")


def tally(parsed: DataFrame) -> DataFrame:
    """A-18: lines by reason; accepted lines are their own class, so the counts add up to the batch."""
    return parsed.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def implied_sessions(events: DataFrame) -> DataFrame:
    """A-19: the first identity and the earliest instant of each session in a batch."""
    order = F.struct("occurred_at", "event_id")
    return events.groupBy("session_id").agg(F.min_by("client_id", order).alias("client_id"), F.min("occurred_at").alias("started_at"))


def bounded_tail(lines: DataFrame, order: str, line_col: str, max_bytes: int) -> DataFrame:
    """S-10, W-05: the newest whole lines whose bytes, with a line break each, stay within the bound.

    Rows are ranged by ``order``; a range knows the bytes of the ranges after it, so no task ranks the whole spool.
    """
    return tailed(lines, order, line_col, max_bytes).where("_kept").drop("_kept", "_bytes")


def tailed(lines: DataFrame, order: str, line_col: str, max_bytes: int) -> DataFrame:
    size = F.coalesce(F.octet_length(line_col), F.lit(0)) + 1
    based = with_base(in_ranges(lines, [order]), size, backwards=True)
    own = F.sum(size).over(Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return based.withColumns({"_kept": F.col("_base") + own <= max_bytes, "_bytes": size}).select(*lines.columns, "_kept", "_bytes")


def spool_sums(lines: DataFrame, order: str, line_col: str, max_bytes: int) -> DataFrame:
    """A-20: lines and bytes that the bound keeps and discards."""
    rows = tailed(lines, order, line_col, max_bytes)
    of = lambda kept: [F.count_if(kept), F.coalesce(F.sum(F.when(kept, F.col("_bytes"))), F.lit(0))]
    names = ["kept_lines", "kept_bytes", "discarded_lines", "discarded_bytes"]
    return rows.agg(*[c.cast("long").alias(n) for c, n in zip([*of(F.col("_kept")), *of(~F.col("_kept"))], names)])


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """O-06: a batch number for every ``size`` rows in order."""
    empty = rows.sparkSession.createDataFrame([], "_n long")
    ranked = numbered(rows, order, "_n", empty)
    return ranked.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def pair_calls(events: DataFrame) -> DataFrame:
    """J-23, ST-11: (session_id, result_id, call_id): each result takes the latest waiting call of its correlation, else of its tool, else the latest.

    ``events``: session_id, seq, event_id, category (tool_call or tool_result), tool, correlation. What waits depends on
    all results before, so a session's rows are walked in order; only the calls still waiting are in memory.
    """
    rows = events.where(F.col("category").isin("tool_call", "tool_result")).select("session_id", "seq", "event_id", "category", "tool", "correlation")
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "seq", "event_id")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, waiting = object(), []
        for batch in parts:
            out = []
            for r in batch.itertuples(index=False):
                if r.session_id != session:
                    session, waiting = r.session_id, []
                if r.category == "tool_call":
                    waiting.append((r.event_id, r.tool, r.correlation))
                    continue
                pick = None
                for same in (lambda w: w[2] == r.correlation and r.correlation is not None, lambda w: w[1] == r.tool and r.tool is not None, lambda w: True):
                    pick = next((i for i in range(len(waiting) - 1, -1, -1) if same(waiting[i])), None)
                    if pick is not None:
                        break
                out.append((r.session_id, r.event_id, waiting.pop(pick)[0] if pick is not None else None))
            yield pd.DataFrame(out, columns=["session_id", "result_id", "call_id"]).astype({"call_id": "Int64"})

    return dealt.mapInPandas(walk, "session_id long, result_id long, call_id long")


def workspace_clients(sessions: DataFrame, roots: DataFrame, path_col: str = "workspace_path", default: int = -1) -> DataFrame:
    """J-24: the client of the longest root (root, root_client) that holds a workspace; ``default`` without one.

    A workspace is joined by each of its own ancestors, so the join is an equi-join and no pair is tried in vain.
    """
    parts = F.split(F.regexp_replace(path_col, "/+$", ""), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = sessions.select("session_id", F.explode(ancestors).alias("root"))
    found = tried.join(roots, "root").groupBy("session_id").agg(F.max_by("root_client", F.char_length("root")).alias("root_client"))
    return sessions.join(found, "session_id", "left").select("session_id", path_col, F.coalesce("root_client", F.lit(default)).alias("root_client"))


def admit_metrics(metrics: DataFrame, most: int = 10) -> DataFrame:
    """F-33, S-22: the first ``most`` distinct dimensions of each metric stay; the rest are added up as one named other."""
    first = metrics.groupBy("name", "dims").agg(F.min("at").alias("_first"))
    ranked = first.withColumn("_place", F.row_number().over(Window.partitionBy("name").orderBy("_first", "dims")))
    kept = ranked.where(F.col("_place") <= most).select("name", "dims", F.lit(True).alias("_kept"))
    joined = metrics.join(kept, ["name", "dims"], "left")
    return joined.groupBy("name", F.when(F.col("_kept").isNotNull(), F.col("dims")).otherwise("other").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
