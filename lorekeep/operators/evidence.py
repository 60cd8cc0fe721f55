"""Evidence of erasure runs: certificates as canonical documents, their verification, and composed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import history

KINDS = ("hard_delete", "retained", "surgical_redaction")


def canonical_object(**fields: Column) -> Column:
    """F-21 as an expression over flat fields: sorted keys, no spaces, quoted values, explicit nulls."""
    escaped = lambda c: F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1")
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), escaped(fields[k]), F.lit('"')), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def certificates(runs: DataFrame, clients: DataFrame, dispositions: DataFrame, bindings: DataFrame, leases: DataFrame) -> DataFrame:
    """C-08, A-16: (run_id, document, digest), one canonical document for each run from counts that tasks make.

    Counts before are those of dispositions that named the client and of claims still live; counts after are the latter.
    """
    counts = dispositions.groupBy("run_id").agg(*[F.count_if(F.col("disposition") == k).alias(k) for k in KINDS])
    named = dispositions.select("run_id", F.explode("bindings_before").alias("slug")).groupBy("run_id", "slug").agg(F.count(F.lit(1)).alias("named"))
    live = history.current(bindings).groupBy("client_id").agg(F.count(F.lit(1)).alias("live"))
    generation = leases.where("superseded_at is null").select("client_id", "generation")
    rows = runs.join(clients.select("client_id", "slug"), "client_id").join(counts, "run_id", "left").join(named, ["run_id", "slug"], "left")
    rows = rows.join(live, "client_id", "left").join(generation, "client_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    fields = {k: zero(F.col(k)) for k in KINDS} | {
        "after": zero(F.col("live")), "before": zero(F.col("named")) + zero(F.col("live")), "client": F.col("slug"),
        "generation": F.col("generation"), "run": F.col("run_id"), "status": F.col("status"),
    }
    out = rows.select("run_id", "client_id", canonical_object(**fields).alias("document"))
    return out.withColumn("digest", F.sha2("document", 256))


def verify(certificates: DataFrame, dispositions: DataFrame, bindings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """C-09: for each certificate whether its digest holds, its live count still does, and how many hard-deleted artifacts survive."""
    live = history.current(bindings).groupBy("client_id").agg(F.count(F.lit(1)).alias("_live"))
    deleted = dispositions.where("disposition = 'hard_delete'").select("run_id", "artifact_id")
    left = deleted.join(artifacts.select("artifact_id"), "artifact_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("_left"))
    rows = certificates.join(live, "client_id", "left").join(left, "run_id", "left")
    stated = F.get_json_object("document", "$.after").cast("long")
    return rows.select(
        "run_id",
        (F.col("digest") == F.sha2("document", 256)).alias("digest_holds"),
        (stated == F.coalesce("_live", F.lit(0))).alias("count_holds"),
        F.coalesce("_left", F.lit(0)).alias("survivors"),
    )


def extend(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """C-05: candidates and the included findings, whose reason is their own; a candidate keeps the reason it has."""
    new = findings.where("included").select(F.lit("derived_artifact").alias("artifact_kind"), "artifact_id", F.lit(None).cast("string").alias("content_digest"), F.lit("semantic_residue").alias("selection_reason"))
    new = new.join(candidates.where("artifact_kind = 'derived_artifact'").select("artifact_id"), "artifact_id", "left_anti")
    return candidates.unionByName(new)


def fleet(session: DataFrame, clients: DataFrame, found: DataFrame) -> DataFrame:
    """C-13: sessions, running sessions, cost and matches of each client."""
    s = session.groupBy("client_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("outcome") == "in_progress").alias("running"), F.sum("cost_usd").cast("double").alias("cost"))
    m = found.groupBy("client_id").agg(F.count(F.lit(1)).alias("matches"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return clients.select("client_id", "slug").join(s, "client_id", "left").join(m, "client_id", "left").select("client_id", "slug", zero("sessions"), zero("running"), F.coalesce("cost", F.lit(0.0)).alias("cost"), zero("matches"))


def procedures(artifacts: DataFrame, retrievals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """C-13: each procedure's standing with its retrievals and outcomes."""
    r = retrievals.groupBy("procedure_id").agg(F.count(F.lit(1)).alias("retrievals"))
    o = outcomes.groupBy("procedure_id").agg(F.count_if(F.col("outcome") == "succeeded").alias("succeeded"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    rows = artifacts.where("kind = 'learned_procedure'").select(F.col("artifact_id").alias("procedure_id"), "confidence")
    joined = rows.join(r, "procedure_id", "left").join(o, "procedure_id", "left")
    return joined.select("procedure_id", "confidence", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("retrievals", "succeeded", "failed")])


def session_detail(session: DataFrame, ledger: DataFrame) -> DataFrame:
    """C-13: each session with its events by category (a map), its last event and what it cost."""
    by = ledger.groupBy("session_id", "category").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("seq", "event_id")).alias("last"))
    one = by.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"), F.sum("n").alias("events"), F.max("last").alias("last")
    )
    head = session.select("session_id", "client_id", "outcome", F.col("cost_usd").cast("double").alias("cost"))
    return head.join(one, "session_id", "left").select("session_id", "client_id", "outcome", "cost", F.coalesce("events", F.lit(0)).alias("events"), "categories", F.col("last.event_id").alias("last_event"))
