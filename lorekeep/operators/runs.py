"""Erasure runs as they are applied: lifecycle, redaction with its consequences, stored evidence, embedding state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from . import erasure, history, upkeep
from .providers import embed, width_gate
from .recall import clamp

#: States of a text's embedding, and of a stored certificate (fixed values).
STATES = ("pending", "embedded", "not_required")
FINAL = ("completed", "aborted")
SWEEP_LEAST, SWEEP_MOST = 1, 10_000


def headers(runs: DataFrame, clients: DataFrame) -> DataFrame:
    """J-02: runs with the slug of their client."""
    return runs.join(clients.select("client_id", "slug"), "client_id").select("run_id", "slug", "status", "started_at", "finished_at")


def begin(runs: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """D-16: (runs, answers). A request (run_id, client_id, idempotency_key) begins a run, unless its key has one already.

    Of requests with one key in a batch the least run_id begins; ``answers`` (idempotency_key, run_id, replayed) name the
    run that each key has. Requests without a key are refused.
    """
    first = requests.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min_by(F.struct("run_id", "client_id"), "run_id").alias("r"))
    known = runs.select("idempotency_key", F.col("run_id").alias("_known"))
    judged = first.join(known, "idempotency_key", "left")
    answers = judged.select("idempotency_key", F.coalesce("_known", "r.run_id").alias("run_id"), F.col("_known").isNotNull().alias("replayed"))
    new = judged.where("_known is null").select("r.run_id", "r.client_id", "idempotency_key", F.lit("running").alias("status"), now.alias("started_at"))
    return runs.unionByName(new, allowMissingColumns=True), answers


def finalise(runs: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """D-16: (runs, answers). A result (run_id, status) ends a running run once; later ones are answered with what stands.

    ``answers``: run_id, status, outcome (finalised, replayed, unknown_run, bad_status). Of several results for a run
    in one batch the least status counts.
    """
    asked = results.groupBy("run_id").agg(F.min("status").alias("_asked"))
    joined = asked.join(runs.select("run_id", "status"), "run_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "unknown_run").when(F.col("status") != "running", "replayed").when(~F.col("_asked").isin(*FINAL), "bad_status").otherwise("finalised")
    )
    judged = joined.withColumn("outcome", outcome)
    answers = judged.select("run_id", F.when(F.col("outcome") == "finalised", F.col("_asked")).otherwise(F.col("status")).alias("status"), "outcome")
    ended = judged.where("outcome = 'finalised'").select("run_id", "_asked")
    out = runs.join(ended, "run_id", "left").withColumns({"status": F.coalesce("_asked", "status"), "finished_at": F.when(F.col("_asked").isNotNull(), now).otherwise(F.col("finished_at"))})
    return out.select(*runs.columns), answers


def orphaned_parent_edges(edges: DataFrame, bindings: DataFrame, client: int, children: DataFrame) -> DataFrame:
    """J-16: edges of ``children`` (artifact_id) whose parent is bound to the erased client alone."""
    alone = erasure.orphaned(bindings, client)
    own = edges.where("parent_kind = 'derived_artifact'").join(children, F.col("child_id") == F.col("artifact_id"), "left_semi")
    return own.join(alone, F.col("parent_id") == F.col("artifact_id"), "left_semi")


def redact(artifacts: DataFrame, embedding: DataFrame, edges: DataFrame, bindings: DataFrame, rewrites: DataFrame, client: int, now: Column, provider: Callable | None = None) -> dict[str, DataFrame]:
    """D-13: the tables after ``rewrites`` (artifact_id, pre_digest, new_body), each of which counts only while its digest holds.

    A redacted artifact has a new body, digest and revision; its vector is replaced by one of the new body, its edges
    to parents of the erased client alone go, and the client's claim on it closes.
    """
    after = saved(erasure.redact(artifacts, rewrites))
    changed = saved(after.where("removed is not null").select("artifact_id", "body"))
    vectors = embed(changed, "body", "vec", provider).select("artifact_id", F.col("vec").cast(embedding.schema["vec"].dataType).alias("_vec"))
    renewed = embedding.join(vectors, "artifact_id", "left").withColumn("vec", F.coalesce("_vec", "vec")).select(*embedding.columns)
    gone = orphaned_parent_edges(edges, bindings, client, changed.select("artifact_id")).select("edge_id")
    pairs = changed.select("artifact_id", F.lit(client).cast("long").alias("client_id"))
    return {
        "derived_artifact": after.select(*artifacts.columns),
        "embedding": renewed,
        "lineage_edge": edges.join(gone, "edge_id", "left_anti"),
        "client_binding": history.withdraw(bindings, pairs, now),
    }


def planned(artifacts: DataFrame, decided: DataFrame, rewrites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C-06: (decisions, rewrites that hold) of a run, before anything is applied; a dry run is this and nothing more.

    Artifacts to be redacted that have no rewrite whose digest holds are deleted: what can't be rewritten doesn't stay.
    """
    digest = artifacts.select("artifact_id", F.col("content_digest").alias("pre_digest"))
    good = saved(rewrites.join(digest, ["artifact_id", "pre_digest"], "left_semi"))
    kind = F.col("artifact_kind") == "derived_artifact"
    torn = decided.join(good.select("artifact_id", F.lit(True).alias("_good")).distinct(), "artifact_id", "left")
    failed = (F.col("disposition") == "surgical_redaction") & kind & F.col("_good").isNull()
    final = torn.withColumns({"reason": F.when(failed, "rewrite_failed").otherwise(F.col("reason")), "disposition": F.when(failed, "hard_delete").otherwise(F.col("disposition"))})
    return saved(final.select("artifact_kind", "artifact_id", "selection_reason", "disposition", "reason")), good


def apply(tables: dict[str, DataFrame], decided: DataFrame, rewrites: DataFrame, client: int, generation: int, now: Column, provider: Callable | None = None) -> dict[str, DataFrame]:
    """C-05: all tables after a decided run, and its evidence (``disposition``), see ``planned``. Nothing is written by it.

    ``tables`` by name: derived_artifact, client_binding, lineage_edge, embedding, ledger, session, working_memory,
    erasure_lease. The client must hold the lease at ``generation``, else the run is refused.
    """
    held = upkeep.fenced(tables["session"].sparkSession.createDataFrame([(client, generation)], "client_id long, generation long"), tables["erasure_lease"])
    if held.isEmpty():
        raise PermissionError(f"client {client} does not hold its lease at generation {generation}")
    final, good = planned(tables["derived_artifact"], decided, rewrites)
    sessions = tables["session"].where(F.col("client_id") == client)
    left = erasure.delete(final, *[tables[n] for n in ("derived_artifact", "client_binding", "lineage_edge", "embedding", "ledger", "session")])
    chosen = final.where("disposition = 'surgical_redaction' AND artifact_kind = 'derived_artifact'").select("artifact_id")
    redacted = redact(left["derived_artifact"], left["embedding"], left["lineage_edge"], left["client_binding"], good.join(chosen, "artifact_id", "left_semi"), client, now, provider)
    return left | redacted | {"working_memory": upkeep.purge(tables["working_memory"], sessions)[0], "disposition": final}


def insert_once(store: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """D-19, D-20: rows of ``store``, and those of ``new`` whose keys it lacks; of several with one key, one."""
    return store.unionByName(new.dropDuplicates(list(keys)).join(store.select(*keys), list(keys), "left_anti"))


def latest_checkpoint(store: DataFrame, moments: DataFrame) -> DataFrame:
    """O-09: for each instant ``at`` the last checkpoint (window_end, root_digest) at or before it; none leaves nulls.

    Instants and checkpoints stand in one order, and each instant takes the last checkpoint before it: a window over days,
    whose last checkpoints pass on to the days without one.
    """
    c = store.select(F.col("window_end").alias("at"), F.struct("window_end", "root_digest").alias("c"), F.lit(0).alias("side"))
    m = moments.select("at", F.lit(None).cast(c.schema["c"].dataType).alias("c"), F.lit(1).alias("side")).distinct()
    both = c.union(m).withColumn("day", F.date_trunc("day", "at"))
    days = both.groupBy("day").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("at"))).alias("last"))
    before = days.select("day", F.last("last", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row a day
    own = F.last("c", ignorenulls=True).over(Window.partitionBy("day").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("own", own).where("side = 1").join(before, "day").withColumn("f", F.coalesce("own", "before"))
    return found.select("at", "f.window_end", "f.root_digest")


def storage_status(certificates: DataFrame, reports: DataFrame) -> DataFrame:
    """D-20: a certificate's storage status moves from pending to what is reported (run_id, storage_status), once."""
    told = reports.groupBy("run_id").agg(F.min("storage_status").alias("_told"))
    joined = certificates.join(told, "run_id", "left")
    return joined.withColumn("storage_status", F.when(F.col("storage_status") == "pending", F.coalesce("_told", "storage_status")).otherwise(F.col("storage_status"))).select(*certificates.columns)


def write_with_vectors(artifacts: DataFrame, vectors: DataFrame, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """D-23: (artifacts with ``embedding_state``, their vectors): both come from one join, so a state is embedded just where a vector is.

    ``vectors``: artifact_id, vec. Vectors of artifacts that are not written are left out. With a ``width`` the first
    vector of another one fails the whole write (V-07).
    """
    vectors = vectors if width is None else width_gate(vectors, "vec", width)
    own = vectors.groupBy("artifact_id").agg(F.first("vec", ignorenulls=True).alias("vec"))
    joined = saved(artifacts.join(own, "artifact_id", "left"))
    empty = F.coalesce(F.col("body"), F.lit("")) == ""
    state = F.when(F.col("vec").isNotNull(), "embedded").when(empty, "not_required").otherwise("pending")
    return joined.select(*artifacts.columns, state.alias("embedding_state")), joined.where("vec is not null").select("artifact_id", "vec")


def embedded(artifacts: DataFrame, embedding: DataFrame, written: DataFrame, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """D-07: (artifacts, embedding) after vectors (artifact_id, vec) are written: one for each artifact, the first stays; pending turns to embedded."""
    written = written if width is None else width_gate(written, "vec", width)
    both = insert_once(embedding.select("artifact_id", "vec"), written.where("vec is not null").select("artifact_id", "vec"), "artifact_id")
    there = both.select("artifact_id", F.lit(True).alias("_there"))
    moved = artifacts.join(there, "artifact_id", "left")
    state = F.when((F.col("embedding_state") == "pending") & F.col("_there"), "embedded").otherwise(F.col("embedding_state"))
    return moved.withColumn("embedding_state", state).select(*artifacts.columns), both


def pending(artifacts: DataFrame, limit: int = 100) -> DataFrame:
    """O-07: artifacts whose vector is owed, the oldest first; ``limit`` is clamped to 1 .. 10,000."""
    return artifacts.where("embedding_state = 'pending'").orderBy("created_at", "artifact_id").limit(clamp(limit, SWEEP_LEAST, SWEEP_MOST))


def known_states(rows: DataFrame, state_col: str = "embedding_state") -> tuple[DataFrame, DataFrame]:
    """P-15: (rows of a known state, the others). Null is unknown."""
    good = F.coalesce(F.col(state_col).isin(*STATES), F.lit(False))
    return rows.where(good), rows.where(~good)


def axis_values(grid: DataFrame) -> DataFrame:
    """A-22: (axis, value), the distinct thresholds of a sensitivity grid."""
    return grid.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("auto", "review")]))).distinct()


def permitted_union(*lists: Column) -> Column:
    """U-06: the members of several lists, each once, in the order in which they first come; null lists are empty."""
    none = F.array().cast("array<long>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def reset(tables: dict[str, tuple[DataFrame, Column]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """D-17: (what is left, counts) after each table loses its rows for which its condition holds, in the tables' order.

    ``counts``: place, name, n. A null condition removes nothing.
    """
    left, counts = {}, None
    for place, (name, (rows, condition)) in enumerate(tables.items()):
        gone = F.coalesce(condition, F.lit(False))
        left[name] = rows.where(~gone)
        n = rows.agg(F.count_if(gone).alias("n")).select(F.lit(place).alias("place"), F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.union(n)
    return left, counts
