"""Staged erasure: what a client's removal selects, what lies near it, what becomes of each, and how much a threshold moves.

Candidates are rows (artifact_kind, artifact_id, content_digest, selection_reason); ids of different kinds may clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import removed_segments
from ..functions.vectors import knn_join
from ..session import saved
from . import graph, history

#: In the order in which the first reason sticks (fixed values).
REASONS = ("session_scope", "event_of_scoped_session", "client_binding", "lineage_descendant", "embedding_of_selected")
AUTO, REVIEW = 0.20, 0.45
AUTO_AXIS, REVIEW_AXIS = (0.10, 0.15, 0.20, 0.25, 0.30), (0.35, 0.40, 0.45, 0.50, 0.55)
FLOOR = 0.15


def first_reason(selected: DataFrame) -> DataFrame:
    """U-05: one row for each key, that of the earliest step."""
    cols = [c for c in selected.columns if c not in ("artifact_kind", "artifact_id", "step")]
    best = F.min_by(F.struct(*cols), "step").alias("b")
    return selected.groupBy("artifact_kind", "artifact_id").agg(best).select("artifact_kind", "artifact_id", "b.*")


def step(rows: DataFrame, n: int, kind: str, key: str, digest: Column | None = None, reason: str | None = None) -> DataFrame:
    digest = digest if digest is not None else F.lit(None).cast("string")
    return rows.select(F.lit(kind).alias("artifact_kind"), F.col(key).alias("artifact_id"), digest.alias("content_digest"), F.lit(reason or REASONS[n]).alias("selection_reason"), F.lit(n).alias("step"))


def scoped(session: DataFrame, ledger: DataFrame, client: int) -> DataFrame:
    """Steps 1 and 2 of the sweep: the client's sessions, and every event of one of them."""
    own = session.where(F.col("client_id") == client)
    return step(own, 0, "session", "session_id").union(step(ledger.join(own.select("session_id"), "session_id", "left_semi"), 1, "event", "event_id"))


def below_floor(artifacts: DataFrame, bindings: DataFrame, client: int, floor: float = FLOOR) -> DataFrame:
    """J-15: the client's procedures of a confidence strictly under the floor."""
    bound = history.current(bindings).where(F.col("client_id") == client).select("artifact_id")
    return artifacts.where((F.col("kind") == "learned_procedure") & (F.col("confidence") < floor)).join(bound, "artifact_id", "left_semi")


def sweep(session, ledger, artifacts, bindings, edges, embedding, client: int, floor: float = FLOOR) -> DataFrame:
    """C-02: everything that a client's removal selects, with the first reason for each."""
    bound = artifacts.select("artifact_id").join(history.current(bindings).where(F.col("client_id") == client), "artifact_id", "left_semi")
    roots = saved(bound.union(below_floor(artifacts, bindings, client, floor).select("artifact_id")).distinct().toDF("node"))
    # events and sessions are roots too: artifacts made from them directly, and what descends from those
    direct = saved(scoped(session, ledger, client))
    made = edges.join(direct, (F.col("parent_kind") == F.col("artifact_kind")) & (F.col("parent_id") == F.col("artifact_id")), "left_semi").select(F.col("child_id").alias("node")).distinct()
    below = made.union(graph.closure(graph.down(edges), roots.union(made))).distinct()
    ids = roots.withColumn("at", F.lit(2)).union(below.withColumn("at", F.lit(3))).groupBy("node").agg(F.min("at").alias("at"))
    # texts are read and digested once, for all steps
    derived = saved(artifacts.select("artifact_id", "content_digest").join(ids, F.col("artifact_id") == F.col("node")).select("artifact_id", "content_digest", "at"))
    so_far = reduce(DataFrame.union, [step(derived.where(F.col("at") == n), n, "derived_artifact", "artifact_id", F.col("content_digest")) for n in (2, 3)])
    vectors = embedding.join(derived.select("artifact_id").distinct(), "artifact_id", "left_semi")
    return first_reason(direct.union(so_far).union(step(vectors, 4, "embedding", "embedding_id")))


def reason_counts(candidates: DataFrame) -> DataFrame:
    """A-01: every reason, with zero where none was selected for it."""
    names = candidates.sparkSession.createDataFrame([(r,) for r in REASONS], "selection_reason string")
    counts = candidates.groupBy("selection_reason").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "selection_reason", "left").select("selection_reason", F.coalesce("n", F.lit(0)).alias("n"))


def run_sessions(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """J-13, W-03, S-32: tip and count of every session that holds a selected event, over the whole session."""
    events = candidates.where("artifact_kind = 'event'").select(F.col("artifact_id").alias("event_id"))
    touched = ledger.join(events, "event_id", "left_semi").select("session_id").distinct()
    return ledger.join(touched, "session_id", "left_semi").groupBy("session_id").agg(F.max("seq").alias("terminal_seq"), F.max_by("event_id", "seq").alias("terminal_event"), F.count(F.lit(1)).alias("row_count"))


def unembedded(candidates: DataFrame, artifacts: DataFrame, ledger: DataFrame, embedding: DataFrame) -> DataFrame:
    """A-12: selected artifacts and events with text of their own but no vector, as one count."""
    chosen = candidates.select("artifact_kind", "artifact_id")
    derived = artifacts.join(chosen.where("artifact_kind = 'derived_artifact'"), "artifact_id", "left_semi").join(embedding, "artifact_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    events = ledger.where("text_body is not null").join(chosen.where("artifact_kind = 'event'"), F.col("event_id") == F.col("artifact_id"), "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return derived.union(events).agg(F.sum("n").alias("unembedded"))


def query_artifacts(candidates: DataFrame, artifacts: DataFrame, embedding: DataFrame, limit: int = 50) -> DataFrame:
    """O-03: selected artifacts with text and a vector, longest first; at most ``limit`` of them (a report's top)."""
    chosen = candidates.where("artifact_kind = 'derived_artifact'").select("artifact_id")
    rows = artifacts.where("body <> ''").join(chosen, "artifact_id", "left_semi").join(embedding.select("artifact_id", "vec"), "artifact_id")
    rows = rows.select("artifact_id", "kind", F.char_length("body").cast("long").alias("length"), "vec")
    return rows.orderBy(F.desc("length"), "artifact_id").limit(limit)


def walk(queries: DataFrame, embedding: DataFrame, candidates: DataFrame, ceiling: float, k: int = 100) -> DataFrame:
    """J-28, J-08, A-23: (artifact_id, query_id, distance), the nearest sighting of every artifact not selected yet.

    The earlier query keeps a tie; queries are in order of length and id, as ``query_artifacts`` gives them.
    """
    ordered = queries.select(F.col("artifact_id").alias("query_id"), F.struct(-F.col("length"), "artifact_id").alias("turn"))
    near = knn_join(embedding.select(F.col("artifact_id").alias("id"), "vec"), queries.select(F.col("artifact_id").alias("id"), "vec"), k, ceiling)
    known = candidates.where("artifact_kind = 'derived_artifact'").select(F.col("artifact_id").alias("id"))
    sighted = near.where("id <> query_id").join(known, "id", "left_anti").join(F.broadcast(ordered), "query_id")  # at most 1000 queries
    best = F.min_by(F.struct("query_id", "distance"), F.struct("distance", "turn"))
    return sighted.groupBy(F.col("id").alias("artifact_id")).agg(best.alias("b")).select("artifact_id", "b.query_id", "b.distance")


def band(found: DataFrame, auto: float = AUTO, verdicts: DataFrame | None = None) -> DataFrame:
    """P-11, C-03: band, included and reason. Without a verdict (artifact_id, classification) a review row is included."""
    near = F.col("distance") <= auto
    if verdicts is None:
        found = found.withColumn("classification", F.lit(None).cast("string"))
    else:
        found = found.join(verdicts.select("artifact_id", "classification"), "artifact_id", "left")
    return found.withColumns(
        {
            "band": F.when(near, "auto_include").otherwise("review"),
            "included": near | ~(F.coalesce("classification", F.lit("include")) == "exclude"),
            "decision_reason": F.when(near, "below_auto_include_threshold").when(F.col("classification").isNull(), "no_verdict_included").otherwise(F.col("classification")),
        }
    )


def merge_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """A-24: the nearer finding's columns, the least distance, included if either was."""
    cols = [c for c in old.columns if c not in ("artifact_id", "included")]
    return old.unionByName(new).groupBy("artifact_id").agg(F.min_by(F.struct(*cols), F.struct("distance", "query_id")).alias("b"), F.bool_or("included").alias("included")).select("artifact_id", "b.*", "included")


def sensitivity(found: DataFrame, planted: DataFrame | None = None, autos=AUTO_AXIS, reviews=REVIEW_AXIS) -> DataFrame:
    """A-15, C-07, W-09: one row for each pair of thresholds, from one walk at the widest ceiling.

    Where auto lies above review every count is null. ``recovered`` counts planted artifacts within review; it is
    null without ``planted`` (artifact_id).
    """
    rows = found.select("artifact_id", "distance")
    rows = rows.withColumn("planted", F.lit(None).cast("boolean")) if planted is None else rows.join(planted.select("artifact_id", F.lit(True).alias("planted")).distinct(), "artifact_id", "left")
    cells = [(a, r) for a in autos for r in reviews]
    sums = []
    for i, (a, r) in enumerate(cells):
        sums += [F.count_if(F.col("distance") <= r).alias(f"c{i}"), F.count_if(F.col("distance") <= a).alias(f"a{i}"), F.count_if((F.col("distance") <= r) & F.col("planted")).alias(f"p{i}")]
    null = F.lit(None).cast("long")
    cell = lambda i, a, r: F.struct(
        F.lit(a).alias("auto"), F.lit(r).alias("review"),
        *[(F.col(x) if a <= r else null).alias(n) for n, x in (("candidates", f"c{i}"), ("auto_included", f"a{i}"))],
        (F.col(f"c{i}") - F.col(f"a{i}") if a <= r else null).alias("referred"),
        (F.col(f"p{i}") if a <= r and planted is not None else null).alias("recovered"),
    )
    return rows.agg(*sums).select(F.inline(F.array(*[cell(i, a, r) for i, (a, r) in enumerate(cells)])))


def classify(candidates: DataFrame, bindings: DataFrame, clients: DataFrame, client: int) -> DataFrame:
    """J-04, A-02: counts of the erased and of other claims on each candidate, and the slugs of all of them."""
    claims = history.current(bindings).join(F.broadcast(clients.select("client_id", "slug")), "client_id").select(F.col("artifact_id").alias("_a"), "client_id", "slug")  # the roster of tenants
    joined = candidates.join(claims, (F.col("artifact_id") == F.col("_a")) & (F.col("artifact_kind") == "derived_artifact"), "left")
    return joined.groupBy("artifact_kind", "artifact_id", "selection_reason").agg(
        F.count_if(F.col("client_id") != client).alias("others"),
        F.count_if(F.col("client_id") == client).alias("own"),
        F.array_sort(F.collect_set("slug")).alias("bindings_before"),
    )


def decide(classified: DataFrame, excluded: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """C-04: disposition and reason, in the table's order. ``excluded`` and ``failed`` are (artifact_id) of derived artifacts."""
    rows = classified
    for name, ids in (("_excluded", excluded), ("_failed", failed)):
        rows = rows.withColumn(name, F.lit(None).cast("boolean")) if ids is None else rows.join(ids.select("artifact_id", F.lit(True).alias(name)).distinct(), "artifact_id", "left")
    session_scope = F.col("selection_reason").isin("session_scope", "event_of_scoped_session")
    table = [
        (F.col("_excluded").isNotNull(), "retained", "excluded_by_review"),
        ((F.col("own") == 0) & ~session_scope, "retained", "binding_already_absent"),
        (F.col("others") == 0, "hard_delete", "sole_client_binding"),
        (F.col("artifact_kind").isin("event", "session"), "hard_delete", "event_not_divisible"),
        (F.col("_failed").isNotNull(), "hard_delete", "rewrite_failed"),
        (F.lit(True), "surgical_redaction", "blended_binding"),
    ]
    what = why = F
    for when, disposition, reason in table:
        what, why = what.when(when, disposition), why.when(when, reason)
    return rows.withColumns({"disposition": what, "reason": why}).drop("_excluded", "_failed")


def orphaned(bindings: DataFrame, client: int) -> DataFrame:
    """A-03: artifacts bound to the erased client alone."""
    return history.current(bindings).groupBy("artifact_id").agg(F.count_if(F.col("client_id") != client).alias("others"), F.count_if(F.col("client_id") == client).alias("own")).where("others = 0 and own > 0").select("artifact_id")


def delete(decided: DataFrame, artifacts: DataFrame, bindings: DataFrame, edges: DataFrame, embedding: DataFrame, ledger: DataFrame, session: DataFrame) -> dict[str, DataFrame]:
    """D-12, O-05: what is left of each table, in the order in which rows go: vectors, edges, claims, artifacts, events, sessions."""
    gone = decided.where("disposition = 'hard_delete'").select("artifact_kind", F.col("artifact_id").alias("_id"))
    of = lambda kind: gone.where(F.col("artifact_kind") == kind).select("_id")
    derived = of("derived_artifact")
    left = lambda df, key, ids: df.join(ids, F.col(key) == F.col("_id"), "left_anti")
    parent = gone.select(F.col("artifact_kind").alias("_kind"), "_id")
    return {
        "embedding": left(left(embedding, "artifact_id", derived), "embedding_id", of("embedding")),
        "lineage_edge": left(edges, "child_id", derived).join(parent, (F.col("parent_kind") == F.col("_kind")) & (F.col("parent_id") == F.col("_id")), "left_anti"),
        "client_binding": left(bindings, "artifact_id", derived),
        "derived_artifact": left(artifacts, "artifact_id", derived),
        "ledger": left(left(ledger, "event_id", of("event")), "session_id", of("session")),
        "session": left(session, "session_id", of("session")),
    }


def redact(artifacts: DataFrame, rewrites: DataFrame) -> DataFrame:
    """D-13, A-21: artifacts with the ``rewrites`` (artifact_id, pre_digest, new_body) whose digest still holds; a stale one writes nothing."""
    new = rewrites.select("artifact_id", F.col("pre_digest").alias("content_digest"), "new_body")
    joined = artifacts.join(new, ["artifact_id", "content_digest"], "left")
    hit = F.col("new_body").isNotNull()
    diff = removed_segments(F.col("body"), F.col("new_body"))
    out = joined.withColumns({"removed": F.when(hit, diff["removed"]), "retained": F.when(hit, diff["retained"])})
    return out.withColumns(
        {
            "content_digest": F.when(hit, F.sha2("new_body", 256)).otherwise(F.col("content_digest")),
            "revision": F.col("revision") + hit.cast("long"),
            "body": F.coalesce("new_body", "body"),
        }
    ).drop("new_body")
