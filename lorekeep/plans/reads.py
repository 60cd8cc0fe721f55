"""Scans, predicates, joins, aggregates, windows, sorts and set operations over the logical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import digests, text
from ..operators import chain, erasure, graph, history, ingest, upkeep
from ..sources.tables import micros, moment
from .registry import CLIENT, CLIENTS, NOW, query

CURRENT = "SELECT * FROM client_binding WHERE superseded_by IS NULL"
PARSED = """SELECT artifact_id, client_id, binding_id, method, confidence FROM client_binding WHERE superseded_by IS NULL"""


# --- scans and listings


@query("s01_session_by_key", f"SELECT session_id, client_id, outcome, tool_call_count FROM session WHERE session_id = 28 AND client_id = {CLIENT}")
def _(t):
    return t.session.where((F.col("session_id") == 28) & (F.col("client_id") == CLIENT)).select("session_id", "client_id", "outcome", "tool_call_count")


@query("s02_sessions_newest_first", "SELECT session_id, client_id, epoch_us(started_at) AS started_us FROM session ORDER BY started_at DESC, session_id LIMIT 20")
def _(t):
    return t.session.orderBy(F.desc("started_at"), "session_id").limit(20).select("session_id", "client_id", micros("started_at").alias("started_us"))


@query("s03_child_sessions", "SELECT session_id, parent_session_id FROM session WHERE parent_session_id IS NOT NULL")
def _(t):
    return t.session.where("parent_session_id is not null").select("session_id", "parent_session_id")


@query("s04_events_of_session", "SELECT event_id, seq, category, epoch_us(occurred_at) AS at_us FROM ledger WHERE session_id = 28 ORDER BY seq LIMIT 500")
def _(t):
    return t.ledger.where("session_id = 28").orderBy("seq").limit(500).select("event_id", "seq", "category", micros("occurred_at").alias("at_us"))


@query("s05_artifacts_of_client", f"SELECT artifact_id, kind, content_digest FROM derived_artifact WHERE owner_client_id = {CLIENT} ORDER BY created_at DESC, artifact_id LIMIT 100")
def _(t):
    own = t.derived_artifact.where(F.col("owner_client_id") == CLIENT)
    return own.orderBy(F.desc("created_at"), "artifact_id").limit(100).select("artifact_id", "kind", "content_digest")


@query("s07_clients_by_slug", "SELECT client_id, slug FROM client WHERE slug IN ('NATION_3', 'NATION_7', 'NATION_11') ORDER BY client_id")
def _(t):
    return t.client.where(F.col("slug").isin("NATION_3", "NATION_7", "NATION_11")).orderBy("client_id").select("client_id", "slug")


@query("s15_poll_after_cursor", "SELECT event_id, session_id, epoch_us(occurred_at) AS at_us FROM ledger WHERE (occurred_at, event_id) > (TIMESTAMP '2024-01-10', 100) ORDER BY occurred_at, event_id LIMIT 200")
def _(t):
    after = t.ledger.where("(occurred_at, event_id) > (TIMESTAMP_NTZ'2024-01-10 00:00:00', 100L)")
    return after.orderBy("occurred_at", "event_id").limit(200).select("event_id", "session_id", micros("occurred_at").alias("at_us"))


@query("s16_history_as_of", "SELECT binding_id, artifact_id, client_id FROM client_binding WHERE valid_from <= TIMESTAMP '2024-01-11' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-11')")
def _(t):
    return t.client_binding.where(history.valid_at(moment("2024-01-11 00:00:00"))).select("binding_id", "artifact_id", "client_id")


@query("s21_evidence_of_run", f"SELECT artifact_id, disposition, pre_digest FROM disposition WHERE run_id = {CLIENT} ORDER BY artifact_id")
def _(t):
    return t.disposition.where(F.col("run_id") == CLIENT).orderBy("artifact_id").select("artifact_id", "disposition", "pre_digest")


@query("s25_run_by_id_or_key", "SELECT run_id, status FROM erasure_run WHERE run_id = 4 OR idempotency_key = 'key-9'")
def _(t):
    return t.erasure_run.where("run_id = 4 or idempotency_key = 'key-9'").select("run_id", "status")


@query("s26_client_roster", "SELECT client_id, slug, retention_days FROM client ORDER BY slug, client_id")
def _(t):
    return t.client.orderBy("slug", "client_id").select("client_id", "slug", "retention_days")


@query("s27_candidate_text", "SELECT 'event' AS kind, event_id AS id, text_body AS body FROM ledger WHERE text_body IS NOT NULL UNION ALL SELECT 'derived_artifact', artifact_id, body FROM derived_artifact")
def _(t):
    events = t.ledger.where("text_body is not null").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("text_body").alias("body"))
    return events.unionByName(t.derived_artifact.select(F.lit("derived_artifact").alias("kind"), F.col("artifact_id").alias("id"), "body"))


@query("s28_dispositions_in_order", "SELECT run_id, disposition, artifact_id FROM disposition ORDER BY disposition, artifact_kind, artifact_id")
def _(t):
    return t.disposition.orderBy("disposition", "artifact_kind", "artifact_id").select("run_id", "disposition", "artifact_id")


@query("s29_current_leases", f"SELECT client_id, lease_id, generation, expires_at < TIMESTAMP '{NOW}' AS expired FROM erasure_lease WHERE superseded_at IS NULL")
def _(t):
    return upkeep.current_leases(t.erasure_lease, moment(NOW))


@query("s31_clients_with_markers", "SELECT client_id, len(markers) AS n_markers FROM client WHERE len(markers) > 0")
def _(t):
    return t.client.where(F.size("markers") > 0).select("client_id", F.size("markers").cast("long").alias("n_markers"))


@query("s32_chain_tips", "SELECT session_id, max(seq) AS seq, arg_max(event_id, seq) AS event_id FROM ledger GROUP BY session_id")
def _(t):
    return t.ledger.groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("event_id", "seq").alias("event_id"))


@query("s33_current_attribution", PARSED + " ORDER BY artifact_id, client_id")
def _(t):
    return history.current(t.client_binding).select("artifact_id", "client_id", "binding_id", "method", "confidence").orderBy("artifact_id", "client_id")


@query(
    "s34_outcome_context",
    """SELECT o.outcome_id, s.outcome AS session_outcome, a.kind, r.n AS retrievals, p.n AS earlier
    FROM procedure_outcome o LEFT JOIN session s USING (session_id) LEFT JOIN derived_artifact a ON a.artifact_id = o.procedure_id
    LEFT JOIN (SELECT procedure_id, session_id, count(*) AS n FROM procedure_retrieval GROUP BY ALL) r ON r.procedure_id = o.procedure_id AND r.session_id = o.session_id
    JOIN (SELECT outcome_id, count(*) OVER (PARTITION BY procedure_id, session_id ORDER BY recorded_at, outcome_id ROWS UNBOUNDED PRECEDING) - 1 AS n FROM procedure_outcome) p ON p.outcome_id = o.outcome_id""",
)
def _(t):
    counts = t.procedure_retrieval.groupBy("procedure_id", "session_id").agg(F.count(F.lit(1)).alias("retrievals"))
    order = Window.partitionBy("procedure_id", "session_id").orderBy("recorded_at", "outcome_id")
    rows = t.procedure_outcome.withColumn("earlier", F.row_number().over(order).cast("long") - 1)
    rows = rows.join(t.session.select("session_id", F.col("outcome").alias("session_outcome")), "session_id", "left")
    rows = rows.join(t.derived_artifact.select(F.col("artifact_id").alias("procedure_id"), "kind"), "procedure_id", "left")
    return rows.join(counts, ["procedure_id", "session_id"], "left").select("outcome_id", "session_outcome", "kind", "retrievals", "earlier")


@query("s35_procedure_standing", "SELECT artifact_id, confidence FROM derived_artifact WHERE kind = 'learned_procedure' AND artifact_id = 5")
def _(t):
    return t.derived_artifact.where("kind = 'learned_procedure' and artifact_id = 5").select("artifact_id", "confidence")


# --- predicates and projections


@query("p01_current_versions", "SELECT binding_id FROM client_binding WHERE superseded_by IS NULL")
def _(t):
    return history.current(t.client_binding).select("binding_id")


@query("p04_disposed_of_client", "SELECT artifact_id, run_id FROM disposition WHERE list_contains(bindings_before, 'NATION_3')")
def _(t):
    return t.disposition.where(F.array_contains("bindings_before", "NATION_3")).select("artifact_id", "run_id")


@query("p06_below_floor_flag", "SELECT artifact_id, coalesce(confidence < 0.15, false) AS below_floor FROM derived_artifact")
def _(t):
    return t.derived_artifact.select("artifact_id", F.coalesce(F.col("confidence") < 0.15, F.lit(False)).alias("below_floor"))


@query("p07_excerpts", "SELECT event_id, left(coalesce(text_body, ''), 400) AS excerpt, length(coalesce(text_body, '')) AS chars FROM ledger UNION ALL SELECT artifact_id, left(body, 400), length(body) FROM derived_artifact")
def _(t):
    cut = lambda key, c: (F.col(key).alias("event_id"), text.excerpt(F.col(c)).alias("excerpt"), F.char_length(F.coalesce(c, F.lit(""))).cast("long").alias("chars"))
    return t.ledger.select(*cut("event_id", "text_body")).unionAll(t.derived_artifact.select(*cut("artifact_id", "body")))


@query("p09_half_open_window", "SELECT event_id FROM ledger WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-06'")
def _(t):
    return t.ledger.where((F.col("occurred_at") >= moment("2024-01-05 00:00:00")) & (F.col("occurred_at") < moment("2024-01-06 00:00:00"))).select("event_id")


@query("p10_known_categories", "SELECT event_id, category IN ('tool_call', 'error', 'cost_record', 'session_start', 'file_read') AS known FROM ledger")
def _(t):
    return t.ledger.select("event_id", F.col("category").isin(*ingest.CATEGORIES).alias("known"))


@query("p13_parent_session", "SELECT edge_id, CASE WHEN parent_kind = 'session' THEN parent_id ELSE l.session_id END AS session_id FROM lineage_edge e LEFT JOIN ledger l ON e.parent_kind = 'event' AND l.event_id = e.parent_id WHERE parent_kind <> 'derived_artifact'")
def _(t):
    e = t.lineage_edge.where("parent_kind <> 'derived_artifact'")
    joined = e.join(t.ledger.select("event_id", F.col("session_id").alias("s")), (F.col("parent_kind") == "event") & (F.col("event_id") == F.col("parent_id")), "left")
    return joined.select("edge_id", F.when(F.col("parent_kind") == "session", F.col("parent_id")).otherwise(F.col("s")).alias("session_id"))


@query("p14_embedding_state", "SELECT event_id, CASE WHEN coalesce(text_body, '') <> '' THEN 'pending' ELSE 'not_required' END AS state FROM ledger")
def _(t):
    return t.ledger.select("event_id", ingest.embedding_state(F.col("text_body")).alias("state"))


# --- joins


@query(
    "j01_run_facts",
    "SELECT r.run_id, r.request_id, r.status, c.slug, l.generation FROM erasure_run r JOIN client c USING (client_id) LEFT JOIN (SELECT * FROM erasure_lease WHERE superseded_at IS NULL) l USING (client_id)",
)
def _(t):
    leases = t.erasure_lease.where("superseded_at is null").select("client_id", "generation")
    return t.erasure_run.join(t.client, "client_id").join(leases, "client_id", "left").select("run_id", "request_id", "status", "slug", "generation")


@query("j05_admitted_artifacts", f"SELECT embedding_id FROM embedding e WHERE EXISTS (SELECT 1 FROM ({CURRENT}) b WHERE b.artifact_id = e.artifact_id AND b.client_id IN (3, 7, 11))")
def _(t):
    return history.admit(t.embedding, t.client_binding, CLIENTS).select("embedding_id")


@query("j06_admitted_up_to_cap", f"SELECT artifact_id FROM embedding WHERE artifact_id IN (SELECT DISTINCT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11) ORDER BY artifact_id LIMIT 40)")
def _(t):
    capped = history.permitted_artifacts(t.client_binding, CLIENTS).orderBy("artifact_id").limit(40)  # the cap is the feature
    return t.embedding.join(capped, "artifact_id", "left_semi").select("artifact_id")


@query("j07_pending_sweep", "SELECT artifact_id FROM derived_artifact a WHERE body <> '' AND NOT EXISTS (SELECT 1 FROM embedding e WHERE e.artifact_id = a.artifact_id)")
def _(t):
    return t.derived_artifact.where("body <> ''").join(t.embedding, "artifact_id", "left_anti").select("artifact_id")


@query(
    "j09_attribution_as_of",
    "SELECT a.artifact_id, b.client_id, b.method, b.confidence FROM (SELECT artifact_id, created_at + INTERVAL 11 DAY AS at FROM derived_artifact) a JOIN client_binding b USING (artifact_id) WHERE b.valid_from <= a.at AND (b.valid_to IS NULL OR b.valid_to > a.at)",
)
def _(t):
    at = t.derived_artifact.select("artifact_id", F.timestamp_add("DAY", F.lit(11), F.col("created_at")).alias("at"))
    return history.as_of(t.client_binding, at).select("artifact_id", "client_id", "method", "confidence")


@query(
    "j10_event_provenance",
    "SELECT l.event_id, s.session_id, s.client_id, s.machine_id, s.outcome FROM ledger l JOIN session s USING (session_id) WHERE s.client_id IN (3, 7, 11)",
)
def _(t):
    s = t.session.where(F.col("client_id").isin(CLIENTS)).select("session_id", "client_id", "machine_id", "outcome")
    return t.ledger.select("event_id", "session_id").join(s, "session_id").select("event_id", "session_id", "client_id", "machine_id", "outcome")


EARLIEST = """SELECT artifact_id, s.sid AS session_id, s.since AS since FROM (
  SELECT child_id AS artifact_id, arg_min({'sid': sid, 'since': since}, {'since': since, 'sid': sid}) AS s FROM (
    SELECT child_id, l.session_id AS sid, l.occurred_at AS since FROM lineage_edge e JOIN ledger l ON e.parent_kind = 'event' AND l.event_id = e.parent_id
    UNION ALL SELECT child_id, s.session_id, s.started_at FROM lineage_edge e JOIN session s ON e.parent_kind = 'session' AND s.session_id = e.parent_id
  ) GROUP BY child_id)"""


@query("j11_earliest_session", "SELECT artifact_id, session_id, epoch_us(since) AS at_us FROM earliest", earliest=EARLIEST)
def _(t):
    return graph.earliest_session(t.lineage_edge, t.ledger, t.session).select("artifact_id", "session_id", micros("occurred_at").alias("at_us"))


@query(
    "j17_accounting_runs",
    """SELECT DISTINCT r.run_id, s.session_id FROM disposition r JOIN lineage_edge e ON e.child_id = r.artifact_id AND e.parent_kind = 'session' JOIN session s ON s.session_id = e.parent_id
    UNION SELECT r.run_id, l.session_id FROM disposition r JOIN lineage_edge e ON e.child_id = r.artifact_id AND e.parent_kind = 'event' JOIN ledger l ON l.event_id = e.parent_id""",
)
def _(t):
    edges = t.lineage_edge.join(t.disposition.select("run_id", F.col("artifact_id").alias("child_id")), "child_id")
    direct = edges.where("parent_kind = 'session'").join(t.session.select(F.col("session_id").alias("parent_id")), "parent_id", "left_semi").select("run_id", F.col("parent_id").alias("session_id"))
    events = edges.where("parent_kind = 'event'").join(t.ledger.select(F.col("event_id").alias("parent_id"), "session_id"), "parent_id").select("run_id", "session_id")
    return direct.union(events).distinct()


@query("j18_permitted_artifacts", f"SELECT artifact_id FROM derived_artifact a WHERE owner_client_id IN (3, 7, 11) OR EXISTS (SELECT 1 FROM ({CURRENT}) b WHERE b.artifact_id = a.artifact_id AND b.client_id IN (3, 7, 11))")
def _(t):
    marked = history.permitted_artifacts(t.client_binding, CLIENTS).withColumn("_in", F.lit(True))
    return t.derived_artifact.join(marked, "artifact_id", "left").where(F.col("owner_client_id").isin(CLIENTS) | F.col("_in")).select("artifact_id")


@query(
    "j19_permitted_edges",
    f"SELECT edge_id FROM lineage_edge WHERE parent_kind = 'derived_artifact' AND child_id IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11)) AND parent_id IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11))",
)
def _(t):
    nodes = history.permitted_artifacts(t.client_binding, CLIENTS).withColumnRenamed("artifact_id", "node")
    return graph.inside(t.lineage_edge, nodes).select("edge_id")


@query("j20_other_claimants", f"SELECT artifact_id, c.slug FROM ({CURRENT}) b JOIN client c USING (client_id) WHERE client_id <> {CLIENT}")
def _(t):
    return history.current(t.client_binding).where(F.col("client_id") != CLIENT).join(t.client, "client_id").select("artifact_id", "slug")


@query(
    "j21_session_anchor",
    "SELECT s.session_id, coalesce(p.depth + 1, 0) AS depth FROM session s LEFT JOIN (SELECT session_id, 3 AS depth FROM session) p ON p.session_id = s.parent_session_id",
)
def _(t):
    parent = t.session.select(F.col("session_id").alias("parent_session_id"), F.lit(3).alias("depth"))
    return t.session.select("session_id", "parent_session_id").join(parent, "parent_session_id", "left").select("session_id", F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"))


@query(
    "j24_workspace_clients",
    """SELECT session_id, coalesce(arg_max(root_client, length(root)), -1) AS root_client FROM session LEFT JOIN (
      SELECT '/work/c' || client_id AS root, client_id AS root_client FROM client UNION ALL SELECT '/work/c' || client_id || '/p1', client_id + 100 FROM client WHERE client_id <> 3
      ) r ON workspace_path = r.root OR starts_with(workspace_path, r.root || '/') GROUP BY session_id""",
)
def _(t):
    one = t.client.select(F.concat(F.lit("/work/c"), "client_id").alias("root"), F.col("client_id").alias("root_client"))
    two = t.client.where("client_id <> 3").select(F.concat(F.lit("/work/c"), "client_id", F.lit("/p1")), F.col("client_id") + 100)
    return ingest.workspace_clients(t.session, one.union(two)).select("session_id", "root_client")


@query("j29_principal_scope", "SELECT s.session_id, c.client_id, c.slug FROM session s JOIN client c USING (client_id)")
def _(t):
    return t.session.select("session_id", "client_id").join(t.client, "client_id").select("session_id", "client_id", "slug")


@query("j31_procedure_retrievals", "SELECT retrieval_id, procedure_id FROM procedure_retrieval r JOIN derived_artifact a ON a.artifact_id = r.procedure_id WHERE a.kind = 'learned_procedure'")
def _(t):
    procedures = t.derived_artifact.where("kind = 'learned_procedure'").select(F.col("artifact_id").alias("procedure_id"))
    return t.procedure_retrieval.join(procedures, "procedure_id", "left_semi").select("retrieval_id", "procedure_id")


# --- aggregates


@query("a03_orphaned_artifacts", f"SELECT artifact_id FROM ({CURRENT}) GROUP BY artifact_id HAVING count(*) FILTER (client_id <> 4) = 0 AND count(*) FILTER (client_id = 4) > 0")
def _(t):
    return erasure.orphaned(t.client_binding, 4)


RETENTION = f"""SELECT c.client_id, c.slug, count(*) FILTER (e > TIMESTAMP '{NOW}' AND e <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY) AS soon,
  count(*) FILTER (e <= TIMESTAMP '{NOW}') AS expired FROM client c LEFT JOIN (
  SELECT client_id, expires_at AS e FROM ledger UNION ALL SELECT owner_client_id, expires_at FROM derived_artifact UNION ALL SELECT client_id, expires_at FROM embedding) x
  ON x.client_id = c.client_id GROUP BY c.client_id, c.slug"""


@query("a04_retention_report", RETENTION)
def _(t):
    derived = t.derived_artifact.select(F.col("owner_client_id").alias("client_id"), "expires_at")
    return upkeep.retention_report(t.client, [t.ledger, derived, t.embedding], moment(NOW))


@query("j25_roster_retention", RETENTION + " ORDER BY c.slug, c.client_id")
def _(t):
    derived = t.derived_artifact.select(F.col("owner_client_id").alias("client_id"), "expires_at")
    return upkeep.retention_report(t.client, [t.ledger, derived, t.embedding], moment(NOW)).orderBy("slug", "client_id")


@query(
    "j26_disposition_origins",
    "SELECT d.artifact_id, d.disposition, f.client_id, epoch_us(f.first_at) AS first_us, f.first_method FROM disposition d LEFT JOIN (SELECT artifact_id, client_id, min(valid_from) AS first_at, arg_min(method, valid_from) AS first_method FROM client_binding GROUP BY 1, 2) f USING (artifact_id)",
)
def _(t):
    joined = t.disposition.join(history.first_attribution(t.client_binding), "artifact_id", "left")
    return joined.select("artifact_id", "disposition", "client_id", micros("first_at").alias("first_us"), "first_method")


@query("a06_dispositions_by_kind", "SELECT run_id, disposition, count(*) AS n FROM disposition GROUP BY ALL")
def _(t):
    return t.disposition.groupBy("run_id", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a07_inherited_claims",
    f"SELECT e.child_id AS artifact_id, b.client_id, max(b.confidence) AS confidence FROM lineage_edge e JOIN ({CURRENT}) b ON b.artifact_id = e.parent_id WHERE e.parent_kind = 'derived_artifact' GROUP BY ALL",
)
def _(t):
    return history.inherited_claims(t.lineage_edge, t.client_binding)


@query("a08_first_attribution", "SELECT artifact_id, client_id, epoch_us(min(valid_from)) AS first_us, arg_min(method, valid_from) AS first_method FROM client_binding GROUP BY artifact_id, client_id")
def _(t):
    return history.first_attribution(t.client_binding).select("artifact_id", "client_id", micros("first_at").alias("first_us"), "first_method")


@query(
    "a09_outcome_counts",
    "SELECT procedure_id, outcome, count(o.outcome_id) AS n FROM (SELECT DISTINCT procedure_id FROM procedure_outcome) CROSS JOIN (VALUES ('succeeded'), ('failed'), ('abandoned')) v(outcome) LEFT JOIN procedure_outcome o USING (procedure_id, outcome) GROUP BY ALL",
)
def _(t):
    return upkeep.outcome_counts(t.procedure_outcome)


@query(
    "a10_tier_counts",
    """SELECT tier, sum(n)::BIGINT AS n FROM (SELECT 'events' AS tier, count(*) AS n FROM ledger UNION ALL SELECT 'attribution', count(*) FROM client_binding
    UNION ALL SELECT 'derived', count(*) FROM derived_artifact UNION ALL SELECT 'derived', count(*) FROM procedure_retrieval UNION ALL SELECT 'derived', count(*) FROM procedure_outcome
    UNION ALL SELECT 'provenance', count(*) FROM lineage_edge UNION ALL SELECT 'erasure', count(*) FROM disposition UNION ALL SELECT 'erasure', count(*) FROM erasure_lease UNION ALL SELECT 'working', count(*) FROM working_memory) GROUP BY tier""",
)
def _(t):
    return upkeep.tier_counts(
        {
            "events": [t.ledger],
            "attribution": [t.client_binding],
            "derived": [t.derived_artifact, t.procedure_retrieval, t.procedure_outcome],
            "provenance": [t.lineage_edge],
            "erasure": [t.disposition, t.erasure_lease],
            "working": [t.working_memory],
        }
    )


@query("a11_highest_generation", "SELECT coalesce(max(generation), 0) AS generation FROM erasure_lease")
def _(t):
    return upkeep.highest_generation(t.erasure_lease)


@query("a13_session_counters", "SELECT session_id, tool_call_count, model_request_count, error_count, token_count, cost_usd::DOUBLE AS cost_usd FROM session")
def _(t):
    return t.session.select("session_id", "tool_call_count", "model_request_count", "error_count", "token_count", F.col("cost_usd").cast("double").alias("cost_usd"))


@query(
    "a16_derived_counts",
    f"SELECT c.slug, coalesce(l.n, 0) AS live, coalesce(d.n, 0) + coalesce(l.n, 0) AS before FROM client c LEFT JOIN (SELECT client_id, count(*) AS n FROM ({CURRENT}) GROUP BY 1) l USING (client_id) LEFT JOIN (SELECT slug, count(*) AS n FROM (SELECT unnest(bindings_before) AS slug FROM disposition) GROUP BY 1) d ON d.slug = c.slug",
)
def _(t):
    live = history.current(t.client_binding).groupBy("client_id").agg(F.count(F.lit(1)).alias("l"))
    before = t.disposition.select(F.explode("bindings_before").alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("d"))
    rows = t.client.join(live, "client_id", "left").join(before, "slug", "left")
    return rows.select("slug", F.coalesce("l", F.lit(0)).alias("live"), (F.coalesce("d", F.lit(0)) + F.coalesce("l", F.lit(0))).alias("before"))


@query("a19_implied_sessions", "SELECT session_id, arg_min(client_id, occurred_at) AS client_id, epoch_us(min(occurred_at)) AS started_us FROM ledger GROUP BY session_id")
def _(t):
    return ingest.implied_sessions(t.ledger).select("session_id", "client_id", micros("started_at").alias("started_us"))


@query("a21_structural_diff", "SELECT a.artifact_id, len(list_filter(l, lambda x: NOT list_contains(p, x))) AS removed, len(list_filter(l, lambda x: list_contains(p, x))) AS retained FROM (SELECT artifact_id, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '') AS l, string_split(replace(body, 'the', ''), chr(10)) AS p FROM derived_artifact) a")
def _(t):
    diff = text.removed_segments(F.col("body"), F.replace(F.col("body"), F.lit("the"), F.lit("")))
    return t.derived_artifact.select("artifact_id", diff.alias("d")).select("artifact_id", "d.removed", "d.retained")


@query("a25_live_bound_count", f"SELECT client_id, count(*) AS n FROM ({CURRENT}) GROUP BY client_id")
def _(t):
    return history.current(t.client_binding).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


@query("a26_retrieval_counts", "SELECT procedure_id, count(*) AS n FROM procedure_retrieval GROUP BY procedure_id")
def _(t):
    return t.procedure_retrieval.groupBy("procedure_id").agg(F.count(F.lit(1)).alias("n"))


@query("a27_expired_working_rows", "SELECT client_id, count(*) FILTER (updated_at + INTERVAL 1 HOUR < TIMESTAMP '2024-01-02') AS expired, count(*) AS n FROM working_memory GROUP BY client_id")
def _(t):
    old = F.timestamp_add("HOUR", F.lit(1), F.col("updated_at")) < moment("2024-01-02 00:00:00")
    return t.working_memory.groupBy("client_id").agg(F.count_if(old).alias("expired"), F.count(F.lit(1)).alias("n"))


# --- windows, sorts, sets


@query("w04_trailing_error_share", "SELECT event_id, round(avg(CASE WHEN category = 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS 19 PRECEDING), 6) AS share FROM ledger")
def _(t):
    from ..operators.policy import error_share

    return t.ledger.select("event_id", F.round(error_share(20), 6).alias("share"))


@query("w05_spool_tail", "SELECT event_id FROM (SELECT event_id, sum(strlen(payload) + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM ledger) WHERE tail <= 50000")
def _(t):
    return ingest.bounded_tail(t.ledger.select("event_id", "payload"), "event_id", "payload", 50_000).select("event_id")


@query("w06_sequences", "SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) AS seq FROM ledger")
def _(t):
    return t.ledger.select("event_id", "seq")


@query("w10_recent_changes", "SELECT procedure_id, outcome_id FROM (SELECT *, row_number() OVER (PARTITION BY procedure_id ORDER BY recorded_at DESC, outcome_id DESC) AS n FROM procedure_outcome) WHERE n <= 5")
def _(t):
    order = Window.partitionBy("procedure_id").orderBy(F.desc("recorded_at"), F.desc("outcome_id"))
    return t.procedure_outcome.withColumn("n", F.row_number().over(order)).where("n <= 5").select("procedure_id", "outcome_id")


@query("o06_delete_batches", "SELECT artifact_id, (row_number() OVER (ORDER BY artifact_id) - 1) // 100 AS batch FROM derived_artifact")
def _(t):
    return ingest.batches(t.derived_artifact.select("artifact_id"), ["artifact_id"], 100)


@query("o08_lowest_standing", "SELECT artifact_id, confidence FROM derived_artifact WHERE kind = 'learned_procedure' ORDER BY confidence, artifact_id LIMIT 25")
def _(t):
    return t.derived_artifact.where("kind = 'learned_procedure'").orderBy("confidence", "artifact_id").limit(25).select("artifact_id", "confidence")


@query("o12_window_tips", "SELECT session_id, max(seq) AS terminal_seq, arg_max(event_id, seq) AS event_id FROM ledger WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12' GROUP BY session_id")
def _(t):
    rows = t.ledger.withColumn("chain_digest", F.col("event_id"))
    return chain.window_tips(rows, moment("2024-01-05 00:00:00"), moment("2024-01-12 00:00:00")).withColumnRenamed("terminal_digest", "event_id")


@query("u01_artifact_view", "SELECT 'event' AS kind, event_id AS id, client_id FROM ledger UNION ALL SELECT 'session', session_id, client_id FROM session UNION ALL SELECT 'derived_artifact', artifact_id, owner_client_id FROM derived_artifact")
def _(t):
    part = lambda df, kind, key, client="client_id": df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(client).alias("client_id"))
    return part(t.ledger, "event", "event_id").unionByName(part(t.session, "session", "session_id")).unionByName(part(t.derived_artifact, "derived_artifact", "artifact_id", "owner_client_id"))


@query("u03_surviving_ids", "SELECT artifact_id AS id FROM derived_artifact UNION SELECT event_id FROM ledger")
def _(t):
    return t.derived_artifact.select(F.col("artifact_id").alias("id")).union(t.ledger.select("event_id")).distinct()


@query("f02_content_digests", "SELECT event_id, sha256(concat_ws(chr(31), event_id, session_id, client_id, seq, category, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00', payload)) AS content_digest FROM ledger")
def _(t):
    return t.ledger.select("event_id", chain.content_digest().alias("content_digest"))


@query("f05_name_ids")
def _(t):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    return t.ledger.select("event_id", digests.name_id(space, F.col("category"), F.col("event_id")).alias("id"))
