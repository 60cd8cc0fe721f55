"""Vectors, graphs, attribution writes, recall, erasure, chains, policy, standing: the composed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, text
from ..functions import vectors as V
from ..operators import chain, erasure, graph, history, ingest, policy, recall, upkeep
from ..session import saved
from ..sources.tables import MARKER_WORDS, N_CLIENTS, micros, moment
from .reads import CURRENT, EARLIEST, NOW
from .registry import CLIENT, CLIENTS, query

NEAR = "round(list_cosine_distance(e.vec::DOUBLE[], q.vec::DOUBLE[]), 6)"


def query_vector(t):
    return t.embedding.where("embedding_id = 0").select("vec").first().vec


# --- vectors


@query("v01_cosine_distance", f"SELECT e.embedding_id, {NEAR} AS distance FROM embedding e CROSS JOIN (SELECT vec FROM embedding WHERE embedding_id = 0) q")
def _(t):
    q = F.lit([float(x) for x in query_vector(t)])
    return t.embedding.select("embedding_id", (F.round(V.cosine_distance(F.col("vec"), q), 6) + 0.0).alias("distance"))


@query("v02_l2_order", "SELECT e.embedding_id, round(list_distance(e.vec::DOUBLE[], q.vec::DOUBLE[]), 6) AS distance FROM embedding e CROSS JOIN (SELECT vec FROM embedding WHERE embedding_id = 0) q")
def _(t):
    q = F.lit([float(x) for x in query_vector(t)])
    return t.embedding.select("embedding_id", F.round(V.l2_distance(F.col("vec"), q), 6).alias("distance"))


@query("v03_nearest", f"SELECT e.artifact_id, {NEAR} AS distance FROM embedding e CROSS JOIN (SELECT vec FROM embedding WHERE embedding_id = 0) q ORDER BY distance, artifact_id LIMIT 10")
def _(t):
    return recall.nearest(t.embedding.select("artifact_id", "vec"), query_vector(t), 10).select("artifact_id", (F.col("distance") + 0.0).alias("distance"))


@query("v04_unit_check", "SELECT embedding_id, abs(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) - 1) <= 1e-6 AS is_unit FROM embedding")
def _(t):
    return t.embedding.select("embedding_id", V.is_unit(F.col("vec")).alias("is_unit"))


@query("v06_token_hash_vectors")
def _(t):
    return V.token_hash_vectors(t.derived_artifact.select("artifact_id", "body"), "body").select("artifact_id", V.to_text(F.col("vec")).alias("vec"))


@query(
    "j28_knn_join",
    f"SELECT query_id, id, distance, place FROM (SELECT q.artifact_id AS query_id, e.artifact_id AS id, {NEAR} AS distance, row_number() OVER (PARTITION BY q.artifact_id ORDER BY {NEAR}, e.artifact_id) AS place FROM embedding e CROSS JOIN (SELECT artifact_id, vec FROM embedding ORDER BY label, artifact_id LIMIT 50) q WHERE {NEAR} <= 0.9) WHERE place <= 100",
)
def _(t):
    queries = t.embedding.orderBy("label", "artifact_id").limit(50).select(F.col("artifact_id").alias("id"), "vec")  # the stated query set
    return V.knn_join(t.embedding.select(F.col("artifact_id").alias("id"), "vec"), queries, 100, 0.9).withColumn("place", F.col("place").cast("long"))


RECALL = f"""WITH pool AS (SELECT e.artifact_id, {NEAR} AS distance FROM embedding e CROSS JOIN (SELECT vec FROM embedding WHERE embedding_id = 0) q ORDER BY distance, e.artifact_id LIMIT 256),
admitted AS (SELECT * FROM pool WHERE artifact_id IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11))),
flagged AS (SELECT p.artifact_id, distance, a.kind, a.confidence, o.session_id, coalesce(a.confidence < 0.15, false) AS below_floor FROM admitted p JOIN derived_artifact a USING (artifact_id) JOIN earliest o USING (artifact_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY below_floor ORDER BY distance, confidence DESC NULLS LAST, artifact_id) AS place, CASE WHEN below_floor THEN count(*) OVER (PARTITION BY below_floor) ELSE 0 END AS excluded FROM flagged)
SELECT artifact_id, distance, kind, confidence, session_id, below_floor, place, excluded FROM ranked WHERE (NOT below_floor AND place <= 10) OR (below_floor AND place = 1)"""


@query("c01_recall", RECALL, earliest=EARLIEST)
def _(t):
    found = recall.recall(t.embedding, t.client_binding, t.derived_artifact, t.lineage_edge, t.ledger, t.session, query_vector(t), CLIENTS)
    return found.select("artifact_id", (F.col("distance") + 0.0).alias("distance"), "kind", "confidence", "session_id", "below_floor", "place", "excluded")


# --- graph

DOWN = "SELECT parent_id AS src, child_id AS dst FROM lineage_edge WHERE parent_kind = 'derived_artifact'"
ROOTS = f"SELECT artifact_id AS node FROM derived_artifact WHERE owner_client_id = {CLIENT}"


def roots(t):
    return t.derived_artifact.where(F.col("owner_client_id") == CLIENT).select(F.col("artifact_id").alias("node"))


@query("g01_descendants", f"WITH RECURSIVE d(node) AS (SELECT dst FROM edge JOIN ({ROOTS}) ON src = node UNION SELECT e.dst FROM d JOIN edge e ON e.src = d.node) SELECT node FROM d", edge=DOWN)
def _(t):
    return graph.closure(graph.down(t.lineage_edge), roots(t))


@query(
    "g02_ancestors",
    f"WITH RECURSIVE a(node) AS (SELECT src FROM edge JOIN ({ROOTS}) ON dst = node UNION SELECT e.src FROM a JOIN edge e ON e.dst = a.node) SELECT node, 'derived_artifact' AS kind FROM a UNION SELECT parent_id, parent_kind FROM lineage_edge WHERE parent_kind <> 'derived_artifact' AND (child_id IN (SELECT node FROM a) OR child_id IN ({ROOTS}))",
    edge=DOWN,
)
def _(t):
    return graph.ancestors(t.lineage_edge, roots(t))


@query(
    "g03_permitted_descendants",
    f"WITH RECURSIVE d(node) AS (SELECT dst FROM edge WHERE src = 1 UNION SELECT e.dst FROM d JOIN edge e ON e.src = d.node) SELECT node FROM d WHERE node IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11)) ORDER BY node LIMIT 1000",
    edge=DOWN,
)
def _(t):
    one = t.spark.createDataFrame([(1,)], "node long")
    found = graph.closure(graph.down(t.lineage_edge), one).withColumnRenamed("node", "artifact_id")
    return history.admit(found, t.client_binding, CLIENTS).select(F.col("artifact_id").alias("node")).orderBy("node").limit(1000)


@query(
    "g04_edge_verdicts",
    """WITH RECURSIVE proposed AS (SELECT artifact_id * 10 AS edge_id, artifact_id AS child_id, artifact_id * 2 AS parent_id FROM derived_artifact WHERE owner_client_id = 3 UNION ALL
      SELECT artifact_id * 10 + 1, artifact_id, artifact_id + 1 FROM derived_artifact WHERE owner_client_id = 3 UNION ALL SELECT artifact_id * 10 + 2, artifact_id, artifact_id FROM derived_artifact WHERE owner_client_id = 3 UNION ALL
      SELECT artifact_id * 10 + 3, artifact_id, artifact_id // 2 FROM derived_artifact WHERE owner_client_id = 3),
    w(edge_id, goal, node) AS (SELECT edge_id, parent_id, child_id FROM proposed WHERE child_id <> parent_id UNION SELECT w.edge_id, goal, e.dst FROM w JOIN edge e ON e.src = w.node)
    SELECT edge_id, CASE WHEN child_id = parent_id THEN 'self_edge' WHEN parent_id NOT IN (SELECT artifact_id FROM derived_artifact) THEN 'absent_parent'
      WHEN edge_id IN (SELECT edge_id FROM w WHERE node = goal) THEN 'cycle' WHEN (child_id, parent_id) IN (SELECT (dst, src) FROM edge) THEN 'duplicate' ELSE 'accepted' END AS verdict FROM proposed""",
    edge=DOWN,
)
def _(t):
    a = F.col("artifact_id")
    kinds = [(0, a * 2), (1, a + 1), (2, a), (3, F.floor(a / 2).cast("long"))]
    rows = t.derived_artifact.where(F.col("owner_client_id") == CLIENT)
    rows = rows.select(F.inline(F.array(*[F.struct((a * 10 + j).alias("edge_id"), a.alias("child_id"), p.alias("parent_id")) for j, p in kinds])))
    return graph.judge_edges(t.lineage_edge, rows, t.derived_artifact.select(a.alias("node"))).select("edge_id", "verdict")


@query(
    "g05_layers",
    "WITH RECURSIVE l(node, layer) AS (SELECT artifact_id, 0 FROM derived_artifact WHERE artifact_id NOT IN (SELECT dst FROM edge WHERE src <> dst) UNION SELECT e.dst, layer + 1 FROM l JOIN edge e ON e.src = l.node AND e.src <> e.dst) SELECT node, max(layer) AS layer FROM l GROUP BY node",
    edge=DOWN,
)
def _(t):
    return graph.layers(t.derived_artifact.select(F.col("artifact_id").alias("node")), graph.down(t.lineage_edge))


@query("g06_touching_edges", f"SELECT edge_id FROM lineage_edge WHERE child_id IN ({ROOTS}) OR (parent_kind = 'derived_artifact' AND parent_id IN ({ROOTS}))")
def _(t):
    return graph.touching(t.lineage_edge, roots(t)).select("edge_id")


@query(
    "g08_session_depths",
    "WITH RECURSIVE d(node, depth) AS (SELECT session_id, 0 FROM session WHERE parent_session_id IS NULL OR parent_session_id NOT IN (SELECT session_id FROM session) UNION SELECT s.session_id, depth + 1 FROM d JOIN session s ON s.parent_session_id = d.node AND s.session_id <> d.node) SELECT node, depth FROM d",
)
def _(t):
    return graph.depths(t.session.select(F.col("session_id").alias("node"), F.col("parent_session_id").alias("parent")))


# --- attribution

CASELESS_WORD = {w: text.marker_pattern(w).replace("(?iu:", "(?i:") for w in (*MARKER_WORDS, *[f"NATION_{i}" for i in range(N_CLIENTS)])}


def marked_sql() -> str:
    words = " UNION ALL ".join(
        "SELECT artifact_id, '{w}' AS word FROM derived_artifact WHERE regexp_matches(body, '{p}')".format(w=w, p=p.replace("'", "''")) for w, p in CASELESS_WORD.items()
    )
    return f"SELECT w.artifact_id, c.client_id FROM ({words}) w JOIN client c ON list_contains(c.markers, w.word)"


@query(
    "d04_binding_detection",
    f"""WITH claims AS (SELECT artifact_id, owner_client_id AS client_id, 'scope' AS method, 1.0::DOUBLE AS confidence, 1 AS place FROM derived_artifact
      UNION ALL SELECT artifact_id, client_id, 'marker', 0.9, 2 FROM marked
      UNION ALL SELECT e.child_id, b.client_id, 'inherited', max(b.confidence), 3 FROM lineage_edge e JOIN ({CURRENT}) b ON b.artifact_id = e.parent_id WHERE e.parent_kind = 'derived_artifact' GROUP BY e.child_id, b.client_id)
    SELECT artifact_id, client_id, method, confidence FROM claims QUALIFY row_number() OVER (PARTITION BY artifact_id, client_id ORDER BY confidence DESC, place) = 1""",
    marked=marked_sql(),
)
def _(t):
    return history.detect(t.derived_artifact, t.client, t.lineage_edge, t.client_binding)


SUBMITTED = "SELECT artifact_id, (artifact_id * 7 + 1) % 25 AS client_id, CASE WHEN artifact_id % 2 = 0 THEN 'marker' ELSE 'inherited' END AS method, 0.85::DOUBLE AS confidence FROM derived_artifact UNION ALL SELECT artifact_id, 25, 'marker', 0.9 FROM derived_artifact WHERE artifact_id % 4 = 0"


def submitted(t):
    a = F.col("artifact_id")
    one = t.derived_artifact.select(a, ((a * 7 + 1) % N_CLIENTS).alias("client_id"), F.when(a % 2 == 0, "marker").otherwise("inherited").alias("method"), F.lit(0.85).alias("confidence"))
    return one.union(t.derived_artifact.where(a % 4 == 0).select(a, F.lit(25).cast("long"), F.lit("marker"), F.lit(0.9)))


@query(
    "d02_record_attribution",
    f"""SELECT b.artifact_id, b.client_id, b.method, b.confidence, s.artifact_id IS NOT NULL AND NOT (s.method = b.method AND s.confidence <= b.confidence) AND b.superseded_by IS NULL OR b.superseded_by IS NOT NULL AS closed
      FROM client_binding b LEFT JOIN submitted s ON s.artifact_id = b.artifact_id AND s.client_id = b.client_id AND b.superseded_by IS NULL
    UNION ALL SELECT s.artifact_id, s.client_id, s.method, greatest(s.confidence, coalesce(b.confidence, 0)), false FROM submitted s LEFT JOIN ({CURRENT}) b ON s.artifact_id = b.artifact_id AND s.client_id = b.client_id
      WHERE b.artifact_id IS NULL OR NOT (s.method = b.method AND s.confidence <= b.confidence)""",
    submitted=SUBMITTED,
)
def _(t):
    snapshot, _actions = history.record(t.client_binding, submitted(t), moment(NOW))
    return snapshot.select("artifact_id", "client_id", "method", "confidence", F.col("superseded_by").isNotNull().alias("closed"))


@query("d03_withdraw", f"SELECT binding_id, superseded_by IS NULL AND client_id <> {CLIENT} AS open FROM client_binding")
def _(t):
    pairs = history.current(t.client_binding).where(F.col("client_id") == CLIENT)
    return history.withdraw(t.client_binding, pairs, moment(NOW)).select("binding_id", F.col("superseded_by").isNull().alias("open"))


# --- erasure

SWEEP = f"""SELECT artifact_kind, artifact_id, arg_min(selection_reason, step) AS selection_reason FROM (
  SELECT 'session' AS artifact_kind, session_id AS artifact_id, 'session_scope' AS selection_reason, 0 AS step FROM session WHERE client_id = {CLIENT}
  UNION ALL SELECT 'event', event_id, 'event_of_scoped_session', 1 FROM ledger WHERE session_id IN (SELECT session_id FROM session WHERE client_id = {CLIENT})
  UNION ALL SELECT 'derived_artifact', artifact_id, 'client_binding', 2 FROM swept_bound
  UNION ALL SELECT 'derived_artifact', node, 'lineage_descendant', 3 FROM swept_below
  UNION ALL SELECT 'embedding', embedding_id, 'embedding_of_selected', 4 FROM embedding WHERE artifact_id IN (SELECT artifact_id FROM swept_bound UNION SELECT node FROM swept_below)
) GROUP BY artifact_kind, artifact_id"""
SWEPT = {
    "swept_bound": f"SELECT artifact_id FROM client_binding WHERE superseded_by IS NULL AND client_id = {CLIENT}",
    "swept_below": f"""WITH RECURSIVE s(node) AS (SELECT child_id FROM lineage_edge WHERE (parent_kind = 'derived_artifact' AND parent_id IN (SELECT artifact_id FROM swept_bound))
        OR (parent_kind = 'session' AND parent_id IN (SELECT session_id FROM session WHERE client_id = {CLIENT})) OR (parent_kind = 'event' AND parent_id IN (SELECT event_id FROM ledger WHERE session_id IN (SELECT session_id FROM session WHERE client_id = {CLIENT})))
      UNION SELECT e.child_id FROM s JOIN lineage_edge e ON e.parent_kind = 'derived_artifact' AND e.parent_id = s.node) SELECT node FROM s""",
    "candidate": SWEEP,
}


def swept(t):
    """The candidates of one composed run, computed once for all its phases."""
    if not hasattr(t, "swept"):
        t.swept = saved(erasure.sweep(t.session, t.ledger, t.derived_artifact, t.client_binding, t.lineage_edge, t.embedding, CLIENT))
    return t.swept


@query("c02_sweep", "SELECT artifact_kind, artifact_id, selection_reason FROM candidate", **SWEPT)
def _(t):
    return swept(t).select("artifact_kind", "artifact_id", "selection_reason")


@query("a01_reason_counts", "SELECT selection_reason, count(artifact_id) AS n FROM (VALUES ('session_scope'), ('event_of_scoped_session'), ('client_binding'), ('lineage_descendant'), ('embedding_of_selected')) v(selection_reason) LEFT JOIN candidate USING (selection_reason) GROUP BY selection_reason", **SWEPT)
def _(t):
    return erasure.reason_counts(swept(t))


@query("j13_run_sessions", "SELECT session_id, max(seq) AS terminal_seq, arg_max(event_id, seq) AS terminal_event, count(*) AS row_count FROM ledger WHERE session_id IN (SELECT session_id FROM ledger WHERE event_id IN (SELECT artifact_id FROM candidate WHERE artifact_kind = 'event')) GROUP BY session_id", **SWEPT)
def _(t):
    return erasure.run_sessions(swept(t), t.ledger)


@query("j15_below_floor_procedures", f"SELECT artifact_id FROM derived_artifact WHERE kind = 'learned_procedure' AND confidence < 0.15 AND artifact_id IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id = {CLIENT})")
def _(t):
    return erasure.below_floor(t.derived_artifact, t.client_binding, CLIENT).select("artifact_id")


@query(
    "a12_unembedded_count",
    "SELECT (SELECT count(*) FROM derived_artifact WHERE artifact_id IN (SELECT artifact_id FROM candidate WHERE artifact_kind = 'derived_artifact') AND artifact_id NOT IN (SELECT artifact_id FROM embedding)) + (SELECT count(*) FROM ledger WHERE text_body IS NOT NULL AND event_id IN (SELECT artifact_id FROM candidate WHERE artifact_kind = 'event')) AS unembedded",
    **SWEPT,
)
def _(t):
    return erasure.unembedded(swept(t), t.derived_artifact, t.ledger, t.embedding)


QUERIES_OF_RUN = "SELECT a.artifact_id, length(a.body) AS length, e.vec FROM derived_artifact a JOIN embedding e USING (artifact_id) WHERE a.body <> '' AND a.artifact_id IN (SELECT artifact_id FROM candidate WHERE artifact_kind = 'derived_artifact') ORDER BY length DESC, a.artifact_id LIMIT 50"
WALK = f"""SELECT artifact_id, query_id, distance FROM (SELECT e.artifact_id, q.artifact_id AS query_id, {NEAR} AS distance, q.length AS length,
    row_number() OVER (PARTITION BY q.artifact_id ORDER BY {NEAR}, e.artifact_id) AS place FROM embedding e CROSS JOIN run_query q WHERE {NEAR} <= 0.9)
  WHERE place <= 100 AND artifact_id <> query_id AND artifact_id NOT IN (SELECT artifact_id FROM candidate WHERE artifact_kind = 'derived_artifact')
  QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY distance, length DESC, query_id) = 1"""
RESIDUE = SWEPT | {"run_query": QUERIES_OF_RUN, "residue": WALK}
#: Directions of the test vectors are random, so thresholds are set where some of them fall.
AUTO, REVIEW = 0.75, 0.9


def walked(t):
    queries = saved(erasure.query_artifacts(swept(t), t.derived_artifact, t.embedding))
    return erasure.walk(queries, t.embedding, swept(t), REVIEW)


@query("o03_query_artifacts", "SELECT artifact_id, length FROM run_query", **RESIDUE)
def _(t):
    return erasure.query_artifacts(swept(t), t.derived_artifact, t.embedding).select("artifact_id", "length")


@query(
    "c03_residue",
    f"SELECT artifact_id, query_id, distance, CASE WHEN distance <= {AUTO} THEN 'auto_include' ELSE 'review' END AS band, distance <= {AUTO} OR artifact_id % 3 <> 0 AS included, CASE WHEN distance <= {AUTO} THEN 'below_auto_include_threshold' WHEN artifact_id % 3 = 0 THEN 'exclude' ELSE 'no_verdict_included' END AS decision_reason FROM residue",
    **RESIDUE,
)
def _(t):
    verdicts = t.embedding.where("artifact_id % 3 = 0").select("artifact_id", F.lit("exclude").alias("classification"))
    return erasure.band(walked(t), AUTO, verdicts).select("artifact_id", "query_id", "distance", "band", "included", "decision_reason")


@query("a05_residue_counters", f"SELECT count(*) AS n, count(*) FILTER (distance <= {AUTO}) AS auto_included, count(*) FILTER (distance > {AUTO}) AS review FROM residue", **RESIDUE)
def _(t):
    return erasure.band(walked(t), AUTO).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band") == "auto_include").alias("auto_included"), F.count_if(F.col("band") == "review").alias("review"))


AUTOS, REVIEWS = (0.70, 0.74, 0.78, 0.82, 0.86), (0.72, 0.76, 0.80, 0.84, 0.88)


@query(
    "c07_sensitivity",
    f"""SELECT a AS auto, r AS review, CASE WHEN a <= r THEN count(artifact_id) FILTER (distance <= r) END AS candidates, CASE WHEN a <= r THEN count(artifact_id) FILTER (distance <= a) END AS auto_included,
      CASE WHEN a <= r THEN count(artifact_id) FILTER (distance <= r) - count(artifact_id) FILTER (distance <= a) END AS referred, CASE WHEN a <= r THEN count(artifact_id) FILTER (distance <= r AND artifact_id % 2 = 0) END AS recovered
      FROM (SELECT unnest({list(AUTOS)})::DOUBLE AS a) CROSS JOIN (SELECT unnest({list(REVIEWS)})::DOUBLE AS r) LEFT JOIN residue ON true GROUP BY a, r""",
    **RESIDUE,
)
def _(t):
    planted = t.embedding.where("artifact_id % 2 = 0").select("artifact_id")
    return erasure.sensitivity(walked(t), planted, AUTOS, REVIEWS)


CLASSIFIED = f"""SELECT c.artifact_kind, c.artifact_id, c.selection_reason, count(*) FILTER (b.client_id <> {CLIENT}) AS others, count(*) FILTER (b.client_id = {CLIENT}) AS own,
  array_to_string(list_sort(list_distinct(array_agg(b.slug) FILTER (b.slug IS NOT NULL))), ',') AS slugs FROM candidate c
  LEFT JOIN (SELECT artifact_id, client_id, slug FROM ({CURRENT}) JOIN client USING (client_id)) b ON b.artifact_id = c.artifact_id AND c.artifact_kind = 'derived_artifact' GROUP BY ALL"""


@query("a02_classification", "SELECT artifact_kind, artifact_id, others, own, coalesce(slugs, '') AS slugs FROM classified", **SWEPT, classified=CLASSIFIED)
def _(t):
    found = erasure.classify(swept(t), t.client_binding, t.client, CLIENT)
    return found.select("artifact_kind", "artifact_id", "others", "own", F.array_join("bindings_before", ",").alias("slugs"))


DECIDED = """SELECT artifact_kind, artifact_id, CASE WHEN artifact_kind = 'derived_artifact' AND artifact_id % 11 = 0 THEN 'retained'
    WHEN own = 0 AND selection_reason NOT IN ('session_scope', 'event_of_scoped_session') THEN 'retained' WHEN others = 0 THEN 'hard_delete' ELSE 'surgical_redaction' END AS disposition FROM classified"""


def decided(t):
    kept = t.derived_artifact.where("artifact_id % 11 = 0").select("artifact_id")
    rows = erasure.classify(swept(t), t.client_binding, t.client, CLIENT)
    derived = erasure.decide(rows.where("artifact_kind = 'derived_artifact'"), kept)
    return derived.unionByName(erasure.decide(rows.where("artifact_kind <> 'derived_artifact'")))


@query("c04_dispositions", "SELECT * FROM decided", **SWEPT, classified=CLASSIFIED, decided=DECIDED)
def _(t):
    return decided(t).select("artifact_kind", "artifact_id", "disposition")


@query(
    "d12_after_deletion",
    """SELECT 'embedding' AS name, count(*) AS n FROM embedding WHERE artifact_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact') AND embedding_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'embedding')
    UNION ALL SELECT 'lineage_edge', count(*) FROM lineage_edge WHERE child_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact') AND (parent_kind, parent_id) NOT IN (SELECT (artifact_kind, artifact_id) FROM gone)
    UNION ALL SELECT 'client_binding', count(*) FROM client_binding WHERE artifact_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact')
    UNION ALL SELECT 'derived_artifact', count(*) FROM derived_artifact WHERE artifact_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact')
    UNION ALL SELECT 'ledger', count(*) FROM ledger WHERE event_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'event')
    UNION ALL SELECT 'session', count(*) FROM session WHERE session_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'session')""",
    **SWEPT,
    classified=CLASSIFIED,
    decided=DECIDED,
    gone="SELECT artifact_kind, artifact_id FROM decided WHERE disposition = 'hard_delete'",
)
def _(t):
    left = erasure.delete(saved(decided(t)), t.derived_artifact, t.client_binding, t.lineage_edge, t.embedding, t.ledger, t.session)
    return upkeep.tier_counts({name: [df] for name, df in left.items()}).withColumnRenamed("tier", "name")


@query(
    "d13_redaction",
    "SELECT artifact_id, CASE WHEN artifact_id % 3 = 0 THEN sha256('redacted ' || artifact_id) ELSE content_digest END AS content_digest, CASE WHEN artifact_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS revision FROM derived_artifact",
)
def _(t):
    a = F.col("artifact_id")
    digest = F.when(a % 3 == 0, F.col("content_digest")).otherwise("stale")
    rewrites = t.derived_artifact.where("artifact_id % 3 <> 2").select("artifact_id", digest.alias("pre_digest"), F.concat(F.lit("redacted "), a).alias("new_body"))
    return erasure.redact(t.derived_artifact, rewrites).select("artifact_id", "content_digest", "revision")


# --- chains and checkpoints


def chained(t):
    return chain.append(t.ledger)


@query("d01_chain_append")
def _(t):
    return chained(t).select("event_id", "session_id", "seq", "content_digest", "prev_chain_digest", "chain_digest")


@query("ud01_verify_chain", "SELECT session_id, count(*) AS rows, CASE WHEN session_id % 7 = 3 AND count(*) >= 4 THEN 3 ELSE count(*) END AS verified, CASE WHEN session_id % 7 = 3 AND count(*) >= 4 THEN 'content' END AS fault, CASE WHEN session_id % 7 = 3 AND count(*) >= 4 THEN 4 END AS fault_seq FROM ledger GROUP BY session_id")
def _(t):
    tampered = F.when((F.col("session_id") % 7 == 3) & (F.col("seq") == 4), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    found = chain.verify(saved(chained(t)).withColumn("payload", tampered))
    return found.select("session_id", "rows", "verified", "fault", F.col("fault_seq").cast("int").alias("fault_seq"))


@query("a17_root_digests")
def _(t):
    return chain.root_digest(chain.hourly_tips(chained(t), 24), "window_start").select(micros(F.col("window_start").cast("timestamp_ntz")).alias("window_us"), "sessions", "root_digest")


@query("st10_daily_tips", "SELECT epoch_us(date_trunc('day', occurred_at)) AS window_us, session_id, max(seq) AS terminal_seq, arg_max(event_id, seq) AS event_id FROM ledger GROUP BY 1, 2")
def _(t):
    rows = t.ledger.withColumn("chain_digest", F.col("event_id"))
    tips = chain.hourly_tips(rows, 24)
    return tips.select(micros(F.col("window_start").cast("timestamp_ntz")).alias("window_us"), "session_id", "terminal_seq", F.col("terminal_digest").alias("event_id"))


@query(
    "j27_checkpoint_compare",
    "SELECT session_id, session_id % 10 = 1 AS missing, session_id % 4 = 1 AS accounted FROM (SELECT DISTINCT session_id FROM ledger) WHERE session_id % 10 = 1 OR session_id % 5 = 2",
)
def _(t):
    tips = saved(chain.window_tips(chained(t), moment("2020-01-01 00:00:00"), moment("2030-01-01 00:00:00")))
    moved = F.when(F.col("session_id") % 5 == 2, "other").otherwise(F.col("terminal_digest"))
    live = tips.where("session_id % 10 <> 1").withColumn("terminal_digest", moved)
    return chain.compare(tips, live, tips.where("session_id % 4 = 1").select("session_id"))


# --- policy

RULES = [
    policy.Rule(1, "halt-expensive", "session_cost", "halt_agent", threshold=1400.0),
    policy.Rule(2, "many-errors", "error_rate", "warn", threshold=0.3, window_events=20),
    policy.Rule(3, "key-material", "file_path", "require_approval", pattern="**/*.pem"),
    policy.Rule(4, "environment", "file_path", "warn", pattern="~/.env"),
    policy.Rule(5, "force-push", "shell_command", "require_approval", pattern="git push*"),
    policy.Rule(6, "removal", "shell_command", "halt_agent", pattern=r"re:^rm\s"),
    policy.Rule(7, "client-three", "client", "warn", client_id=3),
    policy.Rule(8, "off", "client", "halt_agent", client_id=4, enabled=False),
]
PATHS, COMMANDS = ("src/main.py", "a//b\\.env", "keys/host.pem", "envy/.environment"), ("ls -la", "rm -rf /tmp/x", "git push --force", "git pull")
MUTATION = """SELECT event_id, l.session_id, l.client_id, seq, category, s.cost_usd::DOUBLE AS cost,
  CASE WHEN category = 'file_read' THEN ['src/main.py','a//b\\.env','keys/host.pem','envy/.environment'][1 + k % 4] END AS path,
  CASE WHEN category = 'tool_call' THEN ['ls -la','rm -rf /tmp/x','git push --force','git pull'][1 + k % 4] END AS command,
  avg(CASE WHEN category = 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY l.session_id ORDER BY seq ROWS 19 PRECEDING) AS share
  FROM (SELECT *, (payload->>'$.k')::BIGINT AS k FROM ledger) l JOIN session s USING (session_id)"""
MET = """SELECT event_id, session_id, client_id, category, rule_id, action, row_number() OVER (PARTITION BY event_id ORDER BY rank, name) = 1 AS governing FROM (
  SELECT *, 1::BIGINT AS rule_id, 'halt-expensive' AS name, 'halt_agent' AS action, 1 AS rank FROM mutation WHERE cost > 1400
  UNION ALL SELECT *, 2, 'many-errors', 'warn', 3 FROM mutation WHERE share > 0.3
  UNION ALL SELECT *, 3, 'key-material', 'require_approval', 2 FROM mutation WHERE path LIKE '%.pem'
  UNION ALL SELECT *, 4, 'environment', 'warn', 3 FROM mutation WHERE path LIKE '%.env'
  UNION ALL SELECT *, 5, 'force-push', 'require_approval', 2 FROM mutation WHERE command LIKE 'git push%'
  UNION ALL SELECT *, 6, 'removal', 'halt_agent', 1 FROM mutation WHERE command LIKE 'rm %'
  UNION ALL SELECT *, 7, 'client-three', 'warn', 3 FROM mutation WHERE client_id = 3)"""
POLICY = {"mutation": MUTATION, "met": MET}


def mutations(t):
    k = (F.get_json_object("payload", "$.k").cast("long") % 4).cast("int")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), k)
    return t.ledger.withColumns({"path": F.when(F.col("category") == "file_read", pick(PATHS)), "command": F.when(F.col("category") == "tool_call", pick(COMMANDS))})


def outcomes(t):
    return policy.evaluate(policy.enrich(mutations(t), t.session, RULES), RULES)


@query("c12_policy_outcomes", "SELECT event_id, rule_id, action, governing FROM met", **POLICY)
def _(t):
    return outcomes(t).select("event_id", "rule_id", "action", "governing")


@query("d14_new_matches", "SELECT rule_id, session_id, event_id FROM met WHERE rule_id <> 7", **POLICY)
def _(t):
    found = outcomes(t)
    return policy.new_matches(found.unionAll(found), found.where("rule_id = 7")).select("rule_id", "session_id", "event_id")


@query("d14_halted_sessions", "SELECT session_id, min(event_id) AS event_id FROM met WHERE action = 'halt_agent' AND session_id IN (SELECT session_id FROM session WHERE outcome = 'in_progress') GROUP BY session_id", **POLICY)
def _(t):
    return policy.halts(outcomes(t), t.session).select("session_id", "event_id")


@query("j03_approval_queue", "SELECT m.event_id, m.rule_id, s.client_id, s.outcome FROM met m JOIN session s USING (session_id) WHERE action = 'require_approval' AND s.client_id IN (3, 7, 11)", **POLICY)
def _(t):
    return policy.approvals(outcomes(t), policy.rule_table(t.spark, RULES), t.session, CLIENTS).select("event_id", "rule_id", "client_id", "outcome")


# --- upkeep


@query("d06_working_latest", "SELECT session_id, scratch_key, arg_max(value, {'at': updated_at, 'v': value}) AS value FROM working_memory GROUP BY session_id, scratch_key")
def _(t):
    return upkeep.latest(t.working_memory).select("session_id", "scratch_key", "value")


@query("d06_working_purge", "SELECT count(*) AS purged FROM working_memory WHERE session_id IN (SELECT session_id FROM session WHERE client_id = 3)")
def _(t):
    return upkeep.purge(t.working_memory, t.session.where("client_id = 3"))[1]


@query(
    "d05_session_upsert",
    "SELECT session_id, outcome, error_count + 1 AS error_count FROM (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'succeeded' ELSE outcome END AS outcome, error_count FROM session)",
)
def _(t):
    new = t.session.withColumns({"outcome": F.when(F.col("session_id") % 2 == 0, "succeeded").otherwise("in_progress"), "error_count": F.col("error_count") + 1, "token_count": F.lit(0).cast("long")})
    return upkeep.upsert_sessions(t.session, new).select("session_id", "outcome", "error_count")


@query("d09_lease_acquire", f"SELECT c.client_id, coalesce(l.expires_at < TIMESTAMP '{NOW}', true) AS granted, m.g + coalesce(l.expires_at < TIMESTAMP '{NOW}', true)::INT AS generation FROM client c LEFT JOIN (SELECT * FROM erasure_lease WHERE superseded_at IS NULL) l USING (client_id) JOIN (SELECT client_id, max(generation) AS g FROM erasure_lease GROUP BY 1) m USING (client_id)")
def _(t):
    return upkeep.acquire(t.erasure_lease, t.client, moment(NOW))


@query("d10_fenced_writes", "SELECT client_id, generation FROM (SELECT client_id, 1::BIGINT AS generation FROM client UNION ALL SELECT client_id, 2 FROM client) WHERE (client_id, generation) IN (SELECT (client_id, generation) FROM erasure_lease WHERE superseded_at IS NULL)")
def _(t):
    writes = t.client.select("client_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("generation"))
    return upkeep.fenced(writes, t.erasure_lease)


@query("d11_unguarded_writes", "SELECT binding_id FROM client_binding WHERE client_id NOT IN (SELECT client_id FROM erasure_run WHERE status = 'running')")
def _(t):
    return upkeep.unguarded(t.client_binding, t.erasure_run).select("binding_id")


ADMITTED = "SELECT * FROM procedure_outcome WHERE (procedure_id, session_id) IN (SELECT (procedure_id, session_id) FROM procedure_retrieval) QUALIFY row_number() OVER (PARTITION BY procedure_id, session_id ORDER BY recorded_at, outcome_id) = 1"


@query("j30_admitted_outcomes", "SELECT outcome_id, procedure_id, session_id FROM admitted", admitted=ADMITTED)
def _(t):
    return upkeep.admitted_outcomes(t.procedure_outcome, t.procedure_retrieval).select("outcome_id", "procedure_id", "session_id")


@query(
    "d08_standing_changes",
    """WITH RECURSIVE o AS (SELECT procedure_id, outcome_id, CASE outcome WHEN 'succeeded' THEN 0.05 ELSE -0.10 END::DOUBLE AS d, row_number() OVER (PARTITION BY procedure_id ORDER BY recorded_at, outcome_id) AS n FROM admitted WHERE outcome <> 'abandoned'),
    f(procedure_id, outcome_id, n, prior_value, new_value) AS (SELECT procedure_id, outcome_id, n, 0.5::DOUBLE, round(greatest(0, least(1, 0.5 + d)), 6) FROM o WHERE n = 1
      UNION ALL SELECT o.procedure_id, o.outcome_id, o.n, f.new_value, round(greatest(0, least(1, f.new_value + d)), 6) FROM f JOIN o ON o.procedure_id = f.procedure_id AND o.n = f.n + 1)
    SELECT procedure_id, outcome_id, prior_value, new_value FROM f WHERE prior_value <> new_value""",
    admitted=ADMITTED,
)
def _(t):
    return upkeep.standing_changes(upkeep.admitted_outcomes(t.procedure_outcome, t.procedure_retrieval))


# --- capture and text


@query("s08_parse_batch")
def _(t):
    return ingest.tally(ingest.parse_batch(wire(t)))


def wire(t):
    """Event records as lines, some of them broken, from the ledger."""
    record = F.to_json(
        F.struct(
            F.lit("cli").alias("agent_cli"), F.when(F.col("event_id") % 13 == 0, "unheard").otherwise(F.col("category")).alias("category"), F.col("client_id").cast("string").alias("client_id"),
            F.col("event_id").cast("string").alias("id"), F.lit("m1").alias("machine_id"),
            F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 17 == 0, "").otherwise("Z")).alias("occurred_at"),
            F.lit("x").alias("payload"), F.lit(False).alias("redacted"), F.col("session_id").cast("string").alias("session_id"),
        )
    )
    broken = F.when(F.col("event_id") % 11 == 0, F.substring(record, 1, 20)).when(F.col("event_id") % 7 == 0, F.replace(record, F.lit('"machine_id"'), F.lit('"machine"')))
    return t.ledger.select(F.coalesce(broken, record).alias("value"))


@query("j23_call_pairs")
def _(t):
    k = F.get_json_object("payload", "$.k").cast("long")
    kind = F.when(F.col("category") == "tool_call", "tool_call").when(F.col("category") == "error", "tool_result")
    rows = t.ledger.select("session_id", "seq", "event_id", kind.alias("category"), F.concat(F.lit("t"), k % 3).alias("tool"), F.when(k % 2 == 0, F.concat(F.lit("c"), k % 20)).alias("correlation"))
    return ingest.pair_calls(rows.where("category is not null"))


@query("f12_redacted_texts", "SELECT artifact_id, replace(body, chr(1), chr(1)) AS body FROM (SELECT artifact_id, 'key ' || '[removed]' || ' then Bearer [removed] https://[removed]@host/' AS body FROM derived_artifact)")
def _(t):
    a = F.col("artifact_id")
    made = F.concat(F.lit("key AKIA"), F.lpad(a.cast("string"), 16, "A"), F.lit(" then Bearer "), F.lpad(a.cast("string"), 20, "x"), F.lit(" https://user:pass"), a, F.lit("@host/"))
    return t.derived_artifact.select("artifact_id", text.redact_secrets(made).alias("body"))


@query("f14_redacted_payloads")
def _(t):
    payload = F.to_json(F.struct(F.struct(F.col("body").alias("apiToken"), F.col("artifact_id").alias("n")).alias("outer"), F.lit("plain").alias("note")))
    return t.derived_artifact.select("artifact_id", text.redact_json()(payload).alias("r")).select("artifact_id", "r.value", "r.modified")


@query("f20_canonical_payloads", "SELECT event_id, '{\"a\":[1,2],\"k\":' || (payload->>'$.k') || '}' AS canonical FROM ledger")
def _(t):
    odd = F.concat(F.lit('{"k" : '), F.get_json_object("payload", "$.k"), F.lit('.0, "a": [1.0, 2]}'))
    return t.ledger.select("event_id", digests.canonical_json(odd).alias("canonical"))


@query("f22_byte_caps", "SELECT artifact_id, CASE WHEN strlen(body) <= 50 THEN body ELSE (SELECT max(left(body, n)) FILTER (strlen(left(body, n)) <= 50) FROM (SELECT unnest(range(0, 51)) AS n)) END AS body FROM derived_artifact")
def _(t):
    return t.derived_artifact.select("artifact_id", text.byte_cap(F.col("body"), 50).alias("body"))


@query("f23_clip_or_digest", "SELECT artifact_id, CASE WHEN strlen(body) <= 1000 THEN body END AS value, CASE WHEN strlen(body) > 1000 THEN sha256(body) END AS digest, strlen(body) AS bytes FROM derived_artifact")
def _(t):
    return t.derived_artifact.select("artifact_id", text.clip_or_digest(F.col("body"), 1000).alias("c")).select("artifact_id", "c.*")


@query("f33_metric_admission", "WITH first AS (SELECT category AS name, session_id AS dims, min(occurred_at) AS f FROM ledger GROUP BY ALL), kept AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f, dims::VARCHAR) AS place FROM first) SELECT l.category AS name, CASE WHEN place <= 10 THEN session_id::VARCHAR ELSE 'other' END AS dims, count(*) AS n, sum(seq)::BIGINT AS value FROM ledger l JOIN kept k ON k.name = l.category AND k.dims = l.session_id GROUP BY ALL")
def _(t):
    rows = t.ledger.select(F.col("category").alias("name"), F.col("session_id").cast("string").alias("dims"), F.col("occurred_at").alias("at"), F.col("seq").alias("value"))
    return ingest.admit_metrics(rows)
