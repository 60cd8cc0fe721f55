"""Certificates, whole runs, views, the remaining table changes, and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import erasure, evidence, graph, history, ingest, policy, upkeep
from ..session import saved
from ..sources import generator
from .pipelines import AUTO, DOWN, MUTATION, POLICY, RESIDUE, mutations, outcomes, swept, walked
from .reads import CURRENT
from .registry import CLIENT, CLIENTS, query

CERTIFICATE = f"""SELECT run_id, r.client_id, '{{"after":"' || coalesce(l.n, 0) || '","before":"' || (coalesce(n.n, 0) + coalesce(l.n, 0)) || '","client":"' || slug || '","generation":' || coalesce('"' || g.generation || '"', 'null')
  || ',"hard_delete":"' || coalesce(d.hd, 0) || '","retained":"' || coalesce(d.re, 0) || '","run":"' || run_id || '","status":"' || status || '","surgical_redaction":"' || coalesce(d.su, 0) || '"}}' AS document
  FROM erasure_run r JOIN client c ON c.client_id = r.client_id LEFT JOIN (SELECT run_id, count(*) FILTER (disposition = 'hard_delete') AS hd, count(*) FILTER (disposition = 'retained') AS re, count(*) FILTER (disposition = 'surgical_redaction') AS su FROM disposition GROUP BY 1) d USING (run_id)
  LEFT JOIN (SELECT run_id, slug, count(*) AS n FROM (SELECT run_id, unnest(bindings_before) AS slug FROM disposition) GROUP BY 1, 2) n USING (run_id, slug)
  LEFT JOIN (SELECT client_id, count(*) AS n FROM ({CURRENT}) GROUP BY 1) l ON l.client_id = r.client_id LEFT JOIN (SELECT client_id, generation FROM erasure_lease WHERE superseded_at IS NULL) g ON g.client_id = r.client_id"""


def made(t):
    return evidence.certificates(t.erasure_run, t.client, t.disposition, t.client_binding, t.erasure_lease)


@query("c08_certificates", "SELECT run_id, document, sha256(document) AS digest FROM certificate", certificate=CERTIFICATE)
def _(t):
    return made(t).select("run_id", "document", "digest")


@query(
    "c09_certificate_checks",
    "SELECT run_id, run_id % 6 <> 1 AS digest_holds, true AS count_holds, (SELECT count(*) FROM disposition d WHERE d.run_id = r.run_id AND disposition = 'hard_delete' AND artifact_id % 2 = 0) AS survivors FROM erasure_run r",
)
def _(t):
    tampered = made(t).withColumn("document", F.when(F.col("run_id") % 6 == 1, F.replace("document", F.lit('"status"'), F.lit('"state"'))).otherwise(F.col("document")))
    return evidence.verify(tampered, t.disposition, t.client_binding, t.derived_artifact.where("artifact_id % 2 = 0"))


EXTENDED = "SELECT * FROM candidate UNION ALL SELECT 'derived_artifact', artifact_id, 'semantic_residue' FROM residue"
EXTENDED_CLASS = f"""SELECT c.artifact_kind, c.artifact_id, c.selection_reason, count(*) FILTER (b.client_id <> {CLIENT}) AS others, count(*) FILTER (b.client_id = {CLIENT}) AS own
  FROM extended c LEFT JOIN ({CURRENT}) b ON b.artifact_id = c.artifact_id AND c.artifact_kind = 'derived_artifact' GROUP BY ALL"""


@query(
    "c05_erasure_run",
    """SELECT artifact_kind, artifact_id, selection_reason, CASE WHEN own = 0 AND selection_reason NOT IN ('session_scope', 'event_of_scoped_session') THEN 'retained' WHEN others = 0 THEN 'hard_delete' ELSE 'surgical_redaction' END AS disposition,
    CASE WHEN own = 0 AND selection_reason NOT IN ('session_scope', 'event_of_scoped_session') THEN 'binding_already_absent' WHEN others = 0 THEN 'sole_client_binding' ELSE 'blended_binding' END AS reason FROM extended_class""",
    **RESIDUE,
    extended=EXTENDED,
    extended_class=EXTENDED_CLASS,
)
def _(t):
    """C-05 and C-06: the decisions of a whole run; nothing is changed until they are applied."""
    candidates = evidence.extend(swept(t), erasure.band(walked(t), AUTO))
    found = erasure.decide(erasure.classify(candidates, t.client_binding, t.client, CLIENT))
    return found.select("artifact_kind", "artifact_id", "selection_reason", "disposition", "reason")


@query(
    "c13_fleet",
    "SELECT c.client_id, c.slug, coalesce(s.sessions, 0) AS sessions, coalesce(s.running, 0) AS running, coalesce(s.cost, 0) AS cost, coalesce(m.matches, 0) AS matches FROM client c LEFT JOIN (SELECT client_id, count(*) AS sessions, count(*) FILTER (outcome = 'in_progress') AS running, sum(cost_usd)::DOUBLE AS cost FROM session GROUP BY 1) s USING (client_id) LEFT JOIN (SELECT client_id, count(*) AS matches FROM met GROUP BY 1) m USING (client_id)",
    **POLICY,
)
def _(t):
    return evidence.fleet(t.session, t.client, outcomes(t))


@query(
    "c13_procedures",
    "SELECT artifact_id AS procedure_id, confidence, coalesce(r.n, 0) AS retrievals, coalesce(o.s, 0) AS succeeded, coalesce(o.f, 0) AS failed FROM derived_artifact a LEFT JOIN (SELECT procedure_id, count(*) AS n FROM procedure_retrieval GROUP BY 1) r ON r.procedure_id = a.artifact_id LEFT JOIN (SELECT procedure_id, count(*) FILTER (outcome = 'succeeded') AS s, count(*) FILTER (outcome = 'failed') AS f FROM procedure_outcome GROUP BY 1) o ON o.procedure_id = a.artifact_id WHERE a.kind = 'learned_procedure'",
)
def _(t):
    return evidence.procedures(t.derived_artifact, t.procedure_retrieval, t.procedure_outcome)


@query(
    "w08_order_in_layer",
    f"WITH RECURSIVE n AS (SELECT artifact_id AS node FROM derived_artifact WHERE artifact_id IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11)) ORDER BY artifact_id LIMIT 200), i AS (SELECT src, dst FROM edge WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)), l(node, layer) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM i) UNION SELECT i.dst, layer + 1 FROM l JOIN i ON i.src = l.node), m AS (SELECT node, max(layer) AS layer FROM l GROUP BY node) SELECT node, layer, row_number() OVER (PARTITION BY layer ORDER BY node) AS place FROM m",
    edge=DOWN,
)
def _(t):
    nodes = history.permitted_artifacts(t.client_binding, CLIENTS).select(F.col("artifact_id").alias("node"))
    nodes = saved(t.derived_artifact.select(F.col("artifact_id").alias("node")).join(nodes, "node", "left_semi").orderBy("node").limit(200))  # a view shows so many nodes
    found = graph.layers(nodes, graph.down(graph.inside(t.lineage_edge, nodes)))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy("node")).cast("long"))


# --- table changes


@query("d07_new_embeddings", "SELECT artifact_id FROM derived_artifact WHERE artifact_id % 2 = 0 AND artifact_id NOT IN (SELECT artifact_id FROM embedding) UNION ALL SELECT artifact_id FROM embedding")
def _(t):
    new = t.derived_artifact.where("artifact_id % 2 = 0").join(t.embedding, "artifact_id", "left_anti").select("artifact_id")
    return new.union(t.embedding.select("artifact_id"))


@query("d15_resolved_approvals", "SELECT event_id AS approval_id, CASE WHEN event_id % 3 = 0 THEN 'approved' WHEN event_id % 2 = 0 THEN 'denied' ELSE 'pending' END AS status FROM met WHERE action = 'require_approval'", **POLICY)
def _(t):
    e = F.col("event_id")
    queue = outcomes(t).where("action = 'require_approval'").select(e.alias("approval_id"), F.when(e % 3 == 0, "approved").otherwise("pending").alias("status"))
    answers = queue.where("approval_id % 2 = 0").select("approval_id", F.lit("denied").alias("resolution"))
    return policy.resolve(queue, answers)


@query("d17_reset_counts", "SELECT 'ledger' AS tier, count(*) AS n FROM ledger WHERE client_id = 3 UNION ALL SELECT 'session', count(*) FROM session WHERE client_id = 3 UNION ALL SELECT 'derived_artifact', count(*) FROM derived_artifact WHERE owner_client_id = 3")
def _(t):
    own = lambda df, c="client_id": [df.where(F.col(c) == CLIENT)]
    return upkeep.tier_counts({"ledger": own(t.ledger), "session": own(t.session), "derived_artifact": own(t.derived_artifact, "owner_client_id")})


@query("d18_live_rows", "SELECT event_id FROM ledger WHERE expires_at > TIMESTAMP '2024-02-20'")
def _(t):
    from ..sources.tables import moment

    return upkeep.live(t.ledger, moment("2024-02-20 00:00:00")).select("event_id")


@query("d21_client_upsert", "SELECT client_id, slug FROM client UNION ALL SELECT 100, 'NEW'")
def _(t):
    new = t.client.select((F.col("client_id") + 500).alias("new_id"), "slug").where("client_id < 5").union(t.spark.createDataFrame([(100, "NEW")], "new_id long, slug string"))
    joined = t.client.select("client_id", "slug").join(new, "slug", "full")
    return joined.select(F.coalesce("client_id", "new_id").alias("client_id"), "slug")


@query("a24_merged_findings", f"SELECT artifact_id, distance, true AS included FROM residue", **RESIDUE)  # noqa: F541
def _(t):
    found = saved(erasure.band(walked(t), AUTO).select("artifact_id", "query_id", "distance", "included"))
    return erasure.merge_findings(found, found.withColumns({"distance": F.col("distance") + 0.1, "included": F.lit(True)})).select("artifact_id", "distance", "included")


@query("a18_batch_tally", "SELECT CASE WHEN event_id % 11 = 0 THEN 'not_json' WHEN event_id % 7 = 0 THEN 'unknown_field' WHEN event_id % 13 = 0 THEN 'bad_category' WHEN event_id % 17 = 0 THEN 'naive_instant' ELSE 'accepted' END AS reason, count(*) AS n FROM ledger GROUP BY 1")
def _(t):
    from .pipelines import wire

    return ingest.tally(ingest.parse_batch(wire(t)))


# --- sources and scalar functions


@query("s23_generated_corpus", "SELECT c.artifact_id AS seed, i AS event_id, (i * 31 + c.artifact_id) % 28 AS session_id, (i * 31 + c.artifact_id) % 28 % 4 AS client_id, ['session_start','prompt','model_request','model_response','tool_call','tool_result','file_read','file_write','shell_command','response','cost_record','session_end'][1 + (i // 28) % 12] AS category, sha256(c.artifact_id || ':' || i) AS payload FROM derived_artifact c, range(60) r(i)")
def _(t):
    return generator.corpora(t.derived_artifact.select(F.col("artifact_id").alias("seed")), 60)


@query("s11_rules_from_toml", "SELECT event_id, 1::BIGINT AS rule_id, 'require_approval' AS action FROM mutation WHERE path LIKE '%.pem' UNION ALL SELECT event_id, 2, 'halt_agent' FROM mutation WHERE cost > 1400", mutation=MUTATION)
def _(t):
    rules = policy.rules_from_toml('[[rule]]\nname = "keys"\nmatch_kind = "file_path"\naction = "require_approval"\npattern = "**/*.pem"\n[[rule]]\nname = "spend"\nmatch_kind = "session_cost"\naction = "halt_agent"\nthreshold = 1400.0\n')
    return policy.evaluate(policy.enrich(mutations(t), t.session, rules), rules).select("event_id", "rule_id", "action")


PATHS = ("a/b/key.pem", "C:\\\\x\\\\key.pem", "key.pem.txt", "/etc//passwd", "home/etc/passwd", "src/.env", "x/secrets/a/b", "secretsx/a")


@query("f08_path_rules")
def _(t):
    rules = ("**/*.pem", "/etc/passwd", "~/.env", "secrets/", "re:^src", "?ey.pem")
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("event_id") % len(PATHS)).cast("int"))
    return t.ledger.select("event_id", *[text.normal_path(path).rlike(text.path_pattern(r)).alias(f"r{i}") for i, r in enumerate(rules)])


@query("f11_markers", "SELECT artifact_id, regexp_matches(body, '" + text.marker_pattern("la").replace("'", "''").replace("(?iu:", "(?i:") + "') AS la, regexp_matches(body, '" + text.marker_pattern("the").replace("'", "''").replace("(?iu:", "(?i:") + "') AS the FROM derived_artifact")
def _(t):
    return t.derived_artifact.select("artifact_id", F.col("body").rlike(text.marker_pattern("la")).alias("la"), F.col("body").rlike(text.marker_pattern("the")).alias("the"))


@query("f13_sensitive_keys", "SELECT event_id, event_id % 4 IN (0, 2) AS sensitive FROM ledger")
def _(t):
    key = F.get(F.array(*[F.lit(k) for k in ("dbPassword", "tokenizer", "API-Key", "monkey")]), (F.col("event_id") % 4).cast("int"))
    return t.ledger.select("event_id", text.is_sensitive_key(key).alias("sensitive"))


@query("f24_verdicts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' END AS verdict FROM ledger")
def _(t):
    replies = ('{"verdict": "include"}', '```json\n{"verdict": "EXCLUDE"}\n```', '{"verdict": "maybe"}', "no json")
    reply = F.get(F.array(*[F.lit(r) for r in replies]), (F.col("event_id") % 4).cast("int"))
    return t.ledger.select("event_id", text.verdict(reply).alias("verdict"))


@query("f25_rewrite_faults", "SELECT artifact_id, CASE artifact_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'names_erased' WHEN 2 THEN 'length_ratio' END AS fault FROM derived_artifact")
def _(t):
    body = F.concat(F.lit("x"), "body")
    k = F.col("artifact_id") % 4
    after = F.when(k == 0, " ").when(k == 1, F.concat(body, F.lit(" Nation_3"))).when(k == 2, F.repeat(body, 3)).otherwise(F.concat(body, F.lit(".")))
    return t.derived_artifact.select("artifact_id", text.rewrite_fault(body, after, F.lit("NATION_3")).alias("fault"))


@query("f27_severity", "SELECT event_id, min(CASE action WHEN 'halt_agent' THEN 1 WHEN 'require_approval' THEN 2 WHEN 'warn' THEN 3 END) AS rank FROM met GROUP BY event_id", **POLICY)
def _(t):
    return outcomes(t).groupBy("event_id").agg(F.min(policy.rank(F.col("action"))).cast("int").alias("rank"))
