"""Runs as they are applied, stored evidence, embedding state, provider seams, the four questions, and twins of hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import facade
from ..functions import text, vectors
from ..operators import erasure, evidence, history, ingest, providers, runs
from ..session import saved
from ..sources import generator
from ..sources.tables import micros, moment
from .evidence import EXTENDED, EXTENDED_CLASS
from .pipelines import AUTO, AUTOS, DOWN, NEAR, RECALL, RESIDUE, REVIEWS, chained, swept, walked
from .reads import CURRENT, EARLIEST, NOW
from .registry import CLIENT, CLIENTS, query

# --- runs


@query("j02_run_headers", "SELECT run_id, slug, status, epoch_us(started_at) AS started_us FROM erasure_run JOIN client USING (client_id)")
def _(t):
    return runs.headers(t.erasure_run, t.client).select("run_id", "slug", "status", micros("started_at").alias("started_us"))


@query(
    "d16_begun_runs",
    """SELECT idempotency_key, coalesce(r.run_id, a.run_id) AS run_id, r.run_id IS NOT NULL AS replayed FROM (SELECT CASE WHEN client_id % 3 = 0 THEN 'key-' || client_id ELSE 'new-' || (client_id // 2) END AS idempotency_key, min(client_id + 500) AS run_id FROM client GROUP BY 1) a
    LEFT JOIN erasure_run r USING (idempotency_key)""",
)
def _(t):
    c = F.col("client_id")
    key = F.when(c % 3 == 0, F.concat(F.lit("key-"), c)).otherwise(F.concat(F.lit("new-"), F.floor(c / 2)))
    return runs.begin(t.erasure_run, t.client.select((c + 500).alias("run_id"), c, key.alias("idempotency_key")), moment(NOW))[1]


ENDED = """SELECT run_id, CASE WHEN status = 'running' AND run_id % 5 <> 0 THEN CASE WHEN run_id % 2 = 0 THEN 'completed' ELSE 'aborted' END ELSE status END AS status,
  CASE WHEN status <> 'running' THEN 'replayed' WHEN run_id % 5 = 0 THEN 'bad_status' ELSE 'finalised' END AS outcome FROM erasure_run"""


@query("d16_finalised_runs", f"{ENDED} UNION ALL SELECT 999, NULL, 'unknown_run'")
def _(t):
    r = F.col("run_id")
    status = F.when(r % 5 == 0, "odd").when(r % 2 == 0, "completed").otherwise("aborted")
    results = t.erasure_run.select(r, status.alias("status")).union(t.spark.createDataFrame([(999, "completed")], "run_id long, status string"))
    after, first = runs.finalise(t.erasure_run, results.union(results), moment(NOW))
    again = runs.finalise(after, results, moment(NOW))[1].where("outcome = 'finalised'")  # nothing is left to end
    return first.union(again)


ALONE = f"SELECT artifact_id FROM ({CURRENT}) GROUP BY artifact_id HAVING count(*) FILTER (client_id <> 4) = 0 AND count(*) FILTER (client_id = 4) > 0"


@query("j16_orphaned_parent_edges", f"SELECT edge_id FROM lineage_edge WHERE parent_kind = 'derived_artifact' AND child_id % 2 = 0 AND parent_id IN ({ALONE})")
def _(t):
    return runs.orphaned_parent_edges(t.lineage_edge, t.client_binding, 4, t.derived_artifact.where("artifact_id % 2 = 0").select("artifact_id")).select("edge_id")


def told(tables):
    """Rows of several tables as (name, id, state)."""
    kinds = {
        "derived_artifact": ("artifact_id", F.concat_ws("/", "content_digest", F.col("revision").cast("string"))), "lineage_edge": ("edge_id", F.lit("")), "ledger": ("event_id", F.lit("")),
        "client_binding": ("binding_id", F.when(F.col("superseded_by").isNull(), "open").otherwise("closed")), "session": ("session_id", F.lit("")),
        "disposition": ("artifact_id", F.concat_ws("/", "artifact_kind", "disposition")), "embedding": ("embedding_id", F.lit("")), "renewed": ("embedding_id", F.lit("")),
    }
    out = None
    for name, rows in tables.items():
        key, state = kinds[name]
        own = rows.select(F.lit(name).alias("name"), F.col(key).alias("id"), state.alias("state"))
        out = own if out is None else out.union(own)
    return out


def renewed(before, after):
    """Vectors that are no longer what they were."""
    return after.join(before.select("embedding_id", F.col("vec").alias("_old")), "embedding_id").where("vec <> _old")


@query(
    "d13_whole_redaction",
    f"""SELECT 'derived_artifact' AS name, artifact_id AS id, CASE WHEN artifact_id % 3 = 0 THEN sha256('redacted ' || artifact_id) || '/2' ELSE content_digest || '/1' END AS state FROM derived_artifact
    UNION ALL SELECT 'lineage_edge', edge_id, '' FROM lineage_edge WHERE NOT (parent_kind = 'derived_artifact' AND child_id % 3 = 0 AND parent_id IN ({ALONE}))
    UNION ALL SELECT 'client_binding', binding_id, CASE WHEN superseded_by IS NULL AND NOT (client_id = 4 AND artifact_id % 3 = 0) THEN 'open' ELSE 'closed' END FROM client_binding
    UNION ALL SELECT 'renewed', embedding_id, '' FROM embedding WHERE artifact_id % 3 = 0 AND artifact_id IN (SELECT artifact_id FROM derived_artifact)""",
)
def _(t):
    a = F.col("artifact_id")
    digest = F.when(a % 3 == 0, F.col("content_digest")).otherwise("stale")
    rewrites = t.derived_artifact.where("artifact_id % 3 <> 2").select("artifact_id", digest.alias("pre_digest"), F.concat(F.lit("redacted "), a).alias("new_body"))
    after = runs.redact(t.derived_artifact, t.embedding, t.lineage_edge, t.client_binding, rewrites, 4, moment(NOW))
    after["renewed"] = renewed(t.embedding, after.pop("embedding"))
    return told(after)


RUN = RESIDUE | {
    "extended": EXTENDED,
    "extended_class": EXTENDED_CLASS,
    "final": """SELECT artifact_kind, artifact_id, CASE WHEN own = 0 AND selection_reason NOT IN ('session_scope', 'event_of_scoped_session') THEN 'retained' WHEN others = 0 OR artifact_kind <> 'derived_artifact' OR artifact_id % 2 = 1 THEN 'hard_delete' ELSE 'surgical_redaction' END AS disposition FROM extended_class""",
    "gone": "SELECT artifact_kind, artifact_id FROM final WHERE disposition = 'hard_delete'",
    "blended": "SELECT artifact_id FROM final WHERE disposition = 'surgical_redaction'",
    "binding_left": "SELECT * FROM client_binding WHERE artifact_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact')",
}


def decisions(t):
    """What a run decides, and the rewrites that a provider has for half of the artifacts."""
    candidates = evidence.extend(swept(t), erasure.band(walked(t), AUTO))
    decided = erasure.decide(erasure.classify(candidates, t.client_binding, t.client, CLIENT))
    rewrites = t.derived_artifact.where("artifact_id % 2 = 0").select("artifact_id", F.col("content_digest").alias("pre_digest"), F.concat(F.lit("rewritten "), F.col("artifact_id")).alias("new_body"))
    return saved(decided), rewrites


def run(t):
    names = ("derived_artifact", "client_binding", "lineage_edge", "embedding", "ledger", "session", "working_memory", "erasure_lease")
    return runs.apply({n: getattr(t, n) for n in names}, *decisions(t), CLIENT, 1, moment(NOW))


@query(
    "c05_applied_run",
    f"""SELECT 'disposition' AS name, artifact_id AS id, artifact_kind || '/' || disposition AS state FROM final
    UNION ALL SELECT 'derived_artifact', artifact_id, CASE WHEN artifact_id IN (FROM blended) THEN sha256('rewritten ' || artifact_id) || '/2' ELSE content_digest || '/1' END FROM derived_artifact WHERE artifact_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact')
    UNION ALL SELECT 'client_binding', binding_id, CASE WHEN superseded_by IS NULL AND NOT (client_id = {CLIENT} AND artifact_id IN (FROM blended)) THEN 'open' ELSE 'closed' END FROM binding_left
    UNION ALL SELECT 'lineage_edge', edge_id, '' FROM lineage_edge WHERE child_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact') AND (parent_kind, parent_id) NOT IN (SELECT (artifact_kind, artifact_id) FROM gone)
      AND NOT (parent_kind = 'derived_artifact' AND child_id IN (FROM blended) AND parent_id IN (SELECT artifact_id FROM binding_left WHERE superseded_by IS NULL GROUP BY artifact_id HAVING count(*) FILTER (client_id <> {CLIENT}) = 0))
    UNION ALL SELECT 'embedding', embedding_id, '' FROM embedding WHERE artifact_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'derived_artifact') AND embedding_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'embedding')
    UNION ALL SELECT 'ledger', event_id, '' FROM ledger WHERE event_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'event') AND session_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'session')
    UNION ALL SELECT 'session', session_id, '' FROM session WHERE session_id NOT IN (SELECT artifact_id FROM gone WHERE artifact_kind = 'session')""",
    **RUN,
)
def _(t):
    """C-05 whole: sweep, residue, decisions, and every table after they are applied under the client's lease."""
    after = run(t)
    after.pop("working_memory")
    return told(after)


# --- stored evidence

STORE = "SELECT date_trunc('day', occurred_at) + INTERVAL 1 DAY AS window_end, sha256(count(*)::VARCHAR) AS root_digest FROM ledger GROUP BY 1"


def checkpoints(t):
    days = t.ledger.groupBy(F.date_trunc("day", "occurred_at").cast("timestamp_ntz").alias("d")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("root_digest"))
    return days.select(F.timestamp_add("DAY", F.lit(1), F.col("d")).alias("window_end"), "root_digest")


@query("d19_stored_checkpoints", "SELECT epoch_us(window_end) AS window_us, CASE WHEN day(window_end) % 2 = 0 THEN root_digest ELSE 'later' END AS root_digest FROM store", store=STORE)
def _(t):
    store = checkpoints(t)
    found = runs.insert_once(store.where("day(window_end) % 2 = 0"), store.withColumn("root_digest", F.lit("later")), "window_end")
    return found.select(micros("window_end").alias("window_us"), "root_digest")


@query("o09_latest_checkpoint", "SELECT epoch_us(m) AS at_us, epoch_us(max(window_end)) AS window_us, arg_max(root_digest, window_end) AS root_digest FROM (SELECT DISTINCT started_at AS m FROM session UNION SELECT DISTINCT ended_at FROM session) LEFT JOIN store ON window_end <= m AND day(window_end) % 3 = 0 GROUP BY m", store=STORE)
def _(t):
    moments = t.session.select(F.col("started_at").alias("at")).union(t.session.select("ended_at"))
    found = runs.latest_checkpoint(checkpoints(t).where("day(window_end) % 3 = 0"), moments)
    return found.select(micros("at").alias("at_us"), micros("window_end").alias("window_us"), "root_digest")


@query("d20_stored_certificates", "SELECT run_id, CASE WHEN run_id < 10 THEN 'stored' WHEN run_id % 2 = 0 THEN 'archived' ELSE 'pending' END AS storage_status FROM erasure_run")
def _(t):
    made = evidence.certificates(t.erasure_run, t.client, t.disposition, t.client_binding, t.erasure_lease).withColumn("storage_status", F.lit("pending"))
    store = made.where("run_id < 10").withColumn("storage_status", F.lit("stored"))
    written = runs.insert_once(store, made, "run_id")
    reports = made.where("run_id % 2 = 0").select("run_id", F.lit("archived").alias("storage_status"))
    return runs.storage_status(written, reports).select("run_id", "storage_status")


# --- embedding state


def with_state(t):
    given = t.derived_artifact.where("artifact_id % 3 = 0").select("artifact_id", F.array(F.lit(1.0)).alias("vec"))
    return runs.write_with_vectors(t.derived_artifact, given)


STATE = "SELECT artifact_id, created_at, CASE WHEN artifact_id % 3 = 0 THEN 'embedded' WHEN coalesce(body, '') = '' THEN 'not_required' ELSE 'pending' END AS embedding_state FROM derived_artifact"


@query("d23_written_units", "SELECT artifact_id, embedding_state, embedding_state = 'embedded' AS has_vector FROM state", state=STATE)
def _(t):
    artifacts, vectors = with_state(t)
    there = vectors.select("artifact_id", F.lit(True).alias("has_vector"))
    return artifacts.join(there, "artifact_id", "left").select("artifact_id", "embedding_state", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query("d07_state_moves", "SELECT artifact_id, CASE WHEN embedding_state = 'pending' AND artifact_id % 2 = 0 THEN 'embedded' ELSE embedding_state END AS embedding_state FROM state", state=STATE)
def _(t):
    artifacts, vectors = with_state(t)
    written = t.derived_artifact.where("artifact_id % 2 = 0").select("artifact_id", F.array(F.lit(2.0)).alias("vec"))
    return runs.embedded(artifacts, vectors, written)[0].select("artifact_id", "embedding_state")


@query("o07_pending_sweep", "SELECT artifact_id FROM state WHERE embedding_state = 'pending' ORDER BY created_at, artifact_id LIMIT 100", state=STATE)
def _(t):
    return runs.pending(with_state(t)[0]).select("artifact_id")


@query("p15_unknown_states", "SELECT artifact_id FROM state WHERE artifact_id % 7 IN (2, 5)", state=STATE)
def _(t):
    a = F.col("artifact_id")
    odd = F.when(a % 7 == 2, "lost").when(a % 7 == 5, F.lit(None).cast("string")).otherwise(F.col("embedding_state"))
    return runs.known_states(with_state(t)[0].withColumn("embedding_state", odd))[1].select("artifact_id")


@query("a22_axis_values", f"SELECT 'auto' AS axis, unnest({list(AUTOS)})::DOUBLE AS value UNION ALL SELECT 'review', unnest({list(REVIEWS)})::DOUBLE")
def _(t):
    return runs.axis_values(erasure.sensitivity(walked(t), None, AUTOS, REVIEWS))


@query("u06_permitted_union", "SELECT artifact_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS clients FROM (SELECT artifact_id, [owner_client_id, 7, (artifact_id * 7 + 1) % 25, 3, owner_client_id] AS l FROM derived_artifact)")
def _(t):
    a, long = F.col("artifact_id"), lambda x: F.lit(x).cast("long")
    both = runs.permitted_union(F.array(F.col("owner_client_id"), long(7)), F.lit(None).cast("array<bigint>"), F.array((a * 7 + 1) % 25, long(3), F.col("owner_client_id")))
    return t.derived_artifact.select(a, F.array_join(both, ",").alias("clients"))


@query("a23_nearest_sightings", "SELECT artifact_id, query_id, distance FROM residue", **RESIDUE)
def _(t):
    return walked(t).select("artifact_id", "query_id", "distance")


@query("a20_spool_sums", "SELECT count(*) FILTER (tail <= 50000) AS kept_lines, coalesce(sum(n) FILTER (tail <= 50000), 0)::BIGINT AS kept_bytes, count(*) FILTER (tail > 50000) AS discarded_lines, coalesce(sum(n) FILTER (tail > 50000), 0)::BIGINT AS discarded_bytes FROM (SELECT strlen(payload) + 1 AS n, sum(strlen(payload) + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM ledger)")
def _(t):
    return ingest.spool_sums(t.ledger.select("event_id", "payload"), "event_id", "payload", 50_000)


@query(
    "d02_successors",
    f"""WITH submitted AS (SELECT artifact_id, 25::BIGINT AS client_id FROM derived_artifact WHERE artifact_id % 4 = 0 UNION ALL SELECT artifact_id, client_id FROM ({CURRENT}) WHERE artifact_id % 3 = 0),
    written AS (SELECT s.*, b.binding_id AS old_id, (SELECT max(binding_id) FROM client_binding) + row_number() OVER (ORDER BY s.artifact_id, s.client_id) AS new_id FROM submitted s LEFT JOIN ({CURRENT}) b ON b.artifact_id = s.artifact_id AND b.client_id = s.client_id)
    SELECT b.binding_id, coalesce(w.new_id, b.superseded_by) AS superseded_by FROM client_binding b LEFT JOIN written w ON w.old_id = b.binding_id UNION ALL SELECT new_id, NULL FROM written""",
)
def _(t):
    new = t.derived_artifact.where("artifact_id % 4 = 0").select("artifact_id", F.lit(25).cast("long").alias("client_id"))
    again = history.current(t.client_binding).where("artifact_id % 3 = 0").select("artifact_id", "client_id")
    claims = new.union(again).withColumns({"method": F.lit("review"), "confidence": F.lit(0.5)})
    return history.record(t.client_binding, claims, moment(NOW))[0].select("binding_id", "superseded_by")


# --- provider seams


WORDS = "SELECT artifact_id, sha256(unnest(regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9_]+'))) AS h FROM derived_artifact"
HASHED = """SELECT artifact_id, bucket, s / nullif(sqrt(sum(s * s) OVER (PARTITION BY artifact_id)), 0) AS v FROM (SELECT artifact_id, (('0x' || left(h, 16))::UBIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM word GROUP BY ALL)"""


@query(
    "ud02_embedded_texts",
    "SELECT artifact_id, bucket, round(v::VARCHAR::DECIMAL(38, 22), 6)::DOUBLE AS value FROM hashed WHERE v <> 0 UNION ALL SELECT artifact_id, 0, 1.0 FROM derived_artifact WHERE artifact_id NOT IN (SELECT artifact_id FROM hashed WHERE v <> 0)",
    word=WORDS,
    hashed=HASHED,
)
def _(t):
    found = providers.embed(t.derived_artifact.select("artifact_id", "body"), "body")
    return found.select("artifact_id", F.posexplode("vec").alias("bucket", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query("ud03_rewrites", "SELECT artifact_id, CASE WHEN artifact_id % 6 = 0 THEN 'length_ratio' END AS fault, CASE WHEN artifact_id % 6 <> 0 THEN sha256(coalesce(body, '') || ' [removed] and [removed].') END AS digest FROM derived_artifact")
def _(t):
    named = F.concat(F.coalesce("body", F.lit("")), F.lit(" NATION_3 and Nation_3."))
    made = t.derived_artifact.withColumn("body", F.when(F.col("artifact_id") % 6 == 0, F.repeat(F.lit("NATION_3"), 4)).otherwise(named))
    long = lambda body: F.when(body.startswith("NATION_3NATION_3"), "x").otherwise(F.regexp_replace(body, r"(?i)NATION_3", "[removed]"))
    good, bad = providers.rewrite(made, F.lit("NATION_3"), long)
    plain, none = providers.rewrite(made.where("artifact_id % 6 <> 0"), F.lit("NATION_3"))
    same = good.join(plain, ["artifact_id", "pre_digest", "new_body"])  # the default says the same as this provider
    return same.select("artifact_id", F.lit(None).cast("string").alias("fault"), F.sha2("new_body", 256).alias("digest")).union(bad.union(none).select("artifact_id", "fault", F.lit(None).cast("string")))


@query("ud04_adjudications", "SELECT artifact_id, CASE WHEN strlen(body) % 4 = 0 THEN 'include' WHEN strlen(body) % 4 = 1 THEN 'exclude' END AS classification FROM derived_artifact")
def _(t):
    n = F.octet_length("body") % 4
    said = lambda body: F.when(n == 0, '{"verdict": "include"}').when(n == 1, '```json\n{"verdict": "EXCLUDE"}\n```').when(n == 2, body)
    return providers.adjudicate(t.derived_artifact, said)


# --- the four questions

BY_TEXT = RECALL.replace("(SELECT vec FROM embedding WHERE embedding_id = 0) q", "(SELECT [CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END FOR i IN range(64)] AS vec) q")


@query("ud07_recall", BY_TEXT, earliest=EARLIEST)
def _(t):
    found = facade.TOOLS["recall"](t, "...", CLIENTS)  # a text without words is the first axis
    return found.select("artifact_id", (F.col("distance") + 0.0).alias("distance"), "kind", "confidence", "session_id", "below_floor", "place", "excluded")


def lineage(start: int, src: str, dst: str) -> str:
    return f"WITH RECURSIVE d(node) AS (SELECT {dst} FROM edge WHERE {src} = {start} UNION SELECT e.{dst} FROM d JOIN edge e ON e.{src} = d.node) SELECT node FROM d WHERE node IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11)) ORDER BY node LIMIT 1000"


@query("ud07_ancestors", lineage(178, "dst", "src"), edge=DOWN)
def _(t):
    return facade.TOOLS["ancestors"](t, 178, CLIENTS)


@query("ud07_descendants", lineage(3, "src", "dst"), edge=DOWN)
def _(t):
    return facade.TOOLS["descendants"](t, 3, CLIENTS)


@query("ud07_residue", f"SELECT artifact_id, distance, CASE WHEN distance <= {AUTO} THEN 'auto_include' ELSE 'review' END AS band FROM residue WHERE artifact_id IN (SELECT artifact_id FROM ({CURRENT}) WHERE client_id IN (3, 7, 11))", **RESIDUE)
def _(t):
    return facade.TOOLS["residue"](t, CLIENT, CLIENTS, AUTO, 0.9)


# --- hashes, chains, secrets and rules in SQL

CONTENT = "SELECT *, sha256(concat_ws(chr(31), event_id, session_id, client_id, seq, category, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00', coalesce(payload, ''))) AS content FROM ledger"
CHAIN = "SELECT event_id, session_id, seq, occurred_at, content AS content_digest, repeat('0', 64) AS prev_chain_digest, sha256(repeat('0', 64) || chr(31) || content) AS chain_digest FROM content WHERE seq = 1 UNION ALL SELECT r.event_id, r.session_id, r.seq, r.occurred_at, r.content, c.chain_digest, sha256(c.chain_digest || chr(31) || r.content) FROM link c JOIN content r ON r.session_id = c.session_id AND r.seq = c.seq + 1"


def over_chain(sql: str) -> str:
    return f"WITH RECURSIVE content AS ({CONTENT}), link(event_id, session_id, seq, occurred_at, content_digest, prev_chain_digest, chain_digest) AS ({CHAIN}) {sql}"


@query("d01_chained_rows", over_chain("SELECT event_id, session_id, seq, content_digest, prev_chain_digest, chain_digest FROM link"))
def _(t):
    return chained(t).select("event_id", "session_id", "seq", "content_digest", "prev_chain_digest", "chain_digest")


@query("c10_checkpoint_tips", over_chain("SELECT session_id, max(seq) AS terminal_seq, arg_max(chain_digest, seq) AS terminal_digest FROM link WHERE occurred_at < TIMESTAMP '2024-01-15' AND occurred_at >= TIMESTAMP '2024-01-05' GROUP BY session_id"))
def _(t):
    from ..operators import chain

    return chain.window_tips(chained(t), moment("2024-01-05 00:00:00"), moment("2024-01-15 00:00:00"))


@query("f05_named_ids", "SELECT event_id, concat_ws('-', left(h, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), ['8','9','a','b'][1 + ('0x' || substr(h, 17, 1))::INT % 4] || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(category || chr(31) || event_id)) AS h FROM ledger)")
def _(t):
    from ..functions import digests

    return t.ledger.select("event_id", digests.name_id("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("category"), F.col("event_id")).alias("id"))


@query("s08_parsed_lines", "SELECT CASE WHEN event_id % 11 = 0 THEN 'not_json' WHEN event_id % 7 = 0 THEN 'unknown_field' WHEN event_id % 13 = 0 THEN 'bad_category' WHEN event_id % 17 = 0 THEN 'naive_instant' END AS reason, CASE WHEN event_id % 11 <> 0 THEN event_id::VARCHAR END AS id, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 13 = 0 THEN 'unheard' ELSE category END END AS category FROM ledger")
def _(t):
    from .pipelines import wire

    return ingest.parse_batch(wire(t)).select("reason", "id", "category")




@query(
    "f12_secrets_in_bodies",
    "SELECT artifact_id, sha256(coalesce(body, '') || chr(10) || 'id [removed], aws-secret-access-key = [removed] \"aws_secret_access_key\": \"[removed]\" bearer \"[removed]\" https://[removed]@host/ postgres://[removed]@db:5432/x [removed] https://[removed]@host/') AS digest FROM derived_artifact",
)
def _(t):
    a = F.col("artifact_id").cast("string")
    armour = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.lit("MIIE\n"), F.when(F.col("artifact_id") % 50 == 0, 20_000).otherwise(20)), F.lit("-----END RSA PRIVATE KEY-----"))
    planted = F.concat(
        F.lit("\nid AKIA"), F.lpad(a, 16, "A"), F.lit(", aws-secret-access-key = "), F.lpad(a, 40, "b"), F.lit(' "aws_secret_access_key": "'), F.lpad(a, 40, "/"), F.lit('" bearer "'), F.lpad(a, 20, "x"),
        F.lit('" https://user:pa[ss'), a, F.lit("@host/ postgres://u:p"), a, F.lit("@db:5432/x "), armour, F.lit(" https://u:@host/"),
    )
    return t.derived_artifact.select("artifact_id", F.sha2(text.redact_secrets(F.concat(F.coalesce("body", F.lit("")), planted)), 256).alias("digest"))


KEYS = ("dbPassword", "tokenizer", "API-Key", "monkey", "auth", "author", "Cookie", "userCookies", "DSN", "encryptionKey", "passphrase", "my.pwd", "sessionKey", "session", "signing key", "sshKey", "secretary", "clientSecret", "x_access_key_id", "keys", "Credentials", "HTTP_AUTHORIZATION", "passwdFile", "privateKey", "apikey")
SPLIT = "regexp_replace(lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g')"


@query("f13_sensitive_names", f"SELECT event_id, regexp_matches(concat('_', {SPLIT}, '_'), '_(access_key|api_key|apikey|auth|authorization|cookie|credential|credentials|dsn|encryption_key|passphrase|passwd|password|private_key|pwd|secret|session_key|signing_key|ssh_key|token)_') AS sensitive FROM (SELECT event_id, {list(KEYS)}[1 + event_id % {len(KEYS)}] AS k FROM ledger)")
def _(t):
    key = F.get(F.array(*[F.lit(k) for k in KEYS]), (F.col("event_id") % len(KEYS)).cast("int"))
    return t.ledger.select("event_id", text.is_sensitive_key(key).alias("sensitive"))


@query("f14_redacted_json", "SELECT artifact_id, '{\"outer\":{\"apiToken\":\"[removed]\",\"n\":' || artifact_id || '},\"note\":\"plain\",\"deep\":[[[]],\"Bearer [removed]\"]}' AS value, true AS modified FROM derived_artifact")
def _(t):
    a = F.col("artifact_id")
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("x"), F.coalesce("body", F.lit(""))).alias("apiToken"), a.alias("n")).alias("outer"), F.lit("plain").alias("note")))
    deep = F.concat(F.substring(payload, 1, 10**9), F.lit(""))
    whole = F.concat(F.regexp_replace(deep, r"\}$", ""), F.lit(',"deep":[[["'), a, F.lit('"]],"Bearer '), F.lpad(a.cast("string"), 20, "k"), F.lit('"]}'))
    return t.derived_artifact.select(a, text.redact_json(max_depth=3)(whole).alias("r")).select("artifact_id", "r.value", "r.modified")


@query(
    "f08_rules_on_paths",
    """SELECT event_id, p LIKE '%.pem' AS r0, p = '/etc/passwd' AS r1, p = '.env' OR p LIKE '%/.env' AS r2, p LIKE 'secrets/%' OR p LIKE '%/secrets/%' AS r3, p LIKE 'src%' AS r4, p LIKE '_ey.pem' AND NOT p LIKE '/%' OR p LIKE '%/_ey.pem' AS r5
    FROM (SELECT event_id, ['a/b/key.pem','C:/x/key.pem','key.pem.txt','/etc/passwd','home/etc/passwd','src/.env','x/secrets/a/b','secretsx/a'][1 + event_id % 8] AS p FROM ledger)""",
)
def _(t):
    from .evidence import PATHS

    rules = ("**/*.pem", "/etc/passwd", "~/.env", "secrets/", "re:^src", "?ey.pem")
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("event_id") % len(PATHS)).cast("int"))
    return t.ledger.select("event_id", *[text.normal_path(path).rlike(text.path_pattern(r)).alias(f"r{i}") for i, r in enumerate(rules)])


@query(
    "j28_hundredths",
    f"SELECT query_id, id, distance, place FROM (SELECT q.artifact_id AS query_id, e.artifact_id AS id, {NEAR} AS distance, row_number() OVER (PARTITION BY q.artifact_id ORDER BY {NEAR}, e.artifact_id) AS place FROM embedding e CROSS JOIN (SELECT artifact_id, vec FROM embedding WHERE artifact_id % 100 = 0) q) WHERE place <= 10",
)
def _(t):
    rows = t.embedding.select(F.col("artifact_id").alias("id"), "vec")
    return vectors.knn_join(rows, rows.where("id % 100 = 0"), 10).withColumn("place", F.col("place").cast("long"))


@query("w01_places_by_client", f"SELECT client_id, artifact_id, row_number() OVER (PARTITION BY client_id ORDER BY confidence DESC, artifact_id) AS place, count(*) FILTER (confidence < 0.92) OVER (PARTITION BY client_id) AS low FROM ({CURRENT})")
def _(t):
    each = Window.partitionBy("client_id")
    rows = history.current(t.client_binding)
    return rows.select("client_id", "artifact_id", F.row_number().over(each.orderBy(F.desc("confidence"), "artifact_id")).cast("long").alias("place"), F.count_if(F.col("confidence") < 0.92).over(each).alias("low"))


@query(
    "a17_roots",
    over_chain("""SELECT window_us, sum(n)::BIGINT AS sessions, sha256(string_agg(cell || ':' || d, ',' ORDER BY cell)) AS root_digest FROM (SELECT window_us, cell, count(*) AS n, sha256(string_agg(session_id || ':' || tip, ',' ORDER BY session_id)) AS d FROM (
      SELECT epoch_us(date_trunc('day', occurred_at)) AS window_us, session_id, left(sha256(session_id::VARCHAR), 3) AS cell, arg_max(chain_digest, seq) AS tip FROM link GROUP BY ALL) GROUP BY window_us, cell) GROUP BY window_us"""),
)
def _(t):
    from ..operators import chain

    return chain.root_digest(chain.hourly_tips(chained(t), 24), "window_start").select(micros(F.col("window_start").cast("timestamp_ntz")).alias("window_us"), "sessions", "root_digest")


@query("ud01_last_good", over_chain("SELECT session_id, CASE WHEN session_id % 7 = 3 AND count(*) >= 4 THEN 4 END AS fault_seq, CASE WHEN session_id % 7 = 3 AND count(*) >= 4 THEN max(chain_digest) FILTER (seq = 3) ELSE arg_max(chain_digest, seq) END AS last_good FROM link GROUP BY session_id"))
def _(t):
    from ..operators import chain

    spoilt = F.when((F.col("session_id") % 7 == 3) & (F.col("seq") == 4), "x").otherwise(F.col("chain_digest"))
    return chain.verify(saved(chained(t)).withColumn("chain_digest", spoilt)).select("session_id", F.col("fault_seq").cast("int").alias("fault_seq"), "last_good")


@query("a24_two_sightings", "SELECT artifact_id, round(CASE WHEN artifact_id % 2 = 0 THEN distance - 0.05 ELSE distance END, 6) AS distance, artifact_id % 5 = 0 OR artifact_id % 3 = 0 AS included FROM residue WHERE artifact_id % 4 <> 3 UNION ALL SELECT artifact_id, round(distance + 0.05, 6), artifact_id % 3 = 0 FROM residue WHERE artifact_id % 4 = 3", **RESIDUE)
def _(t):
    a, found = F.col("artifact_id"), saved(walked(t))
    old = found.where(a % 4 != 3).select("artifact_id", "query_id", "distance", (a % 5 == 0).alias("included"))
    new = found.select("artifact_id", "query_id", (F.col("distance") + F.when(a % 2 == 0, -0.05).otherwise(0.05)).alias("distance"), (a % 3 == 0).alias("included"))
    return erasure.merge_findings(old, new).select("artifact_id", F.round("distance", 6).alias("distance"), "included")


@query("d17_reset_rows", "SELECT 'ledger' AS name, event_id AS id, 0 AS n FROM ledger WHERE client_id <> 3 UNION ALL SELECT 'session', session_id, 0 FROM session WHERE client_id <> 3 UNION ALL SELECT 'count of ledger', 0, count(*) FROM ledger WHERE client_id = 3 UNION ALL SELECT 'count of session', 1, count(*) FROM session WHERE client_id = 3")
def _(t):
    own = F.col("client_id") == CLIENT
    left, counts = runs.reset({"ledger": (t.ledger, own), "session": (t.session, own)})
    zero = F.lit(0).cast("long").alias("n")
    rows = left["ledger"].select(F.lit("ledger").alias("name"), F.col("event_id").alias("id"), zero).union(left["session"].select(F.lit("session"), "session_id", zero))
    return rows.union(counts.select(F.concat(F.lit("count of "), "name"), F.col("place").cast("long"), "n"))


@query("c13_session_detail", "SELECT session_id, client_id, outcome, cost_usd::DOUBLE AS cost, count(event_id) AS events, arg_max(event_id, seq) AS last_event, count(event_id) FILTER (category = 'error') AS errors FROM session LEFT JOIN (SELECT session_id, event_id, seq, category FROM ledger) l USING (session_id) GROUP BY session_id, client_id, outcome, cost_usd")
def _(t):
    found = evidence.session_detail(t.session, t.ledger)
    return found.select("session_id", "client_id", "outcome", "cost", "events", "last_event", F.coalesce(F.try_element_at("categories", F.lit("error")), F.lit(0)).alias("errors"))


@query(
    "c14_planted_fragments",
    "SELECT artifact_id + 1000000 AS artifact_id, (owner_client_id + 1) % 25 AS holder, owner_client_id AS owner, sha256(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '\\S*/\\S+', '', 'g'), '(?i)' || ['the','and','la','un','die','ich','of'][1 + owner_client_id % 7], '', 'g'), '[ \\t]+', ' ', 'g'))) AS digest FROM derived_artifact WHERE artifact_id % 20 = 0 AND owner_client_id % 5 <> 4",
)
def _(t):
    owners = t.client.where("client_id % 5 <> 4").select("client_id", F.slice("markers", 1, 1).alias("tokens"))
    chosen = (F.col("artifact_id") % 20 == 0) & (F.col("owner_client_id") % 5 != 4)
    fragments, truth = generator.planted(t.derived_artifact, owners.union(t.client.where("client_id = 24").select("client_id", F.array().cast("array<string>"))), chosen, 1_000_000)
    found = fragments.join(truth.withColumnRenamed("owner_client_id", "owner"), "artifact_id")
    return found.select("artifact_id", F.col("owner_client_id").alias("holder"), "owner", F.sha2("body", 256).alias("digest"))
