"""The logical tables of ``sources.tables`` as DuckDB common table expressions."""

from __future__ import annotations

import re

TABLES = {
    "client": """SELECT n_nationkey::BIGINT AS client_id, n_name AS slug, n_regionkey::BIGINT AS jurisdiction,
  (30 + 10 * n_regionkey)::BIGINT AS retention_days,
  CASE WHEN n_nationkey % 5 = 4 THEN []::VARCHAR[]
       ELSE [['the','and','la','un','die','ich','of'][1 + n_nationkey % 7], n_name] END AS markers FROM nation""",
    "ledger": """SELECT event_id, user_id AS session_id, user_id % 25 AS client_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'cost_record'
    WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'file_read' END AS category,
  ts AS occurred_at, props AS payload, CASE WHEN event_type IN ('view', 'click') THEN props END AS text_body,
  value AS cost, ts + to_days((30 + 10 * (user_id % 5))::INT) AS expires_at FROM events""",
    "session": """SELECT user_id AS session_id, min(ts) AS started_at, max(ts) AS ended_at,
  count(*) FILTER (event_type = 'click') AS tool_call_count, count(*) FILTER (event_type = 'view') AS model_request_count,
  count(*) FILTER (event_type = 'error') AS error_count, sum((props->>'$.k')::BIGINT)::BIGINT AS token_count,
  sum(value::DECIMAL(14,6)) AS cost_usd, user_id % 25 AS client_id,
  ['in_progress','succeeded','failed','abandoned'][1 + user_id % 4] AS outcome,
  CASE WHEN user_id > 0 THEN user_id // 2 END AS parent_session_id, 'm' || (user_id % 7) AS machine_id,
  '/work/c' || (user_id % 25) || '/p' || (user_id % 3) || '/src' AS workspace_path FROM events GROUP BY user_id""",
    "derived_artifact": """SELECT doc_id AS artifact_id, ['summary','behavioral_baseline','learned_procedure'][1 + doc_id % 3] AS kind,
  doc_id % 25 AS owner_client_id, text AS body, sha256(text) AS content_digest,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
  CASE WHEN doc_id % 3 = 2 THEN (doc_id % 101)::DOUBLE / 100 END AS confidence, 1::BIGINT AS revision,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_days((30 + 10 * (doc_id % 5))::INT) AS expires_at FROM documents""",
    "embedding": """SELECT vec_id AS embedding_id, vec_id AS artifact_id, vec_id % 25 AS client_id, embedding AS vec, label::BIGINT AS label,
  TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS created_at,
  TIMESTAMP '2024-01-01' + to_minutes(vec_id) + to_days((30 + 10 * (vec_id % 5))::INT) AS expires_at FROM embeddings""",
    "client_binding": """SELECT * FROM (
  SELECT doc_id AS artifact_id, doc_id * 4 AS binding_id, doc_id % 25 AS client_id, 'scope' AS method, 1.0::DOUBLE AS confidence,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS valid_from, NULL::TIMESTAMP AS valid_to, NULL::BIGINT AS superseded_by FROM documents
  UNION ALL SELECT doc_id, doc_id * 4 + 1, (doc_id * 7 + 1) % 25, 'marker', 0.9, TIMESTAMP '2024-01-02' + to_minutes(doc_id),
    CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-01-12' + to_minutes(doc_id) END, CASE WHEN doc_id % 10 = 0 THEN doc_id * 4 + 2 END
    FROM documents WHERE doc_id % 25 <> (doc_id * 7 + 1) % 25
  UNION ALL SELECT doc_id, doc_id * 4 + 2, (doc_id * 7 + 1) % 25, 'residue', 0.95, TIMESTAMP '2024-01-12' + to_minutes(doc_id), NULL, NULL
    FROM documents WHERE doc_id % 25 <> (doc_id * 7 + 1) % 25 AND doc_id % 10 = 0)""",
    "lineage_edge": """SELECT * FROM (
  SELECT doc_id AS child_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, doc_id * 4 AS edge_id, doc_id // 2 AS parent_id,
    'derived_artifact' AS parent_kind FROM documents WHERE doc_id > 0
  UNION ALL SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id), doc_id * 4 + 1, doc_id // 3, 'derived_artifact' FROM documents
    WHERE doc_id > 2 AND doc_id // 2 <> doc_id // 3
  UNION ALL SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id), doc_id * 4 + 2, doc_id, 'event' FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id), doc_id * 4 + 3, doc_id % 150, 'session' FROM documents WHERE doc_id % 5 = 0)""",
    "erasure_run": """SELECT client_id AS run_id, client_id + 1000 AS request_id, client_id, 'key-' || client_id AS idempotency_key,
  ['completed','running','aborted'][1 + client_id % 3] AS status, TIMESTAMP '2024-02-01' + to_days(client_id::INT) AS started_at,
  CASE WHEN client_id % 3 <> 1 THEN TIMESTAMP '2024-02-01 02:00:00' + to_days(client_id::INT) END AS finished_at FROM client""",
    "erasure_lease": """SELECT * FROM (
  SELECT client_id, client_id * 2 AS lease_id, 1::BIGINT AS generation, TIMESTAMP '2024-02-01' + to_days(client_id::INT) AS acquired_at,
    TIMESTAMP '2024-02-01 00:00:30' + to_days(client_id::INT) AS expires_at,
    CASE WHEN client_id % 2 = 0 THEN TIMESTAMP '2024-02-01 00:05:00' + to_days(client_id::INT) END AS superseded_at FROM client
  UNION ALL SELECT client_id, client_id * 2 + 1, 2, TIMESTAMP '2024-02-01 00:05:00' + to_days(client_id::INT),
    TIMESTAMP '2024-02-01' + to_days((client_id + 400)::INT), NULL FROM client WHERE client_id % 2 = 0)""",
    "disposition": """SELECT doc_id % 25 AS run_id, doc_id AS artifact_id, 'derived_artifact' AS artifact_kind,
  ['hard_delete','surgical_redaction','retained'][1 + (doc_id // 25) % 3] AS disposition,
  list_sort(list_distinct(['NATION_' || (doc_id % 25), 'NATION_' || ((doc_id * 7 + 1) % 25)])) AS bindings_before,
  CASE WHEN doc_id % 25 = (doc_id * 7 + 1) % 25 THEN [] ELSE ['NATION_' || ((doc_id * 7 + 1) % 25)] END AS bindings_after,
  sha256(text) AS pre_digest FROM documents""",
    "working_memory": """SELECT conv_id AS session_id, role AS scratch_key, conv_id % 25 AS client_id, text AS value,
  TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS updated_at FROM conversations""",
    "procedure_retrieval": """SELECT o_orderkey AS retrieval_id, 3 * (o_custkey % 60) + 2 AS procedure_id, o_orderkey % 150 AS session_id,
  o_orderdate AS retrieved_at FROM orders""",
    "procedure_outcome": """SELECT o_orderkey AS outcome_id, 3 * (o_custkey % 60) + 2 AS procedure_id, (o_orderkey // 2) % 150 AS session_id,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' WHEN 'P' THEN 'abandoned' END AS outcome,
  o_orderdate AS recorded_at FROM orders WHERE o_orderkey % 3 <> 0""",
}


def with_tables(sql: str, **more: str) -> str:
    """``sql`` with the logical tables it names, and ``more`` of them, put in front; it may begin with WITH itself."""
    known = TABLES | more
    order = list(known)
    found: set[str] = set()

    def need(text: str) -> None:
        for name in order:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                need(known[name])

    need(sql)
    parts: list[str] = []
    placed: set[str] = set()

    def put(name: str) -> None:
        if name in placed:
            return
        placed.add(name)
        for other in order:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", known[name]):
                put(other)
        parts.append(f"{name} AS ({known[name]})")

    for name in order:
        if name in found:
            put(name)
    sql = sql.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", sql))
    own = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql) if re.match(r"WITH\b", sql) else None
    head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts)
    if not parts:
        return sql
    return f"{head}{',' if own is not None else ''}\n{own if own is not None else sql}"
