"""Queries over the indexes of graph and vectors, and batches of edges judged one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, recall
from ..operators.lineage_index import LineageIndex
from ..operators.vector_index import VectorIndex
from .pipelines import DOWN, EARLIEST, RECALL, ROOTS, query_vector, roots
from .registry import CLIENT, CLIENTS, query


def index(t, upwards: bool = False) -> LineageIndex:
    """Written beside the edges and read back, as it stands for many questions."""
    edges = graph.up(t.lineage_edge) if upwards else graph.down(t.lineage_edge)
    return LineageIndex.read(t.spark, LineageIndex.build(edges).write())


@query("g01_indexed_descendants", f"WITH RECURSIVE d(node) AS (SELECT dst FROM edge JOIN ({ROOTS}) ON src = node UNION SELECT e.dst FROM d JOIN edge e ON e.src = d.node) SELECT node FROM d", edge=DOWN)
def _(t):
    return index(t).reached(roots(t))


@query("g02_indexed_ancestors", f"WITH RECURSIVE a(node) AS (SELECT src FROM edge JOIN ({ROOTS}) ON dst = node UNION SELECT e.src FROM a JOIN edge e ON e.dst = a.node) SELECT node FROM a", edge=DOWN)
def _(t):
    return index(t, upwards=True).reached(roots(t))


#: A chain of all artifacts, in which the hundredth is linked to the tenth after it, and a way round for every fiftieth.
CHAIN = "SELECT doc_id AS src, doc_id + 1 AS dst FROM documents UNION ALL SELECT doc_id, doc_id + 10 FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT doc_id, -doc_id FROM documents WHERE doc_id % 50 = 1 UNION ALL SELECT -doc_id, doc_id + 2 FROM documents WHERE doc_id % 50 = 1"
FAR = "SELECT doc_id AS node FROM documents WHERE doc_id % 1000 = 500 OR doc_id = 7"


@query("g01_deep_chain", f"WITH RECURSIVE d(node) AS (SELECT dst FROM chain JOIN ({FAR}) ON src = node UNION SELECT c.dst FROM d JOIN chain c ON c.src = d.node) SELECT node FROM d", chain=CHAIN)
def _(t):
    d = F.col("artifact_id")
    links = [(F.lit(True), d, d + 1), (d % 100 == 0, d, d + 10), (d % 50 == 1, d, -d), (d % 50 == 1, -d, d + 2)]
    made = F.array(*[F.when(test, F.struct(a.alias("src"), b.alias("dst"))) for test, a, b in links])
    edges = t.derived_artifact.select(F.inline(F.filter(made, lambda x: x.isNotNull())))
    return LineageIndex.build(edges).reached(t.derived_artifact.where((d % 1000 == 500) | (d == 7)).select(d.alias("node")))


#: Proposals of one client's artifacts: onto the graph, rings of three, and two ways between neighbours of the batch.
PROPOSED = f"""SELECT a * 10 + j AS edge_id, CASE j WHEN 2 THEN a + 1 WHEN 3 THEN a + 2 WHEN 6 THEN a + 25 ELSE a END AS child_id,
  CASE j WHEN 0 THEN a * 2 WHEN 1 THEN a + 1 WHEN 2 THEN a + 2 WHEN 3 THEN a WHEN 4 THEN a // 2 WHEN 5 THEN a WHEN 6 THEN a WHEN 7 THEN a + 25 ELSE a + 1 END AS parent_id
  FROM (SELECT artifact_id AS a FROM derived_artifact WHERE owner_client_id = {CLIENT}), range(9) x(j)"""


@query(
    "g04_batch_verdicts",
    """WITH RECURSIVE ends AS (SELECT child_id AS node FROM proposed UNION SELECT parent_id FROM proposed),
    w(x, y) AS (SELECT node, node FROM ends UNION SELECT w.x, e.dst FROM w JOIN edge e ON e.src = w.y),
    known AS (SELECT list({'x': x, 'y': y}) AS pairs FROM w WHERE y IN (SELECT node FROM ends)),
    sorted AS (SELECT *, row_number() OVER (ORDER BY edge_id) AS k, child_id = parent_id AS own, parent_id NOT IN (SELECT artifact_id FROM derived_artifact) AS absent,
      (child_id, parent_id) IN (SELECT (dst, src) FROM edge) AS held, edge_id > min(edge_id) OVER (PARTITION BY child_id, parent_id) AS again FROM proposed),
    fold AS (SELECT 0::BIGINT AS k, pairs, NULL::BIGINT AS edge_id, NULL::VARCHAR AS verdict FROM known UNION ALL
      SELECT k, CASE WHEN verdict <> 'accepted' THEN pairs ELSE list_distinct(list_concat(pairs, flatten(list_transform(list_filter(pairs, lambda q: q.y = parent_id),
        lambda q: list_transform(list_filter(pairs, lambda r: r.x = child_id), lambda r: {'x': q.x, 'y': r.y}))))) END, edge_id, verdict
      FROM (SELECT s.k, s.edge_id, s.child_id, s.parent_id, pairs, CASE WHEN own THEN 'self_edge' WHEN absent THEN 'absent_parent' WHEN held THEN 'duplicate'
        WHEN len(list_filter(pairs, lambda q: q.x = child_id AND q.y = parent_id)) > 0 THEN 'cycle' WHEN again THEN 'duplicate' ELSE 'accepted' END AS verdict
        FROM fold f JOIN sorted s ON s.k = f.k + 1))
    SELECT edge_id, verdict FROM fold WHERE k > 0""",
    edge=DOWN,
    proposed=PROPOSED,
)
def _(t):
    a = F.col("artifact_id")
    kinds = [(a, a * 2), (a, a + 1), (a + 1, a + 2), (a + 2, a), (a, F.floor(a / 2).cast("long")), (a, a), (a + 25, a), (a, a + 25), (a, a + 1)]
    made = F.array(*[F.struct((a * 10 + j).alias("edge_id"), c.alias("child_id"), p.alias("parent_id")) for j, (c, p) in enumerate(kinds)])
    rows = t.derived_artifact.where(F.col("owner_client_id") == CLIENT).select(F.inline(made))
    return graph.judge_batch(t.lineage_edge, rows, t.derived_artifact.select(a.alias("node"))).select("edge_id", "verdict")


@query("c01_recall_by_index", RECALL, earliest=EARLIEST)
def _(t):
    rows = t.embedding.select(F.col("artifact_id").alias("id"), "vec")
    built = VectorIndex.build(rows.where("id % 3 <> 0"), recall=0.99)
    built.insert(rows.where("id % 3 = 0"))  # a third comes later
    found = recall.recall(t.embedding, t.client_binding, t.derived_artifact, t.lineage_edge, t.ledger, t.session, query_vector(t), CLIENTS, index=VectorIndex.read(t.spark, built.path))
    return found.select("artifact_id", (F.col("distance") + 0.0).alias("distance"), "kind", "confidence", "session_id", "below_floor", "place", "excluded")
