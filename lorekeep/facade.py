"""UD-07: the four read-only questions that an agent may ask, over the logical tables and within the clients it may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import erasure, graph, history
from .operators import recall as recalls
from .operators.providers import embed
from .session import saved
from .sources.tables import Tables

#: Rows that a question about lineage or residue returns at most (a report's top).
LIMIT = 1000


def recall(t: Tables, query: str | list[float], clients: list[int], k: int = 10, provider=None) -> DataFrame:
    """What is nearest to a text or vector. A text is embedded by ``provider``, or else by the hashes of its words."""
    if isinstance(query, str):
        one = t.spark.createDataFrame([(query,)], "body string")
        query = list(embed(one, "body", "vec", provider).first().vec)
    return recalls.recall(t.embedding, t.client_binding, t.derived_artifact, t.lineage_edge, t.ledger, t.session, query, clients, k)


def _lineage(t: Tables, artifact: int, clients: list[int], edges: DataFrame, limit: int) -> DataFrame:
    root = t.spark.createDataFrame([(artifact,)], "artifact_id long")
    if history.admit(root, t.client_binding, clients).isEmpty():  # what may not be seen has no lineage either
        return root.select(F.col("artifact_id").alias("node")).where("false")
    found = graph.closure(edges, root.select(F.col("artifact_id").alias("node"))).withColumnRenamed("node", "artifact_id")
    admitted = history.admit(found, t.client_binding, clients)
    return admitted.select(F.col("artifact_id").alias("node")).orderBy("node").limit(recalls.clamp(limit, 1, LIMIT))


def ancestors(t: Tables, artifact: int, clients: list[int], limit: int = LIMIT) -> DataFrame:
    """Artifacts that one was derived from, those of permitted clients only."""
    return _lineage(t, artifact, clients, graph.up(t.lineage_edge), limit)


def descendants(t: Tables, artifact: int, clients: list[int], limit: int = LIMIT) -> DataFrame:
    """Artifacts derived from one, those of permitted clients only."""
    return _lineage(t, artifact, clients, graph.down(t.lineage_edge), limit)


def residue(t: Tables, client: int, clients: list[int], auto: float = erasure.AUTO, review: float = erasure.REVIEW) -> DataFrame:
    """Artifacts close to what a client's removal would select, were it asked for now; nothing unless the client is permitted."""
    if client not in clients:
        return t.embedding.select("artifact_id", F.lit(None).cast("double").alias("distance"), F.lit("").alias("band")).where("false")
    candidates = saved(erasure.sweep(t.session, t.ledger, t.derived_artifact, t.client_binding, t.lineage_edge, t.embedding, client))
    queries = saved(erasure.query_artifacts(candidates, t.derived_artifact, t.embedding))
    found = erasure.band(erasure.walk(queries, t.embedding, candidates, review), auto)
    return history.admit(found, t.client_binding, clients).select("artifact_id", "distance", "band")


#: The registry: name, function.
TOOLS = {"recall": recall, "ancestors": ancestors, "descendants": descendants, "residue": residue}
