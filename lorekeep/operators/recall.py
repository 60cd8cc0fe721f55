"""Recall: nearest artifacts that the asking clients may see, with where they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.vectors import near_block
from ..session import saved
from . import graph, history
from .vector_index import VectorIndex

POOL_FACTOR, POOL_LEAST, POOL_MOST = 16, 256, 20_000
LIMIT_MOST = 1000
#: Edges of a pool that go to every task; more of them are joined by a shuffle.
EDGES_MOST = 500_000


def clamp(n: int, low: int, high: int) -> int:
    """O-11: bounds are met, not refused."""
    return max(low, min(high, n))


def pool_size(k: int) -> int:
    """O-02."""
    return clamp(POOL_FACTOR * k, POOL_LEAST, POOL_MOST)


def nearest(embedding: DataFrame, query: list[float], k: int, ceiling: float | None = None) -> DataFrame:
    """O-01, V-03, exact-scan form: the ``k`` rows nearest to ``query`` with their distance; P-05: a null ceiling admits all.

    Every Arrow batch of vectors is one matrix product and keeps its own ``k`` nearest. Vectors of another width,
    null and zero vectors have no distance and are left out.
    """
    most = clamp(k, 1, POOL_MOST)
    rows = [Row(id=0, vec=[float(x) for x in query])]
    names = embedding.select(F.col("artifact_id").alias("id"), "vec")
    near = near_block(names, rows, most, ceiling).select(F.col("id").alias("artifact_id"), "distance")
    return near.orderBy("distance", "artifact_id").limit(most)


def candidates(embedding: DataFrame, bindings: DataFrame, query: list[float], clients: list[int], k: int, mode: str = "index", index: VectorIndex | None = None) -> DataFrame:
    """The admitted pool. ``index`` ranks first and admits after, so fewer than ``k`` may be left; ``scan`` admits first.

    With an ``index`` over the embeddings' (artifact_id as id, vec) only its opened lists are read; without one all are.
    """
    rows = embedding.select("artifact_id", "vec")
    if mode == "scan":
        return saved(nearest(history.admit(rows, bindings, clients), query, pool_size(k)))
    ranked = index.search(query, pool_size(k)).withColumnRenamed("id", "artifact_id") if index else nearest(rows, query, pool_size(k))
    pool = saved(ranked)
    own = bindings.join(F.broadcast(pool.select("artifact_id")), "artifact_id", "left_semi")  # at most POOL_MOST ids
    return history.admit(pool, own, clients)


def page(pool: DataFrame, artifacts: DataFrame, origin: DataFrame, k: int, floor: float = 0.15) -> DataFrame:
    """C-01, P-06, W-01, W-02: the first ``k`` admitted rows and one flagged row that carries the tally of rows under the floor.

    Artifacts without a session or event among their direct parents drop out. The floor flags rows, it does not
    filter them; a null confidence is never under it. The pool is bounded, so its ranking is small.
    """
    rows = artifacts.select("artifact_id", "kind", "confidence").join(F.broadcast(pool), "artifact_id").join(F.broadcast(origin.select("artifact_id", "session_id")), "artifact_id")
    flagged = rows.withColumn("below_floor", F.coalesce(F.col("confidence") < floor, F.lit(False)))
    each = Window.partitionBy("below_floor")
    order = each.orderBy("distance", F.desc_nulls_last("confidence"), "artifact_id")
    ranked = flagged.withColumns({"place": F.row_number().over(order).cast("long"), "excluded": F.when(F.col("below_floor"), F.count(F.lit(1)).over(each)).otherwise(F.lit(0)).cast("long")})
    return ranked.where((~F.col("below_floor") & (F.col("place") <= k)) | (F.col("below_floor") & (F.col("place") == 1)))


def recall(embedding, bindings, artifacts, edges, ledger, session, query: list[float], clients: list[int], k: int = 10, floor: float = 0.15, mode: str = "index", index: VectorIndex | None = None) -> DataFrame:
    """C-01: artifact_id, distance, kind, confidence, session_id, below_floor, place, excluded. No permitted client: no rows.

    The admitted pool, at most POOL_MOST rows, is computed once; it and its edges go to the tasks that read the other tables.
    """
    pool = saved(candidates(embedding, bindings, query, clients, k, mode, index).select("artifact_id", "distance"))
    near = edges.join(F.broadcast(pool.select("artifact_id")), F.col("child_id") == F.col("artifact_id"), "left_semi")
    near = saved(near.where("parent_kind <> 'derived_artifact'").select("child_id", "parent_id", "parent_kind"))
    if near.count() <= EDGES_MOST:
        near = F.broadcast(near)
    return page(pool, artifacts, graph.earliest_session(near, ledger, session), k, floor)
