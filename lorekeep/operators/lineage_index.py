"""A reachability index of the provenance graph: chain labels, so that the depth of a graph costs only its logarithm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, shared_folder

MAX_ROUNDS = 10_000


def chain_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that lie on chains: the least child of their source and the least parent of their target at once.

    So a node has one of them at most on either side, and they make up paths, or rings where the graph has cycles.
    """
    child = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    parent = edges.groupBy("dst").agg(F.min("src").alias("src"))
    return child.join(parent, ["src", "dst"])


def labels(nodes: DataFrame, links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, chain, pos): the head of each node's chain and the links from it.

    Pointers double: after k rounds a node knows what lies 2**k links before it, so rounds are the logarithm of the
    longest chain. On rings pointers never end; their nodes become chains of their own and their links common edges.
    """
    state = saved(nodes.join(links.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left").select("node", "up", F.col("up").isNotNull().cast("long").alias("pos"), F.coalesce("up", "node").alias("chain")))
    open_before = -1
    for _ in range(max_rounds):
        left = state.where("up is not null").count()
        if left in (0, open_before):  # none, or rings alone, as every path loses pointers in each round
            break
        open_before = left
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("pos").alias("_pos"), F.col("chain").alias("_chain"))
        jumped = state.where("up is not null").join(above, "up").select("node", F.col("_up").alias("up"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_chain").alias("chain"))
        state = saved(state.where("up is null").union(jumped))
    ring = F.col("up").isNotNull()
    return state.select("node", F.when(ring, F.col("node")).otherwise(F.col("chain")).alias("chain"), F.when(ring, 0).otherwise(F.col("pos")).cast("long").alias("pos"))


@dataclass
class LineageIndex:
    """``nodes`` (node, chain, pos) and ``cross`` (src, chain, pos, to_chain, to_pos), the edges that leave a chain or jump on it."""

    nodes: DataFrame
    cross: DataFrame

    @classmethod
    def build(cls, edges: DataFrame) -> LineageIndex:
        """Label the nodes of ``edges`` (src, dst). Null ends and self-edges lead nowhere new and are left out."""
        kept = saved(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
        links = saved(chain_edges(kept))
        nodes = saved(labels(kept.select(F.col("src").alias("node")).union(kept.select("dst")).distinct(), links))
        at = lambda end: nodes.select(F.col("node").alias(end), F.col("chain").alias(f"_{end}"), F.col("pos").alias(f"_{end}_pos"))
        placed = kept.join(at("src"), "src").join(at("dst"), "dst")
        on_chain = (F.col("_src") == F.col("_dst")) & (F.col("_dst_pos") == F.col("_src_pos") + 1)
        cross = placed.where(~on_chain).select("src", F.col("_src").alias("chain"), F.col("_src_pos").alias("pos"), F.col("_dst").alias("to_chain"), F.col("_dst_pos").alias("to_pos"))
        return cls(nodes, saved(cross))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LineageIndex:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/cross"))

    def write(self, path: str | None = None) -> str:
        """Store the index beside the edges, by default in the shared folder, for any number of questions."""
        path = path or shared_folder(self.nodes.sparkSession, "lineage-index")
        self.nodes.write.parquet(f"{path}/nodes")
        self.cross.write.parquet(f"{path}/cross")
        return path

    def reached(self, roots: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
        """G-01, G-02: distinct nodes that edges lead to from ``roots`` (node); a root only if an edge leads to it.

        What is known of a chain is the first place that was reached on it, as all later ones follow. A round takes all
        edges out of the stretches that are new, so rounds are the turns from chain to chain, not the hops.
        """
        begun = saved(roots.select("node").distinct().join(self.nodes, "node"))
        ends = self.nodes.groupBy("chain").agg(F.max("pos").alias("end"))
        after = begun.groupBy("chain").agg((F.min("pos") + 1).alias("at")).join(ends, "chain").where("at <= end").select("chain", "at")
        own = self.cross.join(begun.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("at"))
        new = saved(after.union(own).groupBy("chain").agg(F.min("at").alias("at")).withColumn("until", F.lit(None).cast("long")))
        known = new.select("chain", "at")
        for _ in range(max_rounds):
            if new.isEmpty():
                return self.nodes.join(known, "chain").where("pos >= at").select("node")
            steps = self.cross.join(new, "chain").where("pos >= at AND (until IS NULL OR pos < until)")
            found = steps.groupBy(F.col("to_chain").alias("chain")).agg(F.min("to_pos").alias("at"))
            found = found.join(known.withColumnRenamed("at", "until"), "chain", "left").where("until IS NULL OR at < until")
            new = saved(found.select("chain", "at", "until"))
            known = saved(known.union(new.select("chain", "at")).groupBy("chain").agg(F.min("at").alias("at")))
        raise RuntimeError("the closure did not end")
