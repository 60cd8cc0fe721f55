"""Provenance graph: closures with set semantics, layers, and guarded edges.

Each round is several hops, every one a join on the edges' key; only a round's new nodes are written, to the
checkpoint folder, after an anti-join with what is known. Rounds grow from one hop to HOPS, so a graph of depth d takes
about d / HOPS of them.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .lineage_index import LineageIndex

MAX_ROUNDS = 10_000
#: Most hops of one round, and most parts of what is known before they are put together.
HOPS, PARTS = 8, 8


def closure(edges: DataFrame, roots: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """G-01, G-02, U-04: distinct nodes reachable from ``roots`` (node) over ``edges`` (src, dst).

    A root appears only if an edge leads to it; cycles end because known nodes are not visited again; null ends
    and self-edges lead nowhere new. An empty set of roots reaches nothing. More than ``max_rounds`` rounds raise.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    found = walk(edges, roots.select("node").distinct(), max_rounds)
    return found if found is not None else edges.select(F.col("dst").alias("node")).where("false")


def walk(edges: DataFrame, roots: DataFrame, max_rounds: int) -> DataFrame | None:
    kept = saved(edges.repartition("src"))
    frontier, parts, hops = saved(roots), [], 1
    for _ in range(max_rounds):
        step, reached = frontier, []
        for hop in range(1, hops + 1):
            step = step.select(F.col("node").alias("src")).join(kept, "src").select(F.col("dst").alias("node")).distinct()
            reached.append(step.withColumn("hop", F.lit(hop)))
        new = reduce(DataFrame.union, reached).groupBy("node").agg(F.min("hop").alias("hop"))
        for part in parts:
            new = new.join(part, "node", "left_anti")
        new = saved(new)
        if new.isEmpty():
            return reduce(DataFrame.union, parts) if parts else None
        parts.append(new.select("node"))
        if len(parts) > PARTS:  # one known set instead of many small ones
            parts = [saved(reduce(DataFrame.union, parts))]
        # nodes of the earlier hops have been walked from already
        frontier, hops = new.where(F.col("hop") == hops).select("node"), min(HOPS, 2 * hops)
    raise RuntimeError("the closure did not end")


def down(edges: DataFrame) -> DataFrame:
    """Edges from parent to child, over derived artifacts."""
    return edges.where("parent_kind = 'derived_artifact'").select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))


def up(edges: DataFrame) -> DataFrame:
    return edges.where("parent_kind = 'derived_artifact'").select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"))


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """G-02: (node, kind) over parents of every kind; events and sessions have no parents of their own."""
    derived = saved(closure(up(edges), roots))
    inner = roots.select("node").union(derived).distinct()
    outer = edges.where("parent_kind <> 'derived_artifact'").join(inner, F.col("child_id") == F.col("node"), "left_semi")
    return derived.select("node", F.lit("derived_artifact").alias("kind")).union(outer.select("parent_id", "parent_kind").distinct())


def layers(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """G-05, W-07: (node, layer), the longest path from a node without parents. A cycle, or a path of ``max_rounds`` edges, raises."""
    inner = saved(edges.select("src", "dst").where("src <> dst").distinct().repartition("src"))
    level = saved(nodes.select("node").distinct().join(inner.select(F.col("dst").alias("node")), "node", "left_anti"))
    out, at, hops = [level.select("node", F.lit(0).alias("layer"))], 0, 1
    while at < max_rounds:
        steps = []
        for hop in range(1, hops + 1):
            level = level.select(F.col("node").alias("src")).join(inner, "src").select(F.col("dst").alias("node")).distinct()
            steps.append(level.withColumn("layer", F.lit(at + hop)))
        new = saved(reduce(DataFrame.union, steps))
        if new.isEmpty():
            return reduce(DataFrame.union, out).groupBy("node").agg(F.max("layer").alias("layer"))
        out.append(new)
        if len(out) > PARTS:
            out = [saved(reduce(DataFrame.union, out).groupBy("node").agg(F.max("layer").alias("layer")))]
        at += hops
        level, hops = new.where(F.col("layer") == at).select("node"), min(HOPS, 2 * hops)
    raise RuntimeError("the graph has a cycle")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G-06: edges with an end in ``nodes`` (node): two semi-joins, one row an edge."""
    child = edges.join(nodes, F.col("child_id") == F.col("node"), "left_semi")
    parent = edges.where("parent_kind = 'derived_artifact'").join(nodes, F.col("parent_id") == F.col("node"), "left_semi")
    return child.union(parent).distinct()


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J-19: edges between admitted nodes."""
    own = edges.where("parent_kind = 'derived_artifact'").join(nodes, F.col("child_id") == F.col("node"), "left_semi")
    return own.join(nodes, F.col("parent_id") == F.col("node"), "left_semi")


def judge_edges(edges: DataFrame, proposed: DataFrame, nodes: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """G-04: ``proposed`` (edge_id, child_id, parent_id) with a verdict: accepted, self_edge, absent_parent, cycle, duplicate.

    A proposal is tested against the graph before the batch: it closes a cycle if its parent descends from its
    child. Only (proposal, node) pairs still looking for their parent are walked.
    """
    known = down(edges)
    walk = saved(proposed.where("child_id <> parent_id").select("edge_id", F.col("parent_id").alias("goal"), F.col("child_id").alias("src")))
    seen, cycles = [walk], []
    for _ in range(max_rounds):
        step = walk.join(known, "src").select("edge_id", "goal", F.col("dst").alias("src")).distinct()
        for part in seen:
            step = step.join(part, ["edge_id", "goal", "src"], "left_anti")
        walk = saved(step)
        if walk.isEmpty():
            break
        cycles.append(walk.where("src = goal").select("edge_id"))
        walk = walk.join(cycles[-1], "edge_id", "left_anti")
        seen.append(walk)
        if len(seen) > 8:
            seen = [saved(reduce(DataFrame.union, seen))]
    bad = reduce(DataFrame.union, cycles).distinct() if cycles else proposed.select("edge_id").where("false")
    there = edges.where("parent_kind = 'derived_artifact'").select("child_id", "parent_id").distinct()
    judged = (
        proposed.join(bad.withColumn("_cycle", F.lit(True)), "edge_id", "left")
        .join(nodes.select(F.col("node").alias("parent_id"), F.lit(True).alias("_parent")).distinct(), "parent_id", "left")
        .join(there.withColumn("_there", F.lit(True)), ["child_id", "parent_id"], "left")
    )
    verdict = (
        F.when(F.col("child_id") == F.col("parent_id"), "self_edge")
        .when(F.col("_parent").isNull(), "absent_parent")
        .when(F.col("_cycle").isNotNull(), "cycle")
        .when(F.col("_there").isNotNull(), "duplicate")
        .otherwise("accepted")
    )
    return judged.select("edge_id", "child_id", "parent_id", verdict.alias("verdict"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component), the least node of each weakly connected component of ``edges`` (src, dst).

    Every round each node tells its neighbours, then its least neighbour, the least node it knows; so stars grow
    together in rounds that are about the logarithm of the size.
    """
    state = saved(edges.select("src", "dst").where("src <> dst").distinct())
    everyone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    for _ in range(max_rounds):
        both = state.union(state.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        lower = large.where("src <> dst").distinct()
        down = lower.groupBy("src").agg(F.min("dst").alias("low"))
        small = lower.join(down, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(down.select("src", F.col("low").alias("dst")))
        new = saved(small.where("src <> dst").distinct())
        if new.exceptAll(state).isEmpty() and state.exceptAll(new).isEmpty():
            return everyone.join(new.select(F.col("src").alias("node"), F.col("dst").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("component"))
        state = new
    raise RuntimeError("the components did not settle")


def in_turn(rows: pd.DataFrame) -> pd.DataFrame:
    """Which proposals of one component close a cycle, each tested against the edges before the batch and those let in so far."""
    below: dict = {}
    for r in rows[rows["edge_id"].isna()].itertuples(index=False):
        below.setdefault(r.src, []).append(r.dst)
    out = []
    for r in rows[rows["edge_id"].notna()].sort_values("edge_id").itertuples(index=False):
        seen, todo = {r.dst}, [r.dst]
        while todo and r.src not in seen:
            fresh = [n for n in below.get(todo.pop(), ()) if n not in seen]
            seen.update(fresh)
            todo += fresh
        out.append((r.edge_id, r.src in seen))
        if r.src not in seen:
            below.setdefault(r.src, []).append(r.dst)
    return pd.DataFrame(out, columns=["edge_id", "closes"]).astype({"edge_id": "int64"})


def judge_batch(edges: DataFrame, proposed: DataFrame, nodes: DataFrame) -> DataFrame:
    """G-04 for a whole batch: as ``judge_edges``, but proposals are taken one after the other by edge_id.

    A proposal is refused as a cycle if its parent descends from its child over the edges before the batch and the
    proposals let in before it; the second of two equal ones is a duplicate if the first is let in. Only nodes below
    some proposal's child and above some proposal's parent can lie on a cycle: two closures over the reachability index
    find them, what they hold falls into components, and only inside a component is there an order to keep. So each
    component of such nodes is one task, and all other proposals are never walked.
    """
    known = saved(down(edges).where("src is not null and dst is not null and src <> dst").distinct())
    same = ["child_id", "parent_id"]
    firsts = proposed.groupBy(*same).agg(F.min("edge_id").alias("_first"))
    there = known.select(F.col("dst").alias("child_id"), F.col("src").alias("parent_id"), F.lit(True).alias("_there"))
    parents = nodes.select(F.col("node").alias("parent_id"), F.lit(True).alias("_parent")).distinct()
    rows = saved(proposed.join(firsts, same, "left").join(there, same, "left").join(parents, "parent_id", "left"))
    apt = rows.where("child_id <> parent_id AND _parent AND _there IS NULL AND edge_id = _first")
    new = apt.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"), "edge_id")
    both = known.union(new.select("src", "dst"))
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    under, over = new.select(F.col("dst").alias("node")), new.select(F.col("src").alias("node"))
    below, above = LineageIndex.build(both).reached(under).union(under), LineageIndex.build(back).reached(over).union(over)
    between = saved(below.intersect(above))
    within = known.withColumn("edge_id", F.lit(None).cast("long")).union(new)
    within = within.join(between.select(F.col("node").alias("src")), "src", "left_semi").join(between.select(F.col("node").alias("dst")), "dst", "left_semi")
    within = saved(within.select("src", "dst", "edge_id"))
    own = components(within).select(F.col("node").alias("src"), "component")
    closes = within.join(own, "src").groupBy("component").applyInPandas(lambda g: in_turn(g), "edge_id long, closes boolean")
    judged = rows.join(closes.withColumnsRenamed({"edge_id": "_first", "closes": "_closes"}), "_first", "left")
    verdict = (
        F.when(F.col("child_id") == F.col("parent_id"), "self_edge")
        .when(F.col("_parent").isNull(), "absent_parent")
        .when(F.col("_there").isNotNull(), "duplicate")
        .when(F.col("_closes"), "cycle")
        .when(F.col("edge_id") > F.col("_first"), "duplicate")
        .otherwise("accepted")
    )
    return judged.select("edge_id", "child_id", "parent_id", verdict.alias("verdict"))


def earliest_session(edges: DataFrame, ledger: DataFrame, session: DataFrame) -> DataFrame:
    """J-11, G-09, P-13: (artifact_id, session_id, occurred_at), the earliest direct parent that is a session or an event."""
    of_event = edges.where("parent_kind = 'event'").join(ledger.select(F.col("event_id").alias("parent_id"), "session_id", "occurred_at"), "parent_id")
    of_session = edges.where("parent_kind = 'session'").join(session.select(F.col("session_id").alias("parent_id"), F.col("started_at").alias("occurred_at")), "parent_id")
    both = of_event.select("child_id", "session_id", "occurred_at").union(of_session.select("child_id", F.col("parent_id"), "occurred_at"))
    return both.groupBy(F.col("child_id").alias("artifact_id")).agg(F.min_by(F.struct("session_id", "occurred_at"), F.struct("occurred_at", "session_id")).alias("s")).select("artifact_id", "s.session_id", "s.occurred_at")


def depths(tree: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """G-08: (node, depth) of a forest (node, parent); a parent that is absent makes a root.

    Ancestors double: each round a node's parent becomes its parent's parent, so rounds are the logarithm of the depth.
    A cycle raises.
    """
    rows = saved(tree.select("node", "parent"))
    there = rows.select(F.col("node").alias("parent")).distinct()
    state = rows.join(there.withColumn("_there", F.lit(True)), "parent", "left").select(
        "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).alias("depth")
    )
    state = saved(state)
    for _ in range(64):
        if state.where("up is not null").isEmpty():
            return state.select("node", "depth")
        if not state.where("up = node").isEmpty() or not state.where(F.col("depth") > max_rounds).isEmpty():
            break
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = saved(state.join(above, "up", "left").select("node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    raise RuntimeError("the forest has a cycle")


