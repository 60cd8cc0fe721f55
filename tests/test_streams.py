"""Keyed state, resumable positions and the reachability index against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph, policy, vector_index
from lorekeep.operators.lineage_index import LineageIndex
from lorekeep.plans.catalog import QUERIES
from lorekeep.session import shared_folder
from lorekeep.sources import changes
from lorekeep.sources.changes import change_source
from lorekeep.streaming import trailing, watch

EVENT = "event_id long, session_id long, client_id long, seq long, category string, path string, command string, occurred_at timestamp_ntz"
RULES = [policy.Rule(1, "errors", "error_rate", "warn", threshold=0.3, window_events=3), policy.Rule(2, "all", "error_rate", "halt_agent", threshold=0.4)]


def event(s, seq, bad, minute=None):
    return (s * 1000 + seq, s, 1, seq, "error" if bad else "tool_call", None, None, datetime(2024, 1, 1) + timedelta(minutes=seq if minute is None else minute))


def staged(spark, schema, parts, name):
    """A stream of the parts in this order, one a batch."""
    path = shared_folder(spark, name)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return watch.change_stream(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_trailing_windows_in_any_order(spark):
    rng = random.Random(5)
    rows = [event(s, q, rng.random() < 0.4) for s in range(6) for q in range(1, 30)]
    session = spark.createDataFrame([(s, 1.0) for s in range(6)], "session_id long, cost_usd double")
    want = sorted(map(tuple, policy.evaluate(policy.enrich(spark.createDataFrame(rows, EVENT), session, RULES), RULES).collect()))
    mixed = rows + rows[:40]  # some come twice
    rng.shuffle(mixed)
    source = staged(spark, EVENT, [mixed[:50], mixed[50:51], mixed[51:]], "mixed")
    out = watch.drain(trailing.trailing_stream(source, session, RULES, timedelta(days=9)), "out")
    assert sorted(map(tuple, out.drop("batch").collect())) == want and want


def test_a_gap_is_passed_after_its_lateness(spark):
    session = spark.createDataFrame([(1, 1.0)], "session_id long, cost_usd double")
    parts = [[event(1, q, True) for q in (1, 2, 4, 5)], [event(9, 1, True, 600)], [event(1, 6, True, 601)]]
    out = watch.drain(trailing.trailing_stream(staged(spark, EVENT, parts, "gap"), session, RULES[:1], timedelta(hours=2)), "gap-out")
    assert sorted(r.event_id for r in out.where("session_id = 1").collect()) == [1001, 1002, 1004, 1005, 1006]


class Held:
    """State in memory, which counts how often it is asked."""

    def __init__(self):
        self.rows, self.value, self.timers, self.calls = {}, None, [], 0
        for name, act in (("getValue", lambda k: self.rows.get(k)), ("updateValue", self.rows.__setitem__), ("removeKey", lambda k: self.rows.pop(k, None)), ("registerTimer", self.timers.append)):
            setattr(self, name, self.counted(act))
        self.get, self.update = self.counted(lambda: self.value), self.counted(lambda v: setattr(self, "value", v))
        self.getValueState = self.getMapState = lambda *a: self

    def counted(self, act):
        def call(*args):
            self.calls += 1
            return act(*args)

        return call


def test_waiting_events_are_kept_in_blocks():
    seqs = list(range(1, 8001))
    random.Random(2).shuffle(seqs)
    processor, state, got = trailing.TrailingShares([3], timedelta(hours=1)), Held(), []
    processor.init(state)
    for part in range(4):
        rows = [dict.fromkeys(trailing.CARRIED) | {"seq": q, "event_id": q, "category": "error" if q % 2 else "view", "at": q * 1000} for q in seqs[part::4]]
        got += processor.handleInputRows((7,), iter(rows), None)
    assert [r.seq for r in got] == sorted(seqs) and not state.rows and {r.error_3 for r in got[2:]} == {1 / 3, 2 / 3}
    assert state.calls < 400  # one event at a time they were over 20,000


def test_a_stream_of_a_table_has_small_files_and_as_many_batches(spark):
    from glob import glob

    source = watch.as_stream(spark.range(1000), "small", 4, file_rows=50)
    out = watch.drain(source, "small-out")
    assert out.count() == 1000 and {r.batch for r in out.select("batch").distinct().collect()} == {0, 1}
    folders = glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/small-*/*.parquet")
    assert len(folders) == 20


def test_live_rows_outlive_a_restart(spark):
    kinds, t0 = "session_id long, scratch_key string, value string, updated_at timestamp_ntz", datetime(2024, 1, 1)
    write = lambda s, v, h: (s, "k", v, t0 + timedelta(hours=h))
    path, out, offsets = (shared_folder(spark, n) for n in ("live-in", "live-out", "live-offsets"))
    for rows in ([write(1, "old", 0), write(2, "a", 0), write(2, "b", 1)], [write(1, None, 5)], [write(3, "x", 20)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(path)
        source = watch.change_stream(spark, path, spark.createDataFrame([], kinds).schema, 1)
        changes = trailing.live_stream(source, timedelta(hours=10))
        run = changes.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", offsets)
        run.trigger(availableNow=True).start().awaitTermination()  # a new run each time, on the state of the one before
    rows = spark.read.parquet(out)
    assert sorted((r.session_id, r.value) for r in trailing.standing(rows).collect()) == [(3, "x")]
    assert sorted(r.session_id for r in rows.where("NOT live").collect()) == [1, 2]


@pytest.mark.parametrize("mode,limit", [("feed", 25), ("feed", 4), ("poll", 7)])
def test_a_restart_goes_on_behind_the_last_position(spark, mode, limit):
    rng = random.Random(limit)
    rows = sorted({(rng.randrange(40) * 10, rng.randrange(100)) for _ in range(60)})
    path, out, offsets = (shared_folder(spark, n) for n in ("feed", "fed", "fed-offsets"))
    kinds, seen = "recorded_us long, id long, resolved boolean", []
    for part, promise in ((rows[:30], rows[24]), (rows[30:], rows[50])):
        spark.createDataFrame([(*r, r == promise) for r in part], kinds).repartition(3).write.mode("append").parquet(path)
        run = change_source(spark, path, mode, limit).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        running = run.option("checkpointLocation", offsets).trigger(processingTime="0 seconds").start()
        running.processAllAvailable()
        running.stop()
        got = [(r.recorded_us, r.id, r.batch) for r in spark.read.parquet(out).collect()]
        assert sorted(g[:2] for g in got) == [r for r in rows if r <= (promise if mode == "feed" else part[-1])]
        seen.append(got)
    assert set(seen[0]) <= set(seen[1])  # nothing came again under another number
    sizes = [sum(g[2] == b for g in seen[1]) for b in {g[2] for g in seen[1]}]
    assert max(sizes) <= limit and len(sizes) > 1


def test_a_batch_opens_only_the_row_groups_of_its_positions(spark, tmp_path):
    kinds, rows = "recorded_us long, id long, resolved boolean", [(n // 3, (7 * n) % 3000, n % 500 == 400) for n in range(3000)]
    for k in range(0, 3000, 200):
        spark.createDataFrame(rows[k : k + 200][::-1], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    plain = sorted((at, key) for at, key, _ in rows)
    for mode in ("feed", "poll"):
        reader = changes.ChangeReader({"path": str(tmp_path / "log"), "mode": mode, "limit": 150, "parts": 4}, spark.createDataFrame([], kinds).schema)
        start, opened, got = reader.initialOffset(), [], []
        while (end := reader.latestOffset()) != start:
            slices = reader.partitions(start, end)
            opened += [g for s in slices for g in s.groups]
            batch = [(r["recorded_us"], r["id"]) for s in slices for b in reader.read(s) for r in b.to_pylist()]
            assert 0 < len(batch) <= 150
            got, start = got + sorted(batch), end
        assert got == (plain if mode == "poll" else [r for r in plain if r <= max((at, key) for at, key, done in rows if done)])
        assert len(opened) <= 3 * 15 and len(set(opened)) >= 14  # 15 files; 20 batches, which once read each of them four times
    late = spark.createDataFrame([(999, 5000, False), (1500, 1, False)], kinds)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    assert reader.latestOffset() == {"recorded_us": 1500, "id": 1}  # a file that comes later is seen


@pytest.mark.parametrize("mode", ["feed", "poll"])
def test_a_trigger_takes_several_batches_that_end_as_they_would_alone(spark, tmp_path, mode):
    kinds, rows = "recorded_us long, id long, resolved boolean", [(n // 7, (11 * n) % 2003, n % 70 == 40 and n < 900) for n in range(2000)]
    for k in range(0, 2000, 300):
        spark.createDataFrame(rows[k : k + 300][::-1], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    reader = lambda batches: changes.ChangeReader({"path": str(tmp_path / "log"), "mode": mode, "limit": 60, "parts": 4, "batches": batches}, spark.createDataFrame([], kinds).schema)
    position, handed = lambda o: (o["recorded_us"], o["id"]), lambda s, by: sorted((r["recorded_us"], r["id"]) for b in by.read(s) for r in b.to_pylist())
    ends, got, triggers = {}, {}, {}
    for batches in (1, 8):
        by, ends[batches], got[batches], triggers[batches] = reader(batches), [], [], 0
        start = by.initialOffset()
        while (end := by.latestOffset()) != start:
            slices, again = by.partitions(start, end), reader(batches).partitions(start, end)  # ``again`` as after a restart
            assert [(s.low, s.high, s.groups) for s in slices] == [(s.low, s.high, s.groups) for s in again]
            assert slices[0].low == position(start) and slices[-1].high == position(end)
            ends[batches] += sorted({s.high for s in slices})
            for high in sorted({s.high for s in slices}):
                batch = [r for s in slices if s.high == high for r in handed(s, by)]
                assert 0 < len(batch) <= 60
                got[batches] += sorted(batch)
            start, triggers[batches] = end, triggers[batches] + 1
    plain = sorted((at, key) for at, key, _ in rows)
    assert got[1] == got[8] == (plain if mode == "poll" else [r for r in plain if r <= max((at, key) for at, key, done in rows if done)])
    assert ends[1] == ends[8] and triggers == {1: len(ends[1]), 8: -(-len(ends[1]) // 8)}


def triggers_of(spark, name, before=()):
    from glob import glob

    return set(glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/{name}-offsets-*/commits/[0-9]*")) - set(before)


def test_the_feed_query_takes_many_batches_a_trigger(spark):
    before = triggers_of(spark, "feed-rows")
    found = QUERIES["st02_feed_to_last_promise"](spark, "/root/testdata/sf0.01")
    assert found.count() == 9501 and len(triggers_of(spark, "feed-rows", before)) == 1  # three batches of 4,000 rows at most


def test_the_poll_query_takes_many_batches_a_trigger(spark):
    before = triggers_of(spark, "poll-rows")
    found = QUERIES["st02_polled_rows"](spark, "/root/testdata/sf0.01")
    assert found.count() == 10_000 and len(triggers_of(spark, "poll-rows", before)) == 1  # three batches of 4,000 rows


def test_a_restart_goes_on_behind_several_batches(spark):
    rows = [(n // 3, (7 * n) % 500) for n in range(200)]
    path, out, offsets = (shared_folder(spark, n) for n in ("polled", "polled-out", "polled-offsets"))
    for part, triggers in ((rows[:120], 3), (rows[120:], 5)):  # 12 and 8 batches of 10 rows
        spark.createDataFrame(part, "recorded_us long, id long").repartition(3).write.mode("append").parquet(path)
        write = lambda b, n: b.withColumn("task", F.spark_partition_id()).write.mode("overwrite").parquet(f"{out}/batch={n}")
        run = change_source(spark, path, "poll", 10, batches=5).writeStream.foreachBatch(write).option("checkpointLocation", offsets)
        running = run.trigger(processingTime="0 seconds").start()
        running.processAllAvailable()
        running.stop()
        got = spark.read.parquet(out)
        assert sorted((r.recorded_us, r.id) for r in got.collect()) == sorted(rows[: 120 if part[0] == rows[0] else 200])
        assert {r.batch for r in got.collect()} == set(range(triggers)) and max(r["count"] for r in got.groupBy("batch", "task").count().collect()) <= 10


def reachable(edges, roots):
    below, seen = {}, set()
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    todo = [x for r in roots for x in below.get(r, ())]
    while todo:
        x = todo.pop()
        if x is not None and x not in seen:
            seen.add(x)
            todo += below.get(x, ())
    return sorted(seen)


def test_the_index_reaches_what_edges_reach(spark, tmp_path):
    rng = random.Random(3)
    for n, m in ((30, 40), (20, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (2, None), (5, 5)]
        edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200 + i, 201 + i) for i in range(40)] + [(220, 3)]
        table = spark.createDataFrame(edges, "src long, dst long")
        index = LineageIndex.read(spark, LineageIndex.build(table.union(table)).write(str(tmp_path / f"i{n}")))
        for roots in ([0, 1, 101, 999], [200, 230], [239], []):
            got = index.reached(spark.createDataFrame([(r,) for r in roots], "node long"))
            assert sorted(r.node for r in got.collect()) == reachable(edges, roots)


def test_deep_chains_take_few_rounds(spark):
    edges = spark.range(20 * 250).select((F.floor(F.col("id") / 250) * 1000 + F.col("id") % 250).alias("src"), (F.floor(F.col("id") / 250) * 1000 + F.col("id") % 250 + 1).alias("dst"))
    index = LineageIndex.build(edges)
    assert index.cross.isEmpty() and index.nodes.agg(F.max("pos")).first()[0] == 250
    assert index.reached(spark.range(20).select((F.col("id") * 1000).alias("node")), max_rounds=2).count() == 20 * 250
    assert LineageIndex.build(edges.where("false")).reached(spark.range(1).toDF("node")).count() == 0


def in_order(existing, proposed, n):
    below, out = {}, {}
    for child, parent, _ in existing:
        below.setdefault(parent, set()).add(child)
    for edge, child, parent in sorted(proposed):
        if child == parent:
            out[edge] = "self_edge"
        elif parent >= n:
            out[edge] = "absent_parent"
        elif child in below.get(parent, ()):
            out[edge] = "duplicate"
        elif parent in reachable([(a, b) for a, bs in below.items() for b in bs], [child]):
            out[edge] = "cycle"
        else:
            out[edge] = "accepted"
            below.setdefault(parent, set()).add(child)
    return out


def test_edges_of_a_batch_are_judged_in_turn(spark):
    rng = random.Random(8)
    n = 25
    existing = [(*sorted(rng.sample(range(n), 2), reverse=True), "derived_artifact") for _ in range(20)]
    proposed = [(i, rng.randrange(n), rng.randrange(n + 2)) for i in range(30)] + [(40, 7, 8), (41, 8, 9), (42, 9, 7), (43, 7, 8)]
    run = lambda e, p: {r.edge_id: r.verdict for r in graph.judge_batch(spark.createDataFrame(e, "child_id long, parent_id long, parent_kind string"), spark.createDataFrame(p, "edge_id long, child_id long, parent_id long"), spark.range(n).toDF("node")).collect()}
    assert run(existing, proposed) == in_order(existing, proposed, n)
    assert run([], [(1, 2, 1), (2, 3, 2), (3, 1, 3)]) == {1: "accepted", 2: "accepted", 3: "cycle"}
    assert run(existing, []) == {}


def test_vector_index_finds_what_is_near_and_takes_more_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE", 3000)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (300, 32))
    rows = centres[rng.integers(300, size=20_000)] + rng.normal(0, 0.4, (20_000, 32))
    table = pa.table({"id": np.arange(20_000), "vec": list(rows.astype(np.float32))})
    vectors = spark.createDataFrame(table)
    odd = spark.createDataFrame([(30_000, None), (30_001, [0.0] * 32), (30_002, [1.0] * 5), (30_003, [float("nan")] * 32)], vectors.schema)
    built = vector_index.VectorIndex.build(vectors.where("id < 15000").union(odd), recall=0.97)
    built.insert(vectors.where("id >= 15000"))
    index = vector_index.VectorIndex.read(spark, built.path)
    assert index.rows.count() == 20_000 and 100 <= len(index.centroids) <= 150 and index.probes < len(index.centroids) / 2
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    hit = 0
    for q in rng.integers(20_000, size=6).tolist():
        query = rows[q] + rng.normal(0, 0.1, 32)  # no row of the table
        want = np.argsort(-(unit @ (query / np.linalg.norm(query))))[:10].tolist()
        got = index.search(query.tolist(), 10).collect()
        hit += len({r.id for r in got} & set(want))
        assert [r.distance for r in got] == sorted(r.distance for r in got) and len(got) == 10
    assert hit >= 54  # of 60
    assert vector_index.VectorIndex.build(odd).search([1.0] * 32, 3).count() == 0
