"""Version stores, drains and roots against plain versions."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import vectors
from lorekeep.operators import chain, runs
from lorekeep.operators.versions import HorizonError, VersionStore
from lorekeep.session import shared_folder
from lorekeep.sources import spool
from lorekeep.streaming.draining import Drain


def replayed(changes, instant):
    held = {}
    for k, v, at, turn, gone in sorted(changes, key=lambda c: (c[2], c[3])):
        if at <= instant:
            held[k] = None if gone else (v,)
    return sorted((k, v[0]) for k, v in held.items() if v)


def test_reads_equal_replay_and_the_horizon_holds(spark):
    rng = random.Random(3)
    changes = [(rng.randrange(12), rng.choice(["a", "b", None]), rng.randrange(50), i, rng.random() < 0.2) for i in range(200)]
    store = VersionStore(spark, shared_folder(spark, "versions"), ["k"])
    for part in (changes[::3], changes[1::3], changes[2::3]):
        rows = spark.createDataFrame(part, "k long, v string, at long, turn long, gone boolean")
        store.append(rows.select("k", "v", "at", "turn", "gone"), F.col("at"), F.col("turn"), F.col("gone"))
    read = lambda at: sorted((r.k, r.v) for r in store.read(at).collect())
    for at in (-1, 0, 17, 30, 49, 99):
        assert read(at) == replayed(changes, at)
    store.compact(20)
    for at in (20, 33, 99):
        assert read(at) == replayed(changes, at)
    with pytest.raises(HorizonError, match="before the horizon 20"):
        store.read(19)
    store.append(spark.createDataFrame([(5, "late", 40, 999, False)], "k long, v string, at long, turn long, gone boolean"), F.col("at"), F.col("turn"), F.col("gone"))
    store.compact(40)
    assert read(45) == replayed([*changes, (5, "late", 40, 999, False)], 45)
    with pytest.raises(HorizonError):
        store.read(39)


def test_a_drain_settles_each_key_once(spark):
    seen = []

    def provider(rows):
        got = [(r.key, r.attempt) for r in rows.collect()]
        seen.append(sorted(got))
        good = [(k, f"v{k}") for k, attempt in got if k == 1 or (k == 2 and attempt == 2)]
        return spark.createDataFrame(good, "key long, value string")

    drain = Drain(spark, shared_folder(spark, "drain"), provider, most=3, base=10, cap=25, limit=3)
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (2, "b2", 9), (3, "c", 2), (4, "d", 99), (None, "x", 0)], "key long, text string, created_us long")
    drain.settle(rows, 0, 0)
    drain.settle(rows, 0, 0)  # a repeat after a failure writes over what the first try left
    assert seen[0] == seen[1] == [(1, 0), (2, 0), (3, 0)] and drain.attempts().count() == 3
    drain.settle(rows, 1, 9)  # 2 and 3 are not due before 10
    assert seen[2] == [(4, 0)]
    drain.settle(rows, 2, 20)
    drain.settle(rows, 3, 39)  # waits have doubled to 20, from 20 on
    assert seen[3] == [(2, 1), (3, 1), (4, 1)] and seen[4] == []
    drain.settle(rows, 4, 1000)
    drain.settle(rows, 5, 2000)
    assert seen[5] == [(2, 2), (3, 2), (4, 2)] and seen[6] == []
    told = {r.key: (r.attempts, r.done, r.value, r.dead) for r in drain.standing().collect()}
    assert told == {1: (1, True, "v1", False), 2: (3, True, "v2", False), 3: (3, False, None, True), 4: (3, False, None, True)}


def test_a_drain_ends_when_nothing_is_owed_and_ranks_keys_alone(spark):
    rows = spark.createDataFrame([(k, f"t{k}", 50 - k) for k in range(50)] + [(3, "later", 99)], "key long, text string, created_us long")
    seen = []

    def provider(due):
        got = [(r.key, r.text, r.attempt) for r in due.collect()]
        seen.append(got)
        return spark.createDataFrame([(k, text) for k, text, attempt in got if k % 5 or attempt == 2], "key long, value string")

    drain = Drain(spark, shared_folder(spark, "finish"), provider, limit=8)
    assert "text" not in drain.due(rows, 0, 0).columns
    drain.finish(rows, 0)
    assert sorted(k for k, _, _ in seen[0]) == list(range(42, 50)) and max(map(len, seen)) == 8 and sum(map(len, seen)) == 70
    told = drain.standing().collect()
    assert sorted((r.key, r.attempts, r.value) for r in told) == [(k, 1 if k % 5 else 3, f"t{k}") for k in range(50)]


def test_the_stated_root_is_the_plain_digest(spark):
    tips = [(i * 7919 % 10_000, f"d{i}" if i % 50 else None) for i in range(10_000)]
    rows = [{"session_id": str(s), "terminal_chain_digest": d} for s, d in sorted(tips, key=lambda t: str(t[0]))]
    plain = hashlib.sha256(json.dumps({"sessions": rows}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    table = spark.createDataFrame([*tips, (None, "x")], "session_id long, terminal_digest string")
    for n in (1, 7):
        assert [tuple(r) for r in chain.stated_root(table.repartition(n)).collect()] == [(10_000, plain)]
    odd = spark.createDataFrame([('a"b\\c', "é"), ("z/\n", None)], "session_id string, terminal_digest string")
    text = json.dumps({"sessions": [{"session_id": 'a"b\\c', "terminal_chain_digest": "é"}, {"session_id": "z/\n", "terminal_chain_digest": None}]}, separators=(",", ":"), ensure_ascii=False)
    assert chain.stated_root(odd).first().root_digest == hashlib.sha256(text.encode()).hexdigest()
    assert chain.stated_root(table.where("false")).count() == 0
    keyed = table.where("session_id is not null").withColumn("w", F.col("session_id") % 3)
    got = {r.w: r.root_digest for r in chain.stated_root(keyed, "w").collect()}
    assert got == {w: chain.stated_root(keyed.where(F.col("w") == w).drop("w")).first().root_digest for w in range(3)}


def test_nearest_by_blocks_and_by_broadcast_agree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 90)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 8).round(1).tolist()) for i in range(300)] + [(400 + i, [1.0] + [0.0] * 7) for i in range(30)]
    rows += [(900, None), (901, [0.0] * 8), (902, [math.nan] * 8), (903, [1.0, 2.0]), (904, [2.0, 1.0]), (905, [])]
    table = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = table.where("id % 3 = 0 OR id > 800")
    for ceiling in (None, 0.4):
        got = [sorted(map(tuple, vectors.knn_join(table, queries, 7, ceiling, max_queries=n).collect())) for n in (1000, 10)]
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(np.linalg.norm(v)) and np.linalg.norm(v) > 0}
        want = []
        for q in unit:
            if q % 3 == 0 or q > 800:
                far = sorted((round(float(1 - unit[q] @ u), 6) + 0.0, i) for i, u in unit.items() if len(u) == len(unit[q]))
                want += [(q, i, d, n + 1) for n, (d, i) in enumerate([f for f in far if ceiling is None or f[0] <= ceiling][:7])]
        assert got[0] == got[1] and [(a, b, p) for a, b, _, p in got[0]] == [(a, b, p) for a, b, _, p in sorted(want)]
    assert vectors.knn_join(table.where("false"), queries, 7, None, max_queries=3).count() == 0


def test_vectors_of_another_width_are_not_written(spark):
    artifacts = spark.createDataFrame([(1, "a", "pending"), (2, "", "pending")], "artifact_id long, body string, embedding_state string")
    given = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "artifact_id long, vec array<double>")
    rows, held = runs.write_with_vectors(artifacts.drop("embedding_state"), given, width=2)
    assert {r.artifact_id: r.embedding_state for r in rows.collect()} == {1: "embedded", 2: "not_required"} and held.count() == 1
    with pytest.raises(Exception, match="a vector of width 3 was expected"):
        runs.write_with_vectors(artifacts.drop("embedding_state"), given, width=3)
    with pytest.raises(Exception, match="a vector of width 3 was expected"):
        runs.embedded(artifacts, given.where("false"), given, width=3)[1].collect()


def test_a_spool_keeps_the_newest_whole_records(spark, tmp_path):
    store = spool.Spool(spark, str(tmp_path / "spool"), 40)
    assert store.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "place long, line string")
    assert store.write(rows((1, "a" * 9), (2, 'quote " and é'), (3, None))) == 1
    assert sorted(map(tuple, store.read().collect())) == [(1, "a" * 9), (2, 'quote " and é')]
    with open(tmp_path / "spool/gen=1/part-torn.json", "w") as f:  # a record that was cut off, and one without a place
        f.write('{"place":9,"line":"cut o\n{"line":"no place"}\n')
    assert store.read().count() == 2
    assert store.write(rows((4, "b" * 19))) == 2  # 10 + 15 + 20 bytes are more than 40
    assert sorted(r.place for r in store.read().collect()) == [2, 4]
    (tmp_path / "spool/gen=3").mkdir()  # a writer that was lost
    (tmp_path / "spool/gen=3/part-0.json").write_text('{"place":7,"line":"x"}\n')
    assert store.last() == 2 and store.write(rows((5, "c" * 50))) == 3 and store.read().count() == 0
