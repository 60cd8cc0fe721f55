"""Structure repair, top-k search and resampling against plain versions, on odd rows and on the twins' tables."""

import bisect
import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bitsliced, decontamination, licenses, line_dedup, packing, pii, quality, registry, resampling, sharding, structure, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_top_k_search", "op13_importance_resampling"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    cols = sorted(ours.columns)
    assert sorted(theirs.columns) == cols
    assert sorted(map(tuple, ours.select(*cols).collect()), key=str) == sorted(theirs.select(*cols).fetchall(), key=str)


LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest_edits(turns):
    """Least (cost, audit) and the repaired pieces, by trying all edits in order of cost."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, pieces = heapq.heappop(heap)
        if i == len(turns) and LEGAL.fullmatch(roles):
            return cost, audit, pieces
        state = (i, roles[:1] == "s", roles[-1:])
        if (state, audit) in seen:
            continue
        seen.add((state, audit))
        grown = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(turns):
            role, text, fault = turns[i]
            grown.append((4, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                grown.append((late, "K", i + 1, role[:1] or "?", (f"{role}:{text}",)))
                grown += [(3 + late, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, e, j, r, p in grown:
            if re.fullmatch(r"(s?(ua)*u?)?", roles + r):
                heapq.heappush(heap, (cost + c, audit + e, j, roles + r, pieces + p))


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def test_structure_against_all_edits(spark):
    rng = np.random.default_rng(4)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["One.", "two", " \t", "Three!", None, "four?  ", "One.", " "]
    rows = [(c if c else None, int(t) if t % 4 else None, roles[int(rng.choice(6, p=[0.1, 0.35, 0.35, 0.1, 0.05, 0.05]))], texts[int(rng.integers(8))], "x") for c in range(60) for t in range(int(rng.integers(0, 7)))]
    rows += rows[:9]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, At string")
    out = structure.repair_structure(turns)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["at"]):
        got[r.conv].append(r)
    assert sum(map(len, got.values())) == len(rows)
    told = {r.conv: r for r in structure.summary(out, turns.select(F.col("conv_id").alias("conv")).union(spark.createDataFrame([(777,)], "conv long"))).collect()}
    for conv, own in got.items():
        key = lambda r: (r.turn is not None, r.turn or 0, r.role)
        assert [key(r) for r in own] == sorted(map(key, own))
        faults = plain_faults([(r.role, r.text) for r in own])
        assert [r.fault for r in own] == faults
        cost, audit, pieces = cheapest_edits([(r.role, r.text, f) for r, f in zip(own, faults)])
        t = told[conv]
        assert (t.cost, t.audit) == (cost, audit) and sum(r.cost for r in own) == cost
        assert t.repaired_sha256 == hashlib.sha256("\n".join(pieces).encode()).hexdigest()
        known = {r.turn for r in own if r.turn is not None}
        assert t.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert [t.blank, t.duplicate, t.truncated] == [faults.count(f) for f in structure.FAULTS]
        assert t.illegal == sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    assert told[777][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert structure.repair_structure(turns.where("false")).count() == 0


def test_long_conversations_are_joined_from_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(5, t, ["user", "assistant", "tool"][int(rng.choice(3, p=[0.47, 0.47, 0.06]))], f"text {t // 2 if t % 9 == 0 else t}" + (" " if t % 7 else ".")) for t in range(3 * structure.CHUNK)]
    turns = spark.createDataFrame(rows + [(6, 1, "user", "Hm.")] * 300, "conv_id long, turn long, role string, text string")
    own = sorted(structure.repair_structure(turns).where("conv = 5").collect(), key=lambda r: r["at"])
    assert [r.turn for r in own] == list(range(len(rows)))
    costs = structure.Costs()
    base, columns = structure.chart([(r.role[:1], r.fault) for r in own], structure.OPEN, costs)
    last = structure.closing(base, costs)
    want = "".join(structure.edits_of(columns, last[3])) + last[2]
    assert "".join("I" * len(r.inserted) + r.edit + "I" * len(r.closing) for r in own) == want
    assert sum(r.cost for r in own) == last[0]
    pairs = structure.repair_structure(turns).where("conv = 6").groupBy("fault", "edit").count().collect()
    assert {tuple(r) for r in pairs} == {(None, "K", 1), ("duplicate", "D", 299)}


def test_parts_join_to_the_whole():
    rng = np.random.default_rng(9)
    costs = structure.Costs()
    for _ in range(150):
        rows = [("suat"[int(rng.integers(4))], [None, None, "truncated", "blank"][int(rng.integers(4))]) for _ in range(int(rng.integers(1, 14)))]
        cut = sorted(rng.integers(0, len(rows) + 1, 2).tolist())
        parts = [p for p in (rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]) if p]
        steps = structure.joined([[structure.chart(p, s, costs)[0] for s in range(4)] for p in parts], costs)
        got = []
        for p, (start, end) in zip(parts, steps):
            got += structure.edits_of(structure.chart(p, start, costs)[1], end)
        base, columns = structure.chart(rows, structure.OPEN, costs)
        assert got == structure.edits_of(columns, structure.closing(base, costs)[3])


def plain_top(rows, k, scale=64):
    values = [(i, np.floor(scale * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, v) in enumerate(values):
        if i is not None and i % 20 == 0:
            near = sorted(((-int(v @ w), j is None, j or 0, j) for m, (j, w) in enumerate(values) if m != n and len(w) == len(v)), key=lambda x: x[:3])[:k]
            out.update((i, r + 1, x[3], -x[0]) for r, x in enumerate(near))
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_top_k_on_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(bitsliced, "ROWS", block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.4, 6).tolist()) for i in range(500)] + [(1000 + i, [0.5] * 6) for i in range(60)]  # many ties
    rows += [(None, [0.5] * 6), (2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [math.inf] * 6), (2060, [math.nan] * 6), (20, [0.1] * 6), (20, [0.1] * 6)]
    rows += [(3000 + i, rng.normal(0, 40, 3).tolist()) for i in range(50)] + [(4000, []), (4001, []), (5000, [0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, Score string")
    got = Counter(tuple(r) for r in bitsliced.top_k(vectors, F.expr("vec_id % 20 = 0"), 20).collect())
    assert got == plain_top(rows, 20)
    assert bitsliced.top_k(vectors.where("false"), F.expr("vec_id % 20 = 0")).count() == 0


def test_bit_slices_hold_every_score():
    rng = np.random.default_rng(2)
    for spread, bits in ((3, 5), (1 << 20, 9)):
        values = rng.integers(-spread, spread + 1, (130, bits))
        low, slices = bitsliced.sliced(values)
        queries = np.concatenate([rng.integers(-spread, spread + 1, (9, bits)), np.zeros((1, bits), np.int64)])
        found, offset = bitsliced.Block(130, low, slices).scores(queries)
        rows = np.stack([bitsliced.unpacked(s, 130) for s in found]).astype(np.int64)
        assert ((rows << np.arange(len(found))[:, None, None]).sum(axis=0) + offset[:, None] == queries @ values.T).all()


def plain_resample(docs, bench, longest=1, buckets=10_000):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, target = (Counter(bucket(f) for t in texts for f in grams(split(t))) for texts in ([t for _, t in docs], bench))
    s, t = sum(own.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
    out = []
    for d, text in docs:
        found = grams(split(text))
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(split(text)) >= 20])
    apt = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [10 * len(apt) // 100 >= k + 1 and k + 1 or None for k in range(len(apt))]
    done = [(*r[:4], k) for r, k in zip(apt, ranks)]
    return Counter(done + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_on_odd_rows(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "CACHED", 50)
    rng = np.random.default_rng(1)
    words = ["Alpha", "BETA", "gamma,", "naïve", "Éa", "x1", "-", "中文"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(80)]
    docs += [(None, "alpha " * 30), (None, None), (7, ""), (8, "word " * 40_000)] + [(3, "beta gamma " * 15)] * 40
    bench = ["beta beta gamma", None, "", "Naïve ÉA"]
    table = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, Weight int, _found string")
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    weighed = resampling.weigh(table, target, longest=longest)
    assert [c.lower() for c in weighed.columns] == ["doc_id", "text", "_found", "n_words", "n_features", "weight"]
    got = resampling.draw(resampling.with_noise(weighed.drop("text"))).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == plain_resample(docs, bench, longest)
    empty = resampling.draw(resampling.with_noise(resampling.weigh(table.where("false"), target)))
    assert empty.count() == 0
    assert resampling.weigh(table, target.where("false")).count() == len(docs)


@pytest.mark.parametrize(
    "name,pieces,most",
    [
        ("perfect triples", "triples", 1002),
        ("600 to 759", "narrow", 1000),
        ("few lengths", "few", 900),
        ("drawn evenly", "even", 1540),
    ],
)
def test_packing_program_on_hard_histograms(name, pieces, most):
    rng = np.random.default_rng(1)
    cuts = [sorted(rng.choice(np.arange(1, 2048), 2, replace=False).tolist()) for _ in range(1000)]
    drawn = {
        "triples": [x for a, b in cuts for x in (a, b - a, 2048 - b)],
        "narrow": rng.integers(600, 760, 3000),
        "few": [1030] * 600 + [530] * 600 + [520] * 600 + [490] * 1200,
        "even": np.random.default_rng(3).integers(1, 2049, 3000),
    }[pieces]
    counts = np.bincount(drawn, minlength=2049)
    solution, bound, prices = packing.program(counts, 2048, None, 0.02)
    held = sum(x * packing.as_counts(p, 2048) for p, x in solution.items())
    assert np.allclose(held, counts) and bound <= sum(solution.values()) + 1e-6
    assert all(sum(p) <= 2048 for p in solution)
    plan = packing.packed(counts, 2048)
    assert (sum(t * packing.as_counts(p, 2048) for p, t in plan.items()) == counts).all()
    assert bound - 1e-6 <= sum(plan.values()) <= max(most, plain_best_fit(counts, 2048))
    if pieces != "few":  # prices have moved: the lengths' worth isn't their share of a sequence any more
        there = counts > 0
        assert np.ptp((prices / np.arange(2049).clip(1))[there]) > 0.01 * (prices / np.arange(2049).clip(1))[there].mean()


def plain_best_fit(counts, capacity):
    rooms, n = [], 0
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            at = bisect.bisect_left(rooms, length)
            n += at == len(rooms)
            room = rooms.pop(at) if at < len(rooms) else capacity
            if room > length:
                bisect.insort(rooms, room - length)
    return n


def test_each_quality_measure_has_its_part(spark):
    rng = np.random.default_rng(12)
    prose = lambda n=80: " ".join(f"word{x}" for x in rng.integers(0, 5000, n))
    rows = [(i, prose() + (" &" if i % 10 == 0 else "") + ("\n" + prose(20)) * (i % 3)) for i in range(1000)]
    lines = [prose(9) for _ in range(12)]
    rows += [(2000, " ".join(f"#{x}$%" for x in rng.integers(0, 5000, 80))), (2001, " ".join("w" * 30 + str(x) for x in rng.integers(0, 5000, 80)))]
    rows += [(2002, "\n".join(f"{line}\nad\nad\nad" for line in lines)), (2003, " ".join(str(x % 10) for x in rng.integers(0, 10, 80)) + " x")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs, keep_text=False).collect()}
    assert all(got[i].kept for i in range(1000))  # one symbol in a text is no junk
    assert [got[i].kept for i in (2000, 2001, 2002)] == [False] * 3 and not any(got[i].base_failed for i in (2000, 2001, 2002))


def test_columns_that_clash_but_for_case(spark):
    docs = spark.createDataFrame([(1, "Mail me at a.b@c.example.com, one two three"), (2, None)], "doc_id long, text string")
    add = lambda *names: docs.withColumns({n: F.lit("mine") for n in names})
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([("i", "two three")], "item_id string, text string")
    results = [
        line_dedup.dedup_lines(add("N_Lines", "N_DROPPED")),
        sharding.shard_rows(add("Shard", "SLOT"), 4),
        licenses.scan_licenses(add("License_ID", "Canonical_Chars")),
        pii.replace_pii(add("Kinds", "N_Entities"), "key"),
        toxicity.score_toxicity(add("Score", "HELD_OUT"), labels),
        quality.judge(add("KEPT", "N_Words").withColumns({"lang": F.lit("en"), "source": F.lit("s")})),
        decontamination.decontaminate(add("N_Hit", "ITEMS"), bench),
        resampling.weigh(add("Weight", "N_FEATURES"), bench),
    ]
    for out in results:
        names = [c.lower() for c in out.columns]
        assert len(set(names)) == len(names) and out.count() == 2
        assert "mine" not in {v for r in out.collect() for v in r if isinstance(v, str)}


def test_texts_that_share_a_labelled_id_teach_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i % 3} number {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 60
