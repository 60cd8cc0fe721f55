"""Corpus operators against plain versions of themselves, on odd rows and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import chat, decontamination, licenses, line_dedup, packing, pii, quality, registry, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Shared line of text\nOwn line one\nshared LINE of text  ", "en", "a"),
    (2, "  shared line of text\n\nshort\n", "en", "a"),
    (3, None, None, "a"),
    (4, "", "en", None),
    (5, " \t\n", "fr", "b"),
    (6, "ÉCOLE publique de Paris\nécole publique de paris", "fr", "b"),
    (7, "école publique de paris", "fr", "b"),
    (7, "école publique de paris", "fr", "b"),
    (None, "Shared line of text", "en", "b"),
    (8, "a b c a b c a b c # $ |", "en", "b"),
    (9, "x" * 50000 + " " + "the same words again and again " * 300, "en", "b"),
    (10, "the same words again and again " * 300, "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "extra", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _line string, salt int").repartition(3)


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_sql_twins(spark):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        ours = registry.QUERIES[name](spark, SF)
        theirs = con.sql(sql)
        cols = sorted(ours.columns)
        assert cols == sorted(theirs.columns)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, ours.select(*cols).collect()), key=key) == sorted(theirs.select(*cols).fetchall(), key=key), name


def test_line_dedup_odd_rows(odd):
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(odd).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    assert got[1] == [(ODD[0][1], 3, 0)]
    assert got[2] == [("\nshort\n", 4, 1)]
    assert got[3] == got[4] == [("", 1, 0)]
    assert got[None] == [("", 1, 1)]
    assert got[6] == [("ÉCOLE publique de Paris\nécole publique de paris", 2, 0)]
    assert got[7] == [("", 1, 1)] * 2
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0
    assert line_dedup.dedup_lines(odd, min_docs=3).where("doc_id = 7 and text <> ''").count() == 2


@pytest.mark.parametrize("n", [1, 7, 40])
def test_sharding_law(spark, odd, n):
    docs = odd.union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text", "lang", "source", "'e'", "2"))
    rows = sharding.shard_rows(docs, n).collect()
    assert len(rows) == docs.count()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    sizes = [len(shards[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert sharding.shard_rows(docs.where("false"), n).count() == 0


def test_sharding_moves_little():
    rng = np.random.default_rng(1)
    counts = {c: int(k) for c, k in enumerate(rng.poisson(3, 1 << sharding.CELL_BITS)) if k}
    home = lambda n: {(c, f + i): s for c, parts in sharding.allot(counts, n).items() for f, k, s, _ in parts for i in range(k)}
    a, b = home(20), home(21)
    assert a.keys() == b.keys()
    assert sum(a[k] != b[k] for k in a) <= 2 / 21 * len(a)  # all but 1/20 would move by hash modulo


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_quality_counts(spark, odd):
    docs = odd.union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text", "lang", "source", "'e'", "2"))
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = words(r.text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(odd.where("false")).count() == 0


def test_quality_of_many_groups(spark, odd, monkeypatch):
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text", "lang", "source"))
    few = quality.judge(docs, min_rows=5).collect()
    monkeypatch.setattr(quality, "MAX_BROADCAST", 0)
    many = quality.judge(docs, min_rows=5).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_components(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], fps, plain_components([r.doc_id for r in rows], fps)), key=str)
    got = [(r.doc, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want
    own = odd.collect()
    kept = {r.doc_id for r in simhash.drop_near_duplicates(odd).collect()}
    assert kept == set(plain_components([r.doc_id for r in own], [plain_fingerprint(r.text) for r in own])) | {None}
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("bits", [0, 5, 14])
def test_ball_hashing_loses_no_link(bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [base]
    for _ in range(6):
        v = rng.choice(base, 40)
        for _ in range(4):
            v = v ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
        values.append(v)
    values = np.unique(np.concatenate(values))
    hashes = simhash.folded(values, bits)
    buckets = np.unique(hashes[:, None] ^ simhash.folded(simhash.ball(2), bits)[None, :])
    pairs = set()
    for b in buckets.tolist():
        x, y = simhash.linked_in_bucket(values, b, bits, 2)
        pairs |= set(zip(x.tolist(), y.tolist()))
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    want = plain_components([int(v) for v in values], [int(v) for v in values])
    assert [find(int(v)) for v in values] == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = dict(tuple(r) for r in simhash.components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def plain_hits(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, body in items:
        v = split(body)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontamination.MAX_WINDOWS, 30])
def test_decontamination(spark, odd, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("cast(item_id as string) item_id", "text")
    extra = [("x1", "publique de"), ("x2", None), ("x3", "..."), (None, "same words"), ("x4", "again and again the same words again and again the")]
    bench = bench.union(spark.createDataFrame(extra, bench.schema))
    items = [tuple(r) for r in bench.collect()]
    docs = odd.select("doc_id", "text", "_line").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text", "'e'"))
    for r in decontamination.decontaminate(docs, bench, max_windows=block).collect():
        digest = decontamination.items_digest(r["items"])
        assert (r.n_words, r.n_hit, r.n_items, digest, r.contaminated) == plain_hits(r.text, items)
    assert decontamination.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontamination.remove_spans("One, two; three (four) five", [1, 3]) == "One; three) five"


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, t in docs.collect():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want[d, i // 2048, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(filled) <= 1.02 * least + 1
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_histograms():
    rng = np.random.default_rng(5)
    for sample in (rng.integers(1, 65, 300), rng.integers(20, 40, 500), np.array([33] * 7 + [31] * 7), np.array([64] * 3)):
        counts = np.bincount(sample, minlength=65)
        plan = packing.pack_histogram(counts, 64, rounds=50)
        assert (sum(p * t for p, t in plan) == counts).all()
        assert all((p * np.arange(65)).sum() <= 64 for p, _ in plan)


def test_knapsack_pricing():
    value = np.zeros(31)
    value[[7, 11, 13]] = [0.7, 1.2, 1.35]
    got = packing.best_pattern(value, 30)
    best = max(0.7 * a + 1.2 * b + 1.35 * c for a in range(5) for b in range(3) for c in range(3) if 7 * a + 11 * b + 13 * c <= 30)
    assert abs((got * value).sum() - best) < 1e-9 and (got * np.arange(31)).sum() <= 30


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.9, right


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score_toxicity(odd, labels.where("false")).count() == len(ODD)
    assert toxicity.score_toxicity(odd.where("false"), labels).count() == 0


def test_license_texts(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()),
        (2, mit.replace("sublicense", "sublicence") + "\n(C) 1999 A. N. Other"),
        (3, mit + " And more."),
        (4, None),
        (5, "Copyright 2001 X"),
        (6, "released under the   M.I.T license".replace("M.I.T", "MIT")),
    ]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT-notice"}


def test_pii(spark):
    rows = [
        (1, "Mail ann.lee@mail3.example.com or ANN.LEE@mail3.example.com, call +1 (499) 555-6503."),
        (2, "Call +1-499-555-6503; card 4785 3805 9239 1139, host 152.143.123.131. bob@mail3.example.com"),
        (3, "Mrs. Jane Smith met Mr Smith; г-жа Анна Иванова; key \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""),
        (4, None),
        (5, "nothing here 12 345"),
        (5, "card 4785380592391139"),
        (None, "SSN 123-45-6789"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.replace_pii(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(out) == len(rows)
    one, two, three = by[1][0], by[2][0], by[3][0]
    for secret in ("ann.lee", "499", "4785", "152.143", "Jane", "Smith", "Иванова", "24be6443", "bob@"):
        assert not any(secret in (r.text or "") and secret not in ("4785",) for r in out), secret
    mails = re.findall(r"\S+@[\w.-]+\.com", one.text)
    assert mails[0] == mails[1].rstrip(",") and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\d\.[a-z]{7}\.com", mails[0])
    assert mails[0].split("@")[1] == re.search(r"@(\S+)", two.text)[1]  # one domain stays one
    phones = [re.sub(r"\D", "", re.search(r"\+\d[^;.]*\d", t)[0]) for t in (one.text, two.text)]
    assert phones[0] == phones[1] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", one.text)
    cards = [re.sub(r"\D", "", re.search(r"card ([\d ]+\d)", t)[1]) for t in (two.text, [r.text for r in by[5] if "card" in r.text][0])]
    assert cards[0] == cards[1] and re.search(r"card \d{4} \d{4} \d{4} \d{4},", two.text)
    assert re.match(r"Mrs\. (%s) [A-Z][a-z]+ met Mr [A-Z][a-z]+; г-жа (%s) [А-Я]" % ("|".join(pii.GIVEN["latin", "f"]), "|".join(pii.GIVEN["cyrillic", "f"])), three.text)
    assert by[4][0].text is None and by[4][0].n_entities == 0
    assert "nothing here 12 345" in [r.text for r in by[5]]
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}", by[None][0].text)
    assert pii.replace_pii(docs.where("false")).count() == 0


def test_pii_surrogates_are_distinct(spark):
    names = spark.range(3000).selectExpr("'ip' kind", "concat_ws('.', 1 + id % 200, 7, id div 200, 9) canon")
    got = pii.assign(names, "k").collect()
    assert len({r.new for r in got}) == len(got) == 3000
    assert not {r.new for r in got} & {r.canon for r in got}


def plain_repair(codes):
    """Least cost by trying every path."""
    costs = {chat.START: 0}
    for code in codes:
        new = {}
        for s, c in costs.items():
            for cost, t, _, _ in chat.moves(code, s):
                new[t] = min(new.get(t, 10**9), c + cost)
        costs = new
    return min(c + chat.ending(s) for s, c in costs.items())


def test_chat_repair(spark):
    rng = np.random.default_rng(8)
    roles = ["system", "user", "assistant", "User ", "tool", None]
    rows = [(c if c else None, int(t), roles[int(rng.integers(0, 6))], f"t{c}.{t}" if t % 5 else None) for c in range(30) for t in range(int(rng.integers(1, 12)))]
    rows += [(99, int(t), roles[int(rng.integers(0, 6))], "x") for t in range(400)] + [(98, 1, "user", "same")] * 50
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.repair_conversations(turns).collect()
    assert len(out) == len(rows)
    convs = defaultdict(list)
    for r in out:
        convs[r.conv].append(r)
    for c, own in convs.items():
        own.sort(key=lambda r: (r.turn, r.key))
        assert sum(r.cost for r in own) == plain_repair([chat.role_code(r.role_in) for r in own]), c
        whole = "".join(r.rendered for r in own)
        heads = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
        assert whole.count("<|end|>\n") == len(heads)
        state = chat.START
        for h in heads:
            assert chat.ROLES.index(h) in chat.NEXT[state]
            state = chat.ROLES.index(h)
        assert state == chat.FINAL
    assert chat.repair_conversations(turns.where("false")).count() == 0


def test_packing_ids_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 60)
    texts = [
        "Hello, WORLD! Don't... it's x<|endoftext|>. <|ENDOFTEXT|>, a.b.c; É, é! Σίσυφος ΟΔΟΣ. ΟΔΟΣ",
        "", " \t\n", "中文, 中文。 é, É! ́, 3, 3.14! ², x²: …! 'S, 'RE; I'M! naïve? İ, ß; ǅ. क़, क़!",
        "one two three, four. five! " * 9, "\x1c\x1d a\xa0b   c\x85d 　,",
    ]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Ids(packing.tokenizer_path())(t.encode() for t in texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
