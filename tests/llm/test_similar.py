"""The near-dedup stage against exact search over all pairs."""

from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from lorekeep.llm import similar, simhash


def plain_similar(rows):
    """{id: least id of its component} over all pairs of 5-word similarity >= 0.8."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders, common = {}, {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for own in holders.values():
        for p in combinations(sorted(own), 2):
            common[p] = common.get(p, 0) + 1
    empty = sorted(d for d, s in sets.items() if not s)
    pairs = [p for p, n in common.items() if 10 * n >= 8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + [(empty[0], d) for d in empty[1:]]
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


@pytest.fixture(scope="module")
def edited():
    """Texts with copies a few words apart, so near 0.8 that most are over 4 bits from each other; chains; odd rows."""
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = [(0, None), (1, " \n"), (2, "one"), (3, "ONE "), (4, "one two three"), (5, "a b c d e"), (6, "a b c d e f")]
    for _ in range(40):
        words = draw(int(rng.integers(60, 300)))
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            for at in rng.integers(0, len(words), max(1, len(words) // int(rng.integers(40, 70)))):
                words[at] = draw(1)[0]
    return rows


def test_similar_is_exact(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(5)
    want = plain_similar(edited)
    assert {r.doc: r.component for r in similar.similar(docs).collect()} == want
    kept = corpus_pipeline.near_deduplication(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == set(want.values())
    old = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert len(old) > len(set(want.values())) + 10  # what 4 bits alone leave in


def test_similar_odd_rows(spark):
    rows = [(None, "a b"), (7, "A  b"), (7, "x y z"), (9, "a b"), (None, "q")]
    got = similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc, r.component) for r in got], key=str) == sorted([(None, 7), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    assert similar.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loose_groups_meet_in_blocks(spark, monkeypatch):
    """Texts near one base but mostly under 0.8 to each other: bands hold many components, some of which are linked."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 16)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
    rows = []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(2, 6)), replace=False):
            words[at] = f"v{rng.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(words)))
        if len(rows) % 4 == 0:  # a text that is similar to this one alone
            words[3] = "x"
            rows.append((len(rows), " ".join(words)))
    want = plain_similar(rows)
    assert 5 < len(set(want.values())) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc: r.component for r in similar.similar(docs).collect()} == want


def test_rows_that_share_id_and_text(spark):
    rows = [("a", "one two three four five six", 1), ("a", "one two three four five six", 2), ("b", "one two three four five six", 3), (None, "One two three four five six", 4), (None, "q", 5), ("c", "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _h int").repartition(2)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([("a", rows[0][1]), (None, "q"), ("c", "z")], key=str)
