"""What a review found to be done in part only."""

import re
import textwrap

import numpy as np

from lorekeep.llm import licenses, packing, pii, quality


def test_packing_solves_the_program():
    counts = np.zeros(2049, np.int64)
    counts[[1030, 530, 520]], counts[490] = 600, 1200
    plan = packing.pack_histogram(counts, 2048)
    assert (sum(p * t for p, t in plan) == counts).all()
    assert packing.sequences(plan) <= 905  # best-fit decreasing takes 1100, the volume 897
    covered = sum(p * x for p, x in packing.fractional(counts, 2048, 300, 0.1))
    assert (covered >= counts - 1e-6).all()
    many = np.bincount(np.random.default_rng(2).integers(1, 500, 2000), minlength=513)
    covered = sum(p * x for p, x in packing.fractional(many, 512, 5, 0.1))  # more lengths than rounds
    assert (covered >= many - 1e-6).all()
    assert (packing.capped_pattern(np.arange(65.0), np.bincount([40, 9, 9], minlength=65), 64)[[40, 9]] == [1, 2]).all()


def test_small_groups_meet_fences(spark):
    rng = np.random.default_rng(6)
    prose = lambda: " ".join(f"word{x}" for x in rng.integers(0, 900, 80))
    junk = " ".join(f"#{x}$%" for x in rng.integers(0, 900, 80))
    rows = [(i, prose(), "en", f"s{i % 30}") for i in range(60)] + [(100, junk, "en", "s1"), (101, junk, "en", "rare"), (102, junk, "xx", "y"), (103, prose(), "xx", "y")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {**dict.fromkeys(range(60), True), 100: False, 101: False, 102: False, 103: True}


def test_licence_in_any_wrapping(spark):
    head = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n"
    rows = [(w, head + textwrap.fill(licenses.KNOWN["MIT"], w)) for w in range(30, 130)]
    rows += [(1, "(c) You must keep notices\nCopyright holders are named"), (2, "© Somebody"), (3, "Copyright 2001-2004 X"), (4, "(C) 1999 X"), (5, "Copyright © X")]
    got = {r.n: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "n long, text string")).collect()}
    assert all(got[w].license_id == "MIT" for w in range(30, 130))
    assert got[1].canonical_chars == len("c you must keep notices copyright holders are named")
    assert all(got[k].canonical_chars == 0 for k in (2, 3, 4, 5))


def test_hex_secrets_of_either_case(spark):
    h = "9233a8ecf7c5d01b7e44aa10c9f3e2b86d5f7a01"
    mixed = h[:20].upper() + h[20:]
    docs = spark.createDataFrame([(1, f"TOKEN = {h.upper()}!"), (2, f"token = {h}!"), (3, f"Token = {mixed}!")], "doc_id long, text string")
    got = {r.doc_id: re.search(r"= (\w{40})!", r.text)[1] for r in pii.replace_pii(docs).collect()}
    assert got[1] == got[2].upper() and got[2] == got[2].lower() != h
    assert got[3].lower() == got[2] and all(not a.isupper() or b == b.upper() for a, b in zip(mixed, got[3]))
