"""The pipeline stage by stage against plain checks on the smallest tables."""

import corpus_pipeline
import numpy as np

from lorekeep.llm import packing, simhash

from .test_corpus import SF, plain_components, plain_fingerprint, plain_hits


def test_stages(spark, tmp_path):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert 0.6 * len(before) < len(after) < len(before)
        if name == "line_dedup":
            assert len(after) == len(before)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in before]
            assert {r.doc_id for r in after} == set(plain_components(ids, [plain_fingerprint(r.text) for r in before]))
        if name == "benchmark_decontamination":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not plain_hits(r.text, items)[-1]}
        if name == "best_fit_packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert packing.sequences([(np.ones(1), 2)]) == 2 and simhash.BITS == 64
