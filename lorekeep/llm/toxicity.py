"""Toxicity: multiple-instance learning of sentence scores from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

#: Labelled documents the classifier is fitted on at most, those with the least hashes of their ids.
MAX_TRAINING = 12_000
#: Slots that features hash to.
SLOTS = 1 << 20
TOKENS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SENTENCE = re.compile(rb"[^.!?\n]+[.!?]*")


def features(sentence: bytes) -> list[bytes]:
    """Lower-cased words, and marks for shouting: a sentence all in capitals, or closed by several exclamation marks."""
    out = sentence.translate(TOKENS).split()
    if sentence.isupper() and len(sentence) > 3:
        out.append(b"<capitals>")
    if sentence.endswith(b"!!"):
        out.append(b"<shout>")
    return out


def slot(feature: bytes) -> int:
    return zlib.crc32(feature) % SLOTS


class Model:
    """Weights of hashed features and a bias; a sentence's score is their logistic, a document's the noisy-or."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        weights, bias, known = self.weights, self.bias, {}

        def weight(feature: bytes) -> float:
            if (w := known.get(feature)) is None:
                if len(known) > 500_000:
                    known.clear()
                w = known[feature] = weights.get(slot(feature), 0.0)
            return w

        def score(text: str | None) -> tuple[float, int, int, int, float]:
            """Document score, sentences, and start, end (bytes) and score of the worst sentence."""
            raw = (text or "").encode()
            sums, spans = [], []
            for m in SENTENCE.finditer(raw):
                sums.append(bias + sum(map(weight, set(features(m[0])))))
                spans.append(m.span())
            if not sums:
                sums, spans = [bias], [(0, 0)]
            z = np.array(sums)
            total = np.logaddexp(0, z).sum()
            worst = int(z.argmax())
            return float(-np.expm1(-total)), len(z), *spans[worst], float(1 / (1 + np.exp(-z[worst])))

        return score


def fit(bags: list[tuple[int, list[list[int]]]], rounds: int = 400, rate: float = 0.05, max_features: int = 4000, ridge: float = 2e-3) -> Model:
    """Sentence weights by gradient ascent on the noisy-or likelihood of document labels.

    Features are those whose documents' labels differ most from the base rate (a z-score of at least 2 over at
    least 3 documents), ``max_features`` at most. Without both labels the model is the base rate.
    """
    y = np.array([label for label, _ in bags], float)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    sentences = float(np.mean([max(1, len(s)) for _, s in bags])) if bags else 1.0
    bias = float(np.log(base / sentences / 4))
    if not len(y) or y.min() == y.max():
        return Model({}, bias)
    seen, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for label, bag in bags:
        ids = np.unique(np.concatenate([np.asarray(s, np.int64) for s in bag])) if bag else np.zeros(0, np.int64)
        seen[ids] += 1
        toxic[ids] += label
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where(seen >= 3, (toxic - base * seen) / np.sqrt(base * (1 - base) * seen), 0.0)
    chosen = np.argsort(-z, kind="stable")[:max_features]
    chosen = chosen[z[chosen] >= 2.0]
    index = {int(f): i for i, f in enumerate(chosen)}
    owner, row, col, plain = [], [], [], np.zeros(len(bags))
    for d, (_, bag) in enumerate(bags):
        for s in bag or [[]]:
            own = [index[f] for f in s if f in index]
            if own:
                row += [len(owner)] * len(own)
                col += own
                owner.append(d)
            else:
                plain[d] += 1
    owner, row, col = (np.array(x, np.int64) for x in (owner, row, col))
    w = np.concatenate((np.zeros(len(chosen)), [bias]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], len(owner))
        logistic = lambda x: 1 / (1 + np.exp(-x))
        s = -np.bincount(owner, np.logaddexp(0, z), len(bags)) - plain * np.logaddexp(0, w[-1])
        clean = np.exp(np.minimum(s, -1e-9))
        slope = y * clean / (1 - clean) - (1 - y)  # of the negative log-likelihood by s
        by_z = -slope[owner] * logistic(z)
        grad = np.concatenate((np.bincount(col, by_z[row], len(chosen)), [by_z.sum() - (slope * plain).sum() * logistic(w[-1])])) / len(bags)
        grad[:-1] += ridge * w[:-1] / max(1, len(bags)) * 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({int(f): float(x) for f, x in zip(chosen, w)}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_training: int = MAX_TRAINING) -> Model:
    """Fit on at most ``max_training`` labelled documents that are not held out; their hashed features reach the driver."""
    usable = labels.select(quoted(id_col).alias("doc"), quoted(label_col).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc")))
    usable = usable.groupBy("doc").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc"), "doc").limit(max_training)
    texts = docs.select(quoted(id_col).alias("doc"), quoted(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(usable), "doc")  # bounded by max_training
    chosen = chosen.groupBy("doc", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text for each id

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [[[slot(f) for f in set(features(m[0]))] for m in SENTENCE.finditer((t or "").encode())] for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc": batch["doc"],
                    "label": batch["label"],
                    "ends": [np.cumsum([len(s) for s in b], dtype=np.int32).tobytes() for b in bags],
                    "ids": [np.array([f for s in b for f in s], np.int32).tobytes() for b in bags],
                }
            )

    chosen = chosen.withColumn("doc", F.col("doc").cast("string"))
    rows = chosen.mapInPandas(hashed, "doc string, label int, ends binary, ids binary").collect()
    bags = []
    for r in sorted(rows, key=lambda r: (len(r.doc), r.doc, r.ids)):
        ids, ends = np.frombuffer(r.ids, np.int32), np.frombuffer(r.ends, np.int32)
        bags.append((r.label, [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []))
    return fit(bags)


def held_out(doc):
    """Rows that are never learnt from. A null id is never learnt from either."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    max_training: int = MAX_TRAINING,
) -> DataFrame:
    """Add held_out, score, predicted, n_sentences, worst_start, worst_end (byte offsets) and worst_score.

    Only texts are scored. Null and empty texts are one empty sentence. Labels that are null or not 0 or 1 teach
    nothing; a document labelled twice counts once, as toxic if either says so, and of texts that share an id one teaches. Without labels of both kinds
    every sentence scores the base rate. Ids may be of any type that both tables share. Columns of the input that
    have a result's name are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, max_training))
    new = ["held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score"]
    docs = docs.drop(*new)

    @F.pandas_udf("score double, n_sentences int, worst_start int, worst_end int, worst_score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.value.scorer()
        for texts in batches:
            yield pd.DataFrame([score(t) for t in texts], columns=["score", "n_sentences", "worst_start", "worst_end", "worst_score"])

    (one,) = fresh(docs, "_scored")
    out = docs.withColumn(one, scored(quoted(text_col).cast("string")))
    s = F.col(one)
    return out.select(
        *[quoted(c) for c in docs.columns],
        held_out(quoted(id_col)).alias("held_out"),
        s["score"].alias("score"),
        (s["score"] >= threshold).cast("int").alias("predicted"),
        *[s[c].alias(c) for c in new[3:]],
    )


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score")
