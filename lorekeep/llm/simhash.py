"""SimHash near-dedup: fingerprints meet in the middle of the Hamming ball between them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, saved

BITS = 64
#: Variants that one task holds in memory at a time: 8 bytes each, and as much again to sort them.
VARIANTS_PER_BUCKET = 1 << 22
#: Places of fingerprints in buckets that are sorted at a time.
DEALT_AT_ONCE = 1 << 21
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles' XXH64, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    ones, n = np.zeros(BITS, np.int64), len(a)
    for i in range(0, n, BLOCK):
        pieces = map(joined.__getitem__, map(slice, a[i : i + BLOCK], b[i : i + BLOCK]))
        digests = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, min(BLOCK, n - i))
        ones += np.unpackbits(digests.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(doc, fp) for every row, ids of any type; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found.view(np.int64))], ["doc", "fp"])

    pairs = docs.select(quoted(id_col).alias("doc"), quoted(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(run, f"doc {pairs.schema['doc'].dataType.simpleString()}, fp long")


def ball(radius: int) -> np.ndarray:
    """Every 64-bit pattern of at most ``radius`` set bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)], np.uint64)


def folded(values: np.ndarray, bits: int) -> np.ndarray:
    """A linear hash: folded(a ^ b) == folded(a) ^ folded(b). So a value's variants in a bucket are known from both hashes."""
    rng = np.random.default_rng(20)
    columns = rng.integers(1, 1 << bits, BITS, dtype=np.int64) if bits else np.zeros(BITS, np.int64)
    out = np.zeros(len(values), np.int64)
    for byte in range(8):
        sums = np.zeros(256, np.int64)
        for b in range(8):
            sums[1 << b : 2 << b] = sums[: 1 << b] ^ columns[8 * byte + b]
        out ^= sums[(values >> np.uint64(8 * byte)).astype(np.uint8)]
    return out


def linked_in_bucket(values: np.ndarray, bucket: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (value, least value linked to it here) by the variants that fall in this bucket.

    Values that share a variant are each within ``half`` bits of it, so within 2 * ``half`` of each other;
    a star to the least of them keeps them connected without their pairs.
    """
    values = np.unique(values)
    patterns = ball(half)
    hashes = folded(patterns, bits)
    order = np.argsort(hashes, kind="stable")
    patterns, hashes = patterns[order], hashes[order]
    wanted = folded(values, bits) ^ bucket
    low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
    ends = np.cumsum(high - low)
    variants = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for value, start, stop, end in zip(values, low.tolist(), high.tolist(), ends.tolist()):
        np.bitwise_xor(patterns[start:stop], value, out=variants[end - (stop - start) : end])
    ranked = np.sort(variants)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    del ranked
    if not len(twice):
        return values[:0], values[:0]
    spread, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(BITS - 22)
    seen = np.zeros(1 << 22, bool)
    seen[(twice * spread) >> shift] = True
    owner, group = [], []
    for i in range(0, len(variants), BLOCK):  # a block at a time: most variants are met by no other
        block = variants[i : i + BLOCK]
        maybe = np.flatnonzero(seen[(block * spread) >> shift])
        at = np.searchsorted(twice, block[maybe])
        real = twice[np.minimum(at, len(twice) - 1)] == block[maybe]
        owner.append(np.searchsorted(ends, maybe[real] + i, "right"))
        group.append(at[real])
    owner, group = np.concatenate(owner), np.concatenate(group)
    order = np.lexsort((owner, group))
    owner, group = owner[order], group[order]
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(heads, len(owner)))
    centre = values[np.repeat(owner[heads], sizes)]
    assert (np.bitwise_count(centre ^ values[owner]) <= 2 * half).all()  # the check of colliding pairs
    label = np.arange(len(values))
    while True:  # least label over the stars until nothing moves
        before = label.copy()
        np.minimum.at(label, owner, np.repeat(np.minimum.reduceat(label[owner], heads), sizes))
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Edges (a, b), a > b as unsigned, whose components are those of all pairs at ``radius`` bits or fewer.

    Each of the ``n`` fingerprints goes to the buckets that its variants hash to; the number of buckets grows
    with n so that a bucket's variants fit a task. An odd radius uses balls of the next half and then its exact
    distance test would be needed, so it is refused.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    half = radius // 2
    patterns = len(ball(half))
    bits = min(40, max(5, math.ceil(math.log2(max(1, n) * patterns / VARIANTS_PER_BUCKET))))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        syndromes = np.unique(folded(ball(half), bits))
        step = max(1, DEALT_AT_ONCE // len(syndromes))
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64)
            for i in range(0, len(own), step):
                values = own[i : i + step]
                places = (folded(values.view(np.uint64), bits)[:, None] ^ syndromes[None, :]).ravel()
                order = np.argsort(places, kind="stable")
                places, owners = places[order], values[order // len(syndromes)]
                cuts = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
                yield pd.DataFrame({"bucket": places[cuts], "fps": [x.tobytes() for x in np.split(owners, cuts[1:])]})

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = linked_in_bucket(np.frombuffer(b"".join(rows["fps"]), np.uint64), int(key[0]), bits, half)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInPandas(deal, "bucket long, fps binary").groupBy("bucket").applyInPandas(meet, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): large-star and small-star rounds until nothing moves.

    Each round is two joins whose rows are edges; every round is kept in the checkpoint folder.
    """
    state = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        state = saved(
            large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).distinct()
        )
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select("b", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc, fp, component) for every row: the smallest id reachable over links of at most ``radius`` bits.

    Texts are lower-cased in A-Z and split at ASCII white space; fewer words than ``shingle`` are one shingle, no
    words (null and empty texts) have fingerprint zero and link like any other. A null id keeps its row; it
    joins its component but never names it, and alone its component is null. Rows may share an id.
    """
    found = saved(fingerprints(docs, id_col, text_col, shingle))
    distinct = saved(found.groupBy("fp").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct, distinct.count(), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", "root")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root", "left").where("root is not null or n > 1")
    named = saved(named.select("fp", F.coalesce("least", "first").alias("component")))
    return found.join(named, "fp", "left").select("doc", "fp", F.coalesce("component", "doc").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Keep the document with the smallest id of each group; rows with a null id stay, as nothing names them.

    Rows that share the smallest id all stay; ``similar.drop_similar`` tells them apart by their texts.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle, radius)
    (gone,) = fresh(docs, "_gone")
    losers = groups.where("doc <> component").select(F.col("doc").alias(gone)).distinct()
    return docs.join(losers, quoted(id_col) == F.col(gone), "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
