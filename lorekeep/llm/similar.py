"""Near copies by exact Jaccard similarity of word shingles; SimHash links and MinHash bands only name candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, saved
from .simhash import components, fingerprint, links

#: A pair of similarity s shares a band with 1 - (1 - s ** DEPTH) ** BANDS: 0.9998 at 0.8.
BANDS, DEPTH = 16, 4
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose minima are taken at a time.
BLOCK = 1 << 12
#: Texts, and shingles of texts, of one band that a task compares with as many others of it.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 21


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct XXH64 of ``width`` words in a row; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(7)), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of minima; none for a text without words, which only its own kind equals."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK, None] * FACTORS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, DEPTH))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def described(rows: DataFrame, width: int) -> DataFrame:
    """(doc, h, node, fp, keys) for rows of (doc, h, text); node is the 128-bit digest of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [split(t) for t in texts]
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            nodes = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            keys = pa.array([band_keys(shingles(w, width)) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), pa.array(nodes, pa.binary()), pa.array(fps), keys], ["doc", "h", "node", "fp", "keys"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, h long, node binary, fp long, keys array<long>")


def simhash_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Candidates (a, b): texts of one fingerprint, and texts of linked fingerprints."""
    heads = saved(nodes.groupBy("fp").agg(F.min("node").alias("b")))
    same = nodes.join(heads, "fp").select(F.col("node").alias("a"), "b")
    linked = links(heads, heads.count(), radius).toDF("fp", "other")
    other = heads.select(F.col("fp").alias("other"), "b")
    return same.union(linked.join(other, "other").join(nodes, "fp").select("node", "b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least ``percent`` of their union in common."""
    both = pairs.join(sets.toDF("b", "gb"), "b").join(sets.toDF("a", "ga"), "a")
    both = both.withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return both.where(100 * F.col("common") >= percent * (F.size("ga") + F.size("gb") - F.col("common"))).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked_in_blocks(rows: pd.DataFrame, one: int, two: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Stars (node, least node) of the texts of blocks ``one`` and ``two`` that pairs of ``percent`` similarity connect.

    ``rows``: node, root, block, grams. Pairs of one root are connected already and are not counted as links.
    """
    nodes, grams = rows["node"].to_numpy(), [np.asarray(g, np.int64) for g in rows["grams"]]
    roots, sizes = np.unique(rows["root"].to_numpy(), return_inverse=True)[1], np.fromiter(map(len, grams), np.int64, len(grams))
    block = rows["block"].to_numpy()
    first, second = np.flatnonzero(block == one), np.flatnonzero(block == two)
    if not len(first) or not len(second):
        return []
    _, ids, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    ids = [x[times[x] > 1] for x in ids]  # what one text alone has is in no intersection
    held = np.concatenate([ids[j] for j in second])
    by = np.argsort(held, kind="stable")
    owner = np.repeat(np.arange(len(second)), [len(ids[j]) for j in second])[by]
    starts = np.searchsorted(held[by], np.arange(len(times) + 1))
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in first.tolist():
        low, n = starts[ids[i]], starts[ids[i] + 1] - starts[ids[i]]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(second))
        near = (100 * common >= percent * (sizes[i] + sizes[second] - common)) & (roots[second] != roots[i])
        for j in second[near].tolist():
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return [(nodes[x], nodes[find(x)]) for x in range(len(nodes)) if find(x) != x]


def block_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the roots that a band still holds. ``left``: key, node, root.

    A band's texts are dealt to blocks; each two blocks, and each block with itself, meet in one task, which tells only
    what is connected. So a text goes to as many tasks as its band has blocks, and no pair of texts is ever a row.
    """
    full = left.join(sets, "node")
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum(F.size("grams")) / BLOCK_SHINGLES)).cast("int")
    full = full.join(full.groupBy("key").agg(n.alias("blocks")), "key")
    full = full.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("key", "node", "root", "grams", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked_in_blocks(rows, int(key[1]), int(key[2]), percent), columns=["a", "b"])

    return full.groupBy("key", "one", "two").applyInPandas(meet, "a binary, b binary").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, radius: int) -> DataFrame:
    """(doc, h, root) for every row: the digest that all texts reachable over pairs of ``percent`` similarity share. See ``similar``."""
    text = quoted(text_col).cast("string")
    rows = docs.select(quoted(id_col).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = saved(described(rows, width))
    one = F.min(F.struct("doc", "h")).alias("one")
    nodes = saved(found.groupBy("node").agg(one, F.first("fp").alias("fp"), F.first("keys").alias("keys")))

    banded = nodes.select("node", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = saved(banded.join(heads, "key"))
    star = shared.select(F.col("node").alias("a"), F.col("head").alias("b"))
    tried = saved(ordered(star.union(simhash_pairs(nodes.where(F.size("keys") > 0).select("node", "fp"), radius))))

    wanted = tried.select(F.col("a").alias("node")).union(tried.select("b")).union(shared.select("node")).distinct()
    wanted = nodes.join(wanted, "node").select("node", F.col("one.doc").alias("_doc"), F.col("one.h").alias("_h"))
    texts = rows.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).select("node", "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "grams": [shingles(split(t), width).view(np.int64) for t in batch["text"]]})

    sets = saved(texts.mapInPandas(hashed, "node binary, grams array<long>").dropDuplicates(["node"]))
    roots = saved(components(verified(tried, sets, percent)))

    rooted = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = saved(rooted.join(several, "key"))
    more = saved(block_links(left, sets, percent))
    if not more.isEmpty():
        roots = saved(components(roots.toDF("a", "b").union(more)))
    return found.select("doc", "h", "node").join(roots, "node", "left").select("doc", "h", F.coalesce("root", "node").alias("root"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, radius: int = 4) -> DataFrame:
    """(doc, component) for every row: the smallest id reachable over pairs of ``percent`` similarity or more.

    Words are lower-cased in A-Z and split at ASCII white space; equal words are one node. Candidates are SimHash
    links of ``radius`` bits and texts that share a MinHash band; each is verified by its whole shingle sets. A band's
    texts first meet its least one; bands that still hold several components then meet in blocks (see
    ``block_links``). Ids may be of any type that sorts. Null ids join a component but never name it; texts without
    words equal each other alone.
    """
    found = saved(grouped(docs, id_col, text_col, width, percent, radius))
    least = found.groupBy("root").agg(F.min("doc").alias("component"))
    return found.join(least, "root").select("doc", "component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, radius: int = 4) -> DataFrame:
    """Keep one row of each component: that with the smallest id, null being the last, and of one id the least hash of its text.

    Of rows that share both id and text, one stays.
    """
    gone, h, kept = fresh(docs, "_gone", "_h", "_kept")
    found = saved(grouped(docs, id_col, text_col, width, percent, radius))
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "h"))
    best = found.groupBy("root").agg(first.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "best.doc", "best.h").toDF("root", "_d", "_b")
    several = saved(found.join(best, "root").select("doc", "h", (F.col("doc").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_b"))).alias("best")))
    known = docs.withColumn(h, F.xxhash64(quoted(text_col).cast("string")))
    losers = several.where("NOT best").select(F.col("doc").alias(gone), F.col("h").alias(kept)).distinct()
    stay = known.join(losers, quoted(id_col).eqNullSafe(F.col(gone)) & (F.col(h) == F.col(kept)), "left_anti")
    twice = saved(several.where("best").groupBy("doc", "h").count().where("count > 1").select(F.col("doc").alias(gone), F.col("h").alias(kept)))
    if not twice.isEmpty():
        same = quoted(id_col).eqNullSafe(F.col(gone)) & (F.col(h) == F.col(kept))
        stay = stay.join(twice, same, "left_anti").union(stay.join(twice, same, "left_semi").dropDuplicates([id_col, h]))
    return stay.drop(h)
