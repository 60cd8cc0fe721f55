"""Benchmark decontamination: windows of test items found in training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, saved

#: What separates words: every ASCII character but digits and letters; A-Z become a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Most windows that go to every task, at some 300 bytes each; larger benchmarks are joined.
MAX_WINDOWS = 250_000
#: A window may stand in a third of all documents, so its rows are dealt to this many tasks.
SALTS = 16
#: A filter of windows has at most 2**28 bits, 32 MB; beyond 17 million windows more places pass it in vain.
FILTER_BITS = 28
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Windows:
    """A set of item windows: those of a small benchmark in every task, or the candidates of one document.

    Words are numbered; a window is a row of numbers. A rolling hash finds candidates, the numbers verify them.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = 10):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(tuple(ids[i : i + n]), set()).update([item] if item is not None else [])
        self.by_length: list[tuple] = []
        for n in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == n]
            table = np.array(rows, np.uint64)
            hashes = self.hashes(table.T)
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((n, table[order], hashes[order], [sorted(found[rows[i]]) for i in order]))

    @staticmethod
    def hashes(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c) * FACTOR
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items with a window in the text."""
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, [0] * len(words)), np.uint64, len(words))
        hit, items = np.zeros(len(ids), bool), set()
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, table, hashes, owners in self.by_length:
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            keys = self.hashes([ids[starts + k] for k in range(n)])
            at = np.searchsorted(hashes, keys)
            real = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == keys)
            for start, key, i in zip(starts[real].tolist(), keys[real], at[real].tolist()):
                while i < len(hashes) and hashes[i] == key:
                    if (table[i] == ids[start : start + n]).all():
                        hit[start : start + n] = True
                        items.update(owners[i])
                    i += 1
        return len(ids), hit, items


def window_keys(words: list[bytes], n: int) -> np.ndarray:
    """The rolling hash of every ``n`` words in a row, the same in every task."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return Windows.hashes([hashes[k : len(words) - n + 1 + k] for k in range(n)]).view(np.int64) if len(words) >= n > 0 else np.zeros(0, np.int64)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(key, n, item, words) for every distinct window of ``items`` (item, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["item"], batch["body"]):
                words = words_of(body)
                n = min(width, len(words))
                rows += [(k, n, item, b" ".join(words[i : i + n]).decode(errors="replace")) for i, k in enumerate(window_keys(words, n).tolist())]
            yield pd.DataFrame(rows, columns=["key", "n", "item", "words"])

    return items.mapInPandas(run, "key long, n int, item string, words string").distinct()


def spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of 2**bits bits."""
    raw = keys.view(np.uint64)
    return raw & np.uint64((1 << bits) - 1), (raw * FACTOR) >> np.uint64(64 - bits)


def passing(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = 3 + len(held).bit_length() - 1
    a, b = spots(keys, bits)
    there = lambda at: held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return (there(a) & there(b)).astype(bool)


def key_filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of all windows' keys, 16 bits for each and at most FILTER_BITS; every task makes its own, merged in a tree."""
    bits = min(FILTER_BITS, max(10, (16 * windows.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for at in spots(batch.column("key").to_numpy(), bits):
                np.bitwise_or.at(held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["held"])

    parts = windows.select("key").mapInArrow(build, "held binary").rdd.map(lambda r: np.frombuffer(r[0], np.uint8))
    return parts.treeReduce(np.bitwise_or) if parts.getNumPartitions() else np.zeros(1 << bits - 3, np.uint8)


def candidates(keyed: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc, h1, h2, near) for documents (doc, h1, h2, text) of which a window's hash is an item's; ``near`` has items and words.

    Only places whose hash passes the filter of all windows are shuffled, with salt, to the windows of that hash.
    """
    kind = keyed.schema["doc"].dataType.simpleString()
    held = keyed.sparkSession.sparkContext.broadcast(key_filter(windows))  # bounded by FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            keys = [np.unique(np.concatenate([window_keys(w, n) for n in lengths])) for w in texts]
            keys = [k[passing(held.value, k)] for k in keys]
            own = [batch.column(c) for c in ("doc", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.list_(pa.int64()))], ["doc", "h1", "h2", "keys"])

    placed = keyed.mapInArrow(run, f"doc {kind}, h1 long, h2 long, keys array<long>").distinct()
    placed = placed.select("doc", "h1", "h2", F.explode("keys").alias("key")).withColumn("salt", F.pmod(F.xxhash64("h1", "h2"), F.lit(SALTS)).cast("int"))
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return placed.join(salted, ["key", "salt"]).groupBy("doc", "h1", "h2").agg(F.collect_set(F.struct("item", "words")).alias("near"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Add n_words, n_hit, n_items, items (sorted as strings), hit_words (positions) and contaminated to documents.

    A window is ``width`` consecutive words of an item, or the whole item if it is shorter. A benchmark that can't have
    more than ``max_windows`` of them goes to every task as a hash set; a larger one never leaves its partitions: its
    windows meet the documents' by their hashes, and every document is then held against the windows that it met. Either
    way words decide. Null and empty texts have no words; items without words have no windows; the windows of items
    without an id hit, but only ids are listed and counted; an empty benchmark hits nothing. Ids may be of any type. Other columns pass through; those of the input that have a
    result's name are replaced.
    """
    new = ["n_words", "n_hit", "n_items", "items", "hit_words", "contaminated"]
    docs = docs.drop(*new)
    found, near, h1, h2, rid, j1, j2 = fresh(docs, "_found", "_near", "_h1", "_h2", "_rid", "_j1", "_j2")
    body = F.coalesce(quoted(item_text_col).cast("string"), F.lit(""))
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), body.alias("body"))
    most = items.agg(F.sum(F.floor(F.octet_length("body") / 2) + 1)).first()[0] or 0
    text = quoted(text_col).cast("string")
    fields = "n_words long, n_hit long, items array<string>, hit_words array<int>"

    def told(results: list[tuple[int, np.ndarray, set[str]]]) -> pd.DataFrame:
        places = [np.flatnonzero(hit).astype(np.int32) for _, hit, _ in results]
        return pd.DataFrame({"n_words": [n for n, _, _ in results], "n_hit": [len(p) for p in places], "items": [sorted(x) for _, _, x in results], "hit_words": places})

    if most <= max_windows:
        whole = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], width))  # bounded by max_windows

        @F.pandas_udf(fields)
        def scanned(texts: pd.Series) -> pd.DataFrame:
            return told([whole.value.scan(t) for t in texts])

        out = docs.withColumn(found, scanned(text))
    else:
        windows = saved(item_windows(items, width))
        lengths = [r[0] for r in windows.select("n").distinct().collect()]
        marked = docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(1), text)})
        keyed = marked.select(quoted(id_col).alias("doc"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), text.alias("text"))
        met = candidates(keyed, windows, lengths or [width]).toDF(rid, j1, j2, near)
        joined = marked.join(met, quoted(id_col).eqNullSafe(met[rid]) & (F.col(h1) == F.col(j1)) & (F.col(h2) == F.col(j2)), "left")

        @F.pandas_udf(fields)
        def held(texts: pd.Series, nears: pd.Series) -> pd.DataFrame:
            none = Windows([], width)
            return told([(none if own is None or not len(own) else Windows([(w["item"], w["words"]) for w in own], width)).scan(t) for t, own in zip(texts, nears)])

        out = joined.withColumn(found, held(text, F.col(near)))
    return out.select(
        *[quoted(c) for c in docs.columns],
        F.col(found)["n_words"].alias("n_words"),
        F.col(found)["n_hit"].alias("n_hit"),
        F.size(F.col(found)["items"]).cast("long").alias("n_items"),
        F.col(found)["items"].alias("items"),
        F.col(found)["hit_words"].alias("hit_words"),
        (F.col(found)["n_hit"] > 0).alias("contaminated"),
    )


def remove_spans(text: str | None, hit_words: list[int]) -> str | None:
    """The text without the words at ``hit_words`` and what stands right before each."""
    if text is None or not len(hit_words):
        return text
    raw = text.encode()
    flat = raw.translate(WORDS)
    gone, out, at, word = set(hit_words), [], 0, 0
    for token in flat.split():
        start = flat.index(token, at)
        if word not in gone:
            out.append(raw[at : start + len(token)])
        at, word = start + len(token), word + 1
    return b"".join([*out, raw[at:]]).decode(errors="replace")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")
