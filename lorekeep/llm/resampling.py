"""Target-distribution importance resampling: hashed n-grams of a target weigh documents, Gumbel noise draws them."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, saved, table
from .decontamination import WORDS

#: Features whose buckets a Python worker remembers, about 150 bytes each.
CACHED = 400_000
#: Partition ids stand above this many bits of monotonically_increasing_id().
ROW_BITS = 33


class Buckets:
    """Buckets of the features of UTF-8 texts; those met lately are remembered."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}

    def features(self, words: list[bytes]) -> Iterable[bytes]:
        """Runs of 1 to ``longest`` words, joined by one space."""
        if self.longest == 1:
            return words
        runs = (zip(*(islice(words, k, None) for k in range(n))) for n in range(1, self.longest + 1))
        return map(b" ".join, chain.from_iterable(runs))

    def __call__(self, texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
        """The number of words of each text, and the bucket of every feature of it."""
        for text in texts:
            words = (text or b"").translate(WORDS).split()
            found = list(self.features(words))
            new = set(found).difference(self.known)
            if len(self.known) + len(new) > CACHED:
                self.known.clear()
                new = set(found)
            self.known.update((f, zlib.crc32(f) % self.buckets) for f in new)
            yield len(words), np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))


def text_bytes(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(quoted(text_col).cast("string").cast("binary").alias("text"))


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """First pass: features in each bucket over all texts. A partition sends one vector, merged in a tree of tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in hashed(batch.column("text").to_pylist()):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = text_bytes(df, text_col).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier the target is to use a bucket, one count added to each, rounded down."""
    n = len(own)
    ratio = (target + 1.0) * (own.sum() + float(n)) / ((own + 1.0) * (target.sum() + float(n)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """Add n_words, n_features and weight to ``docs``: the mean gain of a document's features, rounded down.

    Both tables are read whole, ``docs`` twice: once for its counts, once to gather gains. Only vectors of ``buckets``
    counts reach the driver, and one vector of gains goes to every task. Null and empty texts have no features and
    weight 0; with an empty target or no documents at all the one count added to each bucket decides. Repeated rows
    count as often as they stand there. Columns of the input that have a result's name are replaced.
    """
    docs = docs.drop("n_words", "n_features", "weight")
    gains = docs.sparkSession.sparkContext.broadcast(
        gains_of(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    )

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed, gain = Buckets(buckets, longest), gains.value.astype(np.float64)
        for batch in batches:
            rows = list(hashed(batch.to_pylist()))
            sizes = np.array([len(found) for _, found in rows], np.int64)
            of = np.repeat(np.arange(len(rows)), sizes)
            every = np.concatenate([found for _, found in rows]) if rows else np.zeros(0, np.int64)
            sums = np.bincount(of, gain[every], minlength=len(rows)).astype(np.int64)  # whole numbers far below 2 ** 53
            fields = [np.array([n for n, _ in rows], np.int64), sizes, sums // np.maximum(sizes, 1)]
            yield pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["n_words", "n_features", "weight"])

    (found,) = fresh(docs, "_found")
    out = docs.withColumn(found, weighed(quoted(text_col).cast("string").cast("binary")))
    return out.select(*[quoted(c) for c in docs.columns], *[F.col(found)[c].alias(c) for c in ("n_words", "n_features", "weight")])


def with_noise(weighed: DataFrame, id_col: str = "doc_id", seed: int = 2024) -> DataFrame:
    """Add score: the weight and 1000 times a Gumbel variable that seed and id decide. A null id is like an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))))


def draw(scored: DataFrame, id_col: str = "doc_id", percent: int = 10, min_words: int = 20) -> DataFrame:
    """Add rank: 1, 2, 3... for the ``percent`` best scores of the documents with ``min_words`` words, null for all others.

    Ties go to the smaller id, null ids last; rows that share an id have ranks of their own. Rows are dealt by ranges of
    the order, written, and numbered by their place in a range and the rows of the ranges before it; one number for
    each range goes through the driver. All columns travel, so drop wide ones first.
    """
    spark = scored.sparkSession
    scored = scored.drop("rank")
    apt, uid, at, part, base = fresh(scored, "_apt", "_uid", "_at", "_part", "_base")
    rows = saved(scored.withColumn(apt, F.coalesce(F.col("n_words") >= min_words, F.lit(False))))
    most = rows.where(F.col(apt)).count() * percent // 100
    order = [F.desc(apt), F.desc("score"), quoted(id_col).asc_nulls_last(), F.col(uid)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(uid, F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn(at, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(at, ROW_BITS))
    sizes, bases, before = sorted(dealt.groupBy(part).count().collect()), [], 0
    for p, n in sizes:
        bases.append((p, before))
        before += n
    starts = spark.createDataFrame(bases, f"{part} long, {base} long")
    place = F.col(base) + F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    ranked = dealt.join(F.broadcast(starts), part)
    return ranked.select(*[quoted(c) for c in scored.columns], F.when(F.col(apt) & (place <= most), place).alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_noise(weigh(docs, table(spark, sf_dir, "benchmark")).drop("text"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit over the digits of a text's bytes, as DuckDB has no function of that name.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(hex(encode({text}))) // 2), lambda i:
      (16 * (strpos('0123456789ABCDEF', substr(hex(encode({text})), (2 * i - 1)::INT, 1)) - 1)
        + strpos('0123456789ABCDEF', substr(hex(encode({text})), (2 * i)::INT, 1)) - 1)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT 0 AS side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM d
  UNION ALL SELECT 1, 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
hashed AS MATERIALIZED (SELECT word, {CRC32.format(text='word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words)),
counts AS (SELECT b AS bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM range(10000) x(b) LEFT JOIN (SELECT side, bucket FROM words JOIN hashed USING (word)) ON bucket = b GROUP BY b),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scores AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (r)),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS apt FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY apt ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (apt) OVER () AS m FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN apt AND place <= 10 * m // 100 THEN place END AS rank FROM ranked
"""
