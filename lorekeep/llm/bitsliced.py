"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved, table

#: Rows of the index in one block, which is one row of slices, and queries that meet a block at a time.
ROWS, TOGETHER = 8192, 32
#: Quantised components lie within this bound, so that a score of 32,768 of them fits in a long.
LARGEST = 1 << 24


def packed(bits: np.ndarray) -> np.ndarray:
    """0 and 1 along the last axis as 64-bit words, the first row in the lowest bit."""
    raw = np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)])).view("<u8")


def unpacked(words: np.ndarray, rows: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :rows].astype(bool)


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each attribute, and the slices of what lies above it: (bits, attributes, words)."""
    low = values.min(axis=0) if len(values) else np.zeros(values.shape[1], np.int64)
    above = values - low
    bits = int(above.max(initial=0)).bit_length()
    return low, np.stack([packed((above >> b & 1).T) for b in range(bits)]) if bits else np.zeros((0, values.shape[1], -(-len(values) // 64)), "<u8")


def column_sums(bitmaps: np.ndarray, picks: list[np.ndarray]) -> np.ndarray:
    """Slices of the sum of bitmaps, those that ``picks[j]`` (bitmaps, queries) names counting 2**j.

    Full adders turn three bitmaps of a column into one and a carry in the next, many at a time.
    """
    out, j, carries, queries = [], 0, [], picks[0].shape[1]
    while j < len(picks) or carries:
        parts, carries = carries, []
        if j < len(picks) and len(picks[j]):
            parts.append(bitmaps[picks[j]])
        while parts and (len(parts) > 1 or len(parts[0]) > 1):
            x = parts[0] if len(parts) == 1 else np.concatenate(parts)
            m = len(x) // 3
            if m:
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                either = a ^ b
                carries.append((a & b) | (either & c))
                parts = [either ^ c, *([x[3 * m :]] if len(x) > 3 * m else [])]
            else:
                carries.append(x[:1] & x[1:])
                parts = [x[:1] ^ x[1:]]
        out.append(parts[0][0] if parts else np.zeros((queries, bitmaps.shape[1]), "<u8"))
        j += 1
    return np.stack(out)


class Block:
    """Slices of up to some thousands of rows, which stand in order of id."""

    def __init__(self, rows: int, low: np.ndarray, slices: np.ndarray):
        self.rows, self.low, self.bits = rows, low, len(slices)
        self.width, self.words = len(low), -(-rows // 64)
        #: Each slice, its complement, and an empty bitmap to fill up with.
        flat = slices.reshape(-1, self.words)
        self.bitmaps = np.concatenate([flat, ~flat, np.zeros((1, self.words), "<u8")])

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slices (bits, queries, words) and an offset for each query; a row's score is the sum of both.

        A component q meets the attribute's slices once for every bit of abs(q); below zero it meets their complements,
        as -q * u is q * (full - u) less a constant. Bitmaps of equal weight make a column, whatever they stem from.
        """
        size, empty, half = np.abs(queries), len(self.bitmaps) - 1, self.bits * self.width
        offset = queries @ self.low - np.where(queries < 0, size, 0).sum(axis=1) * ((1 << self.bits) - 1)
        digits = int(size.max(initial=0)).bit_length()
        columns = [[np.zeros((0, len(queries)), np.int64)] for _ in range(max(1, digits + self.bits))]
        for p in range(digits):
            on = (size >> p & 1).astype(bool)
            picked = np.argsort(~on, axis=1, kind="stable")[:, : on.sum(axis=1).max()]  # attributes with this bit come first
            there, below = (np.take_along_axis(x, picked, axis=1) for x in (on, queries < 0))
            for b in range(self.bits):
                columns[p + b].append(np.where(there, picked + b * self.width + below * half, empty).T)
        return column_sums(self.bitmaps, [np.concatenate(c) for c in columns]), offset

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the ``k`` best rows of each query; ``own`` is the row that is left out, or -1.

        From the most significant slice down: rows that have the bit are in while they are no more than ``k`` with those
        already in, else they alone stay in question. What is in question at the end has one score, and its first rows
        fill up the ``k``: the rows stand in order of id.
        """
        slices, offset = self.scores(queries)
        valid = np.ones((len(queries), self.rows), np.uint8)
        mine = np.flatnonzero(own >= 0)
        valid[mine, own[mine]] = 0
        asked = packed(valid)
        taken = np.zeros_like(asked)
        for bit in slices[::-1]:
            with_bit = asked & bit
            found = taken | with_bit
            many = (np.bitwise_count(found).sum(axis=1) > k)[:, None]
            taken = np.where(many, taken, found)
            asked = np.where(many, with_bit, asked & ~bit)
        ties = unpacked(asked, self.rows)
        room = k - np.bitwise_count(taken).sum(axis=1).astype(np.int64)
        keep = unpacked(taken, self.rows) | (ties & (np.cumsum(ties, axis=1) <= room[:, None]))
        q, r = np.nonzero(keep)
        bits = slices[:, q, r >> 6] >> (r & 63).astype(np.uint64) & np.uint64(1)
        return q, r, (bits.astype(np.int64) << np.arange(len(slices))[:, None]).sum(axis=0) + offset[q]


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By width, the places of the vectors that take part and floor(scale * component) of each."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = {}
    for width in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == width)
        own = values[starts[at][:, None] + np.arange(width)]
        good = np.isfinite(own).all(axis=1)
        own = np.floor(scale * own[good])
        if (np.abs(own) > LARGEST).any():
            raise ValueError(f"components must lie within {LARGEST / scale}")
        out[width] = at[good], own.astype(np.int64)
    return out


def index(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """One row for each block: its ids, its slices, and its queries with their places in it. Every vector is indexed.

    Vectors are dealt evenly to as many tasks as there are blocks; a task sorts its block by id, null ids last.
    """
    plain = vectors.select(quoted(id_col).alias("id"), quoted(vector_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    blocks = max(1, -(-plain.count() // ROWS))
    kind = plain.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # ROWS rows, give or take
        if not parts:
            return
        whole = pa.Table.from_batches(parts).sort_by("id")  # null ids last
        asks, ids = whole.column("asks").to_numpy(), whole.column("id").combine_chunks()
        for width, (at, values) in quantised(whole.column("vec").combine_chunks(), scale).items():
            if len(at):
                low, slices = sliced(values)
                mine = np.flatnonzero(asks[at])
                columns = [[width], [ids.take(pa.array(at)).to_pylist()], [low.tolist()], [slices.tobytes()], [mine.tolist()], [values[mine].astype("<i4").tobytes()]]
                kinds = [pa.int32(), pa.list_(ids.type), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["width", "ids", "low", "slices", "places", "queries"])

    built = plain.repartition(blocks).mapInArrow(build, f"width int, ids array<{kind}>, low array<bigint>, slices binary, places array<int>, queries binary")
    return saved(built.withColumn("block", F.spark_partition_id()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products of floor(scale * x) with every other row, exactly.

    The rows for which ``is_query`` holds ask; all rows but the asking one answer, ties go to the smaller id, null ids
    last. The index is a table of blocks of about ``ROWS`` rows. Each block's queries are sent to every block and meet
    its slices there, so a task holds one block and a few queries, and a query gets ``k`` rows from a block.
    Vectors meet those of their own width. Null vectors and those with a null or a component that isn't finite take no
    part. A row that repeats an id is a row of its own, as a query too. No vectors, no rows. Other columns are not read.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = index(vectors, is_query, id_col, vector_col, scale)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    last = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    none = F.lit(None)
    slices = blocks.select("block", "width", F.lit(-1).alias("home"), "ids", "low", "slices", none.cast("array<int>").alias("places"))
    query_ids = F.transform("places", lambda p: F.get("ids", p))
    asking = blocks.where(F.size("places") > 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), "width", F.col("block").alias("home"), query_ids.alias("ids"), none.cast("array<bigint>").alias("low"), F.col("queries").alias("slices"), "places"
    )
    met = slices.union(asking).repartition(parts, "block", "width").sortWithinPartitions("block", "width", "home")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ids = held = None
        for batch in batches:
            columns = [batch.column(c) for c in ("block", "width", "home", "ids", "low", "slices", "places")]
            for block, width, home, own_ids, low, raw, places in zip(*columns):
                block, width, home, raw = block.as_py(), width.as_py(), home.as_py(), raw.as_buffer()
                if home < 0:  # a block comes before those who ask
                    key, ids, words = (block, width), own_ids.values, -(-len(own_ids.values) // 64)
                    bits = len(raw) // (8 * words * width) if width else 0
                    held = Block(len(ids), np.array(low.as_py(), np.int64), np.frombuffer(raw, "<u8").reshape(bits, width, words))
                elif key == (block, width):
                    asked = places.values.to_numpy().astype(np.int64)
                    queries = np.frombuffer(raw, "<i4").reshape(len(asked), width).astype(np.int64)
                    for j in range(0, len(queries), TOGETHER):
                        own = asked[j : j + TOGETHER]
                        q, at, score = held.top(queries[j : j + TOGETHER], own if home == block else np.full(len(own), -1), k)
                        rows = [pa.array(np.full(len(q), width, np.int32)), pa.array(home << 32 | own[q]), own_ids.values.take(pa.array(q + j)), ids.take(pa.array(at)), pa.array(score)]
                        yield pa.RecordBatch.from_arrays(rows, ["width", "row", "query_id", "id", "score"])

    found = met.mapInArrow(search, f"width int, row long, query_id {kind}, id {kind}, score long")
    order = Window.partitionBy("width", "row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op12_top_k_search(spark, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))
    return found.withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
