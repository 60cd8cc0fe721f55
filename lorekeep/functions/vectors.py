"""Vector expressions and checks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import saved, shared_folder

#: Most queries of a k-NN join that go to every task, and most neighbours of each.
MAX_QUERIES = MAX_NEIGHBOURS = 1000
#: Vectors of a block.
ROWS = 8192
PLACES = 6


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """V-01: 0 to 2; null where a vector is null or the widths differ, or one is zero."""
    fits = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fits, 1 - dot(a, b) / (norm(a) * norm(b)))


def l2_distance(a: Column, b: Column) -> Column:
    """V-02: orders unit vectors as the cosine distance does."""
    return F.sqrt(F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """V-04: scaled to length one; null for zero vectors and for those with a non-finite part."""
    finite = ~F.exists(as_doubles(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return F.when(finite & (norm(v) > 0), F.transform(as_doubles(v), lambda x: x / norm(v)))


def is_unit(v: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def to_text(v: Column) -> Column:
    """V-05: ``[a,b,...]``."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"[\[\] ]", ""), ",").cast("array<double>")


def token_hash_vectors(df: DataFrame, text_col: str, width: int = 64, out_col: str = "vec") -> DataFrame:
    """V-06: words hashed to signed buckets, then scaled to length one; texts without words, or whose words cancel out, get the first axis.

    Words are runs of ASCII characters after each character became its one lower-case character. A bucket is the first 8 digest bytes, as an unsigned number, modulo ``width``: no JVM type holds that.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        known: dict[str, tuple[int, int]] = {}

        def one(text):
            v = np.zeros(width)
            for word in re.findall(r"[a-z0-9_]+", (text or "").replace("\u0130", "i").lower(), re.ASCII):  # Python lowers it to two
                if word not in known:
                    if len(known) > 200_000:
                        known.clear()
                    d = sha256(word.encode()).digest()
                    known[word] = int.from_bytes(d[:8], "big") % width, 1 - 2 * (d[8] & 1)
                at, sign = known[word]
                v[at] += sign
            size = np.sqrt((v * v).sum())
            if not size:
                v[0] = size = 1.0
            return v / size

        for batch in texts:
            yield batch.map(one)

    return df.withColumn(out_col, embed(F.col(text_col)))


def unit_rows(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this width that have a direction, and they themselves scaled to length one."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    width = width or int(np.bincount(np.maximum(sizes, 0)).argmax())
    values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    at = np.flatnonzero(sizes == width)
    rows = values[starts[at][:, None] + np.arange(width)]
    size = np.linalg.norm(rows, axis=1)
    good = np.isfinite(size) & (size > 0)
    return at[good], rows[good] / size[good, None]


def best_of(far: np.ndarray, ids: np.ndarray, k: int, ceiling: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``k`` least distances of each query within the ceiling; ties by id."""
    if len(ids) > k:
        edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        near = far <= (edge if ceiling is None else np.minimum(edge, ceiling))
    else:
        near = far <= (np.inf if ceiling is None else ceiling)
    q, r = np.nonzero(near)
    order = np.lexsort((ids[r], far[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k]


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.round(1 - queries @ rows.T, PLACES) + 0.0


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, ceiling: float | None = None, max_queries: int = MAX_QUERIES) -> DataFrame:
    """J-28: (query_id, id, distance, place), the ``k`` nearest of ``vectors`` (id, vec) for each of ``queries`` (id, vec).

    Up to ``max_queries`` queries go to every task, which holds each Arrow batch of vectors against all of them. More
    of them never pass the driver: both sides are written in blocks, every block of queries is sent to every block of
    vectors, and a task makes one matrix product for each such pair. Distances are rounded to 6 places, ties go by id,
    and pairs beyond ``ceiling`` are dropped. Vectors meet only those of their own width; null and zero vectors, and
    those with a part that isn't finite, meet nothing.
    """
    if not 0 < k <= MAX_NEIGHBOURS:
        raise ValueError(f"k must be from 1 to {MAX_NEIGHBOURS}")
    rows = queries.select("id", "vec").limit(max_queries + 1).collect()
    found = near_block(vectors, rows, k, ceiling) if len(rows) <= max_queries else near_blocks(vectors, queries, k, ceiling)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def near_block(vectors: DataFrame, rows: list, k: int, ceiling: float | None) -> DataFrame:
    """(query_id, id, distance): of each Arrow batch of ``vectors`` the ``k`` nearest of each query row."""
    by_width: dict[int, list] = {}
    for r in rows:
        if r.vec is not None and np.isfinite(size := np.linalg.norm(r.vec)) and size > 0:
            by_width.setdefault(len(r.vec), []).append((r.id, np.asarray(r.vec, float) / size))
    matrices = [(n, np.array([i for i, _ in own], np.int64), np.stack([v for _, v in own])) for n, own in by_width.items()]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("id").to_numpy()
            for width, ids, matrix in matrices:
                at, unit = unit_rows(batch.column("vec"), width)
                if len(at):
                    far = distances(matrix, unit)
                    q, r = best_of(far, names[at], k, ceiling)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names[at][r]), pa.array(far[q, r])], ["query_id", "id", "distance"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(near, "query_id long, id long, distance double")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, width, ids, matrix): unit vectors of one width, about ``size`` of them, as one row."""
    plain = rows.select(F.col("id").cast("long").alias("id"), "vec")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # ``size`` rows, give or take
        whole = pa.Table.from_batches(parts).combine_chunks() if parts else None
        widths = np.unique(whole.column("vec").combine_chunks().value_lengths().drop_null().to_numpy()) if parts else []
        for width in widths[widths > 0] if len(widths) else []:
            at, unit = unit_rows(whole.column("vec"), int(width))
            if len(at):
                ids = whole.column("id").to_numpy()[at]
                columns = [pa.array([int(width)], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["width", "ids", "matrix"])

    blocks = max(1, -(-plain.count() // size))
    return saved(plain.repartition(blocks).mapInArrow(pack, "width int, ids array<bigint>, matrix binary").withColumn("block", F.spark_partition_id()))


def near_blocks(vectors: DataFrame, queries: DataFrame, k: int, ceiling: float | None) -> DataFrame:
    """(query_id, id, distance): of each block of ``vectors`` the ``k`` nearest of each query."""
    held, asked = in_blocks(vectors, ROWS), in_blocks(queries, MAX_QUERIES)
    last = held.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), "width", F.lit(1).alias("asks"), "ids", "matrix")
    both = held.select("block", "width", F.lit(0).alias("asks"), "ids", "matrix").unionAll(sent)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = both.repartition(parts, "block", "width").sortWithinPartitions("block", "width", "asks")  # a block before those who ask

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = rows = names = None
        for batch in batches:
            for block, width, asks, ids, raw in zip(*(batch.column(c) for c in ("block", "width", "asks", "ids", "matrix"))):
                here, own = (block.as_py(), width.as_py()), ids.values.to_numpy()
                matrix = np.frombuffer(raw.as_buffer(), float).reshape(len(own), here[1])
                if not asks.as_py():
                    key, rows, names = here, matrix, own
                elif key == here:
                    far = distances(matrix, rows)
                    q, r = best_of(far, names, k, ceiling)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(names[r]), pa.array(far[q, r])], ["query_id", "id", "distance"])

    return met.mapInArrow(near, "query_id long, id long, distance double")


class CellIndex:
    """V-03, index form: vectors dealt to the cells of centroids, and how many cells a search opens.

    ``rows`` is (id, vec, cell) of every vector that has a direction, in the shared checkpoint folder, in files by cell.
    """

    def __init__(self, centroids: np.ndarray, rows: DataFrame, probes: int):
        self.centroids, self.rows, self.probes = centroids, rows, probes

    def search(self, query: list[float], k: int, ceiling: float | None = None, probes: int | None = None) -> DataFrame:
        """(id, distance), the ``k`` nearest in the opened cells; distances are exact. Only the files of those cells are read."""
        q = np.asarray(query, float) / np.linalg.norm(query)
        cells = np.argsort(-(self.centroids @ q), kind="stable")[: probes or self.probes].tolist()
        found = near_block(self.rows.where(F.col("cell").isin(cells)), [Row(id=0, vec=list(query))], k, ceiling)
        return found.select("id", "distance").orderBy("distance", "id").limit(k)


def cell_index(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 10, k: int = 10, recall: float = 0.95) -> CellIndex:
    """Centroids are fitted on the ``sample`` vectors of the least id hashes; every vector of their width is indexed.

    The number of cells to open is the least with which 100 of the sample find ``recall`` of their ``k`` nearest in it.
    """
    rows = vectors.select("id", "vec").where("vec is not null")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["vec"]  # bounded by ``sample``
    some = [np.asarray(v, float) for v in some]
    some = np.stack([v for v in some if len(v) == len(some[0]) and np.linalg.norm(v) > 0])
    some /= np.linalg.norm(some, axis=1)[:, None]
    centroids = some[np.linspace(0, len(some) - 1, min(cells, len(some))).astype(int)]
    for _ in range(rounds):
        own = (some @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, some)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centroids)
    own = (some @ centroids.T).argmax(axis=1)
    tried = some[np.linspace(0, len(some) - 1, min(100, len(some))).astype(int)]
    nearest = np.argsort(-(tried @ some.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(tried @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    width = centroids.shape[1]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = batch[[len(v) == width and np.linalg.norm(v) > 0 for v in batch["vec"]]]
            if len(good):
                yield good.assign(cell=(np.stack(good["vec"].to_list()).astype(float) @ centroids.T).argmax(axis=1).astype("int32"))

    kind = rows.schema["vec"].dataType.simpleString()
    spark = vectors.sparkSession
    path = shared_folder(spark, "cells")
    rows.mapInPandas(deal, f"id {rows.schema['id'].dataType.simpleString()}, vec {kind}, cell int").repartition("cell").write.partitionBy("cell").parquet(path)
    return CellIndex(centroids, spark.read.parquet(path), probes)
