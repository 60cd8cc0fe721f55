"""V-03, index form: inverted lists over centroids, with residual codes, that take more rows without being rebuilt."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import near_block, unit_rows
from ..session import saved, shared_folder

#: Most lists, rows that lists and codes are fitted on, values of a code's byte, and rows of the sample that are asked to choose how many lists to open.
MAX_LISTS, SAMPLE, CODES, ASKED = 4096, 20_000, 256, 200


def means(rows: np.ndarray, n: int, rounds: int, unit: bool) -> np.ndarray:
    """k-means from evenly spaced rows; centres without rows stay."""
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        own = (rows @ centres.T - (0 if unit else (centres**2).sum(axis=1) / 2)).argmax(axis=1)
        sums, size = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        there = size > 0
        centres[there] = sums[there] / size[there, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    return centres


class VectorIndex:
    """Lists of rows near a centroid. ``lists`` grow with the root of the rows, so a search reads about the root of the table.

    A row is written once, with its list and a code of one byte for each part of what its list's centroid leaves
    over. Files are dealt by ranges of (list, id), so a crowded list spreads over tasks and files, and sorted by list,
    so a search skips all row groups of other lists. A search ranks the opened lists by their codes, and the best by their
    vectors: distances are exact, only which rows are looked at is not.
    """

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, books: np.ndarray, probes: int):
        self.spark, self.path, self.centroids, self.books, self.probes = spark, path, centroids, books, probes

    @classmethod
    def build(cls, vectors: DataFrame, recall: float = 0.95, k: int = 10, path: str | None = None) -> VectorIndex:
        """Fit on at most ``SAMPLE`` rows of least id hashes, then insert every row of ``vectors`` (id, vec).

        Lists to open: the fewest that hold ``recall`` of the ``k`` nearest of ASKED rows of the sample, in the sample.
        """
        spark = vectors.sparkSession
        n = vectors.count()
        some = vectors.where("vec is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column("vec")
        rows = unit_rows(some)[1] if len(some) else np.zeros((0, 1))
        if not len(rows):
            rows = np.eye(1)
        lists = int(np.clip(round(n**0.5), 1, min(MAX_LISTS, max(1, len(rows) // 4))))
        centroids = means(rows, lists, 8, unit=True)
        own = (rows @ centroids.T).argmax(axis=1)
        parts = max(p for p in (16, 8, 4, 2, 1) if rows.shape[1] % p == 0)
        rest = (rows - centroids[own]).reshape(len(rows), parts, -1)
        books = np.stack([means(rest[:, p], CODES, 6, unit=False) for p in range(parts)])
        asked = rows[np.linspace(0, len(rows) - 1, min(ASKED, len(rows))).astype(int)]
        nearest = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, 1 : k + 1]  # the row itself is no test
        place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
        needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel()) if nearest.size else np.zeros(1, int)
        probes = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1
        index = cls(spark, path or shared_folder(spark, "vector-index"), centroids, books, probes)
        model = [(json.dumps({"centroids": centroids.tolist(), "books": books.tolist(), "probes": probes}),)]
        spark.createDataFrame(model, "model string").coalesce(1).write.parquet(f"{index.path}/model")
        index.insert(vectors)
        return index

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        m = json.loads(spark.read.parquet(f"{path}/model").first().model)
        return cls(spark, path, np.array(m["centroids"]), np.array(m["books"]), m["probes"])

    def insert(self, vectors: DataFrame) -> None:
        """Add rows (id, vec) to their lists. Rows of another width, and null and zero vectors, are left out."""
        rows = vectors.select("id", "vec")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        centroids, books = self.centroids, self.books

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = unit_rows(batch.column("vec"), centroids.shape[1])
                own = (unit @ centroids.T).argmax(axis=1)
                rest = (unit - centroids[own]).reshape(len(unit), len(books), centroids.shape[1] // len(books))
                near = [(rest[:, p] @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for p, b in enumerate(books)]
                codes = np.stack(near, axis=1).astype(np.uint8) if len(at) else np.zeros((0, len(books)), np.uint8)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "vec", "list", "code"])

        dealt = rows.mapInArrow(deal, f"id {kinds['id']}, vec {kinds['vec']}, list int, code binary")
        ranged = dealt.repartitionByRange("list", "id").sortWithinPartitions("list", "id")
        ranged.write.mode("append").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/rows")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, query: list[float], k: int, ceiling: float | None = None, probes: int | None = None, shortlist: int = 16) -> DataFrame:
        """(id, distance), the ``k`` nearest among the ``shortlist * k`` best codes of the opened lists, ties by id.

        A query of another width than the index's meets nothing.
        """
        if len(query) != self.centroids.shape[1]:
            return self.rows.select("id", F.lit(0.0).alias("distance")).where("false")
        q = np.asarray(query, float) / np.linalg.norm(query)
        opened = np.argsort(-(self.centroids @ q), kind="stable")[: probes or self.probes]
        near = dict(zip(opened.tolist(), (self.centroids[opened] @ q).tolist()))
        lines = np.einsum("pcd,pd->pc", self.books, q.reshape(len(self.books), -1))
        most, inside = shortlist * k, self.rows.where(F.col("list").isin(list(near)))

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(lines))
                score = sum(lines[p][codes[:, p]] for p in range(len(lines))) + np.array([near[c] for c in batch.column("list").to_pylist()])
                at = np.argsort(-score, kind="stable")[:most]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(score[at])], ["id", "score"])

        kind = inside.schema["id"].dataType.simpleString()
        best = inside.select("id", "list", "code").mapInArrow(ranked, f"id {kind}, score double").orderBy(F.desc("score"), "id").limit(most)
        short = saved(best.select("id").distinct())
        exact = inside.select("id", "vec").join(F.broadcast(short) if most <= 320_000 else short, "id", "left_semi")
        return near_block(exact, [Row(id=0, vec=[float(x) for x in query])], k, ceiling).select("id", "distance").orderBy("distance", "id").limit(k)
