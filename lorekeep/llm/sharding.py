"""Sharding: a consistent-hash ring with virtual nodes whose shards hold a bounded number of rows."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, saved

#: The ring is cut into this many equal cells; virtual nodes sit at cell starts.
CELL_BITS = 14
#: A cell's rows are ranked in this many parts, so equal texts do not meet in one task.
SALTS = 16
VIRTUAL_NODES = 64


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> dict[int, int]:
    """Cell of each virtual node, and its shard. Where two share a cell the smaller digest has it."""
    best: dict[int, tuple[str, int]] = {}
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            digest = hashlib.sha256(f"{shard}/{v}".encode()).hexdigest()
            cell = int(digest[:8], 16) >> (32 - CELL_BITS)
            best[cell] = min(best.get(cell, (digest, shard)), (digest, shard))
    return {cell: shard for cell, (_, shard) in best.items()}


def allot(counts: dict[int, int], n_shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> dict[int, list[tuple]]:
    """Where each cell's rows go: lists of (first rank, rows, shard, first slot).

    Every shard takes its own keys up to its capacity; keys that find it full continue clockwise to the next
    virtual node of a shard with room. Capacities are equal but for one row, times 1 + ``slack``. The input is
    one count for each cell of the ring, so this costs the same for any number of documents.
    """
    nodes = ring(n_shards, virtual_nodes)
    places = sorted(nodes)
    of_shard: dict[int, list[int]] = {}
    for cell in places:
        of_shard.setdefault(nodes[cell], []).append(cell)
    total = sum(counts.values())
    most = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    room = [int(m * (1 + slack)) for m in most]
    used = [0] * n_shards
    out: dict[int, list[tuple]] = {}

    def put(cell: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.setdefault(cell, []).append((rank, n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return n

    waiting = []
    for cell in sorted(counts):
        home = places[bisect_left(places, cell) % len(places)]
        n = put(cell, 0, counts[cell], nodes[home])
        if n < counts[cell]:
            waiting.append((cell, n, counts[cell] - n, home))
    for cell, rank, left, at in waiting:
        while left:
            ahead = []
            for shard, own in of_shard.items():
                if room[shard]:
                    nxt = own[bisect_left(own, at) % len(own)]
                    ahead.append(((nxt - at) % (1 << CELL_BITS), shard))
            if ahead:
                _, shard = min(ahead)
            else:  # a shard without a virtual node of its own
                shard = max(range(n_shards), key=lambda s: room[s])
            n = put(cell, rank, left, shard)
            rank, left = rank + n, left - n
    return out


def shard_rows(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """Add each row's shard and its place in it, gapless from 0. Row counts of shards differ by one at most.

    The ring key is the text, so equal texts lie side by side on the ring and share a shard unless it is full.
    Only the counts of ring cells (at most 2**14 rows) reach the driver. A null text is an empty one; rows that
    are equal in every used column may change places; an empty table gives an empty result. Other columns pass; those with a result's name are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    docs = docs.drop(shard_col, slot_col)
    key, cell, salt, rank, parts, off = fresh(docs, "_key", "_cell", "_salt", "_rank", "_parts", "_off")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    dealt = docs.withColumn(key, F.xxhash64(text)).withColumns(
        {
            cell: F.shiftrightunsigned(F.col(key), 64 - CELL_BITS).cast("int"),
            salt: F.pmod(F.xxhash64(quoted(id_col)), F.lit(SALTS)).cast("int"),
        }
    )
    sizes = dealt.groupBy(cell, salt).agg(F.count(F.lit(1)).alias("_n"))  # at most 2**14 x SALTS rows
    cells = saved(sizes.groupBy(cell).agg(F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct(salt, "_n"))).alias(off)))
    found = {r[0]: r[1] for r in cells.select(cell, "_n").collect()}
    plan = [(c, [tuple(x) for x in xs]) for c, xs in allot(found, n_shards, virtual_nodes, slack).items()]
    kinds = "c int, p array<struct<first:long,n:long,shard:int,slot:long>>"
    plans = spark.createDataFrame(plan, kinds).select(F.col("c").alias(cell), F.col("p").alias(parts))
    offsets = cells.select(cell, off).join(F.broadcast(plans), cell)  # at most 2**14 rows, one for each cell

    order = Window.partitionBy(cell, salt).orderBy(F.col(key), quoted(id_col), F.crc32(text))
    ranked = dealt.withColumn(rank, F.row_number().over(order)).join(F.broadcast(offsets), cell)
    before = F.aggregate(F.filter(F.col(off), lambda x: x[salt] < F.col(salt)), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    ranked = ranked.withColumn(rank, before + F.col(rank) - 1)
    part = F.get(F.filter(F.col(parts), lambda p: (F.col(rank) >= p.first) & (F.col(rank) < p.first + p.n)), F.lit(0))
    return ranked.withColumn(parts, part).select(
        *[quoted(c) for c in docs.columns],
        F.col(parts).shard.alias(shard_col),
        (F.col(parts).slot + F.col(rank) - F.col(parts).first).alias(slot_col),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat_ws("/", F.xxhash64(text), F.xxhash64(F.lit(1), text)).alias("text"),  # ring key without the text itself
    )
    return shard_rows(small, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
