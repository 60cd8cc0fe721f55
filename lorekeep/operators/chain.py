"""Hash-chained event log: digests, append, verification, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.digests import GENESIS, SEPARATOR, joined, link, stamp


def content_digest() -> Column:
    """F-02: the digest of a ledger row's own fields; its text body is not covered."""
    c = F.col
    return F.sha2(joined(c("event_id"), c("session_id"), c("client_id"), c("seq"), c("category"), stamp(c("occurred_at")), c("payload")), 256)


def append(ledger: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """D-01, W-06: rows with seq, content_digest, prev_chain_digest and chain_digest, after the tips (session_id, seq, chain_digest).

    A chain is sequential by what it is: one digest after the other inside a session. Sessions are dealt to tasks and
    sorted there, and each task walks its rows with one digest in memory, however long a session is.
    """
    base = ledger.drop("seq") if tips is None else ledger.drop("seq").join(tips.select("session_id", F.col("seq").alias("_seq"), F.col("chain_digest").alias("_tip")), "session_id", "left")
    if tips is None:
        base = base.withColumns({"_seq": F.lit(0).cast("long"), "_tip": F.lit(GENESIS)})
    order = Window.partitionBy("session_id").orderBy("occurred_at", "event_id")
    rows = base.withColumn("seq", F.coalesce("_seq", F.lit(0)) + F.row_number().over(order))
    rows = rows.withColumns({"content_digest": content_digest(), "_tip": F.coalesce("_tip", F.lit(GENESIS))})
    rows = rows.select("event_id", "session_id", "client_id", "seq", "category", "occurred_at", "payload", "content_digest", "_tip")
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, digest = object(), ""
        for batch in batches:
            before, after = [], []
            for own, content, tip in zip(batch["session_id"], batch["content_digest"], batch["_tip"]):
                if own != session:
                    session, digest = own, tip
                before.append(digest)
                digest = sha256(f"{digest}{SEPARATOR}{content}".encode()).hexdigest()
                after.append(digest)
            yield batch.drop(columns="_tip").assign(prev_chain_digest=before, chain_digest=after)

    kinds = "event_id long, session_id long, client_id long, seq long, category string, occurred_at timestamp_ntz, payload string, content_digest string, prev_chain_digest string, chain_digest string"
    return dealt.mapInPandas(fold, kinds)


def verify(chained: DataFrame) -> DataFrame:
    """UD-01, C-15: (session_id, rows, verified, fault, fault_seq, last_good), the first row that fails in each session.

    Faults in order: seq, content, previous, chain. Each row is tested against the stored row before it, which is
    exact up to the first fault, and only that is reported. All of it is expressions.
    """
    order = Window.partitionBy("session_id").orderBy("seq", "event_id")
    rows = chained.withColumns({"_n": F.row_number().over(order), "_prev": F.coalesce(F.lag("chain_digest").over(order), F.lit(GENESIS)), "_content": content_digest()})
    fault = (
        F.when(F.col("seq") != F.col("_n"), "seq")
        .when(~F.col("content_digest").eqNullSafe(F.col("_content")), "content")
        .when(~F.col("prev_chain_digest").eqNullSafe(F.col("_prev")), "previous")
        .when(~F.col("chain_digest").eqNullSafe(link(F.col("_prev"), F.col("_content"))), "chain")
    )
    rows = rows.withColumn("_fault", fault)
    bad = F.col("_fault").isNotNull()
    found = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(F.when(bad, F.struct("_fault", "seq", "_n", "_prev")), F.when(bad, F.col("_n"))).alias("f"),
        F.max_by("chain_digest", "_n").alias("tip"),
    )
    return found.select(
        "session_id", "rows",
        F.coalesce(F.col("f._n") - 1, F.col("rows")).cast("long").alias("verified"),
        F.col("f._fault").alias("fault"),
        F.col("f.seq").alias("fault_seq"),
        F.when(F.col("f").isNull(), F.col("tip")).otherwise(F.col("f._prev")).alias("last_good"),
    )


def window_tips(chained: DataFrame, start: Column, end: Column) -> DataFrame:
    """O-12, P-09, C-10: the last event of each session inside the half-open window."""
    inside = chained.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    return inside.groupBy("session_id").agg(F.max("seq").alias("terminal_seq"), F.max_by("chain_digest", "seq").alias("terminal_digest"))


def hourly_tips(chained: DataFrame, hours: int = 1) -> DataFrame:
    """ST-10 over a finished log: tips of every tumbling window."""
    span = F.window("occurred_at", f"{hours} hours")
    return chained.groupBy(span.alias("w"), "session_id").agg(F.max("seq").alias("terminal_seq"), F.max_by("chain_digest", "seq").alias("terminal_digest")).select(F.col("w.start").alias("window_start"), "session_id", "terminal_seq", "terminal_digest")


def root_digest(tips: DataFrame, *keys: str) -> DataFrame:
    """A-17: one digest of the (session, digest) pairs in order of session, for each of ``keys``.

    Pairs are first folded to one digest for each of 4096 cells, by the first digits of the session's own digest; so no
    group grows with the log.
    """
    leaf = tips.withColumn("_cell", F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 3))
    text = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["k"].cast("string"), p["d"])), ",")
    pairs = lambda k, d: F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(d).alias("d"))))
    cells = leaf.groupBy(*keys, "_cell").agg(pairs("session_id", "terminal_digest").alias("p"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("d", F.sha2(text(F.col("p")), 256))
    return cells.groupBy(*keys).agg(F.sum("n").alias("sessions"), pairs("_cell", "d").alias("p")).select(*keys, "sessions", F.sha2(text(F.col("p")), 256).alias("root_digest"))


#: Names in the document that a root is taken over (fixed values).
ROOT_KEY, ROOT_DIGEST, ROOT_SESSION = "sessions", "terminal_chain_digest", "session_id"


def stated_root(tips: DataFrame, *keys: str) -> DataFrame:
    """A-17, F-21: the SHA-256 of one canonical document of all (session, digest) pairs, for each of ``keys``.

    The document is ``{"sessions":[{"session_id":...,"terminal_chain_digest":...},...]}`` without spaces, its rows in
    order of the id's text, so any verifier gets the same value from the stored rows. The rows' texts are made where they
    lie and sorted by Spark; a digest reads its document from end to end, so each root is one task, which holds one
    batch of rows. A null digest is null in the document; sessions without an id are no part of it.
    """
    def value(c: str) -> Column:
        quoted = F.to_json(F.array(F.col(c).cast("string")))  # ["..."], or [null]
        return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)

    row = F.concat(F.lit(f'{{"{ROOT_SESSION}":'), value("session_id"), F.lit(f',"{ROOT_DIGEST}":'), value("terminal_digest"), F.lit("}"))
    rows = tips.where("session_id is not null").select(*keys, F.col("session_id").cast("string").alias("_id"), row.alias("_row"))
    dealt = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "_id", "_row")
    kinds = ", ".join(f"{k} {tips.schema[k].dataType.simpleString()}" for k in keys)
    types = [to_arrow_type(tips.schema[k].dataType) for k in keys]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (r for b in batches for r in zip(zip(*[b.column(k).to_pylist() for k in keys]) if keys else [()] * len(b), b.column("_row").to_pylist()))
        for own, group in groupby(lines, key=lambda r: r[0]):
            sha, n = sha256(f'{{"{ROOT_KEY}":['.encode()), 0
            for _, line in group:
                sha.update((b"," if n else b"") + line.encode())
                n += 1
            sha.update(b"]}")
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(own, types)], pa.array([n]), pa.array([sha.hexdigest()])], [*keys, "sessions", "root_digest"])

    return dealt.mapInArrow(digest, (kinds + ", " if kinds else "") + "sessions long, root_digest string")


def compare(recorded: DataFrame, live: DataFrame, accounted: DataFrame) -> DataFrame:
    """J-27: recorded sessions whose live digest is another or missing, and whether a run accounts for it (session_id)."""
    joined = recorded.join(live.select("session_id", F.col("terminal_digest").alias("_live")), "session_id", "left")
    changed = joined.where(~F.col("terminal_digest").eqNullSafe(F.col("_live")))
    known = accounted.select("session_id", F.lit(True).alias("_known")).distinct()
    return changed.join(known, "session_id", "left").select("session_id", F.col("_live").isNull().alias("missing"), F.col("_known").isNotNull().alias("accounted"))
