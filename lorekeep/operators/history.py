"""Attribution history: validity intervals, as-of reads, detection and supersession."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.markers import Markers
from ..session import saved

#: Confidence of a claim by its method, and which method wins among equals (fixed values).
SCOPE_CONFIDENCE, MARKER_CONFIDENCE = 1.0, 0.9
PRECEDENCE = ("scope", "marker", "inherited", "residue")
#: Characters of markers in one automaton, which takes some 100 bytes for each.
BLOCK_CHARS = 2_000_000


def current(bindings: DataFrame) -> DataFrame:
    """P-01: versions that nothing supersedes."""
    return bindings.where(F.col("superseded_by").isNull())


def valid_at(t: Column) -> Column:
    """P-02: half-open validity, whatever superseded the version later."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def as_of(bindings: DataFrame, moments: DataFrame, key: str = "artifact_id", at: str = "at") -> DataFrame:
    """J-09: the versions of each ``moments`` row's artifact that held at its instant. Equi-join first, then the interval."""
    return moments.join(bindings, key).where(valid_at(F.col(at)))


def permitted_artifacts(bindings: DataFrame, clients: list[int]) -> DataFrame:
    """Distinct artifacts that a current binding gives to one of ``clients``."""
    return current(bindings).where(F.col("client_id").isin(clients)).select("artifact_id").distinct()


def admit(rows: DataFrame, bindings: DataFrame, clients: list[int]) -> DataFrame:
    """J-05: rows whose artifact is bound to a permitted client; a semi-join, so two bindings give one row."""
    return rows.join(permitted_artifacts(bindings, clients), "artifact_id", "left_semi")


def first_attribution(bindings: DataFrame) -> DataFrame:
    """A-08: the earliest instant of each artifact and client, with its method."""
    return bindings.groupBy("artifact_id", "client_id").agg(
        F.min("valid_from").alias("first_at"), F.min_by("method", F.struct("valid_from", "binding_id")).alias("first_method")
    )


def markers_found(artifacts: DataFrame, clients: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(artifact_id, client_id): which clients' marker words stand in which bodies at token boundaries.

    One automaton holds all markers and goes to every task, so a body is read once whatever the roster's size, and no
    pair of body and marker is tried in vain. A roster of more than ``block_chars`` characters makes several automata,
    each of which reads the bodies again.
    """
    roster = clients.select("client_id", F.explode("markers").alias("marker")).select("client_id", F.trim("marker").alias("marker")).where("marker <> ''").distinct()
    spark, kinds = artifacts.sparkSession, {f.name: f.dataType.simpleString() for f in (artifacts.schema["artifact_id"], clients.schema["client_id"])}

    def block(pairs: list[tuple[str, int]]) -> DataFrame:
        held = spark.sparkContext.broadcast(Markers(pairs))  # bounded by block_chars
        client = to_arrow_type(clients.schema["client_id"].dataType)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted(held.value.clients(body)) for body in batch.column("body").to_pylist()]
                at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("artifact_id").take(at), pa.array([c for own in found for c in own], client)], ["artifact_id", "client_id"])

        return artifacts.select("artifact_id", "body").mapInArrow(search, f"artifact_id {kinds['artifact_id']}, client_id {kinds['client_id']}")

    blocks, own, size = [], [], 0
    for r in roster.sort("marker", "client_id").toLocalIterator():
        own.append((r.marker, r.client_id))
        size += len(r.marker)
        if size >= block_chars:
            blocks.append(block(own))
            own, size = [], 0
    if own or not blocks:
        blocks.append(block(own))
    return blocks[0] if len(blocks) == 1 else reduce(DataFrame.unionAll, blocks).distinct()


def detect(artifacts: DataFrame, clients: DataFrame, edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """D-04: the strongest claim of each client on each artifact (artifact_id, body, owner_client_id).

    Scope claims come from the owner, marker claims from a client's words in the body at a token boundary, inherited
    ones from current bindings of direct parents. Equal confidence resolves by PRECEDENCE. Null bodies have no markers.
    """
    scope = artifacts.select("artifact_id", F.col("owner_client_id").alias("client_id"), F.lit("scope").alias("method"), F.lit(SCOPE_CONFIDENCE).alias("confidence"))
    marked = markers_found(artifacts, clients)
    marked = marked.select("artifact_id", "client_id", F.lit("marker").alias("method"), F.lit(MARKER_CONFIDENCE).alias("confidence"))
    inherited = inherited_claims(edges, bindings).select("artifact_id", "client_id", F.lit("inherited").alias("method"), "confidence")
    rank = F.array_position(F.array(*[F.lit(m) for m in PRECEDENCE]), F.col("method"))
    claims = scope.unionByName(marked).unionByName(inherited)
    best = F.max_by(F.struct("method", "confidence"), F.struct("confidence", -rank))
    return claims.groupBy("artifact_id", "client_id").agg(best.alias("b")).select("artifact_id", "client_id", "b.method", "b.confidence")


def inherited_claims(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """A-07: the strongest current claim of each client over an artifact's direct derived parents."""
    parents = edges.where("parent_kind = 'derived_artifact'").select("child_id", F.col("parent_id").alias("artifact_id"))
    joined = parents.join(current(bindings).select("artifact_id", "client_id", "confidence"), "artifact_id")
    return joined.groupBy(F.col("child_id").alias("artifact_id"), "client_id").agg(F.max("confidence").alias("confidence"))


def record(bindings: DataFrame, submitted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """D-02: (new snapshot, actions) for submitted claims (artifact_id, client_id, method, confidence), one a pair.

    A pair without a current version gets one; the same method at no more confidence changes nothing; else the
    current version closes at ``at`` and names a successor with the submitted method and the greater confidence.
    New ids follow the greatest in use, in order of artifact and client.
    """
    now = current(bindings).select("artifact_id", "client_id", F.col("binding_id").alias("old_id"), F.col("method").alias("old_method"), F.col("confidence").alias("old_confidence"))
    joined = submitted.join(now, ["artifact_id", "client_id"], "left")
    same = (F.col("method") == F.col("old_method")) & (F.col("confidence") <= F.col("old_confidence"))
    action = F.when(F.col("old_id").isNull(), "first").when(same, "unchanged").otherwise("supersede")
    actions = joined.withColumn("action", action)
    written = numbered(actions.where("action <> 'unchanged'"), ["artifact_id", "client_id"], "binding_id", bindings)
    fresh = written.select(
        "artifact_id", "binding_id", "client_id", "method", F.greatest("confidence", F.coalesce("old_confidence", F.lit(0.0))).alias("confidence"),
        at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("long").alias("superseded_by"),
    )
    closing = written.where("old_id is not null").select(F.col("old_id").alias("_closed"), F.col("binding_id").alias("_successor"))
    kept = bindings.join(closing, bindings["binding_id"] == closing["_closed"], "left")
    kept = kept.withColumn("valid_to", F.when(F.col("_closed").isNotNull(), at).otherwise(F.col("valid_to")))
    kept = kept.withColumn("superseded_by", F.coalesce("_successor", "superseded_by")).drop("_closed", "_successor")
    return kept.unionByName(fresh), actions


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written once in ranges of ``order``, each row with the number of its range in ``_part``.

    Range bounds are sampled, so a plan that ran twice could draw them twice; what is read back has one set of them.
    """
    return saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def with_base(ranged: DataFrame, size: Column, start: int = 0, backwards: bool = False) -> DataFrame:
    """Add ``_base``: ``start`` and the sizes of all ranges before a row's own, or behind it. One number for each range passes the driver."""
    sums = sorted(((r[0], r[1] or 0) for r in ranged.groupBy("_part").agg(F.sum(size)).collect()), reverse=backwards)
    base, out = start, []
    for part, n in sums:
        out.append((part, base))
        base += n
    spark = ranged.sparkSession
    return ranged.join(F.broadcast(spark.createDataFrame(out, "_part int, _base long")), "_part")


def numbered(rows: DataFrame, order: list[str], name: str, existing: DataFrame) -> DataFrame:
    """Ids after the greatest of ``existing``, in ``order``, without one task that ranks all rows.

    Rows are sorted into ranges, counted by range, and ranked inside their range.
    """
    start = (existing.agg(F.max(name)).first()[0] or 0) + 1
    based = with_base(in_ranges(rows, order), F.lit(1), start)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return based.withColumn(name, (F.col("_base") + place).cast("long")).select(*rows.columns, name)


def withdraw(bindings: DataFrame, pairs: DataFrame, at: Column) -> DataFrame:
    """D-03: current versions of ``pairs`` (artifact_id, client_id) close at ``at`` and name themselves as the end."""
    gone = pairs.select("artifact_id", "client_id", F.lit(True).alias("_gone")).distinct()
    joined = bindings.join(gone, ["artifact_id", "client_id"], "left")
    hit = F.col("_gone").isNotNull() & F.col("superseded_by").isNull()
    joined = joined.withColumns({"valid_to": F.when(hit, at).otherwise(F.col("valid_to")), "superseded_by": F.when(hit, F.col("binding_id")).otherwise(F.col("superseded_by"))})
    return joined.drop("_gone").select(*bindings.columns)
