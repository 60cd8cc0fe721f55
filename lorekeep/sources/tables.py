"""Logical tables of the memory system, derived from the parquet tables by plain arithmetic.

Times are TIMESTAMP_NTZ, so that no session time zone moves them. ``plans.oracle`` has the same tables for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vocabularies (fixed values).
CATEGORY_OF_EVENT = {"click": "tool_call", "error": "error", "purchase": "cost_record", "signup": "session_start", "view": "file_read"}
OUTCOMES = ("in_progress", "succeeded", "failed", "abandoned")
DERIVED_KINDS = ("summary", "behavioral_baseline", "learned_procedure")
MARKER_WORDS = ("the", "and", "la", "un", "die", "ich", "of")
N_CLIENTS = 25


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", moment("1970-01-01 00:00:00"), c)


def later(c: Column | str, unit: str, n: Column | int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add(unit, F.lit(n) if isinstance(n, int) else n.cast("int"), c)


def one_of(names: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), index)


def div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("long")


class Tables:
    """The logical tables over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def client(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        words = F.array(one_of(MARKER_WORDS, F.col("n_nationkey") % len(MARKER_WORDS)), F.col("n_name"))
        return self.raw("nation").select(
            key.alias("client_id"),
            F.col("n_name").alias("slug"),
            F.col("n_regionkey").cast("long").alias("jurisdiction"),
            (30 + 10 * F.col("n_regionkey")).cast("long").alias("retention_days"),
            F.when(key % 5 == 4, F.array().cast("array<string>")).otherwise(words).alias("markers"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        category = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_EVENT.items() for x in pair])[F.col("event_type")]
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("session_id"),
            (F.col("user_id") % N_CLIENTS).alias("client_id"),
            F.row_number().over(order).cast("long").alias("seq"),
            category.alias("category"),
            F.col("ts").cast("timestamp_ntz").alias("occurred_at"),
            F.col("props").alias("payload"),
            F.when(F.col("event_type").isin("view", "click"), F.col("props")).alias("text_body"),
            F.col("value").alias("cost"),
            later(F.col("ts").cast("timestamp_ntz"), "DAY", 30 + 10 * (F.col("user_id") % 5)).alias("expires_at"),
        )

    @cached_property
    def session(self) -> DataFrame:
        kind = lambda name: F.count_if(F.col("event_type") == name)
        found = self.raw("events").groupBy(F.col("user_id").alias("session_id")).agg(
            F.min(F.col("ts").cast("timestamp_ntz")).alias("started_at"),
            F.max(F.col("ts").cast("timestamp_ntz")).alias("ended_at"),
            kind("click").alias("tool_call_count"),
            kind("view").alias("model_request_count"),
            kind("error").alias("error_count"),
            F.sum(F.get_json_object("props", "$.k").cast("long")).alias("token_count"),
            F.sum(F.col("value").cast("decimal(14,6)")).alias("cost_usd"),
        )
        sid = F.col("session_id")
        return found.withColumns(
            {
                "client_id": sid % N_CLIENTS,
                "outcome": one_of(OUTCOMES, (sid % 4).cast("int")),
                "parent_session_id": F.when(sid > 0, div(sid, 2)),
                "machine_id": F.concat(F.lit("m"), sid % 7),
                "workspace_path": F.concat(F.lit("/work/c"), sid % N_CLIENTS, F.lit("/p"), sid % 3, F.lit("/src")),
            }
        )

    @cached_property
    def derived_artifact(self) -> DataFrame:
        d = F.col("doc_id")
        created = later(moment("2024-01-01 00:00:00"), "MINUTE", d)
        return self.raw("documents").select(
            d.alias("artifact_id"),
            one_of(DERIVED_KINDS, (d % 3).cast("int")).alias("kind"),
            (d % N_CLIENTS).alias("owner_client_id"),
            F.col("text").alias("body"),
            F.sha2("text", 256).alias("content_digest"),
            created.alias("created_at"),
            F.when(d % 3 == 2, (d % 101).cast("double") / 100).alias("confidence"),
            F.lit(1).cast("long").alias("revision"),
            later(created, "DAY", 30 + 10 * (d % 5)).alias("expires_at"),
        )

    @cached_property
    def embedding(self) -> DataFrame:
        v = F.col("vec_id")
        created = later(moment("2024-01-01 00:00:00"), "MINUTE", v)
        return self.raw("embeddings").select(
            v.alias("embedding_id"),
            v.alias("artifact_id"),
            (v % N_CLIENTS).alias("client_id"),
            F.col("embedding").alias("vec"),
            F.col("label").cast("long").alias("label"),
            created.alias("created_at"),
            later(created, "DAY", 30 + 10 * (v % 5)).alias("expires_at"),
        )

    @cached_property
    def client_binding(self) -> DataFrame:
        """Validity-interval history: a scope claim, a marker claim, and for every tenth artifact its successor."""
        a = self.derived_artifact.select("artifact_id", "created_at")
        d, created = F.col("artifact_id"), F.col("created_at")
        first, second = d % N_CLIENTS, (d * 7 + 1) % N_CLIENTS
        none = F.lit(None).cast("timestamp_ntz")
        turned = d % 10 == 0

        def version(j, client, method, confidence, start, end, successor):
            return F.struct(
                (d * 4 + j).alias("binding_id"),
                client.alias("client_id"),
                F.lit(method).alias("method"),
                F.lit(confidence).cast("double").alias("confidence"),
                start.alias("valid_from"),
                end.alias("valid_to"),
                successor.cast("long").alias("superseded_by"),
            )

        versions = F.array(
            version(0, first, "scope", 1.0, created, none, F.lit(None)),
            version(1, second, "marker", 0.9, later(created, "DAY", 1), F.when(turned, later(created, "DAY", 11)), F.when(turned, d * 4 + 2)),
            version(2, second, "residue", 0.95, later(created, "DAY", 11), none, F.lit(None)),
        )
        keep = F.filter(versions, lambda v: ((v.method == "scope") | (first != second)) & ((v.method != "residue") | turned))
        return a.select("artifact_id", F.inline(keep))

    @cached_property
    def lineage_edge(self) -> DataFrame:
        a = self.derived_artifact.select("artifact_id", "created_at")
        d = F.col("artifact_id")
        half, third = div(d, 2), div(d, 3)

        def edge(j, parent, kind, present):
            return F.when(present, F.struct((d * 4 + j).alias("edge_id"), parent.alias("parent_id"), F.lit(kind).alias("parent_kind")))

        edges = F.array(
            edge(0, half, "derived_artifact", d > 0),
            edge(1, third, "derived_artifact", (d > 2) & (half != third)),
            edge(2, d, "event", d % 2 == 0),
            edge(3, d % 150, "session", d % 5 == 0),
        )
        return a.select(d.alias("child_id"), "created_at", F.inline(F.filter(edges, lambda e: e.isNotNull())))

    @cached_property
    def erasure_run(self) -> DataFrame:
        c = F.col("client_id")
        started = later(moment("2024-02-01 00:00:00"), "DAY", c)
        return self.client.select(
            c.alias("run_id"),
            (c + 1000).alias("request_id"),
            "client_id",
            F.concat(F.lit("key-"), c).alias("idempotency_key"),
            one_of(("completed", "running", "aborted"), (c % 3).cast("int")).alias("status"),
            started.alias("started_at"),
            F.when(c % 3 != 1, later(started, "HOUR", 2)).alias("finished_at"),
        )

    @cached_property
    def erasure_lease(self) -> DataFrame:
        """Ownership log: generation 1 of every client, superseded by generation 2 where the id is even."""
        c = F.col("client_id")
        taken = later(moment("2024-02-01 00:00:00"), "DAY", c)
        even = c % 2 == 0
        one = F.struct((c * 2).alias("lease_id"), F.lit(1).cast("long").alias("generation"), taken.alias("acquired_at"), later(taken, "SECOND", 30).alias("expires_at"), F.when(even, later(taken, "MINUTE", 5)).alias("superseded_at"))
        two = F.struct((c * 2 + 1).alias("lease_id"), F.lit(2).cast("long").alias("generation"), later(taken, "MINUTE", 5).alias("acquired_at"), later(taken, "DAY", 400).alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
        return self.client.select("client_id", F.inline(F.when(even, F.array(one, two)).otherwise(F.array(one))))

    @cached_property
    def disposition(self) -> DataFrame:
        """Evidence of one run for each client over the artifacts it owned."""
        d = F.col("artifact_id")
        first, second = F.concat(F.lit("NATION_"), d % N_CLIENTS), F.concat(F.lit("NATION_"), (d * 7 + 1) % N_CLIENTS)
        return self.derived_artifact.select(
            F.col("owner_client_id").alias("run_id"),
            "artifact_id",
            F.lit("derived_artifact").alias("artifact_kind"),
            one_of(("hard_delete", "surgical_redaction", "retained"), (div(d, 25) % 3).cast("int")).alias("disposition"),
            F.array_sort(F.array_distinct(F.array(first, second))).alias("bindings_before"),
            F.array_except(F.array(second), F.array(first)).alias("bindings_after"),
            F.col("content_digest").alias("pre_digest"),
        )

    @cached_property
    def working_memory(self) -> DataFrame:
        """Every write of the working tier, oldest first in ``updated_at``; see ``operators.working.latest``."""
        return self.raw("conversations").select(
            F.col("conv_id").alias("session_id"),
            F.col("role").alias("scratch_key"),
            (F.col("conv_id") % N_CLIENTS).alias("client_id"),
            F.col("text").alias("value"),
            later(moment("2024-01-01 00:00:00"), "MINUTE", F.col("conv_id") * 10 + F.col("turn")).alias("updated_at"),
        )

    @cached_property
    def procedure_retrieval(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("retrieval_id"),
            (3 * (F.col("o_custkey") % 60) + 2).alias("procedure_id"),
            (k % 150).alias("session_id"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("retrieved_at"),
        )

    @cached_property
    def procedure_outcome(self) -> DataFrame:
        """Reported outcomes in order of ``outcome_id``; repeats and unretrieved ones are for the operator to refuse."""
        k = F.col("o_orderkey")
        name = F.create_map(*[F.lit(x) for x in ("F", "succeeded", "O", "failed", "P", "abandoned")])
        return self.raw("orders").where(k % 3 != 0).select(
            k.alias("outcome_id"),
            (3 * (F.col("o_custkey") % 60) + 2).alias("procedure_id"),
            (div(k, 2) % 150).alias("session_id"),
            name[F.col("o_orderstatus")].alias("outcome"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("recorded_at"),
        )
