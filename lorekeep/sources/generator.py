"""A corpus made from one seed, of any size, without a driver-side loop (S-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The cycle of event categories (fixed values).
CYCLE = ("session_start", "prompt", "model_request", "model_response", "tool_call", "tool_result", "file_read", "file_write", "shell_command", "response", "cost_record", "session_end")


def made(i: Column, seed: Column, sessions: int, clients: int) -> list[Column]:
    """The columns of the ``i``-th event of a seed."""
    session = (i * 31 + seed) % sessions
    category = F.get(F.array(*[F.lit(c) for c in CYCLE]), (F.floor(i / sessions) % len(CYCLE)).cast("int"))
    return [i.alias("event_id"), session.alias("session_id"), (session % clients).alias("client_id"), category.alias("category"), F.sha2(F.concat_ws(":", seed, i), 256).alias("payload")]


def events(spark: SparkSession, n: int, sessions: int = 28, clients: int = 4, seed: int = 7) -> DataFrame:
    """``n`` events over ``sessions`` of ``clients``; the same seed and sizes give the same rows."""
    return spark.range(n).select(*made(F.col("id"), F.lit(seed), sessions, clients))


def corpora(seeds: DataFrame, n: int, sessions: int = 28, clients: int = 4) -> DataFrame:
    """``n`` events for each row of ``seeds`` (seed), made where the row lies."""
    rows = seeds.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("id"))
    return rows.select("seed", *made(F.col("id"), F.col("seed"), sessions, clients))


def planted(artifacts: DataFrame, owners: DataFrame, chosen: Column, offset: int) -> tuple[DataFrame, DataFrame]:
    """C-14: (fragments, ground truth): copies of ``chosen`` artifacts that another tenant is made to hold.

    A copy has a new id, the next client's ownership, and a body without its real owner's tokens and paths; the ground
    truth (artifact_id, owner_client_id) says whose it is. ``owners``: client_id, tokens; the last client's go to the first.
    """
    last = owners.agg(F.max("client_id")).first()[0]
    own = artifacts.where(chosen).join(owners, F.col("owner_client_id") == F.col("client_id")).drop("client_id")
    words = F.regexp_replace(F.coalesce("body", F.lit("")), r"\S*/\S+", "")
    for at in range(owners.agg(F.max(F.size("tokens"))).first()[0] or 0):
        token = F.regexp_replace(F.coalesce(F.get("tokens", F.lit(at)), F.lit("")), r"([^\p{L}\p{N}\s])", r"\\$1")
        words = F.when(token != "", F.regexp_replace(words, F.concat(F.lit("(?iu)"), token), F.lit(""))).otherwise(words)
    body = F.trim(F.regexp_replace(words, r"[ \t]+", " "))
    holder = F.when(F.col("owner_client_id") == last, F.lit(0)).otherwise(F.col("owner_client_id") + 1)
    copies = own.select((F.col("artifact_id") + offset).alias("artifact_id"), holder.cast("long").alias("holder_client_id"), body.alias("body"), "owner_client_id")
    return copies.select("artifact_id", F.col("holder_client_id").alias("owner_client_id"), "body"), copies.select("artifact_id", "owner_client_id")
