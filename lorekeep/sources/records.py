"""Small sources of records: ground truth and workspace maps."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """S-13: (artifact_id, owner) from a JSON file: a flat map of fragment to owner, or a list under planted_fragments."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    listed = F.from_json("text", "planted_fragments array<struct<artifact_id:string,owner_client_id:string>>")["planted_fragments"]
    flat = F.transform(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: F.struct(e["key"].alias("artifact_id"), e["value"].alias("owner_client_id")))
    rows = text.select(F.inline(F.coalesce(listed, flat)))
    return rows.select("artifact_id", F.col("owner_client_id").alias("owner"))


def workspace_map(spark: SparkSession, text: str) -> DataFrame:
    """S-12: (root, root_client) from a TOML table ``workspaces`` of root to client; anything else is refused."""
    found = tomllib.loads(text)
    if set(found) != {"workspaces"} or not all(isinstance(c, int) for c in found["workspaces"].values()):
        raise ValueError("only a table of workspaces is known")
    return spark.createDataFrame([(root.rstrip("/"), c) for root, c in found["workspaces"].items()], "root string, root_client long")
