"""Every query over the driver tables, with its DuckDB twin."""

from __future__ import annotations

from . import applied, evidence, lineage, pipelines, reads, stores, streams  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir: str):
    return QUERIES["c01_recall"](spark, sf_dir)
