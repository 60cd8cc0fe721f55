"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, use_checkpoints  # noqa: F401

#: The white space that separates words in every contract of this subpackage.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"\x20\x09-\x0D"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the short way."""
    narrow = F.octet_length(c) == F.char_length(c)
    return F.when(narrow, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def ascii_strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however the optimizer moves expressions that index it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
