"""Seams for models that a user brings: embedding, adjudication and rewriting, each a function over a DataFrame's columns.

Without one there is a plain default, and where a model gives no usable answer the caller fails closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rewrite_fault, verdict
from ..functions.vectors import token_hash_vectors, unit

#: A text column to a vector column, and columns to a reply column. Pandas UDFs are such functions.
Embedder = Callable[[Column], Column]
Replier = Callable[..., Column]


def width_gate(df: DataFrame, vec_col: str, width: int) -> DataFrame:
    """V-07: ``df``, whose tasks fail at the first vector that is not ``width`` wide. Null vectors pass."""
    n = F.size(F.col(vec_col))
    fault = F.raise_error(F.concat(F.lit(f"a vector of width {width} was expected, not of "), n.cast("string"))).cast(df.schema[vec_col].dataType)
    return df.withColumn(vec_col, F.when(F.col(vec_col).isNull() | (n == width), F.col(vec_col)).otherwise(fault))


def embed(df: DataFrame, text_col: str, out_col: str = "vec", provider: Embedder | None = None, width: int = 64) -> DataFrame:
    """UD-02: ``df`` with unit vectors of a text; without a provider they are hashes of its words. Widths are checked."""
    out = token_hash_vectors(df, text_col, width, out_col) if provider is None else df.withColumn(out_col, unit(provider(F.col(text_col))))
    return width_gate(out, out_col, width)


def adjudicate(findings: DataFrame, provider: Replier | None = None, text_col: str = "body") -> DataFrame:
    """UD-03, UD-04: (artifact_id, classification) of the replies to each finding's text.

    A reply that is not a clear include or exclude, and no provider at all, is null: the finding is then included.
    """
    reply = provider(F.col(text_col)) if provider is not None else F.lit(None).cast("string")
    return findings.select("artifact_id", verdict(reply).alias("classification"))


def rewrite(rows: DataFrame, erased: Column, provider: Replier | None = None, text_col: str = "body", digest_col: str = "content_digest") -> tuple[DataFrame, DataFrame]:
    """UD-03: (rewrites, failed) of texts that must lose the name ``erased``.

    ``rewrites``: artifact_id, pre_digest, new_body; ``failed``: artifact_id and the fault. Without a provider the name
    itself is blanked, in any case.
    """
    body = F.col(text_col)
    if provider is None:
        quoted = F.regexp_replace(erased, r"([^\p{L}\p{N}\s])", r"\\$1")
        new = F.regexp_replace(body, F.concat(F.lit("(?iu)"), quoted), F.lit("[removed]"))
    else:
        new = provider(body)
    made = rows.select("artifact_id", F.col(digest_col).alias("pre_digest"), new.alias("new_body"), body.alias("_before"), erased.alias("_erased"))
    judged = made.withColumn("fault", rewrite_fault(F.col("_before"), F.col("new_body"), F.col("_erased")))
    return judged.where("fault is null").select("artifact_id", "pre_digest", "new_body"), judged.where("fault is not null").select("artifact_id", "fault")
