"""Line dedup: lines that several documents share stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_strip, fresh, let, quoted

#: A shared line may sit in a third of all documents, so its rows are dealt to this many tasks.
SALTS = 16


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    n_lines_col: str = "n_lines",
    n_dropped_col: str = "n_dropped",
) -> DataFrame:
    """Replace ``text_col`` by its kept lines and add the counts of lines and dropped lines.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose their lines everywhere but in
    the document with the smallest id. Lines are exploded and hashed to 128 bits, counted per hash, joined
    back with salt, and the rest is put together by position.

    Null or empty text is one empty line and comes back as an empty text. A null id is one document that
    comes after all others. Rows that share an id are one document; each row is treated with its own text.
    Lines repeated inside a single document stay. Extra columns pass through; those with the name of a count are replaced.
    """
    text, doc = F.coalesce(quoted(text_col).cast("string"), F.lit("")), quoted(id_col)
    docs = docs.drop(n_lines_col, n_dropped_col)
    rid, fp, fp2, pos, line, k1, k2, first, drop, salt, parts, last, null, many, dfp, dfp2 = fresh(
        docs, *"_rid _fp _fp2 _pos _line _k1 _k2 _first _drop _salt _parts _last _null _many _dfp _dfp2".split()
    )
    marked = docs.withColumns({text_col: text, fp: F.xxhash64(text), fp2: F.xxhash64(F.lit(1), text)})

    exploded = marked.select(doc.alias(rid), fp, fp2, F.posexplode(F.split(quoted(text_col), "\n", -1)).alias(pos, line))
    keyed = exploded.select(rid, fp, fp2, pos, ascii_lower(ascii_strip(F.col(line))).alias(line)).where(
        F.char_length(line) >= min_chars
    )
    keyed = keyed.select(rid, fp, fp2, pos, F.xxhash64(line).alias(k1), F.xxhash64(F.lit(1), F.col(line)).alias(k2))

    if min_docs == 2:  # two different ids are enough, and their minimum and maximum combine on the map side
        ids = keyed.groupBy(k1, k2).agg(F.min(rid).alias(first), F.max(rid).alias(last), F.max(F.col(rid).isNull()).alias(null))
        shared = ids.where((F.col(first) != F.col(last)) | (F.col(first).isNotNull() & F.col(null)))
    else:
        per_doc = keyed.select(k1, k2, rid).distinct()
        shared = per_doc.groupBy(k1, k2).agg(F.min(rid).alias(first), F.count(F.lit(1)).alias(many)).where(F.col(many) >= min_docs)
    shared = shared.select(k1, k2, first, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))

    dealt = keyed.withColumn(salt, F.pmod(F.xxhash64(rid, fp), F.lit(SALTS)).cast("int"))
    dropped = (
        dealt.join(shared, [k1, k2, salt])
        .where(~F.col(rid).eqNullSafe(F.col(first)))
        .groupBy(rid, fp, fp2)
        .agg(F.array_distinct(F.collect_list(pos)).alias(drop))
        .withColumnsRenamed({fp: dfp, fp2: dfp2})
    )

    whole = marked.join(
        dropped,
        doc.eqNullSafe(dropped[rid]) & (marked[fp] == dropped[dfp]) & (marked[fp2] == dropped[dfp2]),
        "left",
    )
    whole = whole.withColumn(parts, F.split(quoted(text_col), "\n", -1))
    n_lines, n_dropped = F.size(parts), F.coalesce(F.size(F.coalesce(drop, F.array().cast("array<int>"))), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(drop))
    kept_text = F.array_join(let(F.col(parts), lambda p: F.transform(kept, lambda i: F.get(p, i))), "\n")
    new_text = F.when(F.col(drop).isNull(), quoted(text_col)).otherwise(kept_text).alias(text_col)
    return whole.select(
        *[new_text if c == text_col else quoted(c) for c in docs.columns],
        n_lines.cast("long").alias(n_lines_col),
        n_dropped.cast("long").alias(n_dropped_col),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
