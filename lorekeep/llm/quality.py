"""Quality rules whose cutoffs come from quantile sketches of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, let, quoted, saved

#: Groups whose fences go to every task, at about 100 bytes each; more of them are joined by a shuffle, with salt.
MAX_BROADCAST, SALTS = 20_000, 32
#: The measures, and the share of a group's rows that may lie above (and below, for the length of words) its bulk.
SHARES = {"symbols_per_word": 0.15, "mean_word_chars": 0.15, "duplicate_lines_per_other": 0.002}
TWO_SIDED = {"mean_word_chars"}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def base_counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts that need one pass over a text's words or lines."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def in_order(grams: Column) -> Column:
    """The hashes of windows with their places, sorted; empty if no hash occurs twice."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))


def window_hashes(words: Column) -> Column:
    spots = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(spots, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def met_again(sorted_pairs: Column) -> Column:
    """The places ``i`` of sorted pairs (g, i) whose ``g`` a neighbour has too."""

    def places(o: Column) -> Column:
        same = lambda x, i: (F.get(o, i - 1).g == x.g) | (F.get(o, i + 1).g == x.g)
        return F.filter(F.transform(o, lambda x, i: F.when(same(x, i), x.i)), lambda i: i.isNotNull())

    return let(sorted_pairs, places)


def repeated_words(words: Column, order: Column) -> Column:
    """Words inside windows that occur at least twice. ``order``: see ``in_order``; windows of one hash are compared by their words."""
    window = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    named = let(words, lambda w: F.sort_array(F.transform(met_again(order), lambda i: F.struct(window(w, i).alias("g"), i.alias("i")))))
    return F.size(F.array_distinct(F.flatten(F.transform(met_again(named), lambda i: F.array(i, i + 1, i + 2)))))


def measure(docs: DataFrame, text_col: str = "text", repeats: bool = True) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and, with ``repeats``, n_repeat_words (null text: no words)."""
    words, lines, grams, order = fresh(docs, "_words", "_lines", "_grams", "_order")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    out = docs.withColumns(
        {
            words: F.regexp_extract_all(text, F.lit(rf"[^{SPACE_CLASS}]+"), F.lit(0)),
            lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(rf"[^{SPACE_CLASS}]")),
        }
    ).withColumns(base_counts(text, F.col(words), F.col(lines)))
    if repeats:
        out = out.withColumn(grams, window_hashes(F.col(words)))
        out = out.withColumn(order, in_order(F.col(grams)))
        out = out.withColumn("n_repeat_words", repeated_words(F.col(words), F.col(order)).cast("long"))
    return out.drop(words, lines, grams, order)


def ratios(counted=lambda n: n) -> dict[str, Column]:
    """The measures of a document; ``counted`` says what of a count of odd symbols or lines is taken."""
    words, others = (F.greatest(n, F.lit(1)) for n in (F.col("n_words"), F.col("n_lines") - F.col("n_dup_lines")))
    return {
        "symbols_per_word": counted(F.col("n_symbols")) / words,
        "mean_word_chars": F.col("word_chars") / words,
        "duplicate_lines_per_other": counted(F.col("n_dup_lines")) / others,
    }


def beyond_chance(n: Column) -> Column:
    """A count less twice its root: what is sure to be there where counts scatter as rare events do. Up to four are none."""
    return F.greatest(n - 2 * F.sqrt(n), F.lit(0.0))


def fences(counts: DataFrame, group_cols: list[str], min_words: int, reach: float, min_rows: int, accuracy: int) -> DataFrame:
    """One row of fences for each group, from sketches that tasks fill and Spark merges, for it and all it is part of.

    A measure's bulk ends at the quantile that leaves its share of SHARES beyond; the fence lies ``reach`` times as far
    beyond that end as the end lies from the median. Nothing in it is fixed but shares and ratios, so a measure's
    scale and its usual values in a language and source make the fence.

    Fences of few rows are unsure. Those of a group of n rows count n / (n + ``min_rows``), and for the rest those of
    the groups that share its first columns but the last, which in turn lean on theirs, up to all documents.
    """
    rows = counts.where(F.col("n_words") >= min_words).withColumns(ratios())
    levels = {m: [share if m in TWO_SIDED else 0.5, 0.5, 1 - share] for m, share in SHARES.items()}
    found = rows.rollup(*group_cols).agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.percentile_approx(m, levels[m], accuracy).alias(f"_{m}") for m in SHARES],
    )
    out = {}
    for m in SHARES:
        low, middle, high = (F.get(F.col(f"_{m}"), F.lit(i)) for i in range(3))
        if m in TWO_SIDED:
            out[f"_low_{m}"] = low - F.lit(reach) * (middle - low)
        out[f"_high_{m}"] = high + F.lit(reach) * (high - middle)
    found = saved(found.select(*group_cols, "_level", "_rows", *[c.alias(name) for name, c in out.items()]))
    top = found.where(F.col("_level") == (1 << len(group_cols)) - 1).select(*out).first()  # the one row of all documents
    wider = None
    for k in range(1, len(group_cols) + 1):
        keys = group_cols[:k]
        own = found.where(F.col("_level") == (1 << (len(group_cols) - k)) - 1)
        if k == 1:
            own = own.withColumns({f"_wide{c}": F.lit(top[c] if top else None).cast("double") for c in out})
        else:
            own = own.join(F.broadcast(wider) if wider.count() <= MAX_BROADCAST else wider, keys[:-1])
        share = F.col("_rows") / (F.col("_rows") + min_rows)
        own = own.select(*keys, *[(share * F.col(c) + (1 - share) * F.col(f"_wide{c}")).alias(c) for c in out])
        if k < len(group_cols):
            wider = saved(own.select(*keys, *[F.col(c).alias(f"_wide{c}") for c in out]))
    return own


def judge(
    docs: DataFrame,
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
    min_words: int = 50,
    max_repeat_percent: int = 50,
    reach: float = 4.0,
    min_rows: int = 100,
    accuracy: int = 2000,
    keep_text: bool = True,
) -> DataFrame:
    """Add the counts of ``measure``, ``base_failed`` and ``kept`` to documents.

    ``base_failed``: under ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated 3-word
    windows. Otherwise a document is kept if its symbols and characters per word and its repeated lines per other
    line lie inside the fences of its language and source. Of symbols and repeated lines only those beyond chance
    count, so one symbol is never too many where most texts have none (see ``beyond_chance`` and ``fences``; ``min_rows`` says how much a small group leans on its
    language, and that on all). A null language or source is a group like any other; null and empty texts have no
    words and fail. Columns of the input that have a result's name are replaced.

    Without ``keep_text`` the result lacks ``text_col``, and every text is measured once: its counts are kept in the
    checkpoint folder. With it, texts are not written a second time; they are measured again when they are judged.
    """
    new = [*COUNTS, "base_failed", "kept"]
    docs = docs.drop(*new)
    n_lines = F.size(F.split(F.coalesce(quoted(text_col).cast("string"), F.lit("")), "\n", -1)).cast("long")
    keys = fresh(docs, *[f"_g{i}" for i in range(len(group_cols))])
    keyed = docs.withColumns({k: F.coalesce(quoted(c).cast("string"), F.lit("\x00")) for k, c in zip(keys, group_cols)})
    keyed = keyed.withColumn("n_lines", n_lines)
    if keep_text:
        counts, full = measure(keyed.select(*keys, quoted(text_col), "n_lines"), text_col, repeats=False), measure(keyed, text_col)
    else:
        counts = full = saved(measure(keyed, text_col).drop(text_col))
    limits = saved(fences(counts, keys, min_words, reach, min_rows, accuracy))
    (salt,) = fresh(full, "_salt")
    if limits.count() <= MAX_BROADCAST:
        limits, full = F.broadcast(limits.withColumn(salt, F.lit(0))), full.withColumn(salt, F.lit(0))
    else:
        limits = limits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        full = full.withColumn(salt, F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_lines"), F.lit(SALTS)).cast("int"))

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    inside = F.lit(True)
    for m, value in ratios(beyond_chance).items():
        inside &= value <= F.col(f"_high_{m}")
        if m in TWO_SIDED:
            inside &= value >= F.col(f"_low_{m}")
    return (
        full.join(limits, [*keys, salt], "left")
        .withColumn("base_failed", failed)
        # not a conjunction, so that a filter on it stays above the join, where the counts are computed already
        .withColumn("kept", F.least(~F.col("base_failed"), F.coalesce(inside, F.lit(True))))
        .select(*[quoted(c) for c in docs.columns if keep_text or c != text_col], *new)
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
