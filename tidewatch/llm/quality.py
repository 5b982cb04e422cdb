"""Quality rules with thresholds that adapt to language and source (native operators only).

Every document gets integer statistics of its whole text.  Three ratios are compared
with thresholds that come from the corpus itself: for each language and source a
quantile sketch is kept per ratio, a histogram whose buckets grow with the value
(32 buckets per power of two, so a quantile is off by at most 1/32).  Such sketches
merge by adding counts: Spark combines them before the shuffle, a group with fewer
than ``min_group`` documents borrows the merged sketch of its language, and below
that the sketch of the whole table.

A document is kept if the fixed base rules pass and no ratio leaves its fence
``q75 + spread * (q75 - q25) + slack`` (mean word length has a lower fence too).

Defined cases: a null or empty text has no words and fails the base rules; null
language or source is a group of its own; repeated rows are judged one by one, each
counts in the sketches; an empty table gives an empty result; further columns pass
through ``judge`` unchanged, but for columns named like a statistic or verdict, which
are replaced; ``quality_stage`` returns all columns as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh_name, join_checked, stage_table, table

# Fixed values of the contract: the word separators and the symbols.
SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Per mille: symbols and duplicated lines; hundredths of a character: mean word length.
RATIOS = ("symbol_ratio", "dup_line_ratio", "word_length")
SLACK = {"symbol_ratio": 20, "dup_line_ratio": 250, "word_length": 400}
SMOOTH = 10  # lines added to a text's own, so that one repeated line of three is no verdict
SPREAD = 4
MIN_GROUP = 200
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    blank = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.trim(F.coalesce(text, F.lit("")), blank)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs more than once."""

    def count(ordered: Column) -> Column:
        hit = lambda pair, i: (
            (F.get(ordered, i - 1)["h"] == pair["h"]) | (F.get(ordered, i + 1)["h"] == pair["h"])
        )
        places = F.array_sort(F.transform(F.filter(ordered, lambda p, i: F.coalesce(hit(p, i), F.lit(False))), lambda p: p["i"]))
        return _let(
            places,
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(at, i - 1)))),
                F.lit(0),
                lambda total, step: total + step,
            ),
        )

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Few texts repeat themselves: only they are sorted.
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeated, _let(pairs, count)).otherwise(0)


def repeated_words(tokens: Column) -> Column:
    """Words in windows of eight that are found twice or more in the text.

    Windows are compared by 64-bit hashes, built by doubling: of one word, two, four
    and eight.
    """

    def double(hashes: Column, step: int) -> Column:
        return F.zip_with(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - step, F.lit(0))),
            F.slice(hashes, F.lit(step + 1), F.greatest(F.size(hashes) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )

    one = F.transform(tokens, lambda w: F.xxhash64(w))
    eight = _let(one, lambda h1: _let(double(h1, 1), lambda h2: _let(double(h2, 2), lambda h4: double(h4, 4))))
    return F.when(F.size(tokens) > WINDOW, _let(eight, _covered)).otherwise(0)


def with_statistics(docs: DataFrame, repeats: bool = True, n_lines: str = "_q_lines") -> DataFrame:
    """``docs`` with the integer statistics of each whole text; ``n_lines`` names its lines with words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens, lines = fresh_name(docs, "_words"), fresh_name(docs, "_lines")
    out = docs.withColumns(
        {tokens: words(F.col("text")), lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))}
    ).withColumns(
        {
            "n_words": F.size(tokens).cast("long"),
            "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            n_lines: F.size(lines).cast("long"),
        }
    )
    if repeats:
        out = out.withColumn("n_repeat_words", repeated_words(F.col(tokens)).cast("long"))
    return out.drop(tokens, lines)


def _ratios(n_lines: str = "_q_lines") -> dict[str, Column]:
    return {
        "symbol_ratio": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
        "dup_line_ratio": F.expr(f"n_dup_lines * 1000 div (`{n_lines}` + {SMOOTH})"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
    }


def _bucket(value: Column) -> Column:
    """The lower bound of the bucket a value falls in: its six leading bits."""
    size = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0)))
    return (F.floor(value / size) * size).cast("long")


def sketches(docs: DataFrame) -> DataFrame:
    """Bucket counts per language, source and ratio: (lang, source, ratio, low, n)."""
    stats = with_statistics(docs.select("text", "lang", "source"), repeats=False)
    entries = F.array(*[F.struct(F.lit(k).alias("ratio"), _bucket(v).alias("low")) for k, v in _ratios().items()])
    # Not a filter: pushed below the statistics it would compute them twice.
    pairs = F.explode(F.when(F.col("n_words") > 0, entries))
    return (
        stats.select("lang", "source", pairs.alias("_p"))
        .groupBy("lang", "source", F.col("_p.ratio").alias("ratio"), F.col("_p.low").alias("low"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Fences per language and source from merged sketches; one row per group."""

    def quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys, "ratio")
        running = F.sum("n").over(by.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))
        at = rows.withColumns({"_run": running, "_all": F.sum("n").over(by)})
        return at.groupBy(*keys, "ratio").agg(
            F.min(F.when(F.col("_run") * 4 >= F.col("_all"), F.col("low"))).alias("q25"),
            F.min(F.when(F.col("_run") * 4 >= F.col("_all") * 3, F.col("low"))).alias("q75"),
            F.max("_all").alias("m"),
        )

    merged = lambda keys: counts.groupBy(*keys, "ratio", "low").agg(F.sum("n").alias("n"))
    own = quartiles(counts, ["lang", "source"])
    lang = quartiles(merged(["lang"]), ["lang"]).select(
        F.col("lang").alias("_l"), F.col("ratio").alias("_lr"), *[F.col(c).alias(f"l_{c}") for c in ("q25", "q75", "m")]
    )
    total = quartiles(merged([]), []).select(F.col("ratio").alias("_tr"), *[F.col(c).alias(f"t_{c}") for c in ("q25", "q75")])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_lr"))).join(
        total, F.col("ratio") == F.col("_tr")
    )
    pick = lambda q: (
        F.when(F.col("m") >= min_group, F.col(q)).when(F.col("l_m") >= min_group, F.col(f"l_{q}")).otherwise(F.col(f"t_{q}"))
    )
    fenced = joined.select("lang", "source", "ratio", pick("q25").alias("q25"), pick("q75").alias("q75"))
    wide = lambda ratio: SPREAD * (F.col("q75") - F.col("q25")) + SLACK[ratio]
    only = lambda ratio, value: F.max(F.when(F.col("ratio") == ratio, value))
    return fenced.groupBy("lang", "source").agg(
        *[only(r, F.col("q75") + wide(r)).alias(f"max_{r}") for r in RATIOS],
        only("word_length", F.col("q25") - wide("word_length")).alias("min_word_length"),
    )


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``.

    The table is read twice, once for the sketches and once for the verdicts; the
    fences are stored in between and joined back.
    """
    fences = stage_table(thresholds(sketches(docs), min_group))
    # A prefix no column of the caller has, for what is dropped again.
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    q = lambda name: F.col(f"{prefix}{name}")
    fences = fences.withColumnsRenamed({c: f"{prefix}{c}" for c in fences.columns})
    stats = with_statistics(docs, n_lines=f"{prefix}lines")
    on = F.col("lang").eqNullSafe(q("lang")) & F.col("source").eqNullSafe(q("source"))
    joined = join_checked(stats, fences, on, "left", row_bytes=256)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    ratio = _ratios(f"{prefix}lines")
    fits = (
        (ratio["symbol_ratio"] <= q("max_symbol_ratio"))
        & (ratio["dup_line_ratio"] <= q("max_dup_line_ratio"))
        & ratio["word_length"].between(q("min_word_length"), q("max_word_length"))
    )
    # One expression over both sides of the join: nothing of it is pushed below, where
    # the statistics would be computed once more.
    kept = F.when(failed, F.lit(False)).otherwise(F.coalesce(fits, F.lit(False)))
    return joined.withColumns({"base_failed": failed, "kept": kept}).drop(*fences.columns, f"{prefix}lines")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose verdict is to keep."""
    # The caller's row travels whole: its columns may be named like a statistic or verdict.
    rows = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return judge(rows).filter("kept").select("row.*")


def op7_quality(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", *STATS, "base_failed", "kept"
    )
