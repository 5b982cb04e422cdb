"""License scans by ordered signature rules (native operators only).

1. Words are the alphanumeric words of the whole text, lower-cased.  A text that holds no
   rule's keyword is done: the prefilter costs one set intersection.
2. Texts with keywords are written as numbered words, `` 0:mit  1:license ``, so that a
   regular expression also says where it matched; of the hundreds of rules in
   ``license_rules`` only those whose keyword is there are tried.
3. Detections of equal texts are counted once, before the shuffle.  A detection falls if
   its stretch lies within that of another one of the same or a better tier (of equal
   stretches the first rule stays): "lesser general public license version 2.1" silences
   the "general public license" inside it.  Overlaps without containment both stay.  This
   is a running maximum over one text's detections in order of place, a column per tier.
4. What stays is joined back to the rows by two 64-bit hashes of the text.

The score is the confidence of the best detection that stays, 0 without any.

Defined cases: a null, empty or blank text has no words, no labels and score 0; rows are
independent, repeated rows and null ids get their own equal results; an empty table gives an
empty result; further columns pass through, but for columns named like a result, whatever
the case, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh_name, join_checked, stage_table, table
from tidewatch.llm.license_rules import CONFIDENCE, rules

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the contract: phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "licenses", "score")
DETECTION = "array<struct<first_word:long,last_word:long,tier:int,rule:int,label:string>>"


def pattern(signature: str, group: bool = False) -> str:
    """The signature over numbered words; ``group`` takes the first word's number."""
    number = "([0-9]+)" if group else "[0-9]+"
    return f" {number}:" + signature.replace(" ", "  [0-9]+:") + " "


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keywords() -> list[str]:
    return sorted({r.keyword for r in rules()} | {p.split()[0] for p, _ in BASE})


def _prepared(text: Column) -> Column:
    """Struct of a text's word count, the keywords it holds and, if any, its numbered words."""
    wanted = F.array(*[F.lit(k) for k in keywords()])
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)

    def number(words: Column) -> Column:
        return F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), i.cast("string"), F.lit(":"), w, F.lit(" "))), "")

    def parts(words: Column, there: Column) -> Column:
        numbered = F.when(F.size(there) > 0, number(F.array_remove(words, ""))).otherwise(F.lit(""))
        edges = (F.element_at(words, 1) == "").cast("int") + ((F.element_at(words, -1) == "") & (F.size(words) > 1)).cast("int")
        return F.struct((F.size(words) - edges).cast("long").alias("n"), there.alias("there"), numbered.alias("numbered"))

    return _let(F.split(lowered, GAP, -1), lambda w: _let(F.array_intersect(w, wanted), lambda k: parts(w, k)))


def _base(numbered: Column) -> dict[str, Column]:
    """Places of the fixed phrases: their count, first and last word, and labels."""
    places = [F.regexp_extract_all(numbered, F.lit(pattern(p, group=True)), F.lit(1)) for p, _ in BASE]
    everywhere = F.transform(F.concat(*places), lambda x: x.cast("long"))
    labels = [F.when(F.size(found) > 0, F.lit(label)) for found, (_, label) in zip(places, BASE, strict=True)]
    return {
        "n_base": F.size(everywhere).cast("long"),
        "first_word": F.array_min(everywhere),
        "last_word": F.array_max(everywhere),
        "base_labels": F.array_sort(F.array_compact(F.array(*labels))),
    }


def _detections(prepared: Column) -> Column:
    """All matches of all rules whose keyword is there."""
    # As one SQL literal: built column by column it takes thousands of calls to the JVM.
    ordered = F.expr(
        "array("
        + ", ".join(
            f"named_struct('rule', {r.rule}, 'tier', {r.tier}, 'label', '{r.label}', 'keyword', '{r.keyword}', "
            f"'pattern', '{pattern(r.signature)}')"
            for r in rules()
        )
        + ")"
    )
    tried = F.filter(ordered, lambda r: F.array_contains(prepared["there"], r["keyword"]))

    def found(r: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(prepared["numbered"], r["pattern"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, "^ ([0-9]+):", 1).cast("long").alias("first_word"),
                F.regexp_extract(m, "([0-9]+):[^ ]* $", 1).cast("long").alias("last_word"),
                r["tier"].alias("tier"), r["rule"].alias("rule"), r["label"].alias("label"),
            ),
        )

    return F.flatten(F.transform(tried, found))


def _key(text: Column) -> list[Column]:
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled), F.xxhash64(F.lit(12), filled)]


def detections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, first_word, last_word, tier, rule, label) of the detections that stay, per unlike text."""
    k1, k2 = _key(F.col(text))
    prepared = docs.select(k1.alias("k1"), k2.alias("k2"), _prepared(F.col(text)).alias("p"))
    rows = prepared.filter(F.size("p.there") > 0).select("k1", "k2", F.explode(_detections(F.col("p"))).alias("d"))
    rows = rows.select("k1", "k2", "d.*").distinct()
    order = Window.partitionBy("k1", "k2").orderBy("first_word", F.desc("last_word"), "tier", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = {f"_reach{t}": F.max(F.when(F.col("tier") <= t, F.col("last_word"))).over(before) for t in CONFIDENCE}
    own = F.coalesce(*[F.when(F.col("tier") == t, F.col(f"_reach{t}")) for t in CONFIDENCE])
    return rows.withColumns(reach).filter(own.isNull() | (own < F.col("last_word"))).drop(*reach)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word count, fixed phrases, ``licenses`` (the detections), labels and score."""
    rows = docs.select([F.col(c) for c in docs.columns if c == text or c.lower() not in RESULT])
    k1, k2, prepared = fresh_name(rows, "_k1"), fresh_name(rows, "_k2"), fresh_name(rows, "_prepared")
    confidence = F.coalesce(*[F.when(F.col("tier") == t, F.lit(c)) for t, c in CONFIDENCE.items()])
    found = detections(docs.select(F.col(text).alias("text"))).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "last_word", "tier", "rule", "label"))).alias("_found"),
        F.max(confidence).alias("_score"),
    )
    stay, score = fresh_name(rows, "_found"), fresh_name(rows, "_score")
    found = stage_table(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("_found").alias(stay), F.col("_score").alias(score)))
    # The struct is computed before the join, once, and what is needed taken from it.
    scanned = rows.withColumn(prepared, _prepared(F.col(text)))
    numbered = F.col(f"{prepared}.numbered")
    base = _base(numbered)
    scanned = scanned.withColumns({k1: _key(F.col(text))[0], k2: _key(F.col(text))[1], "n_words": F.col(f"{prepared}.n")})
    scanned = scanned.withColumns(base).drop(prepared)
    joined = join_checked(scanned, found, [k1, k2], "left", row_bytes=F.size(stay) * 96)
    method = F.transform(F.coalesce(F.col(stay), F.array().cast(DETECTION)), lambda d: d["label"])
    return joined.withColumns(
        {
            "labels": F.array_join(F.array_sort(F.array_union("base_labels", method)), ","),
            "licenses": F.coalesce(F.col(stay), F.array().cast(DETECTION)),
            "score": F.coalesce(F.col(score), F.lit(0.0)),
        }
    ).withColumn("base_labels", F.array_join("base_labels", ",")).drop(k1, k2, stay, score)


def op12_licenses(spark, sf_dir) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
