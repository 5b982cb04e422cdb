"""Token counts by source, language and tokenizer version, maintained by deltas.

A batch is a table of signed counts: an insert is +1 document and its tokens, a delete
is the same with a minus sign, a revision is the old count with a minus and the new one
with a plus (the tokenizer version, source or language may change with it).  A batch is
summed per group before the shuffle and stored as one small delta; totals are the sum of
all deltas, so they never read a document again.

Batches are idempotent: a delta is written aside and renamed to the batch's own name,
which fails if that name exists.  A batch sent twice, or by two writers at once, or
again after a crash in any place, counts once.

Defined cases: a null text has no tokens; null source or language is a group of its own;
repeated rows count each; rows whose signs cancel leave no group (a group is shown while
it has documents or tokens); an empty batch is committed and changes nothing; further
columns of a batch are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, shared_folder, stage_table, table
from tidewatch.llm.quality import MIN_WORDS, SPACE, words
from tidewatch.llm.tokens import token_ids
from tidewatch.session import delete_path, file_system, path_exists

GROUP = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
PIECES = f"[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}{SPACE}]"

# Versions that are expressions; "bpe-50k" runs the vocabulary in Arrow batches.
VERSIONS: Mapping[str, Column] = {
    "words-1": lambda text: F.size(words(text)).cast("long"),
    "words-2": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECES)).cast("long"),
}


def counted(docs: DataFrame, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens) of every row."""
    if version in VERSIONS:
        return docs.select(
            "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), VERSIONS[version](F.col("text")).alias("n_tokens")
        )
    if version != "bpe-50k":
        raise ValueError(f"unknown tokenizer version {version}")

    def run(batches):
        codec = token_ids()
        for batch in batches:
            columns = (batch[c] for c in ("doc_id", "source", "lang", "text"))
            yield [(d, s, g, version, len(codec.ids(t or "")) // 4) for d, s, g, t in zip(*columns, strict=True)]

    return map_rows(
        docs.select("doc_id", "source", "lang", "text"), run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    )


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*GROUP, F.lit(sign).alias("sign"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Totals below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, batch: str) -> str:
        return f"{self.folder}/deltas/batch={batch}"

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed counts; False if it was there already."""
        if path_exists(self.spark, self._path(batch)):
            return False
        delta = changes.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")
        )
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        delta.write.parquet(aside)
        return self._rename(aside, self._path(batch))

    def _rename(self, aside: str, path: str) -> bool:
        jvm = self.spark._jvm
        fs, _ = file_system(self.spark, path)
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path), none)
        except Exception:
            if not path_exists(self.spark, path):
                raise
            delete_path(self.spark, aside)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all batches."""
        if not path_exists(self.spark, f"{self.folder}/deltas"):
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(f"{self.folder}/deltas/*")
        summed = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 OR n_tokens <> 0")


def op9_token_counts(spark, sf_dir) -> DataFrame:
    """All documents loaded, recounted where not English, short ones deleted, load sent twice."""
    docs = table(spark, sf_dir, "documents")
    first = VERSIONS["words-1"](F.col("text")).alias("first")
    both = stage_table(docs.select("doc_id", "source", "lang", first, VERSIONS["words-2"](F.col("text")).alias("second")))
    return _maintained(spark, both, "words-2", F.coalesce(F.col("lang") != "en", F.lit(True)))


def op9_token_counts_bpe(spark, sf_dir) -> DataFrame:
    """The same with all documents recounted by the vocabulary."""
    docs = table(spark, sf_dir, "documents")

    def run(batches):
        codec = token_ids()
        for batch in batches:
            columns = (batch[c] for c in ("source", "lang", "first", "text"))
            yield [(s, g, n, len(codec.ids(t or "")) // 4) for s, g, n, t in zip(*columns, strict=True)]

    first = VERSIONS["words-1"](F.col("text")).alias("first")
    both = map_rows(docs.select("source", "lang", first, "text"), run, "source string, lang string, first long, second long")
    return _maintained(spark, stage_table(both), "bpe-50k", F.lit(True))


def _maintained(spark, both: DataFrame, version: str, recounted: Column) -> DataFrame:
    """Totals after load, recount of some rows under ``version``, the load again, deletes."""

    def under(rows: DataFrame, version: str, count: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col(count).alias("n_tokens"))

    foreign, short = both.filter(recounted), both.filter(F.col("first") < MIN_WORDS)
    rollup = TokenRollup(spark, shared_folder(spark, "rollup"))
    load = inserts(under(both, "words-1", "first"))
    rollup.commit("load", load)
    rollup.commit("recount", revisions(under(foreign, "words-1", "first"), under(foreign, version, "second")))
    rollup.commit("load", load)
    gone = under(short.filter(~recounted), "words-1", "first").unionByName(under(short.filter(recounted), version, "second"))
    rollup.commit("short", deletes(gone))
    return rollup.totals()
