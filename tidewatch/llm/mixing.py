"""Mixing sources to target weights over a tree of domain, language and source.

The budget runs down the tree: at each node the children share it by weight, no child
gets more than its subtree can give (its tokens times ``max_epochs``), and what a child
cannot use goes to its siblings first.  Because every subtree's capacity is known, a
node passes a shortage up only when all its children are full, so siblings come before
ancestors.  Shares are whole tokens; the odd ones go one each in key order.

A leaf with quota ``q`` and ``t`` tokens takes ``q div t`` whole epochs and, of the next
epoch, the longest prefix that fits in the rest.  An epoch is the leaf's documents in
the order of a hash of seed, epoch and id.  The end of the prefix is one hash value per
leaf: token sums per hash bucket find the bucket it lies in, and only the rows of that
bucket are ordered, one in 4096.  No leaf is gathered or sorted, however large.

Defined cases: a null text has no tokens; null language or source is a node of its own;
rows of equal id are taken together or left together; a leaf without tokens is not
selected; a weight of zero leaves the node out; an empty table gives no rows; further
columns pass through ``mix``, names beginning with ``_m_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import join_checked, stage_table, table
from tidewatch.llm.quality import words

TREE = ("_m_domain", "_m_lang", "_m_source")
WEIGHTS: dict[str, dict[str, int]] = {
    "_m_domain": {"web": 4, "books": 3, "reference": 2, "forums": 2},
    "_m_lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
}
# Sources by number: the first five are web crawls and so on.
DOMAINS = ((5, "web"), (10, "books"), (15, "reference"), (1000, "forums"))
SEED = 20240607
MAX_EPOCHS = 3
BUCKET_BITS = 48  # of 60-bit hashes: 4096 buckets


def domain(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    out = F.lit(None).cast("string")
    for limit, name in reversed(DOMAINS):
        out = F.when(number < limit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def order_hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A 60-bit hash of seed, epoch and id, the same in any engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _placed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"_m_domain": domain(F.col("source")), "_m_lang": F.col("lang"), "_m_source": F.col("source")}
    )


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    own = weights.get(level, {})
    out = F.lit(1)
    for name, weight in own.items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """``leaves`` (tree columns, ``capacity``) with their ``quota`` of the budget."""
    nodes = None
    for depth, level in enumerate(TREE):
        path, above = list(TREE[: depth + 1]), list(TREE[:depth])
        children = leaves.groupBy(*path).agg(F.sum("capacity").alias("cap")).withColumn("w", _weight(level, weights))
        children = children.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
        if nodes is None:
            children = children.withColumn("have", F.lit(budget).cast("long"))
        else:
            given = nodes.select(*[F.col(c).alias(f"_p{c}") for c in above], F.col("quota").alias("have"))
            same = [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in above]
            on = same[0]
            for more in same[1:]:
                on = on & more
            children = children.join(given, on).drop(*[f"_p{c}" for c in above])
        group = Window.partitionBy(*above)
        ordered = group.orderBy(F.expr("cap / greatest(w, 1)"), level)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("have") - F.coalesce(F.sum("cap").over(before), F.lit(0))
        weight_left = F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0))
        full = children.withColumn("full", F.col("cap") * weight_left <= F.col("w") * left)
        rest = F.col("have") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
        open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
        shared = full.withColumns({"rest": rest, "open_w": open_weight}).withColumn(
            "share", F.expr("CASE WHEN full THEN cap ELSE (w * rest) div open_w END")
        )
        odd = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("share"))).over(group)
        place = F.row_number().over(group.orderBy("full", level))
        nodes = shared.withColumns({"odd": odd, "place": place}).select(
            *path, F.expr("share + CASE WHEN NOT full AND place <= odd THEN 1 ELSE 0 END").alias("quota")
        )
        nodes = stage_table(nodes)
    return nodes


def _on_leaf(prefix: str) -> Column:
    a, b, c = (F.col(x).eqNullSafe(F.col(f"{prefix}{x}")) for x in TREE)
    return a & b & c


def plan(docs: DataFrame, budget_percent: int, weights, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with tokens (slim, stored) and per leaf: whole epochs and prefix end."""
    slim = stage_table(
        _placed(docs.select("doc_id", "text", "lang", "source")).select(
            "doc_id", *TREE, F.size(words(F.col("text"))).cast("long").alias("_m_tokens")
        )
    )
    leaves = stage_table(slim.groupBy(*TREE).agg(F.sum("_m_tokens").alias("tokens"))).withColumn(
        "capacity", F.col("tokens") * max_epochs
    )
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quota = budgets(leaves, total * budget_percent // 100, weights)
    quota = quota.withColumnsRenamed({c: f"_q{c}" for c in TREE})
    leaf = leaves.join(quota, _on_leaf("_q")).filter("tokens > 0").select(
        *[F.col(c).alias(f"_q{c}") for c in TREE],
        F.expr("quota div tokens").alias("_m_epochs"),
        F.expr("quota % tokens").alias("_m_rest"),
    )
    leaf = stage_table(leaf)
    hashed = join_checked(slim, leaf, _on_leaf("_q"), row_bytes=256).withColumn(
        "_m_order", order_hash(F.col("doc_id"), F.col("_m_epochs"), seed)
    )
    keys = [f"_q{c}" for c in TREE]
    bucket = F.shiftright("_m_order", BUCKET_BITS)
    sums = hashed.groupBy(*keys, "_m_rest", bucket.alias("_b")).agg(F.sum("_m_tokens").alias("s"))
    run = F.sum("s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        sums.withColumn("run", run)
        .filter(F.col("run") > F.col("_m_rest"))
        .groupBy(*keys)
        .agg(F.min("_b").alias("_b"), F.min(F.col("run")).alias("run"), F.min_by("s", "_b").alias("s"))
        .select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_b").alias("_cb"), (F.col("run") - F.col("s")).alias("_before"))
    )
    same = _same(keys)
    inside = join_checked(hashed, stage_table(cut), same & (bucket == F.col("_cb")), row_bytes=256)
    running = F.sum("_m_tokens").over(
        Window.partitionBy(*keys).orderBy("_m_order").rangeBetween(Window.unboundedPreceding, 0)
    )
    # The cut bucket's rows only; their sums per hash are ordered, not the documents.
    per_hash = inside.groupBy(*keys, "_m_rest", "_before", "_m_order").agg(F.sum("_m_tokens").alias("_m_tokens"))
    ends = (
        per_hash.withColumn("run", F.col("_before") + running)
        .filter(F.col("run") > F.col("_m_rest"))
        .groupBy(*keys)
        .agg(F.min("_m_order").alias("_m_end"))
        .withColumnsRenamed({k: f"_c{k}" for k in keys})
    )
    limits = stage_table(leaf.join(ends, same, "left").select(*keys, "_m_epochs", "_m_end"))
    return slim, limits


def _same(keys: list[str]) -> Column:
    a, b, c = (F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys)
    return a & b & c


def _select(rows: DataFrame, limits: DataFrame, seed: int) -> DataFrame:
    """Each row once per epoch it is taken in, with ``_m_epoch``."""
    joined = join_checked(rows, limits, _on_leaf("_q"), row_bytes=256)
    partly = order_hash(F.col("doc_id"), F.col("_m_epochs"), seed) < F.coalesce(F.col("_m_end"), F.lit(1 << 61))
    last = F.col("_m_epochs") + F.when(partly, 1).otherwise(0) - 1
    return joined.withColumn("_m_last", last).filter("_m_last >= 0").withColumn(
        "_m_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m_last")))
    )


def mix(
    docs: DataFrame,
    budget_percent: int = 100,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` drawn to the weights: a row for each epoch it is taken in, with ``epoch``."""
    _, limits = plan(docs, budget_percent, weights, max_epochs, seed)
    taken = _select(_placed(docs), limits, seed)
    return taken.select(*[c for c in docs.columns if c.lower() != "epoch"], F.col("_m_epoch").alias("epoch"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture, documents repeated by epoch."""
    return mix(docs).select(*docs.columns)


def op4_mixing(spark, sf_dir) -> DataFrame:
    slim, limits = plan(table(spark, sf_dir, "documents"), 100, WEIGHTS, MAX_EPOCHS, SEED)
    return _select(slim, limits, SEED).select(
        "doc_id", F.col("_m_domain").alias("domain"), F.col("_m_lang").alias("lang"), F.col("_m_source").alias("source"),
        F.col("_m_tokens").alias("n_tokens"), F.col("_m_epoch").alias("epoch"),
    )
