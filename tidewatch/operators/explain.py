"""Feature contributions to a score: sampled Shapley values.

A feature order and a background row make one walk from the background row to the
explained row, one feature at a time; the score changes along the walk are the
contributions.  Averaging over walks keeps their sum exact: base + contributions =
score.  The walks are the same for every row, so results do not depend on
partitioning.

Models of few features need no sampling: ``explain_exact`` weighs what a feature adds to
every subset of the others, over all background rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import feature, quoted
from tidewatch.operators.bundle import Bundle
from tidewatch.operators.ranks import join_small
from tidewatch.operators.sampling import sample_rows
from tidewatch.operators.scoring import scaled
from tidewatch.session import cut_lineage, ship_package

LEVELS = ("ae", "gmm")
TOP = 15  # fixed value: rows of a waterfall, the last one holding the rest
BACKGROUND = 50
MAX_EXACT = 12  # features; their subsets double with each
_BLOCK = 16_384

_ONE = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("contributions", T.ArrayType(T.DoubleType())),
    ]
)


def background_sample(flows: DataFrame, bundle: Bundle, n: int = BACKGROUND, uid: str = "flow_uid", seed: int = 42) -> np.ndarray:
    """A small, fixed number of scaled rows as the starting points of walks."""
    chosen = sample_rows(flows, n, uid, seed).orderBy(uid).select(*scaled(bundle))
    return np.array([list(r) for r in chosen.collect()])


def explain(
    flows: DataFrame,
    bundle: Bundle,
    background: np.ndarray,
    level: str = "both",
    walks: int = 40,
    seed: int = 42,
    uid: str = "flow_uid",
    partitions: int | None = None,
) -> DataFrame:
    """``flow_uid, model_version, level, base, score, features, data, contributions``.

    ``ae`` explains the mean reconstruction error, ``gmm`` the mixture log-density.
    Each row costs ``walks * features`` model runs, so rows are spread over
    ``partitions`` tasks (three per core) instead of being packed by size.
    """
    levels = LEVELS if level == "both" else (level,)
    spark = flows.sparkSession
    rng = np.random.default_rng(seed)
    d = bundle.dim
    orders = np.array([rng.permutation(d) for _ in range(walks)])
    starts = background[np.arange(walks) % len(background)]
    ship_package(spark)
    shared = spark.sparkContext.broadcast((bundle, orders, starts))

    @F.pandas_udf(T.StructType([T.StructField(name, _ONE) for name in levels]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model, paths, origin = shared.value
        mixture = model.mixture()
        rank = np.argsort(paths, axis=1)
        # taken[w, s, f]: feature f comes from the row after s steps of walk w.
        taken = rank[:, None, :] < np.arange(1, d)[None, :, None]

        def values(block):
            errors = model.errors(block)
            return {n: errors.mean(1) if n == "ae" else mixture.log_density(errors) for n in levels}

        at_start = values(origin)
        rows_per_block = max(1, _BLOCK // taken[..., 0].size)
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            ends = values(x)
            found = {n: np.empty((len(x), d)) for n in levels}
            for at in range(0, len(x), rows_per_block):
                rows = x[at : at + rows_per_block]
                mixed = np.where(taken[None], rows[:, None, None, :], origin[None, :, None, :])
                between = values(mixed.reshape(-1, d))
                for n in levels:
                    f = np.empty((len(rows), len(paths), d + 1))
                    f[:, :, 0] = at_start[n]
                    f[:, :, 1:d] = between[n].reshape(len(rows), len(paths), d - 1)
                    f[:, :, d] = ends[n][at : at + len(rows), None]
                    steps = np.diff(f, axis=2)
                    by_feature = np.take_along_axis(steps, np.broadcast_to(rank, steps.shape), axis=2)
                    found[n][at : at + len(rows)] = by_feature.mean(1)
            yield pd.DataFrame(
                {
                    n: [
                        {"level": n, "base": float(at_start[n].mean()), "score": s, "contributions": c}
                        for s, c in zip(ends[n], found[n])
                    ]
                    for n in levels
                }
            )

    return _explained(flows, bundle, levels, uid, partitions, run)


def explain_exact(
    flows: DataFrame,
    bundle: Bundle,
    background: np.ndarray,
    level: str = "both",
    uid: str = "flow_uid",
    partitions: int | None = None,
) -> DataFrame:
    """As ``explain``, without sampling: the Shapley values over all subsets of features.

    A subset's value is the mean score of the background rows with its features taken from
    the explained row.  A row costs ``2 ** features * background`` model runs.
    """
    levels = LEVELS if level == "both" else (level,)
    spark, d = flows.sparkSession, bundle.dim
    if d > MAX_EXACT:
        raise ValueError(f"{d} features have too many subsets, use explain")
    ship_package(spark)
    subsets = np.arange(1 << d)
    members = (subsets[:, None] >> np.arange(d)) & 1 == 1
    chances = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    shared = spark.sparkContext.broadcast((bundle, background, members))

    @F.pandas_udf(T.StructType([T.StructField(name, _ONE) for name in levels]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model, origin, taken = shared.value
        mixture = model.mixture()
        rows_per_block = max(1, _BLOCK // (len(taken) * len(origin)))
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            out = {n: [] for n in levels}
            for at in range(0, len(x), rows_per_block):
                rows = x[at : at + rows_per_block]
                mixed = np.where(taken[None, :, None, :], rows[:, None, None, :], origin[None, None, :, :])
                errors = model.errors(mixed.reshape(-1, d))
                for n in levels:
                    score = errors.mean(1) if n == "ae" else mixture.log_density(errors)
                    value = score.reshape(len(rows), len(taken), len(origin)).mean(2)
                    found = np.empty((len(rows), d))
                    for i in range(d):
                        without = subsets[~taken[:, i]]
                        weight = chances[taken[without].sum(1)]
                        found[:, i] = (value[:, without | (1 << i)] - value[:, without]) @ weight
                    for v, c in zip(value, found, strict=True):
                        out[n].append({"level": n, "base": v[0], "score": v[-1], "contributions": c})
            yield pd.DataFrame(out)

    return _explained(flows, bundle, levels, uid, partitions, run)


def _explained(flows: DataFrame, bundle: Bundle, levels: tuple[str, ...], uid: str, partitions: int | None, run) -> DataFrame:
    """The rows of ``explain`` from a function of the scaled features."""
    spark = flows.sparkSession
    spread = flows.select(quoted(uid), *[feature(f).alias(f) for f in bundle.feature_names]).repartition(
        partitions or 3 * spark.sparkContext.defaultParallelism, quoted(uid)
    )
    found = spread.select(
        quoted(uid), F.array(*[quoted(f) for f in bundle.feature_names]).alias("data"), run(*scaled(bundle)).alias("r")
    )
    per_level = F.array(*[F.col(f"r.{n}") for n in levels])
    return found.select(uid, "data", F.inline(per_level)).select(
        uid, F.lit(bundle.version).alias("model_version"), "level", "base", "score",
        F.array(*[F.lit(f) for f in bundle.feature_names]).alias("features"), "data", "contributions",
    )


def cached_explanations(wanted: DataFrame, explanations: DataFrame, version: str) -> DataFrame:
    """Stored explanations of the wanted flows for one model version; NULL if none."""
    stored = explanations.filter(F.col("model_version") == version)
    ids = wanted.select("flow_uid").distinct()
    found = cut_lineage(join_small(stored, ids, ["flow_uid"], "left_semi"))
    return ids.join(found, ["flow_uid"], "left").select(*stored.columns)


def waterfall(explanations: DataFrame, top: int = TOP, uid: str = "flow_uid") -> DataFrame:
    """Rows of a waterfall: largest contributions first, the remainder as one row.

    Sorting happens inside each row's array, so nothing is shuffled.
    """
    pair = F.arrays_zip(F.col("features").alias("feature"), F.col("contributions").alias("contribution"))
    ordered = F.array_sort(
        pair,
        lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
        .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
        .when(a["feature"] < b["feature"], -1)
        .otherwise(1),
    )
    df = explanations.withColumn("_o", ordered)
    shown = F.when(F.size("_o") <= top, F.size("_o")).otherwise(top - 1)
    rest = F.slice("_o", shown + 1, F.greatest(F.size("_o") - shown, F.lit(1)))
    other = F.struct(
        F.lit("other").alias("feature"),
        F.aggregate(rest, F.lit(0.0), lambda a, v: a + v["contribution"]).alias("contribution"),
    )
    rows = F.when(F.size("_o") > shown, F.concat(F.slice("_o", F.lit(1), shown), F.array(other))).otherwise(F.col("_o"))
    return df.select(uid, "level", "base", F.posexplode(rows).alias("rank", "_r")).select(
        uid, "level", "base", (F.col("rank") + 1).alias("rank"), "_r.feature", "_r.contribution"
    )
