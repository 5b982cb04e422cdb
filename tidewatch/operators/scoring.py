"""Scoring: scale, reconstruct, mixture density, label, confidence.

Scaling, labels, confidence and rounding are native expressions.  The matrix
arithmetic is one Arrow-batched function that receives only the feature columns;
all other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import canonicalize, feature, metadata_columns, quoted, require_features
from tidewatch.functions.numeric import bounded_confidence, round_half_even
from tidewatch.operators.bundle import Bundle
from tidewatch.operators.ranks import join_small, quantile, quantiles
from tidewatch.session import ship_package, stage_table

NORMAL, ATTACK = "Normal", "Attack"
ERRORS = T.StructType([T.StructField("errors", T.ArrayType(T.DoubleType()))])
SCORES = T.StructType([T.StructField("ae_score", T.DoubleType()), T.StructField("score_raw", T.DoubleType())])


def scaled(bundle: Bundle, names: Sequence[str] | None = None) -> list[Column]:
    """Standardised feature columns, in model order."""
    names = bundle.feature_names if names is None else names
    return [
        (feature(n) - float(m)) / float(s) for n, m, s in zip(names, bundle.scaler_mean, bundle.scaler_scale)
    ]


def _block_udf(spark: SparkSession, bundle: Bundle, result: T.DataType, compute: Callable) -> Callable:
    """An Arrow function over the scaled columns; the bundle is broadcast once."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(bundle)

    @F.pandas_udf(result)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        mixture = model.mixture()
        for columns in batches:
            block = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            yield compute(model, mixture, block)

    return run


def score_struct(spark: SparkSession, bundle: Bundle, columns: Sequence[Column]) -> Column:
    """``struct(ae_score, score_raw)``: mean error and mixture log-density."""

    def compute(model, mixture, block):
        errors = model.errors(block)
        return pd.DataFrame({"ae_score": errors.mean(1), "score_raw": mixture.log_density(errors)})

    return _block_udf(spark, bundle, SCORES, compute)(*columns)


def error_vector(spark: SparkSession, bundle: Bundle, columns: Sequence[Column]) -> Column:
    """Absolute reconstruction error per feature, as an array."""

    def compute(model, mixture, block):
        return pd.DataFrame({"errors": list(model.errors(block))})

    return _block_udf(spark, bundle, ERRORS, compute)(*columns)["errors"]


def score_rows(df: DataFrame, bundle: Bundle, keep: Sequence[str]) -> DataFrame:
    """Kept columns, features (finite doubles), ``ae_score`` and ``score_raw``."""
    require_features(df.columns, bundle.feature_names, len(bundle.scaler_mean))
    clean = df.select(*[quoted(c) for c in keep], *[feature(f).alias(f) for f in bundle.feature_names])
    scores = score_struct(df.sparkSession, bundle, scaled(bundle))
    return clean.withColumn("_s", scores).select(*[quoted(c) for c in clean.columns], "_s.ae_score", "_s.score_raw")


def label(score: Column, threshold: float | Column) -> Column:
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score < threshold, ATTACK).otherwise(NORMAL)


def classify(
    scored: DataFrame, threshold: float, scope: str | None = None, confidence_scale: float | None = None
) -> DataFrame:
    """Add prediction, confidence and rounded score to a table with ``score_raw``.

    Confidence is relative to a scope: the whole table, or the rows that share the
    column ``scope``.  A fixed ``confidence_scale`` needs no look at the table.
    ``scored`` is read twice without it, so it should be a stored table.
    """
    distance = F.abs(F.col("score_raw") - threshold)
    if confidence_scale is not None:
        df, scale = scored, F.lit(float(confidence_scale))
    elif scope is None:
        value = quantile(scored, distance, 0.95)
        df, scale = scored, F.lit(1.0 if value is None else value)
    else:
        per_scope = quantiles(scored, distance, [0.95], [scope]).select(scope, F.col("value").alias("_p95"))
        df, scale = join_small(scored, per_scope, [scope], "left"), F.col("_p95")
    out = df.withColumns(
        {
            "prediction": label(F.col("score_raw"), threshold),
            "confidence": round_half_even(bounded_confidence(F.col("score_raw"), F.lit(float(threshold)), scale)),
            "gmm_score": round_half_even(F.col("score_raw")),
        }
    )
    return out.drop("_p95")


def predict(
    flows: DataFrame,
    bundle: Bundle,
    scope: str | None = None,
    standardize: bool = True,
    keep: Sequence[str] = (),
    confidence_scale: float | None = None,
) -> DataFrame:
    """Flows of any header dialect to labelled rows.

    Output: kept columns, metadata present, features, ``ae_score``, ``score_raw``,
    ``prediction``, ``confidence``, ``gmm_score``, ``model_version``.
    """
    if standardize:
        flows = canonicalize(flows)
    extra = [c for c in dict.fromkeys([*keep, *([scope] if scope else [])]) if c not in bundle.feature_names]
    meta = [c for c in metadata_columns(flows.columns, bundle.feature_names) if c not in extra]
    scored = score_rows(flows, bundle, [*extra, *meta])
    fixed = bundle.confidence_scale if confidence_scale is None else confidence_scale
    if fixed is None:
        # The model runs once; the percentile pass then reads one or two columns.
        scored = stage_table(scored)
    out = classify(scored, bundle.threshold, scope, fixed)
    return out.withColumn("model_version", F.lit(bundle.version))


def relabel(
    scored: DataFrame, threshold: float, scope: str | None = None, confidence_scale: float | None = None
) -> DataFrame:
    """Apply another threshold to stored raw scores; the model is not run."""
    return classify(scored.drop("prediction", "confidence", "gmm_score"), threshold, scope, confidence_scale)


def rescore(
    scored: DataFrame, bundle: Bundle, scope: str | None = None, confidence_scale: float | None = None
) -> DataFrame:
    """Score stored rows again with another model, keeping all other columns."""
    drop = {"ae_score", "score_raw", "prediction", "confidence", "gmm_score", "model_version"}
    keep = [c for c in scored.columns if c not in drop and c not in bundle.feature_names]
    return predict(scored, bundle, scope, standardize=False, keep=keep, confidence_scale=confidence_scale)
