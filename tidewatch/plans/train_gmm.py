"""Gaussian mixture fit by expectation-maximisation over partitions.

Spark's own mixture stops at normalised probabilities, while scoring needs
log-densities of a model with a fixed ridge on the covariances; so the E-step is an
Arrow stage that turns every partition into sufficient statistics, and the M-step
works on their sum.

Statistics are centred moments: sums of differences from each component's last mean, and
of their products.  All partitions take them around the same points, so they add up, and
since a component's mean moves less than its spread, no digits are lost in the update,
however far apart the components lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.network import Mixture
from tidewatch.functions.vectors import VECTOR, one_vector, sum_vectors
from tidewatch.session import cut_lineage, ship_package

# Fixed values.
COMPONENTS, MAX_ITER, TOLERANCE, RIDGE, SEED = 21, 300, 1e-3, 1e-6, 42


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _statistics(x: np.ndarray, weights: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Per component: weight, weighted differences from ``around``, their weighted products."""
    moved, products = [], []
    for j, point in enumerate(around):
        part = x - point
        held = part * weights[:, j, None]
        moved.append(held.sum(0))
        products.append((held.T @ part).ravel())
    return np.concatenate([weights.sum(0), *moved, *products])


def _update(stats: np.ndarray, around: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, d = around.shape
    n = stats[:k] + 10 * np.finfo(float).eps
    step = stats[k : k + k * d].reshape(k, d) / n[:, None]
    covs = stats[k + k * d :].reshape(k, d, d) / n[:, None, None] - step[:, :, None] * step[:, None, :]
    covs = (covs + covs.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)
    return n / n.sum(), around + step, covs


def _sums(rows: DataFrame, partitions: int, part_of) -> np.ndarray:
    """``part_of(matrix)`` of every Arrow batch, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = part_of(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield one_vector(total)

    return sum_vectors(rows.mapInArrow(run, VECTOR), partitions)


def mixture_step(
    rows: DataFrame, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, ridge: float = RIDGE, partitions: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One round of expectation and maximisation over a table of one array column.

    Returns the new weights, means and covariances, and the mean log-likelihood of the old.
    """
    spark = rows.sparkSession
    ship_package(spark)
    if partitions is None:
        partitions = _size(rows)[1]
    means = np.asarray(means, float)
    shared = spark.sparkContext.broadcast((np.asarray(weights, float), means, np.asarray(covs, float)))

    def part_of(x: np.ndarray) -> np.ndarray:
        mixture = Mixture(*shared.value)
        logs = mixture.component_logs(x)
        density = mixture.log_density(x, logs)
        return np.concatenate([[len(x), density.sum()], _statistics(x, np.exp(logs - density[:, None]), mixture.means)])

    s = _sums(rows, partitions, part_of)
    shared.unpersist()
    return *_update(s[2:], means, ridge), float(s[1] / s[0])


def _size(rows: DataFrame) -> tuple[int, int]:
    """Rows, and partitions that have any."""
    return rows.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)), F.count_distinct("p")).first()


def fit_mixture(
    errors: DataFrame,
    column: str = "errors",
    k: int = COMPONENTS,
    max_iter: int = MAX_ITER,
    tolerance: float = TOLERANCE,
    seed: int = SEED,
    ridge: float = RIDGE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Weights, means, covariances and the mean log-likelihood per iteration."""
    spark = errors.sparkSession
    ship_package(spark)
    rows = cut_lineage(errors.select(F.col(column).alias("e")))
    count, partitions = _size(rows)
    if count < k:
        raise ValueError(f"{count} rows cannot fit {k} components")
    start = KMeans(k=k, seed=seed, featuresCol="f", maxIter=20).fit(rows.select(array_to_vector("e").alias("f")))
    centers = np.array(start.clusterCenters())

    def nearest(x: np.ndarray) -> np.ndarray:
        own = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        return _statistics(x, np.eye(len(centers))[own], centers)

    # A cluster the start left empty would have no spread: the ridge keeps it usable.
    weights, means, covs = _update(_sums(rows, partitions, nearest), centers, ridge)
    trace: list[float] = []
    for _ in range(max_iter):
        weights, means, covs, likelihood = mixture_step(rows, weights, means, covs, ridge, partitions)
        trace.append(likelihood)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tolerance:
            break
    return weights, means, covs, trace
