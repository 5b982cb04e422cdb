"""Model bundles: one immutable row of arrays per model version."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import network as net
from tidewatch.schemas import FEATURES, MODELS


@dataclass(frozen=True)
class Bundle:
    """Scaler, autoencoder, mixture and threshold of one version."""

    version: str
    scaler_mean: np.ndarray
    scaler_scale: np.ndarray
    layers: list = field(repr=False)
    gmm_weights: np.ndarray
    gmm_means: np.ndarray
    gmm_covs: np.ndarray
    threshold: float
    feature_names: tuple = tuple(FEATURES)
    confidence_scale: float | None = None
    model_id: str = "flow"
    parent: str | None = None
    status: str = "candidate"
    domains_seen: tuple = ()
    created_at: datetime | None = None

    @property
    def dim(self) -> int:
        return len(self.feature_names)

    def mixture(self) -> net.Mixture:
        return net.Mixture(self.gmm_weights, self.gmm_means, self.gmm_covs)

    def errors(self, x_scaled: np.ndarray) -> np.ndarray:
        return np.abs(x_scaled - net.reconstruct(self.layers, x_scaled))

    def with_(self, **changes) -> Bundle:
        return replace(self, **changes)

    def child(self, version: str, **changes) -> Bundle:
        """A new version derived from this one, with one more domain on record."""
        return replace(
            self, version=version, parent=self.version, status="candidate", created_at=None,
            domains_seen=(*self.domains_seen, "adapted"), **changes,
        )


def to_row(b: Bundle) -> Row:
    layers = [
        (f"{i}/{name}", *(a.shape if a.ndim == 2 else (1, a.size)), a.ravel().tolist())
        for i, layer in enumerate(b.layers)
        for name, a in layer.items()
    ]
    return Row(
        b.version, b.model_id, b.parent, b.created_at or datetime.now(timezone.utc), b.status, list(b.domains_seen),
        list(b.feature_names), np.asarray(b.scaler_mean).tolist(), np.asarray(b.scaler_scale).tolist(),
        float(b.threshold), b.confidence_scale, layers, np.asarray(b.gmm_weights).tolist(),
        np.asarray(b.gmm_means).tolist(), [np.asarray(c).ravel().tolist() for c in b.gmm_covs],
    )


def from_row(row: Row) -> Bundle:
    layers: list[dict] = []
    for item in row.ae_layers:
        number, name = item.name.split("/")
        while len(layers) <= int(number):
            layers.append({})
        values = np.array(item["values"])
        layers[int(number)][name] = values.reshape(item.rows, item.cols) if name == "kernel" else values
    d = len(row.feature_names)
    return Bundle(
        version=row.model_version, scaler_mean=np.array(row.scaler_mean), scaler_scale=np.array(row.scaler_scale),
        layers=layers, gmm_weights=np.array(row.gmm_weights), gmm_means=np.array(row.gmm_means),
        gmm_covs=np.array(row.gmm_covs).reshape(-1, d, d), threshold=row.threshold,
        feature_names=tuple(row.feature_names), confidence_scale=row.confidence_scale, model_id=row.model_id,
        parent=row.parent, status=row.status, domains_seen=tuple(row.domains_seen), created_at=row.created_at,
    )


def as_table(spark: SparkSession, bundles: list[Bundle]) -> DataFrame:
    return spark.createDataFrame([to_row(b) for b in bundles], MODELS)


def current_version(promotions: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """One row ``model_version``: the latest accepted version that exists, else the default.

    As with a pointer file, only the newest pointer counts: if its model is gone the
    default is used, not the pointer before it.
    """
    newest = promotions.filter(F.col("action") == "accept").agg(
        F.max_by("model_version", F.struct("promoted_at", "model_version")).alias("model_version")
    )
    known = newest.join(models.select("model_version"), "model_version", "left_semi")
    return known.agg(F.coalesce(F.max("model_version"), F.lit(default)).alias("model_version"))


def random_bundle(dim: int = 18, seed: int = 7, k: int = 3, encoder=None, latent: int = net.LATENT) -> Bundle:
    """Seeded weights for tests and demonstrations."""
    rng = np.random.default_rng(seed)
    layers = net.fresh_network(dim, encoder, latent, seed)
    for layer in layers:
        layer["bias"] = rng.normal(0, 0.1, layer["bias"].shape)
        if "gamma" in layer:
            layer["mean"], layer["var"] = rng.normal(0, 0.1, layer["mean"].shape), rng.uniform(0.5, 1.5, layer["var"].shape)
    spread = rng.normal(0, 0.2, (k, dim, dim))
    return Bundle(
        version=f"random{dim}-{seed}", scaler_mean=rng.normal(0, 1, dim), scaler_scale=rng.uniform(0.5, 2, dim),
        layers=layers, gmm_weights=rng.dirichlet(np.ones(k)), gmm_means=rng.uniform(0, 1.5, (k, dim)),
        gmm_covs=np.einsum("kij,klj->kil", spread, spread) + np.eye(dim) * 0.3, threshold=-20.0,
        feature_names=tuple(FEATURES[:dim]),
    )
