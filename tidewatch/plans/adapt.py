"""Adaptation jobs: from scratch, incremental with replay, or fine-tuning.

Each returns a candidate bundle beside the live one; nothing is replaced until the
candidate is accepted.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import network as net
from tidewatch.functions.columns import project_features
from tidewatch.operators import sampling, scoring, stats
from tidewatch.operators.bundle import Bundle
from tidewatch.plans import train_ae as ta
from tidewatch.plans.train_gmm import COMPONENTS, MAX_ITER, fit_mixture
from tidewatch.schemas import FEATURES
from tidewatch.session import stage_table

INITIAL, INCREMENTAL, FINETUNE = "initial", "incremental", "finetune"


@dataclass
class Candidate:
    """A new bundle and what a reviewer needs to judge it."""

    bundle: Bundle
    mode: str
    scores: DataFrame
    percentiles: dict[str, float]
    score_min: float
    score_max: float
    score_mean: float
    n_rows: int
    n_replay: int
    trained: ta.Trained
    likelihood: list[float]

    def history(self) -> DataFrame:
        return self.trained.history_table(self.scores.sparkSession)

    def with_threshold(self, mode: str = "auto", value: float | str | None = None) -> Candidate:
        self.bundle = self.bundle.with_(threshold=stats.choose_threshold(self.scores, mode, value))
        return self


def scaler_id(bundle: Bundle) -> str:
    """Scaled rows are only comparable under the scaler that made them."""
    text = np.concatenate([np.asarray(bundle.scaler_mean), np.asarray(bundle.scaler_scale)]).astype("<f8").tobytes()
    return hashlib.md5(text).hexdigest()


def scaled_rows(flows: DataFrame, bundle: Bundle, uid: str = "flow_uid") -> DataFrame:
    """``uid`` and the standardised features under their own names."""
    columns = scoring.scaled(bundle)
    return flows.select(F.col(uid), *[c.alias(n) for c, n in zip(columns, bundle.feature_names)])


def choose_mode(replay: DataFrame | None) -> str:
    """From scratch without replay rows, else incremental."""
    return INITIAL if replay is None or replay.isEmpty() else INCREMENTAL


def _finish(
    mode: str, rows: DataFrame, bundle: Bundle, trained: ta.Trained, scored_rows: str, n_rows: int, n_replay: int,
    components: int, max_iter: int, threshold_mode: str, threshold: float | None,
) -> Candidate:
    """Refit the mixture on all rows, score, choose a threshold.

    ``rows`` holds scaled features and ``is_val``; the network part of the bundle is
    already the new one.
    """
    spark = rows.sparkSession
    x = [F.col(f"`{f}`") for f in bundle.feature_names]
    errors = rows.select(scoring.error_vector(spark, bundle, x).alias("errors"))
    weights, means, covs, trace = fit_mixture(errors, k=components, max_iter=max_iter)
    bundle = bundle.with_(gmm_weights=weights, gmm_means=means, gmm_covs=covs)
    judged = rows.filter("is_val") if scored_rows == "val" else rows
    scores = stage_table(judged.select("uid", scoring.score_struct(spark, bundle, x)["score_raw"].alias("score_raw")))
    lo, hi, mean = stats.score_range(scores).first()
    percentiles = stats.percentile_dict(scores)
    chosen = percentiles["p5"] if threshold_mode == "auto" else stats.choose_threshold(scores, threshold_mode, threshold)
    return Candidate(
        bundle.with_(threshold=chosen), mode, scores, percentiles, lo, hi, mean, n_rows, n_replay, trained, trace
    )


def _version(given: str | None) -> str:
    return given or f"adapted-{uuid.uuid4().hex[:12]}"


def adapt_initial(
    flows: DataFrame, features=FEATURES, uid: str = "flow_uid", version: str | None = None, parent: Bundle | None = None,
    cap: int | None = None, components: int = COMPONENTS, max_iter: int = MAX_ITER,
    encoder=None, latent: int = net.LATENT, seed: int = 42, partitions: int | None = None,
    threshold_mode: str = "auto", threshold: float | None = None, **training,
) -> Candidate:
    """Everything from scratch; all flows count as normal."""
    clean = project_features(flows, features, keep=[uid])
    clean = stage_table(sampling.cap_rows(clean, cap, uid, seed))
    n = clean.count()
    fit = stats.scaler_fit(clean, features).orderBy("position").collect()
    empty = np.empty(0)
    bundle = Bundle(
        version=_version(version), scaler_mean=np.array([r["mean"] for r in fit]),
        scaler_scale=np.array([r["scale"] for r in fit]), layers=net.fresh_network(len(features), encoder, latent, seed),
        gmm_weights=empty, gmm_means=empty.reshape(0, len(features)), gmm_covs=empty.reshape(0, len(features), len(features)),
        threshold=0.0, feature_names=tuple(features), parent=parent.version if parent else None,
        model_id=parent.model_id if parent else "flow",
        domains_seen=(*(parent.domains_seen if parent else ()), "adapted"),
    )
    split = sampling.train_val_split(scaled_rows(clean, bundle, uid), uid=uid, seed=seed, count=n)
    split = stage_table(split.withColumnRenamed(uid, "uid"))
    table = ta.training_table(split, features, n, "uid", partitions)
    trained = ta.train_ae(table, bundle.layers, seed=seed, **(ta.SCRATCH | training))
    bundle = bundle.with_(layers=trained.layers)
    # The mixture starts empty, so the error step must not need it.
    bundle = bundle.with_(gmm_weights=np.ones(1), gmm_means=np.zeros((1, len(features))), gmm_covs=np.eye(len(features))[None])
    return _finish(INITIAL, split, bundle, trained, "val", n, 0, components, max_iter, threshold_mode, threshold)


def adapt_incremental(
    flows: DataFrame, live: Bundle, replay: DataFrame, uid: str = "flow_uid", version: str | None = None,
    ratio: float = sampling.REPLAY_BATCH_SHARE, strength: float = ta.GUARD_STRENGTH,
    cap: int | None = None, components: int | None = None, max_iter: int = MAX_ITER, seed: int = 42,
    importance_rows: int | None = None, per_row: bool = False, partitions: int | None = None,
    threshold_mode: str = "auto", threshold: float | None = None, **training,
) -> Candidate:
    """New flows mixed with replay rows (scaled), important weights held in place."""
    features = list(live.feature_names)
    names = [uid, *features]
    new = scaled_rows(flows, live, uid)
    n_new, n_old = new.count(), replay.count()
    sizes = sampling.composition(n_new, n_old, cap)
    new = sampling.cap_rows(new, sizes.n_new, uid, seed, n_new)
    old = stage_table(sampling.cap_rows(replay.select(*[F.col(f"`{c}`") for c in names]), sizes.n_replay, uid, seed, n_old))
    omega = ta.importance(old, features, live.layers, uid, importance_rows, per_row=per_row, seed=seed)
    mixed = stage_table(sampling.mix_replay(new, old, ratio, uid, seed))
    n = mixed.count()
    # A flow may be in both parts; the split needs ids of its own.
    own = mixed.withColumn("uid", F.concat(F.col(uid).cast("string"), F.when(F.col("from_replay"), ":replay").otherwise(":new")))
    split = stage_table(sampling.train_val_split(own, uid="uid", seed=seed, count=n))
    table = ta.training_table(split, features, n, "uid", partitions)
    trained = ta.train_ae(
        table, live.layers, l1=False, omega=omega, strength=strength, seed=seed, **(ta.GUARDED | training)
    )
    bundle = live.child(_version(version), layers=trained.layers)
    k = components or len(live.gmm_weights)
    return _finish(
        INCREMENTAL, split, bundle, trained, "val", n, n - min(n_new, sizes.n_new), k, max_iter, threshold_mode, threshold
    )


def adapt_finetune(
    flows: DataFrame, live: Bundle, uid: str = "flow_uid", version: str | None = None, components: int | None = None,
    max_iter: int = MAX_ITER, seed: int = 42, partitions: int | None = None, cap: int | None = None,
    threshold_mode: str = "auto", threshold: float | None = None, **training,
) -> Candidate:
    """Warm start under the existing scaler; scores of all rows decide."""
    features = list(live.feature_names)
    rows = sampling.cap_rows(scaled_rows(flows, live, uid), cap, uid, seed).withColumnRenamed(uid, "uid")
    n = rows.count()
    split = stage_table(sampling.train_val_split(rows, uid="uid", seed=seed, count=n))
    table = ta.training_table(split, features, n, "uid", partitions)
    trained = ta.train_ae(table, live.layers, seed=seed, **(ta.FINETUNE | training))
    bundle = live.child(_version(version), layers=trained.layers)
    k = components or len(live.gmm_weights)
    return _finish(FINETUNE, split, bundle, trained, "all", n, 0, k, max_iter, threshold_mode, threshold)


def adapt(
    flows: DataFrame, mode: str | None = None, live: Bundle | None = None, replay: DataFrame | None = None, **options
) -> Candidate:
    """Run one adaptation; without a mode, replay rows decide between the first two."""
    mode = mode or choose_mode(replay)
    if mode == INITIAL:
        return adapt_initial(flows, parent=live, **options)
    if live is None:
        raise ValueError(f"{mode} adaptation needs a live model")
    if mode == INCREMENTAL:
        if replay is None or replay.isEmpty():
            raise ValueError("incremental adaptation needs replay rows")
        return adapt_incremental(flows, live, replay, **options)
    if mode == FINETUNE:
        return adapt_finetune(flows, live, **options)
    raise ValueError(f"unknown mode {mode}")
