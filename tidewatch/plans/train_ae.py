"""Autoencoder training as a sequence of Spark jobs.

The scaled rows are spread over a fixed number of partitions once.  In every epoch
each partition runs mini-batch Adam on its rows from the broadcast state, and the
row-weighted mean of the partitions' states is the next state.  With one partition
this is the ordinary training loop; the number of partitions is part of the result
and is recorded in the history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import network as net
from tidewatch.functions.vectors import VECTOR, block, one_vector, sum_vectors
from tidewatch.operators.sampling import epoch_order, sample_rows
from tidewatch.session import cut_lineage, ship_package

# Training defaults.
PATIENCE = 25
SCRATCH = {"epochs": 200, "batch": 256, "rate": 1e-3, "patience": PATIENCE}
FINETUNE = {"epochs": 30, "batch": 256, "rate": 1e-4, "patience": None}
GUARDED = {"epochs": 1000, "batch": 32, "rate": 1e-3, "patience": PATIENCE}
GUARD_STRENGTH = 50.0
ROWS_PER_PARTITION = 9_000  # the history records the partitions that follow from it
SUM_FANOUT = 64

HISTORY = "epoch int, loss double, recon_loss double, penalty double, val_loss double, val_recon_loss double, val_penalty double, partitions int"


@dataclass
class TrainingTable:
    """Scaled rows in fixed partitions: ``uid``, ``x0`` ... and ``is_val``."""

    rows: DataFrame
    columns: list[str]
    uid: str
    partitions: int


@dataclass
class Trained:
    layers: list
    history: list[dict] = field(default_factory=list)

    def history_table(self, spark) -> DataFrame:
        names = [c.split()[0] for c in HISTORY.split(", ")]
        whole = {"epoch", "partitions"}
        rows = [
            tuple(None if h.get(n) is None else int(h[n]) if n in whole else float(h[n]) for n in names)
            for h in self.history
        ]
        return spark.createDataFrame(rows, HISTORY)


def training_table(
    df: DataFrame,
    features: Sequence[str],
    n_rows: int,
    uid: str = "flow_uid",
    partitions: int | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> TrainingTable:
    """Lay out scaled rows (with ``is_val``) for training."""
    p = partitions or max(1, n_rows // rows_per_partition)
    names = [f"x{i}" for i in range(len(features))]
    # Order inside a partition is by hash, so the layout does not depend on the input's.
    rows = df.select(F.col(uid).cast("string").alias("uid"), "is_val", *[F.col(f"`{f}`").alias(n) for f, n in zip(features, names)])
    return TrainingTable(cut_lineage(rows.repartition(p, "uid")), names, "uid", p)


def _epoch_job(
    table: TrainingTable, layers: list, state: tuple, epoch: int, batch: int, rate: float, seed: int,
    l1: bool, guard: tuple | None, train: bool,
) -> np.ndarray:
    """Sum over partitions of row-weighted states and of validation errors."""
    spark = table.rows.sparkSession
    shared = spark.sparkContext.broadcast((layers, state, guard))
    columns = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, (theta, moving, m, v, step), anchor = shared.value
        incoming = net.unpack(net.unpack(shape, theta), moving, net.MOVING)
        adam, slices = net.Adam(m, v, step, rate), net.variable_slices(shape)
        mask = net.kernel_mask(shape) * net.L1_KERNEL if l1 else None
        theta, moving = theta.copy(), moving.copy()
        n_train, n_val, val_error, steps = 0, 0, 0.0, 0
        recon_sum, penalty_sum = 0.0, 0.0
        waiting = np.empty((0, len(columns)))

        def update(x):
            nonlocal theta, moving, steps, recon_sum, penalty_sum
            now = net.unpack(shape, theta)
            y, grad, stats = net.gradient(now, x, net.mae_gradient(x), training=True)
            penalty = 0.0
            if mask is not None:
                penalty += float(mask @ np.abs(theta))
                grad = grad + mask * np.sign(theta)
            if anchor is not None:
                omega, star, strength = anchor
                shift = theta - star
                penalty += strength / 2 * float(omega @ (shift * shift))
                grad = grad + strength * omega * shift
            theta = adam.update(theta, net.clip_by_variable(grad, slices))
            if stats:
                fresh = np.concatenate([a for s in stats for a in s])
                moving = net.BN_MOMENTUM * moving + (1 - net.BN_MOMENTUM) * fresh
            recon_sum += float(np.abs(x - y).mean())
            penalty_sum += penalty
            steps += 1

        for arrow in batches:
            x = block(arrow, columns)
            is_val = np.asarray(arrow.column(arrow.schema.get_field_index("is_val")).to_numpy(zero_copy_only=False), bool)
            held = x[is_val]
            if len(held):
                val_error += float(np.abs(held - net.reconstruct(incoming, held)).mean(1).sum())
                n_val += len(held)
            if train:
                x = x[~is_val]
                n_train += len(x)
                waiting = np.concatenate([waiting, x])
                while len(waiting) >= batch:
                    update(waiting[:batch])
                    waiting = waiting[batch:]
        if train and len(waiting):
            update(waiting)
        w = float(n_train)
        per_step = (recon_sum / steps, penalty_sum / steps) if steps else (0.0, 0.0)
        head = [n_val, val_error, w, w * per_step[0], w * per_step[1], w * adam.step]
        yield one_vector(np.concatenate([head, w * theta, w * moving, w * adam.m, w * adam.v]))

    ship_package(spark)
    rows = epoch_order(table.rows, table.uid, seed, epoch) if train else table.rows.filter("is_val")
    total = sum_vectors(rows.select(*columns, "is_val").mapInArrow(run, VECTOR), table.partitions)
    shared.unpersist()
    return total


def train_ae(
    table: TrainingTable,
    layers: list,
    epochs: int,
    batch: int,
    rate: float,
    patience: int | None = PATIENCE,
    l1: bool = True,
    omega: np.ndarray | None = None,
    strength: float = 0.0,
    seed: int = 42,
    on_epoch=None,
) -> Trained:
    """Train and return the best layers by validation (the last ones without patience).

    ``omega`` holds the importance of every weight; moving an important weight away
    from its start costs ``strength / 2 * omega * shift**2``.  Early stopping then
    looks at the reconstruction error alone.
    """
    theta = net.pack(layers)
    moving = net.pack(layers, net.MOVING)
    guard = None if omega is None else (omega, theta.copy(), strength)
    mask = net.kernel_mask(layers) * net.L1_KERNEL if l1 else None
    state = (theta, moving, np.zeros_like(theta), np.zeros_like(theta), 0.0)
    history: list[dict] = []
    best, best_value, idle = (theta, moving), np.inf, 0

    def regular(weights):
        value = float(mask @ np.abs(weights)) if mask is not None else 0.0
        if guard is not None:
            value += strength / 2 * float(omega @ (weights - guard[1]) ** 2)
        return value

    for epoch in range(epochs + 1):
        last = epoch == epochs
        s = _epoch_job(table, layers, state, epoch, batch, rate, seed, l1, guard, train=not last)
        if epoch:  # validation of the state the previous epoch ended with
            recon = s[1] / s[0] if s[0] else float("nan")
            penalty = regular(state[0])
            history[-1] |= {"val_recon_loss": recon, "val_penalty": penalty, "val_loss": recon + penalty}
            if on_epoch:
                on_epoch(history[-1])
            watched = recon if guard is not None else recon + penalty
            if watched < best_value:
                best, best_value, idle = state[:2], watched, 0
            else:
                idle += 1
            if last or (patience is not None and idle >= patience):
                break
        elif last:
            break
        w, size, stats = s[2], len(theta), len(moving)
        if not w:
            raise ValueError("no training rows")
        mean = s[6:] / w
        parts = np.split(mean, [size, size + stats, 2 * size + stats])
        state = (parts[0], parts[1], parts[2], parts[3], s[5] / w)
        history.append(
            {"epoch": epoch, "recon_loss": s[3] / w, "penalty": s[4] / w, "loss": (s[3] + s[4]) / w, "partitions": table.partitions}
        )
    chosen = best if patience is not None and history else state[:2]
    return Trained(net.unpack(net.unpack(layers, chosen[0]), chosen[1], net.MOVING), history)


def importance(
    scaled: DataFrame,
    columns: Sequence[str],
    layers: list,
    uid: str = "flow_uid",
    n: int | None = None,
    normalize: bool = True,
    per_row: bool = False,
    seed: int = 42,
) -> np.ndarray:
    """Importance of every weight for the network's output on the given scaled rows.

    The gradient of the summed squared output is squared and divided by the row
    count; ``per_row`` takes the mean of squared per-row gradients instead.
    """
    if n is not None and scaled.count() > n:
        scaled = sample_rows(scaled, n, uid, seed)
    spark = scaled.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(layers)
    names = [f"x{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = 0.0, 0
        for arrow in batches:
            x = block(arrow, names)
            if len(x):
                _, g, _ = net.gradient(shared.value, x, lambda y: 2.0 * y, training=False, squared=per_row)
                total, rows = total + g, rows + len(x)
        if rows:
            yield one_vector(np.concatenate([[rows], total]))

    rows = scaled.select(*[F.col(f"`{c}`").alias(nm) for c, nm in zip(columns, names)])
    s = sum_vectors(rows.mapInArrow(run, VECTOR), SUM_FANOUT)
    if s is None:
        raise ValueError("no rows to compute importance on")
    omega = (s[1:] if per_row else s[1:] ** 2) / s[0]
    top = omega.max()
    return omega / top if normalize and top > 0 else omega
