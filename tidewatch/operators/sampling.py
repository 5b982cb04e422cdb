"""Exact, repeatable samples, splits and unions.

Random choices are orders by a hash of the row id and a seed: the same rows are
chosen whatever the partitioning, and a lost executor changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ranks import smallest

# Shares used by adaptation.  Row caps are the caller's choice.
REPLAY_SEED_SHARE = 0.30
REPLAY_BATCH_SHARE = 0.30
VALIDATION_SHARE = 0.15

_DIGITS = 13  # 52 bits: whole numbers a double holds exactly
HASH_RANGE = 16**_DIGITS


def hash_order(uid: str, seed: int) -> Column:
    """A uniform whole number per row id and seed."""
    text = F.md5(F.concat(F.col(uid).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(text, 1, _DIGITS), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, uid: str = "flow_uid", seed: int = 42, count: int | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    return df.filter(smallest(df, hash_order(uid, seed), uid, n, count=count, uniform=HASH_RANGE))


def cap_rows(df: DataFrame, cap: int | None, uid: str = "flow_uid", seed: int = 42, count: int | None = None) -> DataFrame:
    """The table itself up to ``cap`` rows, else a sample of that size."""
    if cap is None:
        return df
    count = df.count() if count is None else count
    return df if count <= cap else sample_rows(df, cap, uid, seed, count)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows smallest by a unique whole-number column."""
    return df.filter(smallest(df, F.col(order), order, n))


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows largest by a unique whole-number column."""
    if n <= 0:
        return df.limit(0)
    return df.filter(smallest(df, -F.col(order), order, n))


def replay_size(n_new: int, n_replay: int, ratio: float) -> int:
    """Replay rows that make ``ratio`` of the mixed table, at most all there are."""
    if ratio <= 0 or n_replay == 0:
        return 0
    wanted = n_replay if ratio >= 1.0 else int(ratio * n_new / (1 - ratio))
    return min(wanted, n_replay)


def mix_replay(new: DataFrame, replay: DataFrame, ratio: float, uid: str = "flow_uid", seed: int = 42) -> DataFrame:
    """New rows and a sample of replay rows, marked by ``from_replay``."""
    n_old = replay.count()
    chosen = sample_rows(replay, replay_size(new.count(), n_old, ratio), uid, seed, n_old)
    return new.withColumn("from_replay", F.lit(False)).unionByName(chosen.withColumn("from_replay", F.lit(True)))


def train_val_split(
    df: DataFrame, share: float = VALIDATION_SHARE, uid: str = "flow_uid", seed: int = 42, count: int | None = None
) -> DataFrame:
    """Add ``is_val`` for exactly ``max(1, int(rows * share))`` rows."""
    count = df.count() if count is None else count
    return df.withColumn("is_val", smallest(df, hash_order(uid, seed), uid, max(1, int(count * share)), count=count, uniform=HASH_RANGE))


@dataclass(frozen=True)
class Composition:
    n_replay: int
    n_new: int


def composition(n_new: int, n_replay: int, cap: int | None = None, replay_cap: int | None = None) -> Composition:
    """Row counts of an incremental training table; all rows unless capped."""
    limits = [n_replay, replay_cap, None if cap is None else int(cap * REPLAY_BATCH_SHARE)]
    replay = min(x for x in limits if x is not None)
    return Composition(replay, n_new if cap is None else min(n_new, cap - replay))


def replay_seed_size(n_rows: int, cap: int | None = None) -> int:
    """Rows put into the replay buffer after an accepted adaptation."""
    wanted = int(n_rows * REPLAY_SEED_SHARE)
    return wanted if cap is None else min(wanted, cap)


def epoch_order(df: DataFrame, uid: str, seed: int, epoch: int) -> DataFrame:
    """Reshuffle the rows inside each partition for one epoch."""
    return df.sortWithinPartitions(F.xxhash64(F.col(uid).cast("string"), F.lit(seed), F.lit(epoch)))
