"""Summing per-partition vectors, and feature columns as numpy blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VECTOR = "v array<double>"
FAN = 32


def one_vector(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], type=pa.list_(pa.float64()))], ["v"])


def block(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Rows x columns from an Arrow batch of doubles."""
    if not batch.num_rows:
        return np.empty((0, len(columns)))
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for v in batch.column(0):
            v = np.array(v.values.to_numpy())
            total = v if total is None else total + v
    if total is not None:
        yield one_vector(total)


def sum_vectors(partials: DataFrame, partitions: int) -> np.ndarray | None:
    """Element-wise sum of the vectors a ``mapInArrow`` stage made, one per partition.

    With many partitions a first round of sums on the executors leaves ``FAN``
    vectors, so the driver receives a fixed number whatever the size of the data.
    """
    if partitions > FAN:
        partials = partials.repartition(FAN).mapInArrow(_add, VECTOR)
    rows = [np.array(r["v"]) for r in partials.collect()]
    return np.sum(rows, axis=0) if rows else None
