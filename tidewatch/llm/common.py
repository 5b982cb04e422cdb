"""What several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidewatch.session import ensure_checkpoint_dir, ship_package, stage_table

# A table is broadcast only when its stored form is counted and below this many bytes.
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64  # of any row in a hashed relation
BATCH_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def join_checked(
    big: DataFrame, small: DataFrame, on: list[str] | Column, how: str = "inner", row_bytes: int | Column = 64
) -> DataFrame:
    """Join a stored table: broadcast if its measured size stays below ``BROADCAST_BYTES``.

    ``small`` must be staged.  ``row_bytes`` bounds a row (``ROW_BYTES`` at least), or is
    an expression for rows of unbounded width.  A larger table is joined by a shuffle
    whose hot keys adaptive execution splits.
    """
    if isinstance(row_bytes, int):
        size = small.count() * max(row_bytes, ROW_BYTES)
    else:
        size = small.agg(F.sum(row_bytes + ROW_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def map_rows(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """Arrow batches as dicts of Python lists in, lists of tuples out.

    Python integers keep 64 bits beside nulls, which pandas columns would not.
    """
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in function(batch.to_pydict() for batch in batches):
            for start in range(0, len(rows), BATCH_ROWS):
                columns = list(zip(*rows[start : start + BATCH_ROWS], strict=True))
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name the table does not use yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


__all__ = ["BATCH_ROWS", "BROADCAST_BYTES", "fresh_name", "join_checked", "map_rows", "shared_folder", "stage_table", "table"]
