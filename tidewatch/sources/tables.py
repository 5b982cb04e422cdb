"""Append-only Parquet tables and capped buffers.

Rows are never rewritten: an append is a directory of its own, and a capped buffer
forgets old rows by what its ledger lists.  A repeated append with the
same token (a retried micro-batch) replaces its own directory and counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ranks import kth_value, smallest
from tidewatch.operators.sampling import sample_rows
from tidewatch.session import delete_path, file_system, path_exists, rename_new


class AppendTable:
    """A Parquet table to which whole DataFrames are appended."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, df: DataFrame, token: str | None = None) -> str:
        token = token or uuid.uuid4().hex
        if self.schema is not None:
            known = [c for c in df.columns if c in self.schema.fieldNames()]
            empty = self.spark.createDataFrame([], self.schema)
            df = empty.unionByName(df.select(*[F.col(f"`{c}`") for c in known]), allowMissingColumns=True)
        df.write.mode("overwrite").parquet(self._part(token))
        return token

    def _part(self, token: str) -> str:
        # The letter keeps Spark from reading a number into it.
        return f"{self.path}/part=t{token}"

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def tokens(self) -> list[str]:
        """Tokens of the complete appends, sorted; only folder names are listed."""
        fs, root = file_system(self.spark, self.path)
        if not fs.exists(root):
            return []
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [f.getPath() for f in fs.listStatus(root)]
        return sorted(p.getName().removeprefix("part=t") for p in found if fs.exists(marker(p, "_SUCCESS")))

    def read(self, token: str | None = None) -> DataFrame:
        """All rows, or those of one append (only its files are listed)."""
        if not self.exists():
            if self.schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        if token is not None:
            return reader.parquet(self._part(token))
        return reader.option("mergeSchema", self.schema is None).parquet(self.path).drop("part")

    def read_all(self, tokens: list[str]) -> DataFrame:
        """The rows of these appends."""
        return self.spark.read.option("mergeSchema", True).parquet(*[self._part(t) for t in dict.fromkeys(tokens)])


class Snapshots:
    """A small table kept as numbered versions; the newest complete one counts.

    Readers list one folder and read one version, however long the history is; old
    versions are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 10):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def versions(self) -> list[int]:
        """The newest complete versions; older ones are empty folders, so no number is used twice."""
        fs, root = file_system(self.spark, self.path)
        if not fs.exists(root):
            return []
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        found, done = {int(f.getPath().getName().split("=")[1]): f.getPath() for f in fs.listStatus(root)}, []
        for number in sorted(found, reverse=True):
            if fs.exists(marker(found[number], "_SUCCESS")):
                done.append(number)
            elif len(done) > self.keep:
                break
        return done[::-1]

    def _dir(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def latest(self, before: int | None = None) -> tuple[int | None, list[Row]]:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return None, []
        return known[-1], self.spark.read.schema(self.schema).parquet(self._dir(known[-1])).collect()

    def write(self, rows: list[tuple], version: int) -> None:
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("overwrite").parquet(self._dir(version))
        self._forget()

    def commit(self, rows: list[tuple], version: int) -> bool:
        """Write a version that must not exist yet; False if another writer was first."""
        aside = f"{self.path}-aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(aside)
        if not rename_new(self.spark, aside, self._dir(version)):
            return False
        self._forget()
        return True

    def _forget(self) -> None:
        for old in self.versions()[: -self.keep]:
            fs, path = file_system(self.spark, self._dir(old))
            # The mark goes first: a version without it counts as gone.
            names = sorted((f.getPath() for f in fs.listStatus(path)), key=lambda p: p.getName() != "_SUCCESS")
            for name in names:
                fs.delete(name, True)


LEDGER = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("from_ord", T.LongType()),
        T.StructField("token", T.StringType()),
        T.StructField("folder", T.StringType()),
    ]
)


class Buffer:
    """A table of samples that keeps the newest ``cap`` rows.

    Each batch is a folder of its own name.  The ledger holds one line per batch still
    in use: its number, rows and from which position on they count.  A writer commits the
    next version of the ledger; if another one did so first, it tries again on top of
    that, so no batch is lost.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int | None = None):
        self.spark, self.path, self.cap = spark, path, cap
        self.ledger = Snapshots(spark, f"{path}/ledger", LEDGER)

    def _lines(self) -> tuple[int, list[Row]]:
        """The number of the next batch and the lines, oldest batch first."""
        version, lines = self.ledger.latest()
        return (0 if version is None else version + 1), sorted(lines, key=lambda r: r.batch)

    def _data(self, folder: str) -> str:
        return f"{self.path}/data/folder={folder}"

    def add(self, df: DataFrame, token: str | None = None) -> int:
        """Append rows; returns how many were added (0 for an empty or repeated batch)."""
        if token is not None and any(r.token == token for r in self._lines()[1]):
            return 0
        folder = uuid.uuid4().hex
        df.withColumn("_ord", F.monotonically_increasing_id()).write.parquet(self._data(folder))
        rows = self.spark.read.parquet(self._data(folder)).count()
        while rows:
            batch, lines = self._lines()
            if token is not None and any(r.token == token for r in lines):
                rows = 0
                break
            kept = self._trimmed([*map(tuple, lines), (batch, rows, 0, token, folder)])
            if self.ledger.commit(kept, batch):
                held = {line[4] for line in kept}
                for line in lines:
                    if line.folder not in held:
                        delete_path(self.spark, self._data(line.folder))
                return rows
        delete_path(self.spark, self._data(folder))
        return rows

    def _trimmed(self, lines: list[tuple]) -> list[tuple]:
        """Drop the oldest rows beyond the cap: whole batches, and a part of one."""
        if self.cap is None or sum(line[1] for line in lines) <= self.cap:
            return lines
        out, kept = [], 0
        for batch, rows, from_ord, token, folder in reversed(lines):
            keep = min(rows, self.cap - kept)
            if keep <= 0:
                break
            if keep < rows:
                part = self.spark.read.parquet(self._data(folder)).filter(F.col("_ord") >= from_ord)
                newest = part.filter(smallest(part, -F.col("_ord"), "_ord", keep, count=rows))
                from_ord = newest.agg(F.min("_ord")).first()[0]
            out.append((batch, keep, from_ord, token, folder))
            kept += keep
        return out[::-1]

    def load(self) -> DataFrame | None:
        """The rows now held; None when there are none."""
        _, lines = self._lines()
        if not lines:
            return None
        paths = [self._data(r.folder) for r in lines]
        df = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*paths)
        oldest = lines[0]
        # Only the oldest batch may be cut.
        return df.filter((F.col("folder") != oldest.folder) | (F.col("_ord") >= oldest.from_ord)).drop("_ord", "folder")

    def sample(self, n: int, uid: str = "flow_uid", seed: int = 42) -> DataFrame | None:
        df = self.load()
        return None if df is None else sample_rows(df, n, uid, seed)

    @property
    def count(self) -> int:
        return sum(r.rows for r in self._lines()[1])

    @property
    def is_empty(self) -> bool:
        return self.count == 0

    def clear(self) -> None:
        while not self.ledger.commit([], self._lines()[0]):
            pass


def keep_last(df: DataFrame, batch: str, seq: str, cap: int) -> DataFrame:
    """The newest ``cap`` rows of a table of numbered batches.

    The batch of the ``cap``-th row from the end is cut; only inside it are rows ranked.
    """
    from tidewatch.operators.sampling import last_rows

    if cap <= 0:
        return df.limit(0)
    count = df.count()
    if count <= cap:
        return df
    cut = -kth_value(df, -F.col(batch), cap, count)
    newer = df.filter(F.col(batch) > cut)
    return newer.unionByName(last_rows(df.filter(F.col(batch) == cut), seq, cap - newer.count()))
