"""Flow CSV files: any header dialect in, canonical columns out; results back to CSV."""

from __future__ import annotations

import csv
import gzip
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import ASSEMBLED, canonical_name, canonicalize, quoted, shown_label
from tidewatch.operators.sampling import first_rows
from tidewatch.session import file_system, ship_package, stage_table
from tidewatch.sources.files import open_input

SOURCE = "source_file"
PATH, BLOCK, ROW = "_file_path", "_file_block", "_file_row"
HEADER_BLOCK = 1 << 16


def header_line(path: str) -> str:
    """The first line of a file; only as many blocks as it takes are read."""
    raw, start = open_input(path), b""
    with gzip.open(raw) if path.endswith(".gz") else raw as file:
        while b"\n" not in start:
            block = file.read(HEADER_BLOCK)
            if not block:
                break
            start += block
    line = start.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
    if not line:
        raise ValueError(f"{path} is empty")
    return line


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The non-empty files a path, directory or pattern stands for, sorted by name."""
    fs, pattern = file_system(spark, path)
    found = fs.globStatus(pattern)
    if not found:
        raise FileNotFoundError(path)
    files = []
    for status in found:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        files += [
            f.getPath().toString() for f in inner
            if not f.isDirectory() and f.getLen() and not f.getPath().getName().startswith(("_", "."))
        ]
    return sorted(files)


def header_lines(paths: DataFrame) -> DataFrame:
    """(path, line, reason): the header line of each file, or why it cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append((path, header_line(path), None))
                except (OSError, ValueError) as error:  # reported, the others go on
                    rows.append((path, None, str(error).splitlines()[0]))
            yield pd.DataFrame(rows, columns=["path", "line", "reason"])

    ship_package(paths.sparkSession)
    return paths.select("path").mapInPandas(run, "path string, line string, reason string")


def group_dialects(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[tuple[str, ...], list[str]], dict[str, str]]:
    """Files by header line, and the files whose header cannot be read with the reason.

    One job reads the first block of every file; a row per file comes back.
    """
    if not paths:
        return {}, {}
    tasks = min(len(paths), 8 * spark.sparkContext.defaultParallelism)
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    groups: dict[tuple[str, ...], list[str]] = {}
    failed: dict[str, str] = {}
    for path, line, reason in sorted(header_lines(names).collect()):
        if reason:
            failed[path] = reason
        else:
            groups.setdefault(tuple(next(csv.reader([line]))), []).append(path)
    return groups, failed


def read_dialect(spark: SparkSession, paths: Sequence[str], header: Sequence[str], places: bool = False) -> DataFrame:
    """Files that share one header, every cell as text under canonical names.

    ``places`` adds where a row comes from: ``PATH``, ``BLOCK`` (where in the file its
    block starts) and ``ROW``, a number that grows inside a block.
    """
    slots = [f"_{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(s, T.StringType()) for s in slots])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(list(paths))
    place = [F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(BLOCK)]
    place = [*place, F.monotonically_increasing_id().alias(ROW)] if places else []
    raw = raw.select(*slots, F.col("_metadata.file_name").alias(SOURCE), *place)
    return canonicalize(raw, [*header, SOURCE, *[c for c in (PATH, BLOCK, ROW) if places]])


def read_flow_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    header: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    places: bool = False,
) -> DataFrame:
    """Flow CSVs as text columns under canonical names plus ``source_file``.

    With ``header`` all files (or directories) are taken to have it and nothing is
    read ahead; otherwise the first line of every file decides, in directories too.  ``drop``
    names raw header cells to leave out; ``places`` as in ``read_dialect``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if header is not None:
        groups = {tuple(header): paths}
    else:
        groups, failed = group_dialects(spark, [f for p in paths for f in csv_files(spark, p)])
        if failed:
            raise ValueError(f"unreadable flow files: {failed}")
    parts = []
    for cells, files in groups.items():
        part = read_dialect(spark, files, _without(cells, drop), places)
        parts.append(part.drop(*[c for c in part.columns if c.startswith("_drop")]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _without(header: Sequence[str], drop: Sequence[str]) -> list[str]:
    """Mark dropped cells so that positions stay right."""
    return [f"_drop{i}" if cell in drop else cell for i, cell in enumerate(header)]


def list_csv(spark: SparkSession, directory: str) -> DataFrame:
    """The non-empty CSV files of a directory, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a result as CSV with a header; a missing human label shows as a dash."""
    if "human_label" in df.columns:
        df = shown_label(df)
    df.write.mode(mode).option("header", True).csv(path)


def first_in_files(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order, of a table read with its places.

    Rows are counted per block of a file, one row each; the block in which the ``n``-th
    row lies is the only one whose rows are put in order.
    """
    place = F.struct(PATH, BLOCK)
    # Row numbers are only compared inside a block: other plans may number them differently.
    blocks = stage_table(df.groupBy(PATH, BLOCK).agg(F.count(F.lit(1)).alias("rows")))
    upto = F.sum("rows").over(Window.orderBy(PATH, BLOCK))
    cut = blocks.withColumn("before", upto - F.col("rows")).filter(F.col("before") + F.col("rows") > n).orderBy(PATH, BLOCK).first()
    if cut is None:
        return df.drop(PATH, BLOCK, ROW)
    edge = F.struct(F.lit(cut[PATH]).alias(PATH), F.lit(cut[BLOCK]).cast("long").alias(BLOCK))
    whole = df.filter(place < edge)
    last = stage_table(df.filter(place == edge))
    return whole.unionByName(first_rows(last, ROW, n - cut["before"])).drop(PATH, BLOCK, ROW)


def assemble_datasets(
    spark: SparkSession,
    benign: DataFrame,
    datasets: dict[str, tuple[DataFrame | str, int]],
    order_col: str | None = None,
    columns: Sequence[str] = tuple(ASSEMBLED),
    label: str = "Label",
    benign_label: str = "BENIGN",
    drop: Sequence[str] = (" Fwd Header Length.1",),
) -> DataFrame:
    """Benign rows plus the first ``n`` attack rows of every named dataset.

    A dataset is a path to CSV files, whose rows are taken in file order (files by path),
    or a DataFrame with raw header names.  ``order_col``, a unique whole-number column of
    the data, says what comes first instead; a DataFrame needs it.
    """
    parts = [benign.select(*[quoted(c) for c in columns])]
    for name, (source, n) in datasets.items():
        if isinstance(source, str):
            df = read_flow_csv(spark, source, drop=drop, places=order_col is None)
        elif order_col is None:
            raise ValueError(f"{name}: rows of a DataFrame have no order, name a column")
        else:
            df = canonicalize(source.drop(*drop))
        attacks = df.filter(~quoted(label).eqNullSafe(benign_label))
        if order_col is None:
            attacks = first_in_files(attacks, n)
        else:
            attacks = first_rows(attacks.withColumn("_order", quoted(canonical_name(order_col)).cast("long")), "_order", n)
        parts.append(attacks.select(*[quoted(c) for c in columns]))
    return reduce(lambda a, b: a.unionByName(b), parts)
