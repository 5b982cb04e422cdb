"""Session set-up and the checkpoint directory rule."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results rely on (time zone) or that every job profits from.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_ARCHIVE = "tidewatch-workers.zip"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    sc = spark.sparkContext
    if any(name.endswith(_ARCHIVE) for name in sc._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tidewatch-ship-")
    archive = os.path.join(folder, _ARCHIVE)
    shutil.make_archive(archive.removesuffix(".zip"), "zip", root, os.path.basename(os.path.dirname(__file__)))
    sc.addPyFile(archive)


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidewatch") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites for error messages triple the cost of building a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, taking the cluster's own setting first.

    A directory on one machine would be lost with that machine, so a fresh one is
    made only for a local master; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = file_system(spark, path)
    return fs.exists(hadoop_path)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False, and the source removed, if the target is there already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, path = file_system(spark, target)
    fs.mkdirs(path.getParent())
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(hadoop.Path(source), path, no_options)
    except Exception:
        if not fs.exists(path):
            raise
        delete_path(spark, source)
        return False
    return True


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)


_areas = threading.local()


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[None]:
    """Everything staged inside, in this thread, is removed at the end.

    For work that repeats, such as micro-batches, once its results are stored.
    """
    stack = _areas.__dict__.setdefault("stack", [])
    stack.append(f"{ensure_checkpoint_dir(spark)}/area-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete_path(spark, stack.pop())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint directory."""
    if getattr(_areas, "stack", None):
        return stage_table(df)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint directory and read it back.

    Unlike a checkpoint the copy is columnar, so later passes read only the columns
    they need.  For results that several passes use.
    """
    stack = getattr(_areas, "stack", None)
    root = stack[-1] if stack else ensure_checkpoint_dir(df.sparkSession)
    path = f"{root}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
