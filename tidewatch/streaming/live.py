"""Streams around the scoring engine: packets in, labelled flows out, drift watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.columns import require_features, unparsed_by
from tidewatch.operators import routing, scoring, stats
from tidewatch.plans.engine import Engine
from tidewatch.schemas import PACKETS
from tidewatch.session import prepare, stage_table, staging_area
from tidewatch.sources import flow_csv
from tidewatch.streaming.flows import FlowStream

# The columns Spark's file listing source has.
FILES = "path string, modificationTime timestamp, length long, content binary"


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """Packets arriving as files; other sources need only the packet columns."""
    reader = prepare(spark).readStream.schema(PACKETS).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def score_live(engine: Engine, root: str, scope: str = "live", **stream_options) -> FlowStream:
    """A flow stream whose flows are scored, stored and routed batch by batch.

    The current model is looked up for every batch, so an accepted adaptation takes
    effect with the next one.
    """

    def on_flows(flows: DataFrame, token: str) -> None:
        engine.predict(flows, scope=scope, token=f"{scope}-{token}")

    return FlowStream(engine.spark, root, on_flows=on_flows, **stream_options)


def watch_directory(
    engine: Engine, directory: str, checkpoint: str, scope: str = "watch", files_per_trigger: int = 1000, **trigger
) -> StreamingQuery:
    """Score every CSV file that appears, each file as its own confidence scope.

    The stream lists files without reading them; a file that cannot be read, lacks
    features or has text where numbers belong goes to quarantine and the others are
    scored.
    """
    spark = engine.spark
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv")
    reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    listing = reader.load(directory).select("path")

    def process(batch: DataFrame, batch_id: int) -> None:
        with staging_area(spark):
            score_files(batch, batch_id)

    def score_files(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # names only, one trigger's files
        groups, failed = flow_csv.group_dialects(spark, paths)
        bundle = engine.current()
        for i, (header, files) in enumerate(sorted(groups.items())):
            try:
                rows = flow_csv.read_dialect(spark, files, header, places=True).drop(flow_csv.BLOCK, flow_csv.ROW)
                require_features(rows.columns, bundle.feature_names)
            except ValueError as error:
                failed |= {f: str(error) for f in files}
                continue
            rows = stage_table(rows)  # text is parsed once for the check and the scores
            # By path: files of other folders may have the same name.
            bad_files = unparsed_by(rows, flow_csv.PATH, bundle.feature_names).collect()  # one row per file
            failed |= {r[flow_csv.PATH]: f"{r['unparsed']} cells are no numbers" for r in bad_files}
            good = rows.filter(~F.col(flow_csv.PATH).isin([r[flow_csv.PATH] for r in bad_files]))
            engine.predict(
                good.drop(flow_csv.PATH), scope=scope, bundle=bundle, token=f"{scope}-{batch_id:09d}-{i}", scope_column=flow_csv.SOURCE
            )
        if failed:
            bad = spark.createDataFrame(sorted(failed.items()), engine.quarantine.schema)
            engine.quarantine.append(bad.coalesce(1), token=f"{scope}-{batch_id:09d}")

    writer = listing.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drift_alerts(
    scored: DataFrame, time: str, window: str = "1 minute", delay: str = "10 seconds",
    rate: float = stats.ALERT_RATE, rows: int = stats.ALERT_ROWS,
) -> DataFrame:
    """Windows of a stream of labelled rows whose attack rate calls for adaptation."""
    flag = F.when(F.col("prediction") == scoring.ATTACK, 1).otherwise(0)
    counts = (
        scored.withWatermark(time, delay)
        .groupBy(F.window(time, window))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("attacks"))
    )
    return counts.select(
        F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n", "attacks",
        (F.col("attacks") / F.col("n")).alias("attack_rate"),
    ).filter((F.col("attack_rate") >= rate) & (F.col("n") >= rows))


def route_stream(engine: Engine, scored: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Send an already labelled stream to the benign and attack buffers."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            engine.benign.add(routing.benign_rows(batch), f"route-{batch_id}")
            engine.attack.add(routing.attack_rows(batch, engine.attack_conf), f"route-{batch_id}")
        finally:
            batch.unpersist()

    writer = scored.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
