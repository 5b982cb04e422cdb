import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_flows import A, B, S, frame, pk, traffic

from tidewatch.operators import flows as fl
from tidewatch.operators.bundle import random_bundle
from tidewatch.plans.engine import Engine
from tidewatch.schemas import FEATURES
from tidewatch.streaming import live
from tidewatch.streaming import state as st
from tidewatch.streaming.flows import FlowStream


def fresh():
    return tempfile.mkdtemp(prefix="tidewatch-test-")


def rows(df):
    cols = ["flow_uid", "packets", *FEATURES]
    return sorted(tuple(round(r[c], 2) if c in FEATURES else r[c] for c in cols) for r in df.collect())


def run(spark, batches, **options):
    """Each list of packets becomes one file and one micro-batch."""
    folder = fresh()
    for part in batches:
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    stream = FlowStream(spark, fresh(), **options)
    query = stream.start(live.packet_stream(spark, folder, files_per_trigger=1), fresh())
    query.awaitTermination()
    return stream


def test_stream_gives_the_batch_flows(spark):
    packets = traffic(11, n=240)
    a, b, c = packets[:90], packets[80:170], packets[170:]
    a, b = packets[:80] + packets[90:100], packets[80:90] + packets[100:170]  # out of order across files
    stream = run(spark, [a, b, c], delay="60 seconds", rows_per_task=40)
    stream.flush()
    want = fl.build_flows(frame(spark, packets), hot_rows=None)
    assert rows(stream.flows()) == rows(want)
    assert stream.progress.read().agg(F.sum("packets"), F.sum("late")).first() == (240, 0)


def test_a_flush_ends_one_capture_and_the_next_begins(spark):
    first, second = traffic(5, n=120), traffic(6, n=120)
    folder, root, checkpoint = fresh(), fresh(), fresh()
    for part in (first, second):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        stream = FlowStream(spark, root, delay="60 seconds")  # as after a restart
        stream.start(live.packet_stream(spark, folder, files_per_trigger=1), checkpoint).awaitTermination()
        stream.flush()
        stream.flush()
        assert stream.open_flows == 0
    got = sorted((r["packets"], r["end_reason"]) for r in stream.flows().collect())
    want = [r for part in (first, second) for r in fl.build_flows(frame(spark, part), hot_rows=None).collect()]
    assert got == sorted((r["packets"], r["end_reason"]) for r in want)
    assert stream.progress.read().agg(F.sum("packets"), F.sum("late")).first() == (240, 0)


def test_late_rows_idle_ends_and_flush(spark):
    k1, k2 = (A, B), (("10.0.0.9", 1), ("10.0.0.8", 2))
    batches = [
        [pk(1, 0, *k1), pk(3, 3 * S, *k1), pk(10, S // 2, *k2)],
        [pk(2, 2 * S, *k1), pk(4, 20 * S, *k1)],
        [pk(99, S, *k1), pk(11, 30 * S, *k2)],
    ]
    stream = run(spark, batches, delay="2 seconds")
    assert stream.progress.read().agg(F.sum("late")).first()[0] == 1
    before = {r["packets"] for r in stream.flows().collect()}
    assert 3 in before and stream.open_flows >= 0
    stream.flush()
    got = sorted((r["Src IP"], r["packets"], r["end_reason"]) for r in stream.flows().collect())
    assert got == [("10.0.0.1", 1, "idle"), ("10.0.0.1", 3, "idle"), ("10.0.0.9", 1, "flush"), ("10.0.0.9", 1, "idle")]


def test_repeated_batch_counts_once(spark):
    stream = FlowStream(spark, fresh(), delay="1 second")
    df = frame(spark, [pk(1, 0, A, B, 4), pk(2, 10 * S, A, B)])
    stream.process(df, 0)
    stream.process(df, 0)
    assert stream.progress.read().count() == 1 and stream.flows().count() == 1


def test_scored_stream_and_watched_directory(spark):
    engine = Engine(spark, fresh(), default_version="m")
    bundle = random_bundle().with_(version="m", threshold=-1e30)
    engine.save(bundle)
    stream = live.score_live(engine, fresh(), delay="1 second")
    stream.process(frame(spark, traffic(4, n=60)), 0)
    stream.flush()
    assert engine.results("live").count() == stream.flows().count()
    assert engine.benign.count == stream.flows().count()

    folder = fresh()
    flows = fl.build_flows(frame(spark, traffic(4, n=60)), hot_rows=None).drop("start_ts")
    flows.coalesce(1).write.option("header", True).mode("append").csv(folder)
    flows.drop("Bwd IAT Std").coalesce(1).write.option("header", True).mode("append").csv(folder)
    flows.withColumn("Idle Max", F.lit("many")).coalesce(1).write.option("header", True).mode("append").csv(folder)
    live.watch_directory(engine, folder, fresh()).awaitTermination()
    seen = engine.results("watch")
    assert seen.count() == flows.count() and seen.select("source_file").distinct().count() == 1
    bad = sorted(r["reason"] for r in engine.quarantine.read().collect())
    assert len(bad) == 2 and "no numbers" in bad[0] and "Bwd IAT Std" in bad[1]


def test_drift_alert_stream(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [(start + timedelta(seconds=i), "Attack" if i < 60 and i % 2 else "Normal") for i in range(300)]
    folder = fresh()
    spark.createDataFrame(data, "at timestamp, prediction string").write.mode("append").parquet(folder)
    scored = spark.readStream.schema("at timestamp, prediction string").parquet(folder)
    query = live.drift_alerts(scored, "at").writeStream.format("memory").queryName("alerts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("alerts").collect()
    assert [(r["n"], r["attacks"]) for r in got] == [(60, 30)]
    assert got[0]["attack_rate"] == pytest.approx(0.5)


def test_many_five_tuples_share_calls_and_state(spark, monkeypatch):
    calls, packets = [], [pk(i, i * S // 50, (f"10.0.1.{i % 60}", 7), B) for i in range(300)]
    monkeypatch.setattr(st, "BUCKETS", 4)
    kind = type(spark.range(1).groupBy("id"))
    fold = kind.applyInPandasWithState
    monkeypatch.setattr(kind, "applyInPandasWithState", lambda group, *a: (calls.append(group._df), fold(group, *a))[1])
    stream = run(spark, [packets[:150], packets[150:]], delay="1 second")
    assert all("bucket" in df.columns for df in calls) and stream.open_flows == 60
    stream.flush()
    assert stream.open_flows == 0
    assert rows(stream.flows()) == rows(fl.build_flows(frame(spark, packets), hot_rows=None))
