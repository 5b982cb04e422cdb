"""Views of the test tables that stand in for captured traffic.

The test data has no packets, so a packet table is projected from ``events``;
likewise a scored table.  All are plain projections: they grow with the events.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.packet import TCP, UDP
from tidewatch.sources.files import open_output

EPOCH = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds
CLIENTS, SERVERS = 10 << 24, "192.168.1."
SQUEEZE = 10_000  # time compression: median gap per user becomes about 2.6 s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """A packet table: each user is a client talking to one of five servers.

    ``skewed``: a third of the users act as one, so one 5-tuple has a third of all packets.
    """
    events = table(spark, sf_dir, "events")
    if skewed:
        events = events.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    user, eid = F.col("user_id"), F.col("event_id")
    udp = user % 5 == 3
    client = F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (user % 256).cast("string"))
    server = F.concat(F.lit("192.168.1."), (user % 5 + 1).cast("string"))
    client_port = (40000 + user % 20000).cast("int")
    server_port = F.element_at(F.array(*[F.lit(p) for p in (80, 443, 22, 53, 8080)]), (user % 5 + 1).cast("int"))
    out = eid % 3 != 0
    flags = (
        F.when(udp, 0)
        .when((F.col("event_type") == "error") & (eid % 4 == 0), 4)
        .when(F.col("event_type") == "purchase", 17)
        .otherwise(16)
    )
    t = F.lit(EPOCH) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH}) div {SQUEEZE}")
    return events.select(
        eid.alias("seq"),
        F.timestamp_micros(t).alias("ts"),
        F.lit(4).alias("ip_version"),
        F.when(out, client).otherwise(server).alias("src_ip"),
        F.when(out, server).otherwise(client).alias("dst_ip"),
        F.when(out, client_port).otherwise(server_port).alias("src_port"),
        F.when(out, server_port).otherwise(client_port).alias("dst_port"),
        F.when(udp, UDP).otherwise(TCP).alias("protocol"),
        F.floor(F.col("value") * 10).cast("long").alias("payload_len"),
        flags.cast("int").alias("tcp_flags"),
        F.when(udp, 0).otherwise((eid * 37) % 65536).cast("int").alias("tcp_window"),
        F.when(udp, 8).otherwise(20 + 4 * (eid % 4)).cast("int").alias("header_size"),
    )


def captured_ip(ip: Column) -> Column:
    """The packet table's name for an address read from ``capture_files``.

    Clients are 10.0.x.y with x above 255 from user 65 536 on.  On the wire they are 32-bit
    numbers counted up from 10.0.0.0, so 10.0.256.0 travels as 10.1.0.0.
    """
    parts = F.transform(F.split(ip, r"\."), lambda part: part.cast("long"))
    user = F.aggregate(parts, F.lit(0).cast("long"), lambda a, part: a * 256 + part) - CLIENTS
    name = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    return F.when(ip.startswith(SERVERS), ip).otherwise(name)


def capture_files(spark: SparkSession, sf_dir: str, folder: str, files: int) -> DataFrame:
    """The packet table as Ethernet captures in ``folder``: (path, bytes) of each file written.

    ``captured_ip`` takes the addresses back.
    """

    def address(ip: str) -> bytes:
        a, b, c, d = map(int, ip.split("."))
        return struct.pack(">I", (a << 24) + (b << 16) + (c << 8) + d)

    def frame(row) -> bytes:
        payload, words = bytes(int(row.payload_len)), int(row.header_size) // 4
        if row.protocol == UDP:
            body = struct.pack(">HHHH", row.src_port, row.dst_port, 8 + len(payload), 0) + payload
        else:
            head = struct.pack(">HHIIBBHHH", row.src_port, row.dst_port, 0, 0, words << 4, row.tcp_flags, row.tcp_window, 0, 0)
            body = head.ljust(words * 4, b"\0") + payload
        ends = address(row.src_ip) + address(row.dst_ip)
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, row.protocol, 0) + ends + body
        return bytes(12) + b"\x08\x00" + ip

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():05d}.pcap"
        with open_output(folder, name) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 1))
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    data = frame(row)
                    out.write(struct.pack("<IIII", row.t // 1_000_000, row.t % 1_000_000, len(data), len(data)) + data)
            yield pd.DataFrame({"path": [name], "bytes": [out.tell()]})

    rows = packets(spark, sf_dir).withColumn("t", F.unix_micros("ts")).drop("ts")
    return rows.repartition(files, "src_ip").sortWithinPartitions("t", "seq").mapInPandas(write, "path string, bytes long")


THRESHOLD = 45.0


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for model output: one scored row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("flow_uid"),
        "event_id",
        (50 - F.col("value") / 4).alias("score_raw"),
        F.col("event_type").alias("scope"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.when(F.col("event_id") % 100 == 0, "Normal")
        .when(F.col("event_id") % 50 == 0, "Attack")
        .alias("human_label"),
    )


def scored(spark: SparkSession, sf_dir: str, scope: str | None = "scope") -> DataFrame:
    """``raw_scores`` with prediction, confidence and rounded score."""
    from tidewatch.operators.scoring import classify

    return classify(raw_scores(spark, sf_dir), THRESHOLD, scope)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback events on all flows: labels set, changed and cleared, two for every second flow."""
    events = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return events.select(
        F.when(n % 4 == 3, n - 1).otherwise(n).cast("string").alias("flow_uid"),
        F.when(n % 3 == 0, "Normal").when(n % 3 == 1, "Attack").otherwise("Unclear").alias("human_label"),
        F.when(n % 2 == 0, "Normal").otherwise("Attack").alias("model_prediction"),
        F.col("ts").cast("timestamp").alias("feedback_ts"),
        F.when(n % 7 == 0, "clear").otherwise("set").alias("action"),
    )
