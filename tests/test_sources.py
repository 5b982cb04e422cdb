import gzip
import os
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as col
from tidewatch.functions import packet as P
from tidewatch.operators import flows as fl
from tidewatch.operators import stats
from tidewatch.plans import catalog, samples
from tidewatch.schemas import FEATURES
from tidewatch.sources import flow_csv, pcap
from tidewatch.sources.tables import AppendTable
from tidewatch.streaming.flows import FlowStream


def fresh():
    return tempfile.mkdtemp(prefix="tidewatch-test-")


def write(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)
    return os.path.join(folder, name)


# ---- capture files


def ipv4(proto, body, src=(10, 0, 0, 1), dst=(10, 0, 0, 2), frag=0):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, frag, 64, proto, 0, *src, *dst) + body


def tcp(sport, dport, flags, payload=b"", window=100, words=5):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, words << 4, flags, window, 0, 0) + b"\0" * (words * 4 - 20) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ipv6(nxt, body):
    return struct.pack(">IHBB", 6 << 28, len(body), nxt, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + body


def ethernet(kind, body, vlan=False):
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return bytes(12) + tag + struct.pack(">H", kind) + body


def capture(frames, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for t, frame in frames:
        part = (t % 1_000_000) * (1000 if nano else 1)
        out += struct.pack(order + "IIII", 1_700_000_000 + t // 1_000_000, part, len(frame), len(frame)) + frame
    return out


@pytest.fixture(scope="module")
def captures():
    folder = fresh()
    one = [
        (0, ethernet(0x0800, ipv4(6, tcp(5000, 80, 2, b"hello", 500, 6)))),
        (1000, ethernet(0x0800, ipv4(6, tcp(80, 5000, 18), (10, 0, 0, 2), (10, 0, 0, 1)), vlan=True)),
        (2000, ethernet(0x0800, ipv4(17, udp(53, 54, b"abc")) + b"\0" * 20)),
        (3000, ethernet(0x0806, bytes(28))),
        (4000, ethernet(0x0800, ipv4(1, bytes(8)))),
        (5000, ethernet(0x86DD, ipv6(0, bytes([6, 0, 0, 0, 0, 0, 0, 0]) + tcp(1, 2, 16, b"xy")))),
        (6000, ethernet(0x0800, ipv4(6, tcp(1, 2, 16), frag=7))),
    ]
    two = [(9000, ipv4(6, tcp(5000, 80, 4)))]
    for name, data in (("a.pcap", capture(one)), ("b.pcap", capture(two, ">", True, 101)), ("empty.pcap", b"")):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    return folder


def test_capture_files(spark, captures):
    df = pcap.read_pcap(spark, captures)
    got = df.orderBy("ts").collect()
    assert [(r.protocol, r.ip_version, r.payload_len, r.header_size) for r in got] == [
        (6, 4, 5, 24), (6, 4, 0, 20), (17, 4, 3, 8), (1, 4, 0, None), (6, 6, 2, 20), (-1, 4, 0, None), (6, 4, 0, 20),
    ]
    assert got[4].src_ip == "::1" and got[4].dst_port == 2
    counts = stats.packet_counters(df).first()
    assert (counts.packets_processed, counts.packets_skipped, counts.packets_ipv6) == (5, 2, 1)
    assert df.select("seq").distinct().count() == 7
    flows = {r["Flow ID"]: r for r in fl.build_flows(df, hot_rows=None).collect()}
    main = flows["10.0.0.1-10.0.0.2-5000-80-6"]
    assert main["packets"] == 3 and main["end_reason"] == "rst" and main["FWD Init Win Bytes"] == 500
    with pytest.raises(Exception, match="too large"):
        pcap.read_pcap(spark, captures, max_bytes=10).count()


def packet_rows(df):
    names = ("seq", "ts", "src_ip", "src_port", "protocol", "payload_len", "tcp_flags")
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


@pytest.mark.parametrize("part", [200, 333, 5000, 1 << 20])
def test_ranges_of_any_size_give_the_whole_file(spark, part):
    """Payloads that hold records of their own mislead a range; the joins put it right."""
    fake = capture([(i * 1000, bytes(30)) for i in range(40)])[24:]
    frames = []
    for i in range(120):
        payload = fake if i % 11 == 5 else b"\xd4\xc3\xb2\xa1" * (i % 50)
        frames.append((i * 1000, ethernet(0x0800, ipv4(6, tcp(i + 1, 80, 16, payload)))))
    folder = fresh()
    for name, data in (("a.pcap", capture(frames)), ("b.pcap", capture(frames[:50], ">", True)[:-7]), ("head.pcap", capture([]))):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    whole = pcap.read_pcap(spark, folder)
    assert whole.count() == 120 + 49
    assert packet_rows(pcap.read_pcap(spark, folder, part_bytes=part)) == packet_rows(whole)


def test_bad_captures_go_to_quarantine_and_the_others_on(spark, captures):
    folder = fresh()
    for name in os.listdir(captures):
        with open(os.path.join(captures, name), "rb") as a, open(os.path.join(folder, name), "wb") as b:
            b.write(a.read())
    with open(os.path.join(folder, "bad.pcap"), "wb") as f:
        f.write(b"no capture" * 100)
    with open(os.path.join(folder, "short.pcap"), "wb") as f:
        f.write(b"\xd4\xc3\xb2\xa1")
    quarantine = AppendTable(spark, f"{fresh()}/bad")
    for part in (50, 1 << 20):
        assert pcap.read_pcap(spark, folder, part_bytes=part).count() == pcap.read_pcap(spark, captures).count()
    pcap.read_pcap(spark, folder, quarantine=quarantine)
    found = {os.path.basename(r.path): r.reason for r in quarantine.read().collect()}
    assert found == {"bad.pcap": "not a pcap file", "short.pcap": "not a pcap file"}


def test_capture_stream(spark, captures):
    stream = FlowStream(spark, fresh(), delay="1 second")
    stream.start(pcap.stream_pcap(spark, captures), fresh()).awaitTermination()
    stream.flush()
    assert stream.flows().count() == fl.build_flows(pcap.read_pcap(spark, captures), hot_rows=None).count()


# ---- flow CSV dialects


def test_dialects_read_by_name(spark):
    folder = fresh()
    one = write(folder, "abbreviated.csv", "Dst Port,Tot Fwd Pkts,Pkt Len Min,FIN Flag Cnt,Flow Byts/s\n80,1,2,3,4\n")
    two = write(folder, "spaced.csv", " Min Packet Length, Destination Port ,Init_Win_bytes_forward\n7,443,9\n")
    df = flow_csv.read_flow_csv(spark, [one, two])
    got = {r["Dst Port"]: r for r in df.collect()}
    assert got["80"]["Packet Length Min"] == "2" and got["80"]["FIN Flag Count"] == "3" and got["80"]["Flow Bytes/s"] == "4"
    assert got["443"]["Packet Length Min"] == "7" and got["443"]["FWD Init Win Bytes"] == "9"
    assert got["443"]["source_file"] == "spaced.csv"


def test_duplicates_dirty_cells_and_missing(spark):
    folder = fresh()
    path = write(folder, "d.csv", "Dst Port,Destination Port,Fwd Header Length,Fwd Header Length,Idle Max\n1,2,3,4,NaN\n5,6,7,8,Infinity\n9,9,9,9,-inf\n9,9,9,9,\n9,9,9,9,abc\n9,9,9,9,2.5\n")
    df = flow_csv.read_flow_csv(spark, path)
    assert df.columns == ["Dst Port", "Fwd Header Length", "Idle Max", "source_file"]
    assert [r[0] for r in df.select("Fwd Header Length").limit(2).collect()] == ["3", "7"]
    clean = col.project_features(df, ["Idle Max"])
    assert [r[0] for r in clean.collect()] == [0.0, 0.0, 0.0, 0.0, 0.0, 2.5]
    assert col.unparsed_counts(df, ["Idle Max"]).first()["unparsed"] == 1
    with pytest.raises(ValueError, match="Bwd IAT Std"):
        col.require_features(["Idle Max"], ["Idle Max", "Bwd IAT Std"])
    with pytest.raises(ValueError, match="scaler"):
        col.require_features(FEATURES, FEATURES, 17)


def test_unreadable_file_is_reported(spark):
    folder = fresh()
    good, empty = write(folder, "a.csv", "x,y\n1,2\n"), write(folder, "b.csv", "")
    groups, failed = flow_csv.group_dialects(spark, [good, empty])
    assert list(groups) == [("x", "y")] and list(failed) == [empty]
    # Spark's listing leaves out files without content.
    assert [r["path"].rsplit("/")[-1] for r in flow_csv.list_csv(spark, folder).collect()] == ["a.csv"]


def test_names():
    assert col.canonical_name("fwd packet length MEAN") == "Fwd Packet Length Mean"
    assert col.canonical_name(" Bwd  Pkt Length Std") == "Bwd Packet Length Std"
    assert col.canonical_name("flow_iat_max") == "Flow IAT Max"
    assert col.canonical_name("unknown  thing") == "unknown thing"
    assert all(col.canonical_name(c) == c for c in col.CANONICAL)
    assert len(col.CANONICAL) == 90 and len(col.ALIASES) == 93 and len(col.ASSEMBLED) == 84


def test_result_order_and_display(spark):
    df = spark.createDataFrame([(1.0, "x", "Normal", 0.5, 2.0, "now", None)],
                               "`Dst Port` double, extra string, prediction string, confidence double, gmm_score double, timestamp string, human_label string")
    out = col.order_results(df, ["Dst Port"])
    assert out.columns == ["Timestamp", "prediction", "confidence", "gmm_score", "Dst Port", "human_label", "extra"]
    path = fresh() + "/out"
    flow_csv.export_csv(out, path)
    assert spark.read.option("header", True).csv(path).first()["human_label"] == "—"


def test_subnets(spark):
    df = spark.createDataFrame(
        [("10.10.10.5", "8.8.8.8"), ("8.8.8.8", "10.10.10.9"), ("10.10.11.1", "8.8.8.8"), ("fe80::1", "fe80::2"), ("x", None)],
        "s string, d string",
    )
    v4 = df.filter(P.in_subnet(F.col("s"), "10.10.10.0/24") | P.in_subnet(F.col("d"), "10.10.10.0/24"))
    assert v4.count() == 2
    assert df.filter(P.in_subnet(F.col("s"), "fe80::/10")).count() == 1


def test_filter_is_pushed_to_the_scan(spark, sf):
    df = samples.table(spark, sf, "lineitem")
    plan = col.project_features(df.filter("l_quantity > 3"), ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,3.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_a_directory_of_mixed_dialects(spark, tmp_path):
    folder = tmp_path / "flows"
    folder.mkdir()
    (folder / "a.csv").write_text("Dst Port,Protocol\n80,6\n443,6\n")
    (folder / "b.csv").write_text("Protocol, Destination Port\n17,53\n")
    (folder / "empty.csv").write_text("")
    got = flow_csv.read_flow_csv(spark, str(folder))
    assert sorted((r["Dst Port"], r["Protocol"]) for r in got.collect()) == [("443", "6"), ("53", "17"), ("80", "6")]


def test_first_rows_in_file_order_over_many_blocks(spark):
    folder, n = fresh(), 3000
    for k, name in enumerate(("b.csv", "a.csv", "c.csv")):
        lines = [f"{k},{i},{'BENIGN' if i % 4 == 0 else 'X'},1" for i in range(n)]
        write(folder, name, "\n".join(["File,Row, Label, Fwd Header Length.1", *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        benign = spark.createDataFrame([("9", "9", "BENIGN")], "File string, Row string, Label string")
        want = [(k, i) for k in (1, 0, 2) for i in range(n) if i % 4]
        for first in (0, 1, 777, 2250, 2251, 5000, 6750, 9999):
            got = flow_csv.assemble_datasets(spark, benign, {"x": (folder, first)}, columns=["File", "Row", "Label"])
            assert sorted((int(r.File), int(r.Row)) for r in got.collect() if r.File != "9") == sorted(want[:first])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="order"):
        flow_csv.assemble_datasets(spark, benign, {"x": (benign, 3)}, columns=["File"])


def test_headers_of_many_files_take_one_job(spark):
    folder = fresh()
    paths = [write(folder, f"f{i:04d}.csv", f"Dst Port,{'Label' if i % 2 else 'Attack'}\n80,x\n") for i in range(300)]
    long = write(folder, "long.csv", ",".join(f"c{i}" for i in range(20_000)) + "\r\n1\n")
    with gzip.open(os.path.join(folder, "z.csv.gz"), "wt") as f:
        f.write("\ufeffDst Port,Label\n1,2\n")
    missing = os.path.join(folder, "none.csv")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    groups, failed = flow_csv.group_dialects(spark, [*paths, long, os.path.join(folder, "z.csv.gz"), missing])
    jobs = sc.statusTracker().getJobIdsForGroup("headers")
    sc.setJobGroup("rest", "rest")
    assert len(jobs) <= 2 and list(failed) == [missing]
    assert sorted(len(v) for v in groups.values()) == [1, 150, 151]


def test_captures_of_more_clients_than_two_bytes_hold(spark):
    users = [0, 255, 65_535, 65_536, 90_000, 5_000_000, 2**24, 2**31]
    rows = [(i, user, i % 2) for user in users for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, kind int").selectExpr(
        "event_id + 6 * user_id AS event_id", "timestamp_seconds(1704067200 + event_id * 9999) AS ts", "user_id",
        "if(kind = 0, 'view', 'purchase') AS event_type", "1.5D * event_id AS value",
    )
    folder = fresh()
    events.write.parquet(f"{folder}/events.parquet")
    names = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_len", "tcp_flags", "tcp_window", "header_size"]
    want = samples.packets(spark, folder).select(F.unix_micros("ts").alias("t_us"), *names)
    got = catalog.queries()["capture_ranges"](spark, folder)
    assert sorted(got.collect()) == sorted(want.collect())
