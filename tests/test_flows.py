import random
from datetime import datetime, timedelta, timezone

import pytest
from packet_walk import walk
from pyspark.sql import functions as F

from tidewatch.operators import flows as fl
from tidewatch.operators import hot_flows as hf
from tidewatch.plans import samples
from tidewatch.schemas import FEATURES, PACKETS

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
A, B = ("10.0.0.1", 5000), ("10.0.0.2", 80)


def pk(seq, t, src, dst, flags=0, proto=6, length=10, win=0, hdr=20):
    """t in microseconds."""
    return (seq, int(t), src[0], src[1], dst[0], dst[1], proto, length, flags, win, hdr)


def frame(spark, packets):
    rows = [
        (p[0], EPOCH + timedelta(microseconds=p[1]), 6 if ":" in p[2] else 4, p[2], p[4], p[3], p[5], p[6], p[7],
         p[8], p[9], p[10])
        for p in packets
    ]
    return spark.createDataFrame(rows, PACKETS)


def as_table(df):
    rows = {}
    for r in df.collect():
        rows[(r["Flow ID"], r["start_ts"], r["flow_uid"])] = r
    return sorted(rows.values(), key=lambda r: (r["start_ts"], r["Flow ID"], r["flow_uid"]))


def same(spark, packets, **kw):
    got = as_table(fl.build_flows(frame(spark, packets), **kw))
    want = walk(packets)
    assert len(got) == len(want)

    def key(get):
        return tuple(round(get(c), 3) if c in FEATURES else get(c) for c in ["end_reason", "packets", *FEATURES])

    got_keys, want_keys = sorted(key(r.__getitem__) for r in got), sorted(key(r.__getitem__) for r in want)
    for g, w in zip(got_keys, want_keys):
        assert g[:2] == w[:2]
        assert g[2:] == pytest.approx(w[2:], abs=2e-3)
    return got


S = 1_000_000
CASES = {
    "one packet": ([pk(1, 0, A, B, length=100, win=500)], 1),
    "two packets": ([pk(1, 0, A, B), pk(2, S // 2, A, B)], 1),
    "gap is timeout": ([pk(1, 0, A, B), pk(2, 5 * S, A, B)], 1),
    "gap over timeout": ([pk(1, 0, A, B), pk(2, 5 * S + 1, A, B)], 2),
    "gap is idle limit": ([pk(1, 0, A, B), pk(2, S, A, B)], 1),
    "backward first": ([pk(1, 0, B, A), pk(2, S // 10, A, B)], 1),
    "rst first": ([pk(1, 0, A, B, flags=4), pk(2, S // 10, A, B)], 2),
    "fin twice one side": ([pk(1, 0, A, B, 1), pk(2, 1, A, B, 1)], 1),
    "fin fin ack": ([pk(1, 0, A, B, 1), pk(2, 1, B, A, 1), pk(3, 2, A, B, 16)], 2),
    "fin run": ([pk(1, 0, A, B, 1), pk(2, 1, B, A, 1), pk(3, 2, B, A, 1), pk(4, 3, A, B, 1)], 2),
    "udp": ([pk(1, 0, A, B, proto=17, hdr=8)], 1),
    "self-loop": ([pk(1, 0, A, A, 1), pk(2, 1, A, A, 1)], 1),
    "equal time": ([pk(1, 0, A, B), pk(2, 0, B, A)], 1),
    "ipv6": ([pk(1, 0, ("fe80::1", 9), ("fe80::2", 7)), pk(2, 1, ("fe80::2", 7), ("fe80::1", 9))], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_hand_made_cases(spark, name):
    packets, n = CASES[name]
    assert len(same(spark, packets, hot_rows=None)) == n


def test_hand_made_values(spark):
    one = same(spark, CASES["one packet"][0], hot_rows=None)[0]
    assert (one["Packet Length Mean"], one["FWD Init Win Bytes"], one["Flow IAT Std"]) == (100.0, 500.0, 0.0)
    assert one["Flow ID"] == "10.0.0.1-10.0.0.2-5000-80-6" and one["Timestamp"] == "2024-01-01 00:00:00"
    assert same(spark, CASES["gap is timeout"][0], hot_rows=None)[0]["Idle Max"] == 5e6
    assert same(spark, CASES["gap is idle limit"][0], hot_rows=None)[0]["Idle Max"] == 0.0
    assert same(spark, CASES["backward first"][0], hot_rows=None)[0]["Dst Port"] == 5000.0
    assert [r["end_reason"] for r in same(spark, CASES["fin run"][0], hot_rows=None)] == ["finfin", "finfin"]


def traffic(seed, n=400, fin=0.35, rst=0.03, pause=0.03):
    rng = random.Random(seed)
    pairs = [(A, B), (("10.0.0.3", 1), ("10.0.0.3", 2)), (A, A)]
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1000, 300_000, 1_500_000]) if rng.random() > pause else rng.choice([5 * S, 6 * S])
        src, dst = rng.choice(pairs + [(A, B)] * 4)
        if rng.random() < 0.5:
            src, dst = dst, src
        flags = (1 if rng.random() < fin else 16) | (4 if rng.random() < rst else 0)
        out.append(pk(i, t, src, dst, flags, length=rng.randrange(1500), win=rng.randrange(65536), hdr=20 + 4 * (i % 3)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_traffic(spark, seed):
    same(spark, traffic(seed), hot_rows=None)


@pytest.mark.parametrize("seed,limit", [(0, 7), (1, 20), (2, 60), (5, 3)])
def test_hot_keys_give_the_same_flows(spark, seed, limit):
    packets = traffic(seed, n=300)
    same(spark, packets, hot_rows=limit)


@pytest.mark.parametrize("seed,limit", [(0, 7), (1, 25), (2, 60), (5, 3), (6, 1)])
def test_hot_keys_give_the_same_flow_numbers(spark, seed, limit):
    """A 5-tuple with most packets, cut in chunks of every size."""
    packets = frame(spark, traffic(seed, n=300))
    columns = ["seq", "flow_no", "starts", "forward", "closes"]
    for window in (None, "30 seconds"):
        got, want = ({tuple(r[c] for c in columns) for r in fl.cut_flows(packets, window=window, hot_rows=h).collect()} for h in (limit, None))
        assert got == want and len(got) == 300


def test_one_endless_hot_flow(spark):
    packets = [pk(i, i * 1000, *((A, B) if i % 3 else (B, A)), length=i % 50) for i in range(500)]
    assert len(same(spark, packets, hot_rows=25)) == 1


def test_capture_windows_are_independent(spark):
    packets = traffic(3)
    got = fl.build_flows(frame(spark, packets), window="30 seconds", hot_rows=None).collect()
    want = []
    by_window = {}
    for p in packets:
        by_window.setdefault(p[1] // (30 * S), []).append(p)
    for part in by_window.values():
        want += walk(part)
    assert len(got) == len(want)
    assert sorted(r["packets"] for r in got) == sorted(r["packets"] for r in want)
    hot = fl.build_flows(frame(spark, packets), window="30 seconds", hot_rows=10).collect()
    assert sorted(r["flow_uid"] for r in hot) == sorted(r["flow_uid"] for r in got)


def test_known_counts(spark, sf):
    df = fl.build_flows(samples.packets(spark, sf), hot_rows=None)
    got = {r["end_reason"]: r["n"] for r in df.groupBy("end_reason").agg(F.count("*").alias("n")).collect()}
    assert got == {"idle": 246, "rst": 41, "finfin": 24, "flush": 12}
    counts = fl.flow_counts(df).first()
    assert counts["flows"] == 323 and counts["open_flows"] == 12


def test_plan_has_one_exchange(spark, sf):
    df = fl.build_flows(samples.packets(spark, sf), hot_rows=None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan


def test_tasks_follow_the_packets_not_the_limit(spark, monkeypatch):
    packets, asked = traffic(4, n=600), []
    kind = type(spark.range(1))
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, n, *by: (asked.append(n), deal(df, n, *by))[1])
    same(spark, packets, hot_rows=2)
    df, by = fl.keyed(frame(spark, packets))
    sizes = hf._chunked(df, by, 600, 2).groupBy("chunk").count().agg(F.max("count"), F.count("*")).first()
    assert asked == [2, 2] and sizes[0] == 2 and sizes[1] >= 300
