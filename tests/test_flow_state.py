"""The pieces and the fold of the stream, against a packet-by-packet walk."""

import random

import pytest
from packet_walk import walk
from pyspark.sql import functions as F
from test_flows import A, B, S, frame, pk, traffic
from test_streaming import fresh, rows

from tidewatch.operators import flows as fl
from tidewatch.streaming import live
from tidewatch.streaming import state as st
from tidewatch.streaming.flows import FlowStream


def folded(packets, span, timeout=5 * S, idle=S):
    """Flows of one key's packets by windows of ``span`` microseconds."""
    windows, ended, flow = {}, [], None
    for seq, t, src, sport, *_, size, flags, win, hdr in sorted(packets, key=lambda p: (p[1], p[0])):
        a_side = (src, sport) == A
        windows.setdefault(t // span, []).append((t, seq, a_side, size, win, hdr, bool(flags & 1), bool(flags & 4)))
    for _, part in sorted(windows.items()):
        pieces = st.cut_window(part, timeout, idle)
        again = [st.unpacked(st.packed(p)) | {n: p[n] for n in st.CASED} for p in pieces]
        done, flow = st.fold_pieces(flow, again, timeout, idle)
        ended += done
    return ended + ([flow] if flow else [])


@pytest.mark.parametrize("span", [S // 10, S, 20 * S])
def test_windows_of_any_size_give_the_walked_flows(span):
    rng = random.Random(span)
    for _ in range(300):
        t, packets = 0, []
        for seq in range(rng.randint(1, 60)):
            t += rng.choice([0, 1, S // 20, S // 2, S, 2 * S, 5 * S, 5 * S + 1, 9 * S])
            ends = (A, B) if rng.random() < 0.5 else (B, A)
            flags = rng.choice([0, 0, 0, 1, 1, 4, 5, 16])
            packets.append(pk(seq, t, *ends, flags, length=rng.randint(0, 1500), win=seq, hdr=rng.choice([20, 24, 32])))
        want = sorted(
            (w["first_seq"], w["packets"], w["FIN Flag Count"], w["Flow IAT Max"], w["Idle Max"], w["Packet Length Max"],
             w["Fwd IAT Total"], w["Fwd Seg Size Min"], w["Bwd Packet Length Max"]) for w in walk(packets)
        )
        got = []
        for f in folded(packets, span):
            fwd, bwd = ("a", "b") if f["opener_a"] else ("b", "a")
            got.append((f["seq0"], f["packets"], f["fins"], max(f["max_iat"], 0), max(f["idle"], 0), f["max_len"],
                        f[f"s_iat_{fwd}"], f[f"hdr_{fwd}"], max(f[f"m_len_{bwd}"], 0)))
        assert sorted(got) == want


def test_squares_beyond_64_bits_survive():
    piece = st.cut_window([(0, 1, True, 10, 0, 20, False, False), (6 * 10**9, 2, True, 10, 0, 20, False, False)], 10**10, 1)[0]
    assert piece["q_iat"] == 36 * 10**18
    assert st.unpacked(st.packed(piece))["q_iat"] == 36 * 10**18


def test_stream_with_capture_windows_equals_batch(spark):
    packets = traffic(8, n=150)
    folder = fresh()
    frame(spark, packets).coalesce(1).write.mode("append").parquet(folder)
    stream = FlowStream(spark, fresh(), delay="60 seconds", window="10 seconds")
    stream.start(live.packet_stream(spark, folder), fresh()).awaitTermination()
    stream.flush()
    want = fl.build_flows(frame(spark, packets), window="10 seconds", hot_rows=None)
    assert rows(stream.flows()) == rows(want)
    reasons = lambda df: sorted((str(r.capture_time), r.end_reason, r.packets) for r in df.collect())
    assert reasons(stream.flows()) == reasons(want)


def test_late_packets_are_those_that_the_state_store_drops(spark):
    """What the report counts is what is missing from the flows."""
    stream = FlowStream(spark, fresh(), delay="1 second")
    k2 = (("10.0.0.9", 1), ("10.0.0.8", 2))
    stream.process(frame(spark, [pk(1, 0, A, B), pk(2, 10 * S, A, B)]), 0)
    stream.process(frame(spark, [pk(3, 3 * S, A, B), pk(4, 4 * S, *k2), pk(5, 9 * S + 500_000, *k2), pk(6, 12 * S, *k2)]), 1)
    stream.flush()
    total, late = stream.progress.read().agg(F.sum("packets"), F.sum("late")).first()
    kept = stream.flows().agg(F.sum("packets")).first()[0]
    assert (total, late, kept) == (6, 2, 4)


def test_nulls_and_an_empty_batch(spark):
    stream = FlowStream(spark, fresh(), delay="1 second")
    df = frame(spark, [pk(1, 0, A, B, length=7), pk(2, S, A, B)])
    stream.process(df.limit(0), 0)
    stream.process(df.withColumn("payload_len", F.lit(None).cast("long")).withColumn("tcp_window", F.lit(None).cast("int")), 1)
    stream.flush()
    got = stream.flows().collect()
    assert [(r.packets, r["Packet Length Max"], r.end_reason) for r in got] == [(2, 0.0, "flush")]
