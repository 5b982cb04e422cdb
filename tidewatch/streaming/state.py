"""Packets to flows on Spark's own streaming state.

Two queries, each with one stateful operator:

1. ``packet_windows``: packets are grouped by 5-tuple and short event-time window under a
   watermark.  A window comes out once the watermark has passed it, whole and sorted, so
   order is settled by Spark's aggregate state; packets later than that are dropped and
   counted there.  ``window_pieces`` then reduces each window to pieces of flows, in any
   task: a 5-tuple that dominates the stream is worked on window by window.
2. ``flow_states``: pieces are folded per 5-tuple.  Its state is one unfinished flow, some
   forty numbers, with the end of its timeout.  5-tuples are hashed into ``BUCKETS`` keys of
   the state store, each with the list of its unfinished flows and one event-time timer.

A piece is cut wherever a flow can end: after RST, after a gap over the timeout, and after a
FIN that closes in any of the three cases a window may be entered in (no unanswered FIN, one
of endpoint a, one of b).  The fold knows the case and joins pieces that belong together.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidewatch.session import ship_package



CASES = ("none", "a", "b")
END_OF_CAPTURE = "end"  # the key of a row that only moves the watermark on
OPENED = "open"  # the key of a row with the change in open flows
# A 5-tuple and its capture window travel as one text: rows of few columns make the calls
# per key several times cheaper.
KEY = (("ip_a", "string"), ("ip_b", "string"), ("port_a", "int"), ("port_b", "int"), ("proto", "int"), ("capture", "long"))
KEYED = "id string, t long, seq long, a_side boolean, len long, win int, hdr int, fin boolean, rst boolean"
_PACKET = ("t", "seq", "a_side", "len", "win", "hdr", "fin", "rst")

# Of every stretch of one flow, piece or unfinished flow; -1 where there is no value.
SIDE = ("first", "last", "hdr", "n_len", "s_len", "q_len", "m_len", "n_iat", "s_iat", "q_iat")
BODY = (
    "packets", "t0", "seq0", "win0", "opener_a", "t1", "rst", "max_len", "min_len", "fins", "max_iat", "idle",
    "n_iat", "s_iat", "q_iat", *[f"{n}_{s}" for s in "ab" for n in SIDE],
)
CASED = tuple(f"{n}_{c}" for c in CASES for n in ("start", "closes", "open"))
SQUARES = tuple(n for n in BODY if n.startswith("q_"))
FLAGS = ("opener_a", "rst")
# A stretch travels as one array of numbers, sums of squares, which may pass 64 bits, as two.
HALF = 1 << 62
WIDTH = len(BODY) + len(SQUARES)
PIECES = "id string, at timestamp, pieces array<long>"  # each ``WIDTH`` numbers and those by case
STATE = "ids array<string>, flows array<long>"  # of a bucket: by flow ``WIDTH`` numbers, left_open and due
BUCKETS = 4096
FLOW = "id string, flow array<long>"  # with the two of ``ENDED`` behind
ENDED = ("closes", "is_last")


_values, _SQUARES_AT = itemgetter(*BODY), [i for i, n in enumerate(BODY) if n in SQUARES]


def packed(stretch: dict) -> list[int]:
    out = list(map(int, _values(stretch)))
    for at in reversed(_SQUARES_AT):
        out[at : at + 1] = divmod(out[at], HALF)
    return out


def unpacked(numbers: list[int]) -> dict:
    body = list(numbers[:WIDTH])
    for at in _SQUARES_AT:
        body[at : at + 2] = [body[at] * HALF + body[at + 1]]
    return dict(zip(BODY, body, strict=True))


def packet_windows(packets: DataFrame, delay: str, span: str) -> DataFrame:
    """A stream of ``KEYED`` packets to rows (id, at, packets) per closed window of ``span``."""
    timed = packets.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", delay)
    grouped = timed.groupBy("id", F.window("ts", span).alias("span"))
    listed = grouped.agg(F.sort_array(F.collect_list(F.struct(*_PACKET))).alias("packets"))
    return listed.select("id", F.window_time("span").alias("at"), "packets")


def cut_window(rows: list[tuple], timeout: int, idle: int) -> list[dict]:
    """Pieces of one key's packets (t, seq, a_side, len, win, hdr, fin, rst), in order."""
    pieces: list[dict] = []
    piece: dict = {}
    fin_of = {"none": 0, "a": 1, "b": 2}  # by case: who has an unanswered FIN
    closed = dict.fromkeys(CASES, False)
    before_t, before_rst = None, False
    latest: list[int | None] = [None, None]
    for t, seq, a_side, size, win, hdr, fin, rst in rows:
        hard = before_t is not None and (before_rst or t - before_t > timeout)
        starts = {c: hard or closed[c] for c in CASES}
        if before_t is None or any(starts.values()):
            piece = {
                "packets": 0, "t0": t, "seq0": seq, "win0": win, "opener_a": a_side, "max_len": size, "min_len": size, "fins": 0,
                "max_iat": -1, "idle": -1, "n_iat": 0, "s_iat": 0, "q_iat": 0, **{f"start_{c}": starts[c] for c in CASES},
            }
            for s in "ab":
                piece |= {f"{n}_{s}": -1 for n in ("first", "last", "hdr", "m_len")}
                piece |= {f"{n}_{s}": 0 for n in ("n_len", "s_len", "q_len", "n_iat", "s_iat", "q_iat")}
            pieces.append(piece)
            latest = [None, None]
        else:
            gap = t - before_t
            piece["n_iat"] += 1
            piece["s_iat"] += gap
            piece["q_iat"] += gap * gap
            piece["max_iat"] = max(piece["max_iat"], gap)
            if gap > idle:
                piece["idle"] = max(piece["idle"], gap)
        side = 1 if a_side else 2
        s = "a" if a_side else "b"
        if latest[side - 1] is None:
            piece[f"first_{s}"], piece[f"hdr_{s}"] = t, hdr
        else:
            gap = t - latest[side - 1]
            piece[f"n_iat_{s}"] += 1
            piece[f"s_iat_{s}"] += gap
            piece[f"q_iat_{s}"] += gap * gap
            piece[f"hdr_{s}"] = min(piece[f"hdr_{s}"], hdr)
        latest[side - 1] = piece[f"last_{s}"] = t
        piece[f"n_len_{s}"] += 1
        piece[f"s_len_{s}"] += size
        piece[f"q_len_{s}"] += size * size
        piece[f"m_len_{s}"] = max(piece[f"m_len_{s}"], size)
        piece["packets"] += 1
        piece["max_len"], piece["min_len"] = max(piece["max_len"], size), min(piece["min_len"], size)
        piece["fins"] += fin
        for c in CASES:
            if starts[c]:
                fin_of[c] = 0
            closed[c] = fin and fin_of[c] not in (0, side)
            if closed[c]:
                fin_of[c] = 0
            elif fin:
                fin_of[c] = side
            piece[f"closes_{c}"], piece[f"open_{c}"] = closed[c], fin_of[c]
        piece["t1"], piece["rst"] = t, rst
        before_t, before_rst = t, rst
    return pieces


def window_pieces(windows: DataFrame, timeout: int, idle: int) -> DataFrame:
    """Each window's packets as pieces."""
    schema = to_arrow_schema(_parse_datatype_string(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("packets")
            ends, values = listed.offsets.to_pylist(), listed.values
            rows = list(zip(*[values.field(c).to_pylist() for c in _PACKET], strict=True))
            made = []
            for begin, end in zip(ends[:-1], ends[1:], strict=True):
                own = cut_window(rows[begin:end], timeout, idle)
                made.append([x for p in own for x in (*packed(p), *[int(p[n]) for n in CASED])])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), pa.array(made, pa.list_(pa.int64()))], schema=schema)

    ship_package(windows.sparkSession)
    return windows.mapInArrow(run, PIECES)


def join_pieces(flow: dict, piece: dict, idle: int) -> None:
    """Append a piece to a flow of the same key: the gap between them is an inter-arrival time."""
    gap = piece["t0"] - flow["t1"]
    flow["n_iat"] += piece["n_iat"] + 1
    flow["s_iat"] += piece["s_iat"] + gap
    flow["q_iat"] += piece["q_iat"] + gap * gap
    flow["max_iat"] = max(flow["max_iat"], piece["max_iat"], gap)
    flow["idle"] = max(flow["idle"], piece["idle"], gap if gap > idle else -1)
    for s in "ab":
        if piece[f"n_len_{s}"]:
            n_gaps = gap = 0
            if flow[f"n_len_{s}"]:
                n_gaps, gap = 1, piece[f"first_{s}"] - flow[f"last_{s}"]
                flow[f"hdr_{s}"] = min(flow[f"hdr_{s}"], piece[f"hdr_{s}"])
            else:
                flow[f"first_{s}"], flow[f"hdr_{s}"] = piece[f"first_{s}"], piece[f"hdr_{s}"]
            flow[f"last_{s}"] = piece[f"last_{s}"]
            flow[f"n_iat_{s}"] += piece[f"n_iat_{s}"] + n_gaps
            flow[f"s_iat_{s}"] += piece[f"s_iat_{s}"] + gap
            flow[f"q_iat_{s}"] += piece[f"q_iat_{s}"] + gap * gap
            flow[f"m_len_{s}"] = max(flow[f"m_len_{s}"], piece[f"m_len_{s}"])
            for n in ("n_len", "s_len", "q_len"):
                flow[f"{n}_{s}"] += piece[f"{n}_{s}"]
    for n in ("packets", "fins"):
        flow[n] += piece[n]
    flow["max_len"], flow["min_len"] = max(flow["max_len"], piece["max_len"]), min(flow["min_len"], piece["min_len"])
    flow["t1"], flow["rst"] = piece["t1"], piece["rst"]


def fold_pieces(flow: dict | None, pieces: list[dict], timeout: int, idle: int) -> tuple[list[dict], dict | None]:
    """Ended flows and the unfinished one, after the pieces of one window of a key."""
    ended, entry = [], 0
    for i, piece in enumerate(pieces):
        hard = flow is None or piece["t0"] - flow["t1"] > timeout
        if i == 0:
            entry = 0 if hard else flow["left_open"]
        case = CASES[entry]
        if flow is not None and (hard or piece[f"start_{case}"]):
            ended.append(flow | {"closes": False, "is_last": False})
            flow = None
        if flow is None:
            flow = {n: piece[n] for n in BODY}
        else:
            join_pieces(flow, piece, idle)
        flow["left_open"] = piece[f"open_{case}"]
        if flow["rst"] or piece[f"closes_{case}"]:
            ended.append(flow | {"closes": piece[f"closes_{case}"], "is_last": False})
            flow = None
    return ended, flow


def flow_states(pieces: DataFrame, timeout: int, idle: int) -> DataFrame:
    """A stream of pieces to flows: ended ones at once, silent ones when their timer fires.

    A call costs milliseconds whatever it does, so 5-tuples share calls and state by
    bucket; a bucket's timer is its earliest one.  The observation ``OPENED`` tells by how
    many the open flows grew.
    """
    stride, held = WIDTH + len(CASED), WIDTH + 2

    def read(numbers: list[int]) -> list[dict]:
        parts = [numbers[i : i + stride] for i in range(0, len(numbers), stride)]
        return [unpacked(p) | dict(zip(CASED, p[WIDTH:], strict=True)) for p in parts]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flows: dict[str, list[int]] = {}  # open ones: numbers, left_open, due
        if state.exists:
            names, numbers = state.get
            flows = {n: list(numbers[i * held : (i + 1) * held]) for i, n in enumerate(names)}
        before, now = len(flows), state.getCurrentWatermarkMs()
        ids, ended, fresh = [], [], {}
        windows: dict[str, list] = {}
        for f in () if state.hasTimedOut else frames:
            for id_, at, numbers in zip(f["id"].tolist(), f["at"].tolist(), f["pieces"].tolist(), strict=True):
                if id_ != END_OF_CAPTURE:
                    windows.setdefault(id_, []).append((at, numbers))
        for id_, own in windows.items():
            numbers = flows.pop(id_, None)
            flow = None if numbers is None else unpacked(numbers) | {"left_open": numbers[WIDTH]}
            for _, parts in sorted(own, key=lambda w: w[0]):
                done, flow = fold_pieces(flow, read(parts.tolist()), timeout, idle)
                for f in done:
                    ids.append(id_)
                    ended.append([*packed(f), *[int(f[n]) for n in ENDED]])
            if flow is not None:
                # Timers are in milliseconds and must lie beyond the watermark.
                due = (flow["t1"] + timeout) // 1000 + 1
                fresh[id_] = [*packed(flow), flow["left_open"], max(due, now + 1)]
        for id_ in [n for n, numbers in flows.items() if numbers[-1] < now]:
            ids.append(id_)
            ended.append([*flows.pop(id_)[:WIDTH], False, True])
        flows |= fresh
        if flows:
            state.update((list(flows), [x for numbers in flows.values() for x in numbers]))
            state.setTimeoutTimestamp(min(numbers[-1] for numbers in flows.values()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [*ids, OPENED], "flow": [*[[int(x) for x in f] for f in ended], [len(flows) - before]]})

    ship_package(pieces.sparkSession)
    timed = pieces.withWatermark("at", "0 seconds").withColumn("bucket", F.pmod(F.hash("id"), F.lit(BUCKETS)))
    out = timed.groupBy("bucket").applyInPandasWithState(
        run, _parse_datatype_string(FLOW), _parse_datatype_string(STATE), "append", "EventTimeTimeout"
    )
    opened = F.coalesce(F.sum(F.when(F.col("id") == OPENED, F.col("flow")[0])), F.lit(0))
    return out.observe(OPENED, opened.alias("flows")).filter(F.col("id") != OPENED)


def as_flows(ended: DataFrame) -> DataFrame:
    """Ended flows with the key and column types of ``hot_flows.merged_features``."""
    columns, at = [], 0
    for n in BODY:
        value = F.col("flow")[at]
        at += 1
        if n in SQUARES:
            value = value.cast("decimal(38,0)") * F.lit(HALF) + F.col("flow")[at]
            value = value.cast("decimal(38,0)")
            at += 1
        elif n in FLAGS:
            value = value != 0
        elif n in ("max_iat", "idle") or n.split("_")[0] in ("hdr", "m"):
            value = F.when(value >= 0, value)
        columns.append(value.alias(n))
    columns += [(F.col("flow")[at + i] != 0).alias(n) for i, n in enumerate(ENDED)]
    parts = F.split("id", "\\|")
    key = [F.nullif(F.get(parts, i), F.lit("")).cast(kind).alias(n) for i, (n, kind) in enumerate(KEY)]
    return ended.select(F.struct(*key[:5]).alias("k"), key[5], *columns)


def key_text(df: DataFrame, capture: str | None) -> DataFrame:
    """``flows.keyed`` packets with their key and capture window as ``id``."""
    parts = [F.col(f"k.{n}") for n, _ in KEY[:5]] + [F.lit(0) if capture is None else F.col(capture)]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts])
    # A packet without a number counts as 0.
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("len", "win", "hdr")}
    return df.withColumns(filled).select(text.alias("id"), *_PACKET)


__all__ = ["END_OF_CAPTURE", "FLOW", "KEYED", "PIECES", "as_flows", "cut_window", "flow_states", "fold_pieces", "key_text", "packet_windows", "window_pieces"]
