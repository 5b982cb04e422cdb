"""Packets to bidirectional flows with 18 statistics each.

A flow is a run of packets of one 5-tuple (either direction).  A packet opens a
new flow when the 5-tuple was silent for longer than the timeout, when the
previous packet carried RST, or when with the previous packet both endpoints had
sent FIN.

Everything is window functions over one ordering of one hash partitioning, so the
plan has a single exchange and a single sort before the final aggregation.  The
two-sided FIN rule, a small state machine, has a closed form:

* only FIN packets matter; number them 1, 2, ...;
* a FIN is a *turn* when the FIN before it in the same unbroken segment came from the
  other endpoint;
* only turns can close a flow, and a turn closes it unless the FIN before it was
  itself the closing one;
* so the first turn after a FIN that is no turn closes, and from there on closing
  alternates: it depends on the distance to the latest FIN that is no turn.

5-tuples with very many packets do not fit one task; ``hot_rows`` routes them
through :mod:`tidewatch.operators.hot_flows`, which gives the same flows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import packet as P
from tidewatch.schemas import FEATURES, FLOW_HEAD

TIMEOUT = "5 seconds"
IDLE = "1 second"
HOT_ROWS = 5_000_000

_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}


def micros(duration: str) -> int:
    """``"5 seconds"`` -> 5000000."""
    number, unit = duration.split()
    return round(float(number) * _UNITS[unit.rstrip("s")])


def keyed(packets: DataFrame, window: str | None = None) -> tuple[DataFrame, list[str]]:
    """Keep TCP/UDP packets and add the partition columns of the flow table.

    Addresses and ports travel once, inside the key; ``a_side`` tells which of its
    endpoints sent the packet.  With ``window`` every tumbling capture window has its
    own flow table.
    """
    key = P.flow_key(*(F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")))
    df = packets.filter(P.is_transport(F.col("protocol"))).withColumn("k", key)
    columns = [
        "k",
        "seq",
        F.unix_micros("ts").alias("t"),
        ((F.col("src_ip") == F.col("k.ip_a")) & (F.col("src_port") == F.col("k.port_a"))).alias("a_side"),
        F.col("payload_len").cast("long").alias("len"),
        F.col("tcp_window").cast("int").alias("win"),
        F.col("header_size").cast("int").alias("hdr"),
        P.has_flag(F.col("tcp_flags"), P.FIN).alias("fin"),
        P.has_flag(F.col("tcp_flags"), P.RST).alias("rst"),
    ]
    by = ["k"]
    if window:
        columns.append((F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(micros(window)))).alias("capture"))
        by.append("capture")
    return df.select(*columns), by


@dataclass(frozen=True)
class Frames:
    """SQL window clauses over the packets of a key in time order."""

    row: str
    before: str
    upto: str


def frames(by: list[str], order: str = "t, seq") -> Frames:
    over = f"PARTITION BY {', '.join(by)} ORDER BY {order}"
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return Frames(f"OVER ({over})", f"OVER ({over} {rows} 1 PRECEDING)", f"OVER ({over} {rows} CURRENT ROW)")


def last_where(cond: str, value: str, frame: str) -> str:
    """The value at the latest row of the frame that meets the condition."""
    return f"last(CASE WHEN {cond} THEN {value} END, true) {frame}"


SIDES = {"a": "a_side", "b": "NOT a_side"}


def looking_back(df: DataFrame, w: Frames) -> DataFrame:
    """Add what the packet before says, and the latest packet of either side."""
    latest = [f"{last_where(mine, 'struct(t, seq)', w.before)} AS prev_{s}" for s, mine in SIDES.items()]
    return df.selectExpr("*", f"lag(t) {w.row} AS prev_t", f"lag(rst) {w.row} AS prev_rst", *latest)


def since(position: str, start: str) -> str:
    """Whether a (t, seq) position is not before another."""
    return f"({position}.t > {start}.t OR ({position}.t = {start}.t AND {position}.seq >= {start}.seq))"


def fin_turns(df: DataFrame, w: Frames, *more: str) -> DataFrame:
    """Add ``fin_no``, ``fin_first`` (first FIN of its segment) and ``turn``.

    ``more`` are further running columns to compute in the same pass.
    """
    # The latest FIN (1 or 2 by endpoint) or hard cut without FIN (0) before this packet.
    event = "CASE WHEN fin THEN if(a_side, 1, 2) WHEN hard THEN 0 END"
    df = df.selectExpr(
        "*", f"last({event}, true) {w.before} AS prev_event", f"sum(CAST(fin AS BIGINT)) {w.upto} AS fin_no", *more
    )
    df = df.selectExpr("*", "fin AND (hard OR coalesce(prev_event, 0) = 0) AS fin_first")
    return df.selectExpr("*", "fin AND NOT fin_first AND prev_event <> if(a_side, 1, 2) AS turn")


def closing_fins(df: DataFrame, w: Frames, turns: dict[str, str]) -> DataFrame:
    """For each ``{closes: turn}`` pair of columns mark the turns that close a flow,
    and with ``<closes>_before`` the packet after each.

    The first turn after a FIN that is no turn closes; from there it alternates.
    """

    def origin(turn: str, frame: str) -> str:
        return f"coalesce({last_where(f'fin AND NOT {turn}', 'fin_no', frame)}, 0)"

    running = [f"lag(fin_no) {w.row} AS fin_no_before"]
    for c, t in turns.items():
        running += [
            f"{origin(t, w.upto)} AS {c}_from",
            f"{origin(t, w.before)} AS {c}_from_before",
            f"lag({t}) {w.row} AS {c}_turn_before",
        ]
    df = df.selectExpr("*", *running)
    made = []
    for c, t in turns.items():
        made += [
            f"{t} AND (fin_no - {c}_from) % 2 = 1 AS {c}",
            f"coalesce({c}_turn_before AND (fin_no_before - {c}_from_before) % 2 = 1, false) AS {c}_before",
        ]
    return df.selectExpr("*", *made)


def number_flows(df: DataFrame, by: list[str], timeout: str = TIMEOUT) -> DataFrame:
    """Add ``flow_no`` (1, 2, ... per key), ``starts``, ``forward`` and the cut flags."""
    w = frames(by)
    df = looking_back(df, w)
    df = df.selectExpr("*", f"prev_t IS NULL OR t - prev_t > {micros(timeout)} OR prev_rst AS hard")
    df = closing_fins(fin_turns(df, w), w, {"closes": "turn"})
    df = df.selectExpr("*", "hard OR closes_before AS starts")
    df = df.selectExpr(
        "*",
        f"sum(CAST(starts AS BIGINT)) {w.upto} AS flow_no",
        f"{last_where('starts', 'struct(t, seq, a_side)', w.upto)} AS opener",
        f"lead(t) {w.row} IS NULL AS is_last",
    )
    return df.selectExpr("*", "a_side = opener.a_side AS forward")


CUTS = ("flow_no", "seq", "t", "starts", "forward", "fin", "rst", "closes")


def cut_flows(
    packets: DataFrame, timeout: str = TIMEOUT, window: str | None = None, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Packets with the flow each belongs to: ``flow_no`` inside ``k`` (and window).

    ``hot_rows`` as in ``build_flows``.
    """
    df, by = keyed(packets, window)
    cold, hot, n_rows = split_hot(df, by, hot_rows)
    out = number_flows(cold, by, timeout).select(*by, *CUTS)
    if hot is None:
        return out
    from tidewatch.operators.hot_flows import hot_cuts

    return out.unionByName(hot_cuts(hot, by, n_rows, hot_rows, micros(timeout)).select(*by, *CUTS))


def split_hot(df: DataFrame, by: list[str], hot_rows: int | None) -> tuple[DataFrame, DataFrame | None, int]:
    """Packets of usual keys, those of keys with more than ``hot_rows``, None if there are none, and how many those are."""
    if hot_rows is None:
        return df, None, 0
    from tidewatch.operators.hot_flows import hot_keys
    from tidewatch.operators.ranks import join_small

    hot, n_keys, n_rows = hot_keys(df, by, hot_rows)
    if n_keys == 0:
        return df, None, 0
    return join_small(df, hot, by, "left_anti", stored=True), join_small(df, hot, by, "left_semi", stored=True), n_rows


def flow_features(df: DataFrame, by: list[str], idle: str = IDLE, end: Column | None = None) -> DataFrame:
    """One row of metadata and features per flow of ``number_flows``.

    ``end`` is what ``capture_end`` says of these packets.
    """

    def gap(s: str) -> str:
        return f"CASE WHEN {SIDES[s]} AND {since(f'prev_{s}', 'opener')} THEN t - prev_{s}.t END"

    df = df.selectExpr("*", "CASE WHEN NOT starts THEN t - prev_t END AS iat", f"coalesce({gap('a')}, {gap('b')}) AS side_iat")
    df = df.selectExpr(
        *by, "flow_no", "seq", "t", "len", "win", "hdr", "fin", "rst", "starts", "closes", "is_last", "forward", "iat",
        "opener.a_side AS opener_a",
        "CASE WHEN forward THEN side_iat END AS fwd_iat",
        "CASE WHEN NOT forward THEN side_iat END AS bwd_iat",
        "CASE WHEN forward THEN len END AS fwd_len",
        "CASE WHEN NOT forward THEN len END AS bwd_len",
    )
    # Numbers and flags only, so that the aggregation can hash instead of sorting
    # again.  RST and the closing FIN can only be on the last packet of a flow.
    values = {
        "packets": "count(1)",
        "opener_a": "bool_or(opener_a)",
        "t0": "min(t)",
        "t1": "max(t)",
        "seq0": "max(CASE WHEN starts THEN seq END)",
        "rst": "bool_or(rst)",
        "closes": "bool_or(closes)",
        "is_last": "bool_or(is_last)",
        "FWD Init Win Bytes": "max(CASE WHEN starts THEN win END)",
        "Fwd IAT Total": "coalesce(sum(fwd_iat), 0)",
        "Fwd Seg Size Min": "min(CASE WHEN forward THEN hdr END)",
        "Bwd Packet Length Mean": "coalesce(avg(bwd_len), 0D)",
        "Flow IAT Max": "coalesce(max(iat), 0)",
        "Packet Length Max": "max(len)",
        "Flow IAT Std": "coalesce(stddev_samp(iat), 0D)",
        "Fwd Packet Length Std": "coalesce(stddev_samp(fwd_len), 0D)",
        "Idle Max": f"coalesce(max(CASE WHEN iat > {micros(idle)} THEN iat END), 0)",
        "Packet Length Mean": "avg(len)",
        "Bwd Packet Length Max": "coalesce(max(bwd_len), 0)",
        "Bwd Packet Length Std": "coalesce(stddev_samp(bwd_len), 0D)",
        "Fwd Packet Length Mean": "avg(fwd_len)",
        "Packet Length Min": "min(len)",
        "FIN Flag Count": "count_if(fin)",
        "Bwd IAT Std": "coalesce(stddev_samp(bwd_iat), 0D)",
    }
    return flow_rows(df.groupBy(*by, "flow_no").agg(*[F.expr(f"{e} AS `{n}`") for n, e in values.items()]), end)


def capture_end(last: Column, timeout: int, window: int | None = None) -> Column:
    """The earliest last packet an open flow can have.

    A flow silent for longer than the timeout when the capture (or its window) ends
    ended as idle.  ``last`` is the time of the capture's last packet.
    """
    end = last if window is None else F.least(last, F.col("capture") + window)
    return end - timeout


def flow_rows(grouped: DataFrame, open_from: Column | None = None) -> DataFrame:
    """Final columns from per-flow aggregates and the key."""
    grouped = grouped.withColumn("is_open", F.col("is_last") & (F.lit(True) if open_from is None else F.col("t1") >= open_from))
    capture = [c for c in ("capture",) if c in grouped.columns]
    known = [f"`{c}`" for c in grouped.columns if c in FEATURES or c == "packets"]
    df = grouped.selectExpr(
        *known, *capture, "t0", "seq0",
        "CASE WHEN rst THEN 'rst' WHEN closes THEN 'finfin' WHEN is_open THEN 'flush' ELSE 'idle' END AS end_reason",
        "if(opener_a, k.ip_a, k.ip_b) AS `Src IP`",
        "if(opener_a, k.ip_b, k.ip_a) AS `Dst IP`",
        "if(opener_a, k.port_a, k.port_b) AS `Src Port`",
        "if(opener_a, k.port_b, k.port_a) AS `Dst Port`",
        "k.proto AS Protocol",
        "timestamp_micros(t0) AS start_ts",
    )
    df = df.selectExpr("*", "concat_ws('-', `Src IP`, `Dst IP`, `Src Port`, `Dst Port`, Protocol) AS `Flow ID`")
    made = {
        "flow_uid": f"md5(concat_ws('|', {', '.join(['`Flow ID`', 't0', 'seq0', *capture])}))",
        "Timestamp": "date_format(start_ts, 'yyyy-MM-dd HH:mm:ss')",
    }
    return df.selectExpr(
        *[f"timestamp_micros({c}) AS capture_time" for c in capture],
        *[f"CAST({made.get(f.name, f'`{f.name}`')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in FLOW_HEAD.fields],
        *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in FEATURES],
    )


def build_flows(
    packets: DataFrame,
    timeout: str = TIMEOUT,
    window: str | None = None,
    idle: str = IDLE,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Packets to flows; the one call most users need.

    ``hot_rows``: 5-tuples with more packets than this are cut in parallel pieces.
    Finding them is one count with map-side combine; ``None`` skips it when no
    5-tuple can be that large.
    """
    df, by = keyed(packets, window)
    end = capture_end(df.agg(F.max("t")).scalar(), micros(timeout), micros(window) if window else None)
    cold, hot, n_rows = split_hot(df, by, hot_rows)
    flows = flow_features(number_flows(cold, by, timeout), by, idle, end)
    if hot is None:
        return flows
    from tidewatch.operators.hot_flows import hot_flows

    return flows.unionByName(hot_flows(hot, by, n_rows, hot_rows, timeout, idle, end))


def flow_counts(flows: DataFrame) -> DataFrame:
    """Flows by protocol and by way of ending; open flows are those the end of the capture flushed."""
    return flows.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("Protocol") == P.TCP).alias("flows_tcp"),
        F.count_if(F.col("Protocol") == P.UDP).alias("flows_udp"),
        F.count_if(F.col("end_reason") == "flush").alias("open_flows"),
    )
