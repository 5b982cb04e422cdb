"""Flow building for 5-tuples too large for one task.

One 5-tuple may hold a large share of all packets, even as a single endless flow.
Its packets are range-partitioned by time, every task cuts its range into bounded
*chunks*, and each chunk is reduced to *pieces* of flows before anything is put together:

1. Inside a chunk all cuts are known except those that depend on what came before:
   whether the first packet continues a flow, and which endpoint (none, a, b) had
   an unanswered FIN.  The FIN cuts are therefore marked for all three cases, and
   pieces are cut wherever any case cuts.
2. One summary row per chunk is folded in time order into the real case of each
   chunk.  This is the only sequential step; it sees one row per chunk.
3. Pieces of the same flow are merged: sums add up, and the gap between the end of
   a piece and the start of the next supplies the missing inter-arrival time.

Packets are shuffled twice and never gathered by 5-tuple.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.flows import (
    SIDES,
    Frames,
    closing_fins,
    fin_turns,
    flow_rows,
    frames,
    last_where,
    looking_back,
    micros,
    since,
)
from tidewatch.operators.ranks import join_small
from tidewatch.session import cut_lineage, ship_package, stage_table

CASES = ("none", "a", "b")
_EXACT = "decimal(38,0)"
ROWS_PER_TASK = 250_000  # packets of hot keys a task cuts into chunks, unless one chunk has more


def hot_keys(df: DataFrame, by: list[str], limit: int) -> tuple[DataFrame, int, int]:
    """Keys with more than ``limit`` packets, how many, and their packets in all.

    The count is combined before the shuffle; the result has at most rows/limit rows.
    """
    if df.count() <= limit:
        return df.select(*by).limit(0), 0, 0
    hot = df.groupBy(*by).count().filter(F.col("count") > limit)
    n_keys, n_rows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    return (cut_lineage(hot) if n_keys else hot).select(*by), n_keys, n_rows


def _chunked(df: DataFrame, by: list[str], n_rows: int, limit: int) -> DataFrame:
    """Packets with ``chunk``: stretches of at most ``limit`` packets, numbered in order of key and time.

    A task sorts a range of packets and cuts it into chunks.  Tasks follow the number of
    packets, not of chunks: each costs the driver some KB, and samples for the range borders.
    """
    tasks = max(2, -(-n_rows // max(limit, ROWS_PER_TASK)))
    size = max(1, min(limit, -(-n_rows // 2)))
    place = F.monotonically_increasing_id()  # the task above, the row in its sorted range below
    df = df.repartitionByRange(tasks, *by, "t", "seq").sortWithinPartitions(*by, "t", "seq").withColumn("place", place)
    return df.withColumn("chunk", F.expr(f"((place >> 33) << 33) + (place & {(1 << 33) - 1}) div {size}")).drop("place")


def _marked(df: DataFrame, by: list[str], n_rows: int, limit: int, timeout: int) -> tuple[DataFrame, Frames]:
    """Packets in chunks of at most ``limit``, with what can be said inside each.

    Adds ``chunk``, ``seg`` (hard cuts so far) and, for each case a chunk may be entered
    in, ``start_<case>`` and ``closes_<case>``.  The chunk borders come from a sample of
    the data, so the result must be stored: a second evaluation could draw other borders.
    """
    df = _chunked(df, by, n_rows, limit)
    w = frames([*by, "chunk"])
    df = looking_back(df, w)
    df = df.selectExpr("*", f"prev_t IS NOT NULL AND (t - prev_t > {timeout} OR prev_rst) AS hard")
    df = fin_turns(df, w, f"sum(CAST(hard AS BIGINT)) {w.upto} AS seg")
    # An unanswered FIN carried in acts like a FIN before the first one of segment 0.
    df = df.selectExpr(
        "*",
        "turn AS turn_none",
        "turn OR (fin_first AND seg = 0 AND NOT a_side) AS turn_a",
        "turn OR (fin_first AND seg = 0 AND a_side) AS turn_b",
    )
    df = closing_fins(df, w, {f"closes_{c}": f"turn_{c}" for c in CASES})
    return df.selectExpr("*", *[f"hard OR closes_{c}_before AS start_{c}" for c in CASES]), w


def _left_open(case: str) -> str:
    """Endpoint of the unanswered FIN after a packet, as a case number."""
    return f"""CASE WHEN last_fin.seg = seg AND last_fin.closes_{case} THEN 0
        WHEN last_fin.seg = seg THEN if(last_fin.a_side, 1, 2)
        WHEN seg = 0 THEN {CASES.index(case)} ELSE 0 END"""


def cut_pieces(df: DataFrame, by: list[str], n_rows: int, limit: int, timeout: int, idle: int) -> DataFrame:
    """Reduce packets to pieces, chunk by chunk (stored)."""
    part = [*by, "chunk"]
    df, w = _marked(df, by, n_rows, limit, timeout)
    df = df.selectExpr("*", "start_none OR start_a OR start_b AS cut")
    closes = ", ".join(f"closes_{c}" for c in CASES)
    df = df.selectExpr(
        "*",
        f"sum(CAST(cut AS BIGINT)) {w.upto} AS piece",
        f"coalesce(lead(cut) {w.row}, true) AS is_end",
        "prev_t IS NULL OR cut AS is_start",
        "CASE WHEN NOT cut THEN t - prev_t END AS iat",
        f"{last_where('fin', f'struct(seg, a_side, {closes})', w.upto)} AS last_fin",
        f"{last_where('prev_t IS NULL OR cut', 'struct(t, seq)', w.upto)} AS opener",
    )
    df = df.selectExpr(
        "*",
        *[f"CASE WHEN {mine} AND {since(f'prev_{s}', 'opener')} THEN t - prev_{s}.t END AS iat_{s}" for s, mine in SIDES.items()],
    )

    def total(x: str) -> str:
        return f"coalesce(sum({x}), 0)"

    def squares(x: str) -> str:
        return f"CAST(coalesce(sum(CAST({x} AS {_EXACT}) * CAST({x} AS {_EXACT})), 0) AS {_EXACT})"

    values = {
        "packets": "count(1)",
        # Of the piece's first packet.
        "t0": "min(t)",
        "seq0": "max(CASE WHEN is_start THEN seq END)",
        "win0": "max(CASE WHEN is_start THEN win END)",
        "opener_a": "bool_or(is_start AND a_side)",
        **{f"start_{c}": f"bool_or(is_start AND start_{c})" for c in CASES},
        # Of its last packet; RST and closing FINs are on no other.
        "t1": "max(t)",
        "rst": "bool_or(rst)",
        **{f"closes_{c}": f"bool_or(closes_{c})" for c in CASES},
        **{f"open_{c}": f"max(CASE WHEN is_end THEN {_left_open(c)} END)" for c in CASES},
        "max_len": "max(len)",
        "min_len": "min(len)",
        "fins": "count_if(fin)",
        "max_iat": "max(iat)",
        "idle": f"max(CASE WHEN iat > {idle} THEN iat END)",
        "n_iat": "count(iat)", "s_iat": total("iat"), "q_iat": squares("iat"),
    }
    for s, mine in SIDES.items():
        length = f"CASE WHEN {mine} THEN len END"
        values |= {
            f"first_{s}": f"min(CASE WHEN {mine} THEN t END)",
            f"last_{s}": f"max(CASE WHEN {mine} THEN t END)",
            f"hdr_{s}": f"min(CASE WHEN {mine} THEN hdr END)",
            f"n_len_{s}": f"count({length})", f"s_len_{s}": total(length), f"q_len_{s}": squares(length),
            f"m_len_{s}": f"max({length})",
            f"n_iat_{s}": f"count(iat_{s})", f"s_iat_{s}": total(f"iat_{s}"), f"q_iat_{s}": squares(f"iat_{s}"),
        }
    return stage_table(df.groupBy(*part, "piece").agg(*[F.expr(f"{e} AS {n}") for n, e in values.items()]))


def _chunk_cases(pieces: DataFrame, by: list[str], timeout: int) -> DataFrame:
    """The real case and the flow carried into each chunk: one row per chunk."""
    first, last = F.col("piece") == F.col("first_piece"), F.col("piece") == F.col("last_piece")
    whole = Window.partitionBy(*by, "chunk")
    marked = pieces.withColumns({"first_piece": F.min("piece").over(whole), "last_piece": F.max("piece").over(whole)})
    flat = marked.groupBy(*by, "chunk").agg(
        F.max(F.when(first, F.col("t0"))).alias("first_t"),
        F.max(F.when(last, F.col("t1"))).alias("last_t"),
        F.bool_or(last & F.col("rst")).alias("last_rst"),
        *[F.bool_or(last & F.col(f"closes_{c}")).alias(f"closes_{c}") for c in CASES],
        *[F.max(F.when(last, F.col(f"open_{c}"))).alias(f"open_{c}") for c in CASES],
        *[F.count_if(f"start_{c}").alias(f"starts_{c}") for c in CASES],
    )
    schema = T.StructType(
        [flat.schema[c] for c in by]
        + [
            T.StructField("chunk", T.LongType()),
            T.StructField("entry", T.IntegerType()),
            T.StructField("entry_starts", T.BooleanType()),
            T.StructField("from_chunk", T.LongType()),
            T.StructField("from_no", T.LongType()),
            T.StructField("is_final", T.BooleanType()),
        ]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Chunks are numbered in time order over all keys, so a key's chunks are
        # consecutive; sorted within the partition they arrive in that order.
        key = None
        waiting = None
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                this_key = tuple(str(r[c]) for c in by)
                if this_key != key:
                    key, prev, case, flow = this_key, None, 0, None
                if waiting is not None:
                    waiting["is_final"] = prev is None
                    rows.append(waiting)
                hard = prev is None or bool(prev["last_rst"]) or r["first_t"] - prev["last_t"] > timeout
                starts = hard or bool(prev[f"closes_{CASES[case]}"])
                case = 0 if hard else int(prev[f"open_{CASES[case]}"])
                if starts:
                    flow = (r["chunk"], 0)
                waiting = {
                    **{c: r[c] for c in by},
                    "chunk": r["chunk"], "entry": case, "entry_starts": starts,
                    "from_chunk": flow[0], "from_no": flow[1],
                }
                inner = int(r[f"starts_{CASES[case]}"])
                if inner:
                    flow = (r["chunk"], inner)
                prev = r
            if rows:
                yield pd.DataFrame(rows)
        if waiting is not None:
            waiting["is_final"] = True
            yield pd.DataFrame([waiting])

    ship_package(pieces.sparkSession)
    return flat.repartition(*by).sortWithinPartitions(*by, "chunk").mapInPandas(fold, schema)


def hot_cuts(df: DataFrame, by: list[str], n_rows: int, limit: int, timeout: int) -> DataFrame:
    """Packets of hot keys with the flow each belongs to, as ``flows.number_flows`` does.

    A segmented scan: chunks are marked on their own and stored, one row per key and chunk
    is folded into what the chunk begins with (the case, flows before it and who opened
    the one that goes on), and that is joined back to the chunk's packets.
    """
    df, w = _marked(df, by, n_rows, limit, timeout)
    closes = ", ".join(f"closes_{c}" for c in CASES)
    df = df.selectExpr("*", f"{last_where('fin', f'struct(seg, a_side, {closes})', w.upto)} AS last_fin")
    cases = [f"{n}_{c}" for n in ("start", "closes") for c in CASES]
    marked = stage_table(df.selectExpr(
        *by, "chunk", "seq", "t", "a_side", "fin", "rst", *cases, *[f"{_left_open(c)} AS open_{c}" for c in CASES], "prev_t IS NULL AS leads"
    ))
    last = lambda v: F.max_by(v, F.struct("t", "seq"))
    flat = marked.groupBy(*by, "chunk").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), last("rst").alias("last_rst"),
        F.min_by("a_side", F.struct("t", "seq")).alias("first_side"),
        *[last(f"{n}_{c}").alias(f"{n}_{c}") for n in ("closes", "open") for c in CASES],
        *[F.count_if(f"start_{c}").alias(f"starts_{c}") for c in CASES],
        *[F.max_by("a_side", F.when(F.col(f"start_{c}"), F.struct("t", "seq"))).alias(f"side_{c}") for c in CASES],
    )
    schema = T.StructType(
        [flat.schema[c] for c in by]
        + [T.StructField(n, t) for n, t in (
            ("chunk", T.LongType()), ("entry", T.IntegerType()), ("entry_starts", T.BooleanType()),
            ("flows_before", T.LongType()), ("opened", T.BooleanType()),
        )]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                this_key = tuple(str(r[c]) for c in by)
                if this_key != key:
                    key, prev, case, flows, opened = this_key, None, 0, 0, None
                hard = prev is None or bool(prev["last_rst"]) or r["first_t"] - prev["last_t"] > timeout
                starts = hard or bool(prev[f"closes_{CASES[case]}"])
                case = 0 if hard else int(prev[f"open_{CASES[case]}"])
                rows.append({**{c: r[c] for c in by}, "chunk": r["chunk"], "entry": case, "entry_starts": starts,
                             "flows_before": flows, "opened": bool(r["first_side"]) if starts else opened})
                inner = int(r[f"starts_{CASES[case]}"])
                flows += inner + starts
                opened = bool(r[f"side_{CASES[case]}"]) if inner else rows[-1]["opened"]
                prev = r
            if rows:
                yield pd.DataFrame(rows)

    ship_package(df.sparkSession)
    entries = cut_lineage(flat.repartition(*by).sortWithinPartitions(*by, "chunk").mapInPandas(fold, schema))
    df = join_small(marked, entries, [*by, "chunk"], stored=True)

    def pick(prefix: str) -> str:
        return f"element_at(array({', '.join(f'{prefix}_{c}' for c in CASES)}), entry + 1)"

    df = df.selectExpr("*", f"(leads AND entry_starts) OR {pick('start')} AS starts", f"{pick('closes')} AS closes")
    opener = f"coalesce({last_where('starts', 'a_side', w.upto)}, opened)"
    return df.selectExpr("*", f"flows_before + sum(CAST(starts AS BIGINT)) {w.upto} AS flow_no", f"a_side = {opener} AS forward")


def assign_flows(pieces: DataFrame, by: list[str], timeout: int) -> DataFrame:
    """Pieces with the flow they belong to: ``flow_chunk`` and ``flow_no``."""
    cases = cut_lineage(_chunk_cases(pieces, by, timeout))
    # One row per key and chunk.
    df = join_small(pieces, cases, [*by, "chunk"], stored=True)

    def pick(prefix: str) -> str:
        return f"element_at(array({', '.join(f'{prefix}_{c}' for c in CASES)}), entry + 1)"

    w = frames([*by, "chunk"], "piece")
    df = df.selectExpr("*", f"sum(CAST({pick('start')} AS BIGINT)) {w.upto} AS no")
    df = df.selectExpr(
        "*",
        "if(no > 0, chunk, from_chunk) AS flow_chunk",
        "if(no > 0, no, from_no) AS flow_no",
        f"{pick('closes')} AS closes",
        f"{pick('open')} AS left_open",
        f"is_final AND lead(piece) {w.row} IS NULL AS is_last",
    )
    used = [f"{p}_{c}" for p in ("start", "closes", "open") for c in CASES]
    return df.drop("no", "entry", "entry_starts", "from_chunk", "from_no", "is_final", *used)


def merge_pieces(df: DataFrame, by: list[str], idle: int) -> DataFrame:
    """One row per flow with the columns of a piece, and how it ended."""
    flow = [*by, "flow_chunk", "flow_no"]
    w = frames(flow, "chunk, piece")
    df = df.selectExpr(
        "*",
        f"t0 - lag(t1) {w.row} AS gap",
        f"lag(t1) {w.row} IS NULL AS leads",
        f"lead(t0) {w.row} IS NULL AS ends",
        f"first_a - last(last_a, true) {w.before} AS gap_a",
        f"first_b - last(last_b, true) {w.before} AS gap_b",
    )

    def with_gap(gap: str, suffix: str) -> dict[str, str]:
        """Inter-arrival count, sum and sum of squares, gaps between pieces included."""
        wide = f"CAST(coalesce({gap}, 0) AS {_EXACT})"
        return {
            f"n_iat{suffix}": f"sum(n_iat{suffix} + CAST({gap} IS NOT NULL AS BIGINT))",
            f"s_iat{suffix}": f"sum(s_iat{suffix} + coalesce({gap}, 0))",
            f"q_iat{suffix}": f"CAST(sum(CAST(q_iat{suffix} + {wide} * {wide} AS {_EXACT})) AS {_EXACT})",
        }

    values = {
        "packets": "sum(packets)",
        "t0": "min(t0)",
        "seq0": "max(CASE WHEN leads THEN seq0 END)",
        "win0": "max(CASE WHEN leads THEN win0 END)",
        "opener_a": "bool_or(leads AND opener_a)",
        "t1": "max(t1)",
        "rst": "bool_or(ends AND rst)",
        "closes": "bool_or(ends AND closes)",
        "left_open": "max(CASE WHEN ends THEN left_open END)",
        "is_last": "bool_or(is_last)",
        "max_len": "max(max_len)",
        "min_len": "min(min_len)",
        "fins": "sum(fins)",
        "max_iat": "max(greatest(max_iat, gap))",
        "idle": f"max(greatest(idle, CASE WHEN gap > {idle} THEN gap END))",
        **with_gap("gap", ""),
    }
    for s in ("a", "b"):
        values |= {
            f"first_{s}": f"min(first_{s})", f"last_{s}": f"max(last_{s})", f"hdr_{s}": f"min(hdr_{s})",
            f"n_len_{s}": f"sum(n_len_{s})", f"s_len_{s}": f"sum(s_len_{s})",
            f"q_len_{s}": f"CAST(sum(q_len_{s}) AS {_EXACT})", f"m_len_{s}": f"max(m_len_{s})",
            **with_gap(f"gap_{s}", f"_{s}"),
        }
    return df.groupBy(*flow).agg(*[F.expr(f"{e} AS {n}") for n, e in values.items()])


def _std(n: Column, s: Column, q: Column) -> Column:
    """Sample deviation from exact count, sum and sum of squares; 0 below two values."""
    nd, sd = n.cast(_EXACT), s.cast(_EXACT)
    spread = (nd * q - sd * sd).cast("double") / (n.cast("double") * (n.cast("double") - 1.0))
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)


def merged_features(flow: DataFrame, end: Column | None = None) -> DataFrame:
    """Feature rows of merged flows; ``end`` as in ``flow_features``."""

    def side(name: str, forward: bool) -> Column:
        return F.when(F.col("opener_a") == forward, F.col(f"{name}_a")).otherwise(F.col(f"{name}_b"))

    def spread(names: tuple[str, str, str], forward: bool) -> Column:
        return _std(*[side(n, forward) for n in names])

    length, iat, zero = ("n_len", "s_len", "q_len"), ("n_iat", "s_iat", "q_iat"), F.lit(0)
    n_bwd = F.when(side("n_len", False) > 0, side("n_len", False))
    values = {
        "FWD Init Win Bytes": F.col("win0"),
        "Fwd IAT Total": side("s_iat", True),
        "Fwd Seg Size Min": side("hdr", True),
        "Bwd Packet Length Mean": F.coalesce(side("s_len", False) / n_bwd, F.lit(0.0)),
        "Flow IAT Max": F.coalesce("max_iat", zero),
        "Packet Length Max": F.col("max_len"),
        "Flow IAT Std": _std(*[F.col(n) for n in iat]),
        "Fwd Packet Length Std": spread(length, True),
        "Idle Max": F.coalesce("idle", zero),
        "Packet Length Mean": (F.col("s_len_a") + F.col("s_len_b")) / F.col("packets"),
        "Bwd Packet Length Max": F.coalesce(side("m_len", False), zero),
        "Bwd Packet Length Std": spread(length, False),
        "Fwd Packet Length Mean": side("s_len", True) / side("n_len", True),
        "Packet Length Min": F.col("min_len"),
        "FIN Flag Count": F.col("fins"),
        "Bwd IAT Std": spread(iat, False),
    }
    return flow_rows(flow.withColumns(values), end)


def hot_flows(
    df: DataFrame, by: list[str], n_rows: int, limit: int, timeout: str, idle: str, end: Column | None = None
) -> DataFrame:
    """Flows of the packets of hot keys; same rows as the single-task plan."""
    gap_limit, idle_limit = micros(timeout), micros(idle)
    pieces = cut_pieces(df, by, n_rows, limit, gap_limit, idle_limit)
    return merged_features(merge_pieces(assign_flows(pieces, by, gap_limit), by, idle_limit), end)
