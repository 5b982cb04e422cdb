"""The catalogue's queries once more as SQL, for checking results."""

from __future__ import annotations

from tidewatch.schemas import FEATURES

PACKETS = """
pk AS (
 SELECT event_id AS seq,
        1704067200000000 + (epoch_us(ts) - 1704067200000000) // 10000 AS t_us,
        CASE WHEN event_id % 3 <> 0 THEN cip ELSE sip END AS src_ip,
        CASE WHEN event_id % 3 <> 0 THEN sip ELSE cip END AS dst_ip,
        CASE WHEN event_id % 3 <> 0 THEN cport ELSE sport END AS src_port,
        CASE WHEN event_id % 3 <> 0 THEN sport ELSE cport END AS dst_port,
        proto AS protocol,
        CAST(floor(value * 10) AS BIGINT) AS payload_len,
        CASE WHEN proto = 17 THEN 0
             WHEN event_type = 'error' AND event_id % 4 = 0 THEN 4
             WHEN event_type = 'purchase' THEN 17 ELSE 16 END AS tcp_flags,
        CASE WHEN proto = 17 THEN 0 ELSE (event_id * 37) % 65536 END AS tcp_window,
        CASE WHEN proto = 17 THEN 8 ELSE 20 + 4 * (event_id % 4) END AS header_size
 FROM (SELECT *, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS cip,
              '192.168.1.' || (user_id % 5 + 1) AS sip, 40000 + user_id % 20000 AS cport,
              CASE user_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53 ELSE 8080 END AS sport,
              CASE WHEN user_id % 5 = 3 THEN 17 ELSE 6 END AS proto
       FROM events))
"""


def walk(window: int | None = None, halves: bool = False) -> str:
    """Packet-by-packet state machine as a recursive query, and flow aggregates."""
    capture = f"t_us - t_us % {window}" if window else "0"
    last = "(SELECT max(t_us) FROM ord)"
    last = f"least({last}, capture + {window})" if window else last
    if halves:  # two captures, one after the other
        capture = "CASE WHEN t_us < (SELECT (min(t_us) + max(t_us)) // 2 FROM pk) THEN 0 ELSE 1 END"
        last = "(SELECT max(o.t_us) FROM ord o WHERE o.capture = iats.capture)"
    std = "coalesce(stddev_samp({}), 0.0)"
    return f"""
WITH RECURSIVE {PACKETS},
keyed AS (
 SELECT *, {capture} AS capture,
        CASE WHEN (src_ip, dst_ip, src_port, dst_port) <= (dst_ip, src_ip, dst_port, src_port)
             THEN src_ip || ' ' || dst_ip || ' ' || src_port || ' ' || dst_port || ' ' || protocol
             ELSE dst_ip || ' ' || src_ip || ' ' || dst_port || ' ' || src_port || ' ' || protocol END AS k
 FROM pk),
ord AS (
 SELECT *, row_number() OVER (PARTITION BY capture, k ORDER BY t_us, seq) AS rn FROM keyed),
walk AS (
 SELECT capture, k, rn, t_us, 1 AS flow_no, src_ip AS o_ip, src_port AS o_port, tcp_flags & 4 <> 0 AS rst,
        tcp_flags & 1 <> 0 AS fin_f, false AS fin_b
 FROM ord WHERE rn = 1
 UNION ALL
 SELECT o.capture, o.k, o.rn, o.t_us,
        w.flow_no + CASE WHEN {{cut}} THEN 1 ELSE 0 END,
        CASE WHEN {{cut}} THEN o.src_ip ELSE w.o_ip END,
        CASE WHEN {{cut}} THEN o.src_port ELSE w.o_port END,
        o.tcp_flags & 4 <> 0,
        CASE WHEN {{cut}} THEN o.tcp_flags & 1 <> 0
             ELSE w.fin_f OR (o.tcp_flags & 1 <> 0 AND o.src_ip = w.o_ip AND o.src_port = w.o_port) END,
        CASE WHEN {{cut}} THEN false
             ELSE w.fin_b OR (o.tcp_flags & 1 <> 0 AND NOT (o.src_ip = w.o_ip AND o.src_port = w.o_port)) END
 FROM walk w JOIN ord o ON o.capture = w.capture AND o.k = w.k AND o.rn = w.rn + 1),
cut AS (
 SELECT o.*, w.flow_no, w.rst, w.fin_f AND w.fin_b AS finfin,
        o.src_ip = w.o_ip AND o.src_port = w.o_port AS fwd,
        max(w.rn) OVER (PARTITION BY w.capture, w.k) = w.rn AS is_last
 FROM walk w JOIN ord o USING (capture, k, rn)),
iats AS (
 SELECT *, t_us - lag(t_us) OVER (PARTITION BY capture, k, flow_no ORDER BY rn) AS iat,
        t_us - lag(t_us) OVER (PARTITION BY capture, k, flow_no, fwd ORDER BY rn) AS side_iat
 FROM cut),
flows AS (
 SELECT capture, k, flow_no, count(*) AS packets, min(t_us) AS t0, min(rn) AS rn0,
        arg_min(seq, rn) AS seq0,
        arg_min(src_ip, rn) AS "Src IP", arg_min(dst_ip, rn) AS "Dst IP",
        arg_min(src_port, rn) AS src_port0, arg_min(dst_port, rn) AS dst_port0, arg_min(protocol, rn) AS protocol0,
        CASE WHEN arg_max(rst, rn) THEN 'rst' WHEN arg_max(finfin, rn) THEN 'finfin'
             WHEN arg_max(is_last, rn) AND {last} - max(t_us) <= 5000000 THEN 'flush' ELSE 'idle' END AS end_reason,
        CAST(arg_min(tcp_window, rn) AS DOUBLE) AS "FWD Init Win Bytes",
        CAST(coalesce(sum(side_iat) FILTER (fwd), 0) AS DOUBLE) AS "Fwd IAT Total",
        CAST(arg_min(protocol, rn) AS DOUBLE) AS "Protocol",
        CAST(min(header_size) FILTER (fwd) AS DOUBLE) AS "Fwd Seg Size Min",
        coalesce(avg(payload_len) FILTER (NOT fwd), 0.0) AS "Bwd Packet Length Mean",
        CAST(coalesce(max(iat), 0) AS DOUBLE) AS "Flow IAT Max",
        CAST(max(payload_len) AS DOUBLE) AS "Packet Length Max",
        {std.format("iat")} AS "Flow IAT Std",
        coalesce(stddev_samp(payload_len) FILTER (fwd), 0.0) AS "Fwd Packet Length Std",
        CAST(coalesce(max(iat) FILTER (iat > 1000000), 0) AS DOUBLE) AS "Idle Max",
        avg(payload_len) AS "Packet Length Mean",
        CAST(coalesce(max(payload_len) FILTER (NOT fwd), 0) AS DOUBLE) AS "Bwd Packet Length Max",
        coalesce(stddev_samp(payload_len) FILTER (NOT fwd), 0.0) AS "Bwd Packet Length Std",
        avg(payload_len) FILTER (fwd) AS "Fwd Packet Length Mean",
        CAST(min(payload_len) AS DOUBLE) AS "Packet Length Min",
        CAST(arg_min(dst_port, rn) AS DOUBLE) AS "Dst Port",
        CAST(count(*) FILTER (tcp_flags & 1 <> 0) AS DOUBLE) AS "FIN Flag Count",
        coalesce(stddev_samp(side_iat) FILTER (NOT fwd), 0.0) AS "Bwd IAT Std"
 FROM iats GROUP BY capture, k, flow_no)
""".replace("{cut}", "(o.t_us - w.t_us > 5000000 OR w.rst OR (w.fin_f AND w.fin_b))")


ROUNDED = ", ".join(f'round("{f}", 3) AS "{f}"' for f in FEATURES)
FLOW_NAME = '"Src IP" || \'-\' || "Dst IP" || \'-\' || src_port0 || \'-\' || dst_port0 || \'-\' || protocol0'
FLOW_HEAD = (
    f'md5({FLOW_NAME} || \'|\' || t0 || \'|\' || seq0) AS flow_uid, end_reason, packets, {FLOW_NAME} AS "Flow ID", '
    '"Src IP", "Dst IP", CAST(src_port0 AS INTEGER) AS "Src Port", '
    "strftime(make_timestamp(t0), '%Y-%m-%d %H:%M:%S') AS \"Timestamp\""
)

RAW = """
raw AS (
 SELECT CAST(event_id AS VARCHAR) AS flow_uid, event_id, 50 - value / 4 AS score_raw, event_type AS scope,
        CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
        CASE WHEN event_id % 100 = 0 THEN 'Normal' WHEN event_id % 50 = 0 THEN 'Attack' END AS human_label
 FROM events)
"""


def scored(scope: str | None = "scope", threshold: float = 45.0, extra: str = "") -> str:
    over = f"GROUP BY {scope}" if scope else ""
    key = scope or "1"
    return f"""
{RAW},
p AS (SELECT {key} AS g, quantile_cont(abs(score_raw - {threshold}), 0.95) AS p95 FROM raw {over}),
scored AS (
 SELECT raw.*, CASE WHEN score_raw < {threshold} THEN 'Attack' ELSE 'Normal' END AS prediction,
        round_even((1 / (1 + exp(-abs((score_raw - {threshold})
            / (CASE WHEN p95 = 0 THEN 1.0 ELSE p95 END / 3.0)))) - 0.5) * 2 * 1e4, 0) / 1e4 AS confidence,
        round_even(score_raw * 1e4, 0) / 1e4 AS gmm_score
 FROM raw JOIN p ON p.g = {f'raw.{scope}' if scope else '1'} {extra})
"""


FEEDBACK = """
fb AS (
 SELECT CAST(CASE WHEN event_id % 4 = 3 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS flow_uid,
        CASE event_id % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Attack' ELSE 'Unclear' END AS human_label,
        CASE WHEN event_id % 2 = 0 THEN 'Normal' ELSE 'Attack' END AS model_prediction,
        ts AS feedback_ts, CASE WHEN event_id % 7 = 0 THEN 'clear' ELSE 'set' END AS action
 FROM events)
"""
EFFECTIVE = """
eff AS (
 SELECT flow_uid, CASE WHEN action = 'set' THEN human_label END AS human_label
 FROM fb QUALIFY row_number() OVER (PARTITION BY flow_uid ORDER BY feedback_ts DESC, action DESC, human_label DESC) = 1)
"""

SCORED_COLUMNS = "flow_uid, prediction, confidence, gmm_score"

# The two-feature bundle of plans.catalog, written out.
TINY = """
x AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25.0) / 14.0 AS x1, (l_extendedprice - 38000.0) / 23000.0 AS x2
      FROM lineitem),
h AS (SELECT *, greatest(x1 * 0.5 + x2 * -0.25 + 0.1, 0) AS h1, greatest(x1 * 0.75 + x2 * 1.0 - 0.2, 0) AS h2 FROM x),
e AS (SELECT *, abs(x1 - (h1 * 1.25 + h2 * 0.5 - 0.05123456789)) AS e1, abs(x2 - (h1 * -0.5 + h2 * 0.8 + 0.15987654321)) AS e2 FROM h),
g AS (SELECT *,
  ln(0.6) - ln(2 * pi()) - 0.5 * ln(0.5 * 0.4 - 0.1 * 0.1)
    - 0.5 * (0.4 * (e1 - 0.4) ** 2 - 2 * 0.1 * (e1 - 0.4) * (e2 - 0.5) + 0.5 * (e2 - 0.5) ** 2)
      / (0.5 * 0.4 - 0.1 * 0.1) AS g1,
  ln(0.4) - ln(2 * pi()) - 0.5 * ln(0.9 * 1.1 - 0.2 * 0.2)
    - 0.5 * (1.1 * (e1 - 1.5) ** 2 + 2 * 0.2 * (e1 - 1.5) * (e2 - 1.2) + 0.9 * (e2 - 1.2) ** 2)
      / (0.9 * 1.1 - 0.2 * 0.2) AS g2
  FROM e),
s AS (SELECT l_orderkey, l_linenumber, e1, e2, (e1 + e2) / 2 AS ae_score,
             greatest(g1, g2) + ln(exp(g1 - greatest(g1, g2)) + exp(g2 - greatest(g1, g2))) AS score_raw FROM g)
"""

HASH = "md5({} || ':{}')"
HEX = "substring(md5({} || ':{}'), 1, 13)"


def model_sql(bundle, source: str) -> str:
    """CTEs that apply a bundle to the feature columns of ``source``; the last is ``sc``."""

    def linear(coefficients, names, constant):
        terms = [f"({float(c)!r}) * {n}" for c, n in zip(coefficients, names) if c != 0]
        return " + ".join([*terms, f"({float(constant)!r})"])

    x = [f"x{i}" for i in range(bundle.dim)]
    scaled = [
        f'("{f}" - ({float(m)!r})) / ({float(s)!r}) AS {n}'
        for f, n, m, s in zip(bundle.feature_names, x, bundle.scaler_mean, bundle.scaler_scale)
    ]
    parts, names, last = [f"l0 AS (SELECT *, {', '.join(scaled)} FROM {source})"], x, 0
    for i, layer in enumerate(bundle.layers):
        kernel, bias = layer["kernel"], layer["bias"]
        if "gamma" in layer:
            factor = layer["gamma"] / (layer["var"] + 1e-3) ** 0.5
            kernel, bias = kernel * factor, (bias - layer["mean"]) * factor + layer["beta"]
        out = [f"h{i}_{j}" for j in range(kernel.shape[1])]
        sums = [linear(kernel[:, j], names, bias[j]) for j in range(kernel.shape[1])]
        if i < len(bundle.layers) - 1:
            sums = [f"greatest({e}, 0)" for e in sums]
        parts.append(f"l{i + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(sums, out))} FROM l{i})")
        names, last = out, i + 1
    errors = ", ".join(f"abs({a} - {b}) AS e{i}" for i, (a, b) in enumerate(zip(x, names)))
    parts.append(f"er AS (SELECT *, {errors} FROM l{last})")
    mixture = bundle.mixture()
    logs = []
    for mean, whiten, const in zip(mixture.means, mixture.whiten, mixture.const):
        squares = [
            f"({linear(row, [f'e{i}' for i in range(bundle.dim)], -float(row @ mean))}) ** 2" for row in whiten
        ]
        logs.append(f"({float(const)!r}) - 0.5 * ({' + '.join(squares)})")
    parts.append(f"lg AS (SELECT *, {', '.join(f'{e} AS g{k}' for k, e in enumerate(logs))} FROM er)")
    top = f"greatest({', '.join(f'g{k}' for k in range(len(logs)))})"
    total = " + ".join(f"exp(g{k} - {top})" for k in range(len(logs)))
    mean_error = f"({' + '.join(f'e{i}' for i in range(bundle.dim))}) / {bundle.dim}"
    parts.append(f"sc AS (SELECT *, {mean_error} AS ae_score, {top} + ln({total}) AS score_raw FROM lg)")
    return ", ".join(parts)


def oracle_sql() -> dict[str, str]:
    flows, windows = walk(), walk(30_000_000)
    q: dict[str, str] = {}

    # packets
    q["packet_filter_cidr"] = f"""WITH {PACKETS}, n AS (
        SELECT *, list_reduce([CAST(v AS BIGINT) for v in string_split(src_ip, '.')], lambda a, b: a * 256 + b) AS s,
               list_reduce([CAST(v AS BIGINT) for v in string_split(dst_ip, '.')], lambda a, b: a * 256 + b) AS d FROM pk)
        SELECT seq, src_ip, dst_ip FROM n
        WHERE s BETWEEN 167772160 AND 167772191 OR d BETWEEN 167772160 AND 167772191"""
    mixed = f"""{PACKETS}, mixed AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN 1 ELSE protocol END AS protocol,
        CASE WHEN seq % 13 = 0 THEN 0 WHEN seq % 4 = 0 THEN 6 ELSE 4 END AS ip_version FROM pk)"""
    q["packet_counters"] = f"""WITH {mixed} SELECT
        count(*) FILTER (ip_version IN (4, 6) AND protocol IN (6, 17)) AS packets_processed,
        count(*) FILTER (ip_version IN (4, 6) AND protocol = 6) AS packets_tcp,
        count(*) FILTER (ip_version IN (4, 6) AND protocol = 17) AS packets_udp,
        count(*) FILTER (ip_version = 4) AS packets_ipv4, count(*) FILTER (ip_version = 6) AS packets_ipv6,
        count(*) FILTER (ip_version IN (4, 6) AND protocol NOT IN (6, 17)) AS packets_skipped FROM mixed"""
    q["packet_transport"] = f"WITH {mixed} SELECT seq, protocol FROM mixed WHERE protocol IN (6, 17)"
    q["payload_lengths"] = """WITH h AS (
        SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS len,
               event_id % 16 AS off FROM events)
        SELECT seq, CASE WHEN off > 0 THEN off * 4 ELSE 20 END AS header_size,
               CASE WHEN len = 0 THEN 0 ELSE greatest(0, len - 20 - CASE WHEN off > 0 THEN off * 4 ELSE 20 END) END AS tcp_v4,
               greatest(0, len - CASE WHEN off > 0 THEN off * 4 ELSE 20 END) AS tcp_v6,
               CASE WHEN len = 0 THEN 0 ELSE greatest(0, len - 8) END AS udp FROM h"""
    q["flag_tests"] = f"""WITH {PACKETS} SELECT tcp_flags, tcp_flags & 1 <> 0 AS fin, tcp_flags & 4 <> 0 AS rst,
        count(*) AS n FROM pk GROUP BY ALL"""
    q["canonical_key"] = f"""WITH {PACKETS} SELECT
        CASE WHEN (src_ip, dst_ip, src_port, dst_port) <= (dst_ip, src_ip, dst_port, src_port)
             THEN src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port || '|' || protocol
             ELSE dst_ip || '|' || src_ip || '|' || dst_port || '|' || src_port || '|' || protocol END AS k,
        count(*) AS packets FROM pk GROUP BY ALL"""

    # flows
    q["flow_cuts"] = f"""{flows} SELECT k, CAST(flow_no AS BIGINT) AS flow_no, seq, fwd AS forward FROM cut"""
    one = PACKETS.replace("FROM events", "FROM (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)")
    q["flow_cuts_hot_key"] = q["flow_cuts"].replace(PACKETS, one)
    q["flow_features"] = f"{flows} SELECT {FLOW_HEAD}, {ROUNDED} FROM flows"
    q["flow_features_hot_keys"] = q["flow_features"]
    q["capture_window_flows"] = f"{windows} SELECT epoch_ms(capture // 1000) AS capture_time, end_reason, packets, " + (
        f'{FLOW_NAME} AS "Flow ID", {ROUNDED} FROM flows'
    )
    q["flow_counts"] = f"""{flows} SELECT count(*) AS flows, count(*) FILTER (protocol0 = 6) AS flows_tcp,
        count(*) FILTER (protocol0 = 17) AS flows_udp, count(*) FILTER (end_reason = 'flush') AS open_flows FROM flows"""
    q["stream_flows"] = q["flow_features"]
    q["capture_ranges"] = (
        f"WITH {PACKETS} SELECT t_us, src_ip, dst_ip, src_port, dst_port, protocol, payload_len, tcp_flags, tcp_window, header_size FROM pk"
    )
    q["stream_restart"] = f"{walk(halves=True)} SELECT {FLOW_HEAD}, {ROUNDED} FROM flows"

    # columns
    q["canonical_columns"] = """SELECT l_orderkey, l_linenumber, l_quantity AS "Dst Port", l_extendedprice AS "Packet Length Min",
        l_discount AS "FWD Init Win Bytes", l_tax AS "Flow IAT Max", l_partkey AS "Fwd Packet Length Mean" FROM lineitem"""
    dirty = """d AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-inf'
        WHEN 3 THEN '' WHEN 4 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS txt, value FROM events)"""
    q["clean_features"] = f"""WITH {dirty} SELECT event_id, CASE WHEN event_id % 8 < 5 THEN 0.0 ELSE value END AS "Idle Max" FROM d"""
    q["unparsed_counts"] = f"""WITH {dirty} SELECT 'Idle Max' AS feature, count(*) FILTER (txt = 'n/a') AS unparsed FROM d"""
    q["csv_round_trip"] = """SELECT l_orderkey, l_linenumber, l_quantity AS "Dst Port", l_extendedprice AS "Packet Length Min" FROM lineitem"""
    q["csv_mixed_dialects"] = q["csv_round_trip"]
    q["default_label"] = f"WITH {RAW} SELECT flow_uid, coalesce(human_label, '—') AS human_label FROM raw"
    q["append_aligned"] = f"""WITH {RAW} SELECT flow_uid, score_raw, human_label FROM raw WHERE scope = 'error'
        UNION ALL SELECT flow_uid, score_raw, NULL FROM raw WHERE scope <> 'error'"""
    q["one_row"] = f"WITH {RAW} SELECT flow_uid, score_raw, scope FROM raw WHERE flow_uid = '77'"
    q["summary_view"] = f"""{flows} SELECT "Dst Port", "Dst IP", "Src IP", end_reason AS prediction, CAST(packets AS DOUBLE) AS confidence,
        CAST(packets AS DOUBLE) AS gmm_score, round("FWD Init Win Bytes", 3) AS "FWD Init Win Bytes",
        round("Fwd IAT Total", 3) AS "Fwd IAT Total", round("Protocol", 3) AS "Protocol",
        round("Fwd Seg Size Min", 3) AS "Fwd Seg Size Min", round("Bwd Packet Length Mean", 3) AS "Bwd Packet Length Mean" FROM flows"""

    # scoring
    q["scaler_fit"] = "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale FROM lineitem"
        for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    ) + ")"
    q["scale"] = f"WITH {TINY} SELECT l_orderkey, l_linenumber, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM x"
    q["ae_error"] = f"""WITH {TINY} SELECT l_orderkey, l_linenumber, round(e1, 6) AS e1, round(e2, 6) AS e2,
        round((e1 + e2) / 2, 6) AS ae_score FROM e"""
    q["gmm_score"] = f"WITH {TINY} SELECT l_orderkey, l_linenumber, round(score_raw, 6) AS score_raw FROM s"
    q["predict"] = f"""WITH {TINY},
        p AS (SELECT quantile_cont(abs(score_raw + 4.0), 0.95) AS p95 FROM s)
        SELECT l_orderkey, l_linenumber, CASE WHEN score_raw < -4.0 THEN 'Attack' ELSE 'Normal' END AS prediction,
               round_even((1 / (1 + exp(-abs((score_raw + 4.0) / (p95 / 3.0)))) - 0.5) * 2 * 1e4, 0) / 1e4 AS confidence,
               round_even(score_raw * 1e4, 0) / 1e4 AS gmm_score FROM s, p"""
    named = TINY.replace("SELECT l_orderkey, l_linenumber,", "SELECT l_orderkey * 10 + l_linenumber AS flow_uid, l_suppkey,", 1)
    named = named.replace("s AS (SELECT l_orderkey, l_linenumber,", "s AS (SELECT flow_uid, l_suppkey,")
    q["watched_folder"] = f"""WITH {named} SELECT CAST(flow_uid AS VARCHAR) AS flow_uid,
        CASE WHEN score_raw < -4.0 THEN 'Attack' ELSE 'Normal' END AS prediction,
        round_even((1 / (1 + exp(-abs((score_raw + 4.0) / (2.5 / 3.0)))) - 0.5) * 2 * 1e4, 0) / 1e4 AS confidence,
        round_even(score_raw * 1e4, 0) / 1e4 AS gmm_score FROM s WHERE l_suppkey % 7 <> 0"""
    q["unparsed_cells"] = "SELECT event_id % 5 AS bucket, count(*) AS unparsed FROM events WHERE event_id % 8 = 4 GROUP BY 1"
    q["confidence_by_scope"] = f"WITH {scored()} SELECT {SCORED_COLUMNS}, scope FROM scored"
    q["classify"] = f"WITH {scored(None)} SELECT {SCORED_COLUMNS} FROM scored"
    q["relabel"] = f"WITH {scored(threshold=40.0)} SELECT {SCORED_COLUMNS} FROM scored"
    q["choose_threshold"] = f"""WITH {RAW}, t AS (SELECT quantile_cont(score_raw, 0.05) AS threshold FROM raw)
        SELECT round(threshold, 6) AS threshold, count(*) FILTER (score_raw < threshold) AS attacks FROM raw, t GROUP BY threshold"""

    from tidewatch.plans.catalog import flow_bundle

    bundle = flow_bundle()
    t = repr(bundle.threshold)
    q["predict_flows"] = f"""{flows}, {model_sql(bundle, "flows")},
        p AS (SELECT quantile_cont(abs(score_raw - ({t})), 0.95) AS p95 FROM sc)
        SELECT md5({FLOW_NAME} || '|' || t0 || '|' || seq0) AS flow_uid,
               CASE WHEN score_raw < {t} THEN 'Attack' ELSE 'Normal' END AS prediction,
               round_even((1 / (1 + exp(-abs((score_raw - ({t})) / (p95 / 3.0)))) - 0.5) * 2 * 1e4, 0) / 1e4 AS confidence,
               round_even(score_raw * 1e4, 0) / 1e4 AS gmm_score, round(ae_score, 6) AS ae_score FROM sc, p"""

    q["live_scoring"] = q["predict_flows"].replace("SELECT quantile_cont(abs(score_raw - (" + t + ")), 0.95) AS p95 FROM sc", "SELECT 2.0 AS p95")
    named = f"{flows}, {model_sql(bundle, 'flows')}, u AS (SELECT md5({FLOW_NAME} || '|' || t0 || '|' || seq0) AS flow_uid, * FROM sc)"
    q["explain_flows"] = f"""{named} SELECT flow_uid, 'ae' AS level, round(ae_score, 5) AS score, 0.0::DOUBLE AS unexplained FROM u
        UNION ALL SELECT flow_uid, 'gmm', round(score_raw, 5), 0.0::DOUBLE FROM u"""

    # routing
    q["route_benign"] = f"WITH {scored()} SELECT {SCORED_COLUMNS} FROM scored WHERE prediction = 'Normal'"
    q["route_attack"] = f"WITH {scored()} SELECT {SCORED_COLUMNS} FROM scored WHERE prediction = 'Attack' AND confidence >= 0.6"
    q["keep_last"] = f"WITH {RAW} SELECT event_id, score_raw FROM raw ORDER BY event_id DESC LIMIT 777"
    q["feedback_count"] = f"WITH {FEEDBACK} SELECT count(*) AS n FROM fb"
    q["feedback_route"] = f"""WITH {FEEDBACK} SELECT CASE WHEN human_label = 'Normal' THEN 'benign' ELSE 'attack' END AS buffer,
        count(*) AS n FROM fb WHERE action = 'set' GROUP BY 1"""
    q["feedback_effective"] = f"WITH {FEEDBACK}, {EFFECTIVE} SELECT * FROM eff"
    labelled = f"""{scored()}, {FEEDBACK}, {EFFECTIVE}, l AS (SELECT s.* EXCLUDE (human_label), eff.human_label
        FROM scored s LEFT JOIN eff USING (flow_uid))"""
    q["effective_class"] = f"""WITH {labelled} SELECT flow_uid, coalesce(human_label, prediction) AS effective_label,
        human_label IS NOT NULL AS human_confirmed FROM l"""
    q["agreement"] = f"""WITH {labelled} SELECT prediction, human_label,
        CASE WHEN human_label = prediction THEN 'confirmed' ELSE 'corrected' END AS verdict, count(*) AS n
        FROM l WHERE human_label IS NOT NULL GROUP BY ALL"""
    q["buffer_stats"] = f"""WITH {scored()} SELECT
        count(*) FILTER (prediction = 'Normal') AS benign_count,
        count(*) FILTER (prediction = 'Attack' AND confidence >= 0.6) AS attack_count FROM scored"""

    # statistics
    q["status_summary"] = f"""WITH {scored()} SELECT count(*) AS flows, count(*) FILTER (prediction = 'Normal') AS normal,
        count(*) FILTER (prediction = 'Attack') AS attack, count(human_label) AS feedback FROM scored"""
    q["result_summary"] = f"""WITH {scored()} SELECT count(*) AS total, count(*) FILTER (prediction = 'Normal') AS normal,
        count(*) FILTER (prediction = 'Attack') AS attack, round(avg(confidence), 6) AS mean_confidence FROM scored"""
    q["attack_rate_alert"] = f"""WITH {scored()} SELECT scope, round(avg(CASE WHEN prediction = 'Attack' THEN 1.0 ELSE 0.0 END), 6) AS attack_rate,
        count(*) FILTER (prediction = 'Attack') AS attacks, count(*) AS n FROM scored GROUP BY scope
        HAVING avg(CASE WHEN prediction = 'Attack' THEN 1.0 ELSE 0.0 END) >= 0.5 AND count(*) >= 20"""
    q["score_percentiles"] = f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT 'p{p}' AS percentile, round(quantile_cont(score_raw, {p / 100}), 6) AS value FROM raw"
        for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)
    )
    q["score_percentiles_by_scope"] = f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT scope, 'p{p}' AS percentile, round(quantile_cont(score_raw, {p / 100}), 6) AS value FROM raw GROUP BY scope"
        for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)
    )
    q["score_histogram"] = f"""WITH {RAW}, r AS (SELECT min(score_raw) AS lo, max(score_raw) AS hi FROM raw),
        c AS (SELECT least(CAST(floor((score_raw - lo) / ((hi - lo) / 80)) AS INTEGER), 79) AS bin, count(*) AS n FROM raw, r GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 80), 6) AS lo,
               round(lo + (b.bin + 1) * ((hi - lo) / 80), 6) AS hi, coalesce(n, 0) AS n
        FROM range(80) b(bin) CROSS JOIN r LEFT JOIN c ON c.bin = b.bin"""
    q["score_range"] = """SELECT round(min(l_extendedprice), 6) AS score_min, round(max(l_extendedprice), 6) AS score_max,
        round(avg(l_extendedprice), 6) AS score_mean FROM lineitem"""
    q["best_f1_threshold"] = f"""WITH {RAW}, r AS (SELECT min(score_raw) AS lo, max(score_raw) AS hi FROM raw),
        cand AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS t FROM range(200) x(i), r),
        m AS (SELECT i, t, count(*) FILTER (score_raw < t AND label = 1) AS tp, count(*) FILTER (score_raw < t AND label = 0) AS fp,
                     count(*) FILTER (score_raw >= t AND label = 1) AS fn, count(*) FILTER (score_raw >= t AND label = 0) AS tn
              FROM cand, raw GROUP BY i, t),
        f AS (SELECT i, t, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END
                          + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2.0 AS f1 FROM m)
        SELECT round(t, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, i LIMIT 1"""
    q["capture_counters"] = f"""WITH {scored()} SELECT scope, count(*) AS flows, count(*) FILTER (prediction = 'Attack') AS attacks
        FROM scored GROUP BY scope"""
    q["capture_totals"] = f"""WITH {scored()} SELECT count(DISTINCT scope) AS captures, (SELECT count(*) FROM events) AS packets,
        count(*) AS flows, count(*) FILTER (prediction = 'Attack') AS attacks, 0 AS errors, max(scope) AS last_capture FROM scored"""

    # samples, sets, order
    q["sample_n"] = f"WITH {RAW} SELECT flow_uid, score_raw FROM raw ORDER BY {HASH.format('flow_uid', 42)} LIMIT 500"
    q["cap_rows"] = f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {HASH.format('o_orderkey', 7)} LIMIT 3000"
    q["replay_mix"] = f"""WITH {RAW}, new AS (SELECT * FROM raw WHERE scope <> 'view'), old AS (SELECT * FROM raw WHERE scope = 'view')
        SELECT flow_uid, false AS from_replay FROM new
        UNION ALL SELECT * FROM (SELECT flow_uid, true FROM old ORDER BY {HASH.format('flow_uid', 42)}
          LIMIT (SELECT least(CAST(floor(0.3 * (SELECT count(*) FROM new) / (1 - 0.3)) AS BIGINT), (SELECT count(*) FROM old))))"""
    q["train_val_split"] = f"""WITH {RAW} SELECT flow_uid,
        row_number() OVER (ORDER BY {HASH.format('flow_uid', 42)}) <= greatest(1, CAST(floor((SELECT count(*) FROM raw) * 0.15) AS BIGINT)) AS is_val FROM raw"""
    q["composition"] = f"""WITH {RAW}, c AS (SELECT count(*) FILTER (scope <> 'view') AS new, count(*) FILTER (scope = 'view') AS old FROM raw),
        n AS (SELECT least(CAST(floor(5000 * 0.30) AS BIGINT), old) AS n_replay, new FROM c)
        SELECT n_replay, least(new, 5000 - n_replay) AS n_new FROM n"""
    q["replay_seed"] = f"""WITH {RAW} SELECT flow_uid FROM raw ORDER BY {HASH.format('flow_uid', 42)}
        LIMIT (SELECT CAST(floor(count(*) * 0.30) AS BIGINT) FROM raw)"""
    q["union_batches"] = f"WITH {RAW} SELECT flow_uid, scope FROM raw"
    dataset = """SELECT * FROM (SELECT o_orderkey AS seq, o_totalprice AS "Dst Port",
          CASE WHEN o_custkey % 3 = 0 THEN 'BENIGN' ELSE '{}' END AS "Label" FROM orders WHERE o_orderstatus = '{}')
        WHERE "Label" <> 'BENIGN' ORDER BY seq LIMIT {}"""
    q["dataset_assembly"] = f"""SELECT o_orderkey AS seq, o_totalprice AS "Dst Port", 'BENIGN' AS "Label" FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT * FROM ({dataset.format('DoS', 'F', 900)}) UNION ALL SELECT * FROM ({dataset.format('Scan', 'O', 400)})"""
    q["dataset_from_files"] = q["dataset_assembly"]
    q["drop_column"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
    q["sorted_rows"] = f"WITH {RAW} SELECT row_number() OVER (ORDER BY score_raw, event_id) AS \"row\", flow_uid FROM raw"
    q["first_rows"] = f"WITH {RAW} SELECT flow_uid, event_id FROM raw ORDER BY event_id LIMIT 250"
    q["last_rows"] = f"WITH {RAW} SELECT flow_uid, event_id FROM raw ORDER BY event_id DESC LIMIT 10"

    from tidewatch.plans.catalog import STEP_FROM
    from tidewatch.plans.train_gmm import RIDGE

    logs = []
    for w, (ma, mb), (aa, ab, bb) in zip(STEP_FROM["weights"], STEP_FROM["means"], STEP_FROM["covs"]):
        det = aa * bb - ab * ab
        form = f"({bb} * (a - {ma}) * (a - {ma}) - 2 * {ab} * (a - {ma}) * (b - {mb}) + {aa} * (b - {mb}) * (b - {mb})) / {det}"
        logs.append(f"ln({w}) - ln(2 * pi()) - 0.5 * ln({det}::DOUBLE) - 0.5 * {form}")
    moments = " UNION ALL ".join(
        f"""SELECT {j} AS component, sum(r{j}) AS n, sum(r{j} * (a - {ma})) AS sa, sum(r{j} * (b - {mb})) AS sb,
            sum(r{j} * (a - {ma}) * (a - {ma})) AS saa, sum(r{j} * (a - {ma}) * (b - {mb})) AS sab,
            sum(r{j} * (b - {mb}) * (b - {mb})) AS sbb, {ma}::DOUBLE AS ma, {mb}::DOUBLE AS mb, avg(d) AS likelihood, count(*) AS m FROM r"""
        for j, (ma, mb) in enumerate(STEP_FROM["means"])
    )
    q["mixture_step"] = f"""WITH x AS (SELECT l_quantity::DOUBLE AS a, (l_discount * 100)::DOUBLE AS b FROM lineitem),
        l AS (SELECT *, {logs[0]} AS l0, {logs[1]} AS l1 FROM x),
        d AS (SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS d FROM l),
        r AS (SELECT *, exp(l0 - d) AS r0, exp(l1 - d) AS r1 FROM d), s AS ({moments})
        SELECT component::INTEGER AS component, round(n / m, 6) AS weight, round(ma + sa / n, 6) AS mean_a, round(mb + sb / n, 6) AS mean_b,
            round(saa / n - sa * sa / (n * n) + {RIDGE}, 6) AS aa, round(sab / n - sa * sb / (n * n), 6) AS ab,
            round(sbb / n - sb * sb / (n * n) + {RIDGE}, 6) AS bb, round(likelihood, 6) AS likelihood FROM s"""

    from tidewatch.plans.catalog import BACKGROUND

    rest = TINY[TINY.index("h AS") :].replace("s AS (SELECT l_orderkey, l_linenumber,", "s AS (SELECT l_orderkey, l_linenumber, rid, m,")
    level = "SELECT flow_uid, '{0}' AS level, round({0}0, 6) AS base, round({0}3, 6) AS score, " + ", ".join(
        f"round(({{0}}{a} - {{0}}0 + {{0}}3 - {{0}}{b}) / 2, 6) AS contribution_{a}" for a, b in ((1, 2), (2, 1))
    ) + " FROM v"
    values = ", ".join(f"avg({c}) FILTER (m = {m}) AS {n}{m}" for c, n in (("ae_score", "ae"), ("score_raw", "gmm")) for m in range(4))
    q["explain_exact"] = f"""WITH b(b1, b2) AS (VALUES {", ".join(map(str, BACKGROUND))}),
        x0 AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS rid, (l_quantity - 25.0) / 14.0 AS y1, (l_extendedprice - 38000.0) / 23000.0 AS y2 FROM lineitem),
        x AS (SELECT l_orderkey, l_linenumber, rid, m, CASE WHEN m % 2 = 1 THEN y1 ELSE b1 END AS x1, CASE WHEN m >= 2 THEN y2 ELSE b2 END AS x2
              FROM x0, b, range(4) AS t(m)), {rest},
        v AS (SELECT l_orderkey * 10 + l_linenumber AS flow_uid, {values} FROM s GROUP BY rid, l_orderkey, l_linenumber)
        {level.format("ae")} UNION ALL {level.format("gmm")}"""

    # models, explanations
    promos = """pr AS (SELECT 'v' || (event_id % 40) AS model_version, ts AS promoted_at,
        CASE WHEN event_type = 'error' THEN 'reject' ELSE 'accept' END AS action FROM events),
        models AS (SELECT 'v' || (user_id % 30) AS model_version FROM events GROUP BY 1)"""
    q["current_model"] = f"""WITH {promos}, newest AS (SELECT arg_max(model_version, (promoted_at, model_version)) AS v FROM pr WHERE action = 'accept')
        SELECT CASE WHEN v IN (SELECT model_version FROM models) THEN v ELSE 'v0' END AS model_version FROM newest"""
    ex = """ex AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS flow_uid, 'm' || (l_linenumber % 2) AS model_version,
        l_extendedprice AS score FROM lineitem),
        w AS (SELECT CAST(o_orderkey * 10 + 1 AS VARCHAR) AS flow_uid FROM orders)"""
    q["cached_explanations"] = f"""WITH {ex} SELECT w.flow_uid, e.model_version, e.score FROM w
        LEFT JOIN (SELECT * FROM ex WHERE model_version = 'm1') e USING (flow_uid)"""
    q["waterfall_topk"] = """WITH v AS (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS f FROM embeddings),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(CAST(c AS DOUBLE)) DESC, 'f' || lpad(CAST(f AS VARCHAR), 2, '0')) AS rank FROM v)
        SELECT CAST(vec_id AS VARCHAR) AS flow_uid, CAST(rank AS INTEGER) AS rank, 'f' || lpad(CAST(f AS VARCHAR), 2, '0') AS feature,
               round(CAST(c AS DOUBLE), 5) AS contribution FROM r WHERE rank <= 14
        UNION ALL SELECT CAST(vec_id AS VARCHAR), 15, 'other', round(sum(CAST(c AS DOUBLE)), 5) FROM r WHERE rank > 14 GROUP BY vec_id"""

    # training: gradient of the summed squared output of the small network
    grads = [
        "2 * d1 * x1", "2 * d2 * x1", "2 * d1 * x2", "2 * d2 * x2", "2 * d1", "2 * d2",
        "2 * f1 * h1", "2 * f2 * h1", "2 * f1 * h2", "2 * f2 * h2", "2 * f1", "2 * f2",
    ]
    q["weight_importance"] = f"""WITH {TINY},
        f AS (SELECT *, h1 * 1.25 + h2 * 0.5 - 0.05123456789 AS f1, h1 * -0.5 + h2 * 0.8 + 0.15987654321 AS f2 FROM h),
        d AS (SELECT *, CASE WHEN h1 > 0 THEN f1 * 1.25 + f2 * -0.5 ELSE 0 END AS d1,
                        CASE WHEN h2 > 0 THEN f1 * 0.5 + f2 * 0.8 ELSE 0 END AS d2 FROM f),
        o AS ({" UNION ALL ".join(f"SELECT {i} AS position, sum({g}) ** 2 / count(*) AS v FROM d" for i, g in enumerate(grads))})
        SELECT position, round(v / max(v) OVER (), 6) AS importance FROM o"""
    return q
