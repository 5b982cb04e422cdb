"""Packet-by-packet flow builder used only to check the Spark plans."""

import numpy as np


def walk(packets, timeout=5_000_000, idle=1_000_000):
    """``packets``: tuples (seq, t_us, src, sport, dst, dport, proto, len, flags, win, hdr)."""
    open_flows, done = {}, []

    def finish(key, reason):
        flow = open_flows.pop(key)
        flow["reason"] = reason
        done.append(flow)

    for p in sorted(packets, key=lambda p: (p[1], p[0])):
        seq, t, src, sport, dst, dport, proto, *_ = p
        key = min((src, dst, sport, dport, proto), (dst, src, dport, sport, proto))
        if key in open_flows and t - open_flows[key]["rows"][-1][1] > timeout:
            finish(key, "idle")
        flow = open_flows.setdefault(key, {"rows": [], "first": (src, sport), "fins": set()})
        flow["rows"].append(p)
        if p[8] & 1:
            flow["fins"].add((src, sport) == flow["first"])
        if p[8] & 4:
            finish(key, "rst")
        elif len(flow["fins"]) == 2:
            finish(key, "finfin")
    last = max((p[1] for p in packets), default=0)
    for key in list(open_flows):
        finish(key, "flush" if last - open_flows[key]["rows"][-1][1] <= timeout else "idle")
    return [features(f, idle) for f in done]


def features(flow, idle):
    rows = flow["rows"]
    forward = [(r[2], r[3]) == flow["first"] for r in rows]
    fwd = [r for r, f in zip(rows, forward) if f]
    bwd = [r for r, f in zip(rows, forward) if not f]

    def iats(part):
        return np.diff([r[1] for r in part]).astype(float)

    def std(values):
        return float(np.std(values, ddof=1)) if len(values) > 1 else 0.0

    def top(values):
        return float(max(values)) if len(values) else 0.0

    def mean(values):
        return float(np.mean(values)) if len(values) else 0.0

    lens, f_len, b_len = ([float(r[7]) for r in part] for part in (rows, fwd, bwd))
    iat = iats(rows)
    first = rows[0]
    return {
        "first_seq": first[0],
        "end_reason": flow["reason"],
        "packets": len(rows),
        "FWD Init Win Bytes": float(first[9]),
        "Fwd IAT Total": float(sum(iats(fwd))),
        "Protocol": float(first[6]),
        "Fwd Seg Size Min": float(min(r[10] for r in fwd)),
        "Bwd Packet Length Mean": mean(b_len),
        "Flow IAT Max": top(iat),
        "Packet Length Max": top(lens),
        "Flow IAT Std": std(iat),
        "Fwd Packet Length Std": std(f_len),
        "Idle Max": top([x for x in iat if x > idle]),
        "Packet Length Mean": mean(lens),
        "Bwd Packet Length Max": top(b_len),
        "Bwd Packet Length Std": std(b_len),
        "Fwd Packet Length Mean": mean(f_len),
        "Packet Length Min": float(min(lens)),
        "Dst Port": float(first[5]),
        "FIN Flag Count": float(sum(1 for r in rows if r[8] & 1)),
        "Bwd IAT Std": std(iats(bwd)),
    }
