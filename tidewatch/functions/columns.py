"""Column names: header clean-up, aliases, feature projection, display order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import finite_or_zero
from tidewatch.schemas import FEATURES, META

# Canonical flow column names, in their usual order.
CANONICAL = [
    "id", "Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp", "Flow Duration",
    "Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "Fwd RST Flags", "Bwd RST Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
    "CWR Flag Count", "ECE Flag Count", "Down/Up Ratio", "Average Packet Size",
    "Fwd Segment Size Avg", "Bwd Segment Size Avg", "Fwd Bytes/Bulk Avg", "Fwd Packet/Bulk Avg",
    "Fwd Bulk Rate Avg", "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg", "Bwd Bulk Rate Avg",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
    "ICMP Code", "ICMP Type", "Total TCP Flow Time", "Label",
]

# Header aliases and the canonical name each stands for.
ALIASES = {
    "SrcIP": "Src IP",
    "Source IP": "Src IP",
    "DstIP": "Dst IP",
    "Destination IP": "Dst IP",
    "SrcPort": "Src Port",
    "Source Port": "Src Port",
    "DstPort": "Dst Port",
    "Destination Port": "Dst Port",
    "Timestamp": "Timestamp",
    "Protocol": "Protocol",
    "Tot Fwd Pkts": "Total Fwd Packet",
    "Total Fwd Packets": "Total Fwd Packet",
    "Tot Bwd Pkts": "Total Bwd packets",
    "Total Backward Packets": "Total Bwd packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packet",
    "Total Length of Fwd Packets": "Total Length of Fwd Packet",
    "TotLen Bwd Pkts": "Total Length of Bwd Packet",
    "Total Length of Bwd Packets": "Total Length of Bwd Packet",
    "Total Connection Flow Time": "Total TCP Flow Time",
    "Fwd Pkt Len Max": "Fwd Packet Length Max",
    "Fwd Pkt Len Min": "Fwd Packet Length Min",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean",
    "Fwd Pkt Len Std": "Fwd Packet Length Std",
    "Bwd Pkt Len Max": "Bwd Packet Length Max",
    "Bwd Pkt Len Min": "Bwd Packet Length Min",
    "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Bwd Pkt Len Std": "Bwd Packet Length Std",
    "Max Packet Length": "Packet Length Max",
    "Min Packet Length": "Packet Length Min",
    "Pkt Len Min": "Packet Length Min",
    "Pkt Len Max": "Packet Length Max",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "Pkt Size Avg": "Average Packet Size",
    "Flow IAT Stddev": "Flow IAT Std",
    "Fwd IAT Tot": "Fwd IAT Total",
    "Bwd IAT Tot": "Bwd IAT Total",
    "Fwd PSH flags": "Fwd PSH Flags",
    "Bwd PSH flags": "Bwd PSH Flags",
    "Fwd URG flags": "Fwd URG Flags",
    "Bwd URG flags": "Bwd URG Flags",
    "FIN Flag Cnt": "FIN Flag Count",
    "SYN Flag Cnt": "SYN Flag Count",
    "RST Flag Cnt": "RST Flag Count",
    "PSH Flag Cnt": "PSH Flag Count",
    "ACK Flag Cnt": "ACK Flag Count",
    "URG Flag Cnt": "URG Flag Count",
    "CWR Flag Cnt": "CWR Flag Count",
    "CWE Flag Count": "CWR Flag Count",
    "ECE Flag Cnt": "ECE Flag Count",
    "Flow Bytes/s": "Flow Bytes/s",
    "Flow Packets/s": "Flow Packets/s",
    "Fwd Pkts/s": "Fwd Packets/s",
    "Bwd Pkts/s": "Bwd Packets/s",
    "Avg Pkt Size": "Average Packet Size",
    "Flow Byts/s": "Flow Bytes/s",
    "Flow Pkts/s": "Flow Packets/s",
    "Fwd Seg Size Avg": "Fwd Segment Size Avg",
    "Avg Fwd Segment Size": "Fwd Segment Size Avg",
    "Bwd Seg Size Avg": "Bwd Segment Size Avg",
    "Avg Bwd Segment Size": "Bwd Segment Size Avg",
    "min_seg_size_forward": "Fwd Seg Size Min",
    "Min Seg Size Forward": "Fwd Seg Size Min",
    "Backward Segment Size Minimum": "Bwd Seg Size Min",
    "Min Seg Size Backward": "Bwd Seg Size Min",
    "Fwd Avg Bulk Rate": "Fwd Bulk Rate Avg",
    "Bwd Avg Bulk Rate": "Bwd Bulk Rate Avg",
    "Fwd Avg Bytes/Bulk": "Fwd Bytes/Bulk Avg",
    "Bwd Avg Bytes/Bulk": "Bwd Bytes/Bulk Avg",
    "Fwd Avg Packets/Bulk": "Fwd Packet/Bulk Avg",
    "Bwd Avg Packets/Bulk": "Bwd Packet/Bulk Avg",
    "Fwd Byts/b Avg": "Fwd Bytes/Bulk Avg",
    "Fwd Pkts/b Avg": "Fwd Packet/Bulk Avg",
    "Fwd Blk Rate Avg": "Fwd Bulk Rate Avg",
    "Bwd Byts/b Avg": "Bwd Bytes/Bulk Avg",
    "Bwd Pkts/b Avg": "Bwd Packet/Bulk Avg",
    "Bwd Blk Rate Avg": "Bwd Bulk Rate Avg",
    "Subflow Fwd Pkts": "Subflow Fwd Packets",
    "Subflow Bwd Pkts": "Subflow Bwd Packets",
    "Fwd Init Win Bytes": "FWD Init Win Bytes",
    "Init Fwd Win Bytes": "FWD Init Win Bytes",
    "Init Fwd Win Byts": "FWD Init Win Bytes",
    "Init_Win_bytes_forward": "FWD Init Win Bytes",
    "Init Bwd Win Bytes": "Bwd Init Win Bytes",
    "Init Bwd Win Byts": "Bwd Init Win Bytes",
    "Init_Win_bytes_backward": "Bwd Init Win Bytes",
    "Fwd Header Length.1": "Fwd Header Length",
    "act_data_pkt_fwd": "Fwd Act Data Pkts",
    "Act Data Pkt Fwd": "Fwd Act Data Pkts",
    "act_data_pkt_bwd": "Bwd Act Data Pkts",
    "Act Data Pkt Bwd": "Bwd Act Data Pkts",
    "Attack": "Label",
}

# Abbreviations expanded, in this order, before the loose match.
EXPANSIONS = [
    ("Cnt", "Count"),
    ("Pkts", "Packets"),
    ("Pkt", "Packet"),
    ("Stddev", "Std"),
    ("Bytes/s", "Bytes per s"),
    ("Packets/s", "Packets per s"),
]

# The columns of an assembled training dataset.
ASSEMBLED = [
    "Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp", "Flow Duration",
    "Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s", "Packet Length Min",
    "Packet Length Max", "Packet Length Mean", "Packet Length Std", "Packet Length Variance", "FIN Flag Count",
    "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWR Flag Count",
    "ECE Flag Count", "Down/Up Ratio", "Average Packet Size", "Fwd Segment Size Avg", "Bwd Segment Size Avg",
    "Fwd Bytes/Bulk Avg", "Fwd Packet/Bulk Avg", "Fwd Bulk Rate Avg", "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg",
    "Bwd Bulk Rate Avg", "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min", "Active Mean", "Active Std",
    "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Label",
]

NO_LABEL = "—"
RESULT_HEAD = ["Timestamp", "prediction", "confidence", "gmm_score"]


def quoted(name: str) -> Column:
    """A column by exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_header(name: str) -> str:
    return " ".join(str(name).split())


def loose_key(name: str) -> str:
    text = clean_header(name)
    for short, full in EXPANSIONS:
        text = text.replace(short, full)
    return re.sub("[^a-z0-9]", "", text.lower())


_LOOSE = {loose_key(c): c for c in CANONICAL}


def canonical_name(name: str) -> str:
    """The canonical name of a header cell, or the cleaned cell itself."""
    name = clean_header(name)
    return ALIASES.get(name) or _LOOSE.get(loose_key(name), name)


def canonicalize(df: DataFrame, header: Sequence[str] | None = None) -> DataFrame:
    """Rename every column to its canonical name; of equal names the first stays.

    ``header`` gives the raw header cells by position when they differ from
    ``df.columns`` (the CSV reader alters repeated names).
    """
    header = list(df.columns) if header is None else list(header)
    if len(header) != len(df.columns):
        raise ValueError(f"header has {len(header)} cells, the data {len(df.columns)} columns")
    slots = [f"_{i}" for i in range(len(header))]
    first: dict[str, str] = {}
    for slot, cell in zip(slots, header):
        first.setdefault(canonical_name(cell), slot)
    return df.toDF(*slots).select(*[F.col(slot).alias(name) for name, slot in first.items()])


def require_features(columns: Sequence[str], features: Sequence[str] = FEATURES, scaler_size: int | None = None) -> None:
    missing = [f for f in features if f not in columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    if scaler_size is not None and scaler_size != len(features):
        raise ValueError(f"{len(features)} features, but the scaler expects {scaler_size}")


def feature(name: str) -> Column:
    """A feature as a finite double; text that is no number counts as missing."""
    return finite_or_zero(quoted(name).try_cast("double"))


def project_features(df: DataFrame, features: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """The features in model order, as finite doubles, behind the kept columns."""
    require_features(df.columns, features)
    return df.select(*[quoted(c) for c in keep], *[feature(f).alias(f) for f in features])


def _is_bad_text(name: str) -> Column:
    """A non-empty cell that is no number."""
    text = quoted(name).cast("string")
    return text.isNotNull() & (F.trim(text) != "") & text.try_cast("double").isNull()


def unparsed_counts(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Per feature the number of non-empty cells that are no number."""
    require_features(df.columns, features)
    counts = df.agg(*[F.count_if(_is_bad_text(f)).alias(f) for f in features])
    return counts.unpivot([], [quoted(f) for f in features], "feature", "unparsed")


def unparsed_by(df: DataFrame, key: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """The groups (files, say) with cells that are no number: ``key``, ``unparsed``."""
    require_features(df.columns, features)
    bad = reduce(lambda a, b: a + b, [_is_bad_text(f).cast("long") for f in features])
    return df.groupBy(quoted(key)).agg(F.sum(bad).alias("unparsed")).filter(F.col("unparsed") > 0)


def metadata_columns(columns: Sequence[str], features: Sequence[str] = FEATURES) -> list[str]:
    return [c for c in META if c in columns and c not in features]


def order_results(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Display order: time, labels, metadata, features, human label, the rest."""
    if "timestamp" in df.columns:
        df = df.drop("timestamp") if "Timestamp" in df.columns else df.withColumnRenamed("timestamp", "Timestamp")
    wanted = [*RESULT_HEAD, *[c for c in META if c != "Timestamp" and c not in features], *features, "human_label"]
    head = [c for c in wanted if c in df.columns]
    return df.select(*[quoted(c) for c in head + [c for c in df.columns if c not in head]])


def shown_label(df: DataFrame) -> DataFrame:
    """Fill a missing human label with the display dash."""
    label = F.col("human_label") if "human_label" in df.columns else F.lit(None).cast("string")
    return df.withColumn("human_label", F.coalesce(label, F.lit(NO_LABEL)))


def append_aligned(table: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows under the table's columns: missing ones NULL, unknown ones dropped."""
    known = [c for c in new.columns if c in table.columns]
    return table.unionByName(new.select(*[quoted(c) for c in known]), allowMissingColumns=True)


def summary_view(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Endpoints that exist, labels and the first five features."""
    ends = [c for c in ("Dst Port", "Dst IP", "Src IP") if c in df.columns]
    names = ends + ["prediction", "confidence", "gmm_score"] + [f for f in features[:5] if f not in ends]
    return df.select(*[quoted(c) for c in names])
