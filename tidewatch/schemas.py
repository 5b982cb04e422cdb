"""Column names and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The 18 model features, in the order the model expects.
FEATURES = [
    "FWD Init Win Bytes",
    "Fwd IAT Total",
    "Protocol",
    "Fwd Seg Size Min",
    "Bwd Packet Length Mean",
    "Flow IAT Max",
    "Packet Length Max",
    "Flow IAT Std",
    "Fwd Packet Length Std",
    "Idle Max",
    "Packet Length Mean",
    "Bwd Packet Length Max",
    "Bwd Packet Length Std",
    "Fwd Packet Length Mean",
    "Packet Length Min",
    "Dst Port",
    "FIN Flag Count",
    "Bwd IAT Std",
]

# Descriptive columns kept beside the features when the input has them.
META = ["Flow ID", "Src IP", "Dst IP", "Src Port", "Dst Port", "Timestamp"]

PACKETS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("payload_len", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("header_size", T.IntegerType()),
    ]
)

FLOW_HEAD = T.StructType(
    [
        T.StructField("flow_uid", T.StringType()),
        T.StructField("end_reason", T.StringType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("packets", T.LongType()),
        T.StructField("Flow ID", T.StringType()),
        T.StructField("Src IP", T.StringType()),
        T.StructField("Dst IP", T.StringType()),
        T.StructField("Src Port", T.IntegerType()),
        T.StructField("Timestamp", T.StringType()),
    ]
)
FLOWS = T.StructType(FLOW_HEAD.fields + [T.StructField(f, T.DoubleType()) for f in FEATURES])

FEEDBACK = T.StructType(
    [
        T.StructField("flow_uid", T.StringType()),
        T.StructField("human_label", T.StringType()),
        T.StructField("model_prediction", T.StringType()),
        T.StructField("feedback_ts", T.TimestampType()),
        T.StructField("action", T.StringType()),
    ]
)

_LAYER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)
MODELS = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("domains_seen", T.ArrayType(T.StringType())),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("scaler_mean", T.ArrayType(T.DoubleType())),
        T.StructField("scaler_scale", T.ArrayType(T.DoubleType())),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("confidence_scale", T.DoubleType()),
        T.StructField("ae_layers", T.ArrayType(_LAYER)),
        T.StructField("gmm_weights", T.ArrayType(T.DoubleType())),
        T.StructField("gmm_means", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("gmm_covs", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)
