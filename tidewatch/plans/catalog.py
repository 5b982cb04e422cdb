"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as col
from tidewatch.functions import packet as P
from tidewatch.operators import explain as ex
from tidewatch.operators import flows as fl
from tidewatch.operators import ranks, routing, sampling, scoring, stats
from tidewatch.operators.bundle import Bundle, current_version, random_bundle
from tidewatch.plans import samples, train_ae, train_gmm
from tidewatch.schemas import FEATURES
from tidewatch.session import ensure_checkpoint_dir, prepare, stage_table
from tidewatch.sources import flow_csv, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared directory, for queries that write first."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def rounded(df: DataFrame, places: int = 3, names=FEATURES) -> DataFrame:
    return df.withColumns({n: F.round(col.quoted(n), places) for n in names if n in df.columns})


def head(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[col.quoted(n) for n in names])


def lineitem(spark, sf_dir):
    return samples.table(spark, sf_dir, "lineitem")


def line_uid():
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def tiny_bundle() -> Bundle:
    """Two features, one hidden layer, two components, numbers written out."""
    layers = [
        {"kernel": np.array([[0.5, 0.75], [-0.25, 1.0]]), "bias": np.array([0.1, -0.2])},
        {"kernel": np.array([[1.25, -0.5], [0.5, 0.8]]), "bias": np.array([-0.05123456789, 0.15987654321])},
    ]
    return Bundle(
        version="tiny", scaler_mean=np.array([25.0, 38000.0]), scaler_scale=np.array([14.0, 23000.0]), layers=layers,
        gmm_weights=np.array([0.6, 0.4]), gmm_means=np.array([[0.4, 0.5], [1.5, 1.2]]),
        gmm_covs=np.array([[[0.5, 0.1], [0.1, 0.4]], [[0.9, -0.2], [-0.2, 1.1]]]), threshold=-4.0,
        feature_names=("l_quantity", "l_extendedprice"),
    )


# ---- packets


@query
def packet_filter_cidr(spark, sf_dir):
    return P.filter_net(samples.packets(spark, sf_dir), "10.0.0.0/27").select("seq", "src_ip", "dst_ip")


def mixed_packets(spark, sf_dir):
    seq = F.col("seq")
    version = F.when(seq % 13 == 0, 0).when(seq % 4 == 0, 6).otherwise(4)
    protocol = F.when(seq % 11 == 0, 1).otherwise(F.col("protocol"))
    return samples.packets(spark, sf_dir).select("seq", protocol.alias("protocol"), version.alias("ip_version"))


@query
def packet_counters(spark, sf_dir):
    return stats.packet_counters(mixed_packets(spark, sf_dir))


@query
def packet_transport(spark, sf_dir):
    df = mixed_packets(spark, sf_dir)
    return df.filter(P.is_transport(F.col("protocol"))).select("seq", "protocol")


@query
def payload_lengths(spark, sf_dir):
    eid = F.col("event_id")
    df = samples.table(spark, sf_dir, "events").select(
        eid.alias("seq"),
        F.when(eid % 9 == 0, 0).otherwise(F.floor(F.col("value") * 10)).cast("long").alias("len"),
        (eid % 16).alias("off"),
    )
    length, off = F.col("len"), F.col("off")
    return df.select(
        "seq", P.tcp_header_size(off).alias("header_size"), P.tcp_payload_v4(length, F.lit(5), off).alias("tcp_v4"),
        P.tcp_payload_v6(length, off).alias("tcp_v6"), P.udp_payload(length).alias("udp"),
    )


@query
def flag_tests(spark, sf_dir):
    f = F.col("tcp_flags")
    df = samples.packets(spark, sf_dir).groupBy("tcp_flags").agg(F.count(F.lit(1)).alias("n"))
    return df.select("tcp_flags", P.has_flag(f, P.FIN).alias("fin"), P.has_flag(f, P.RST).alias("rst"), "n")


def key_text(separator: str):
    return F.concat_ws(separator, "k.ip_a", "k.ip_b", F.col("k.port_a").cast("string"),
                       F.col("k.port_b").cast("string"), F.col("k.proto").cast("string"))


@query
def canonical_key(spark, sf_dir):
    df, _ = fl.keyed(samples.packets(spark, sf_dir))
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("packets")).select(key_text("|").alias("k"), "packets")


# ---- flows


@query
def flow_cuts(spark, sf_dir):
    df = fl.cut_flows(samples.packets(spark, sf_dir))
    return df.select(key_text(" ").alias("k"), "flow_no", "seq", "forward")


@query
def flow_cuts_hot_key(spark, sf_dir):
    """Flow numbers where one 5-tuple has a third of all packets, cut in chunks of a twentieth."""
    packets = samples.packets(spark, sf_dir, skewed=True)
    df = fl.cut_flows(packets, hot_rows=max(1, packets.count() // 20))
    return df.select(key_text(" ").alias("k"), "flow_no", "seq", "forward")


@query
def flow_features(spark, sf_dir):
    return rounded(fl.build_flows(samples.packets(spark, sf_dir))).drop("start_ts")


@query
def flow_features_hot_keys(spark, sf_dir):
    """The same flows with every 5-tuple above the average treated as too large for one task."""
    packets = samples.packets(spark, sf_dir)
    keys = fl.keyed(packets)[0].agg(F.count(F.lit(1)) / F.count_distinct("k")).first()[0]
    return rounded(fl.build_flows(packets, hot_rows=int(keys))).drop("start_ts")


@query
def capture_window_flows(spark, sf_dir):
    df = rounded(fl.build_flows(samples.packets(spark, sf_dir), window="30 seconds"))
    return df.select(
        F.col("capture_time").cast("timestamp_ntz").alias("capture_time"),
        "end_reason", "packets", "Flow ID", *[col.quoted(f) for f in FEATURES],
    )


@query
def flow_counts(spark, sf_dir):
    return fl.flow_counts(fl.build_flows(samples.packets(spark, sf_dir)))


# ---- columns and CSV


@query
def canonical_columns(spark, sf_dir):
    """Aliases, loose matches, stray blanks and a repeated column, renamed in one projection."""
    df = lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias(" Destination Port"), F.col("l_extendedprice").alias("Min  Packet Length"),
        F.col("l_discount").alias("Init_Win_bytes_forward"), F.col("l_tax").alias("flow_iat_max"),
        F.col("l_partkey").alias("Fwd Pkt Length MEAN"), F.col("l_suppkey").alias("Dst Port"),
    )
    return col.canonicalize(df)


def dirty(spark, sf_dir):
    eid = F.col("event_id")
    text = (
        F.when(eid % 8 == 0, "NaN").when(eid % 8 == 1, "Infinity").when(eid % 8 == 2, "-inf").when(eid % 8 == 3, "")
        .when(eid % 8 == 4, "n/a").otherwise(F.col("value").cast("string"))
    )
    return samples.table(spark, sf_dir, "events").select("event_id", text.alias("Idle Max"))


@query
def unparsed_cells(spark, sf_dir):
    """Per group the cells that are neither a number nor empty."""
    df = dirty(spark, sf_dir).withColumn("bucket", F.col("event_id") % 5)
    return col.unparsed_by(df, "bucket", ["Idle Max"])


@query
def clean_features(spark, sf_dir):
    return col.project_features(dirty(spark, sf_dir), ["Idle Max"], keep=["event_id"])


@query
def unparsed_counts(spark, sf_dir):
    return col.unparsed_counts(dirty(spark, sf_dir), ["Idle Max"])


@query
def csv_round_trip(spark, sf_dir):
    """Export to CSV under abbreviated headers, read back by dialect."""
    path = scratch(spark)
    out = lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("Destination Port"),
        F.col("l_extendedprice").alias("Pkt Len Min"),
    )
    flow_csv.export_csv(out, path)
    return csv_values(flow_csv.read_flow_csv(spark, path))


def csv_values(df):
    return df.select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
        col.feature("Dst Port").alias("Dst Port"), col.feature("Packet Length Min").alias("Packet Length Min"),
    )


@query
def csv_mixed_dialects(spark, sf_dir):
    """One directory with files of two header dialects in different column orders."""
    path, rows = scratch(spark), lineitem(spark, sf_dir)
    short = rows.filter("l_linenumber < 3").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("Destination Port"), F.col("l_extendedprice").alias("Pkt Len Min")
    )
    full = rows.filter("l_linenumber >= 3").select(
        F.col("l_extendedprice").alias("Packet Length Min"), "l_linenumber", F.col("l_quantity").alias("Dst Port"), "l_orderkey"
    )
    flow_csv.export_csv(short, path, "append")
    flow_csv.export_csv(full, path, "append")
    return csv_values(flow_csv.read_flow_csv(spark, path))


@query
def default_label(spark, sf_dir):
    return col.shown_label(samples.raw_scores(spark, sf_dir)).select("flow_uid", "human_label")


@query
def append_aligned(spark, sf_dir):
    df = samples.raw_scores(spark, sf_dir)
    old = df.filter(F.col("scope") == "error").select("flow_uid", "score_raw", "human_label")
    return col.append_aligned(old, df.filter(F.col("scope") != "error").select("label", "score_raw", "flow_uid"))


@query
def one_row(spark, sf_dir):
    return samples.raw_scores(spark, sf_dir).filter(F.col("flow_uid") == "77").select("flow_uid", "score_raw", "scope")


@query
def summary_view(spark, sf_dir):
    df = fl.build_flows(samples.packets(spark, sf_dir))
    n = F.col("packets").cast("double")
    return rounded(
        col.summary_view(df.withColumns({"prediction": F.col("end_reason"), "confidence": n, "gmm_score": n}))
    )


# ---- scoring


@query
def scaler_fit(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(stats.scaler_fit(lineitem(spark, sf_dir), names), 6, ["mean", "scale"])


@query
def scale(spark, sf_dir):
    x1, x2 = scoring.scaled(tiny_bundle())
    df = lineitem(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", F.round(x1, 6).alias("x1"), F.round(x2, 6).alias("x2"))


@query
def ae_error(spark, sf_dir):
    b = tiny_bundle()
    df = lineitem(spark, sf_dir).withColumn("e", scoring.error_vector(spark, b, scoring.scaled(b)))
    e1, e2 = F.get("e", 0), F.get("e", 1)
    return df.select(
        "l_orderkey", "l_linenumber", F.round(e1, 6).alias("e1"), F.round(e2, 6).alias("e2"),
        F.round((e1 + e2) / 2, 6).alias("ae_score"),
    )


@query
def gmm_score(spark, sf_dir):
    df = scoring.score_rows(lineitem(spark, sf_dir), tiny_bundle(), ["l_orderkey", "l_linenumber"])
    return df.select("l_orderkey", "l_linenumber", F.round("score_raw", 6).alias("score_raw"))


@query
def predict(spark, sf_dir):
    df = scoring.predict(lineitem(spark, sf_dir), tiny_bundle(), keep=["l_orderkey", "l_linenumber"])
    return head(df, "l_orderkey", "l_linenumber", "prediction", "confidence", "gmm_score")


_SCORED = ("flow_uid", "prediction", "confidence", "gmm_score")


@query
def confidence_by_scope(spark, sf_dir):
    return head(samples.scored(spark, sf_dir), *_SCORED, "scope")


@query
def classify(spark, sf_dir):
    return head(samples.scored(spark, sf_dir, None), *_SCORED)


@query
def relabel(spark, sf_dir):
    return head(scoring.relabel(samples.scored(spark, sf_dir, None), 40.0, "scope"), *_SCORED)


@query
def choose_threshold(spark, sf_dir):
    """Threshold adjustment without training: pick the 5th percentile, label again."""
    df = samples.raw_scores(spark, sf_dir)
    t = stats.choose_threshold(df)
    labelled = df.select(scoring.label(F.col("score_raw"), t).alias("prediction"))
    return labelled.agg(
        F.round(F.lit(t), 6).alias("threshold"), F.count_if(F.col("prediction") == scoring.ATTACK).alias("attacks")
    )


def flow_bundle() -> Bundle:
    """A small seeded model of all 18 features under a fixed scaler."""
    mean = [2e6 if "IAT" in f or "Idle" in f else 2e4 if "Port" in f or "Win" in f else 300.0 if "Length" in f else 10.0 for f in FEATURES]
    return random_bundle(seed=11, k=2, encoder=[6], latent=4).with_(
        version="flows", scaler_mean=np.array(mean), scaler_scale=np.array(mean) * 0.9, threshold=-25.0
    )


@query
def predict_flows(spark, sf_dir):
    """Packets to flows to labelled rows with an 18-feature model."""
    flows = stage_table(fl.build_flows(samples.packets(spark, sf_dir)))
    df = scoring.predict(flows, flow_bundle(), keep=["flow_uid"])
    return df.select("flow_uid", "prediction", "confidence", "gmm_score", F.round("ae_score", 6).alias("ae_score"))


# ---- routing and feedback


@query
def route_benign(spark, sf_dir):
    return head(routing.benign_rows(samples.scored(spark, sf_dir)), *_SCORED)


@query
def route_attack(spark, sf_dir):
    return head(routing.attack_rows(samples.scored(spark, sf_dir)), *_SCORED)


@query
def keep_last(spark, sf_dir):
    df = samples.raw_scores(spark, sf_dir).withColumn("batch", F.expr("event_id div 500"))
    return tables.keep_last(df, "batch", "event_id", 777).select("event_id", "score_raw")


@query
def feedback_count(spark, sf_dir):
    return samples.feedback(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query
def feedback_route(spark, sf_dir):
    given = samples.feedback(spark, sf_dir).filter(F.col("action") == "set")
    return given.groupBy(routing.feedback_route(F.col("human_label")).alias("buffer")).agg(F.count(F.lit(1)).alias("n"))


@query
def feedback_effective(spark, sf_dir):
    return routing.effective_feedback(samples.feedback(spark, sf_dir))


def labelled(spark, sf_dir):
    return routing.with_feedback(samples.scored(spark, sf_dir), samples.feedback(spark, sf_dir))


@query
def effective_class(spark, sf_dir):
    return head(routing.effective_class(labelled(spark, sf_dir)), "flow_uid", "effective_label", "human_confirmed")


@query
def agreement(spark, sf_dir):
    return routing.agreement(labelled(spark, sf_dir))


@query
def buffer_stats(spark, sf_dir):
    """Fill both buffers, report what they hold."""
    df, root = samples.scored(spark, sf_dir), scratch(spark)
    benign, attack = tables.Buffer(spark, f"{root}/benign"), tables.Buffer(spark, f"{root}/attack")
    benign.add(routing.benign_rows(df))
    attack.add(routing.attack_rows(df))
    held = benign.load().agg(F.count(F.lit(1)).alias("benign_count"))
    return held.select("benign_count", attack.load().agg(F.count(F.lit(1))).scalar().alias("attack_count"))


# ---- statistics


@query
def status_summary(spark, sf_dir):
    return stats.status_summary(samples.scored(spark, sf_dir))


@query
def result_summary(spark, sf_dir):
    return rounded(stats.result_summary(samples.scored(spark, sf_dir)), 6, ["mean_confidence"])


@query
def attack_rate_alert(spark, sf_dir):
    return rounded(stats.drift_alert(samples.scored(spark, sf_dir), ["scope"]), 6, ["attack_rate"])


@query
def score_percentiles(spark, sf_dir):
    return rounded(stats.score_percentiles(samples.raw_scores(spark, sf_dir)), 6, ["value"])


@query
def score_percentiles_by_scope(spark, sf_dir):
    """Grouped percentiles with the largest scopes narrowed by the sketch first."""
    df = samples.raw_scores(spark, sf_dir)
    limit = max(1, df.count() // 5)
    probs = [p / 100 for p in stats.PERCENTILES]
    values = ranks.quantiles(df, "score_raw", probs, ["scope"], group_limit=limit)
    name = F.concat(F.lit("p"), F.rint(F.col("prob") * 100).cast("int").cast("string"))
    return values.select("scope", name.alias("percentile"), F.round("value", 6).alias("value"))


@query
def score_histogram(spark, sf_dir):
    return rounded(stats.score_histogram(samples.raw_scores(spark, sf_dir)), 6, ["lo", "hi"])


@query
def score_range(spark, sf_dir):
    df = stats.score_range(lineitem(spark, sf_dir), "l_extendedprice")
    return rounded(df, 6, ["score_min", "score_max", "score_mean"])


@query
def best_f1_threshold(spark, sf_dir):
    return rounded(stats.best_f1_threshold(samples.raw_scores(spark, sf_dir)), 6, ["threshold", "f1"])


@query
def capture_counters(spark, sf_dir):
    return stats.capture_counters(samples.scored(spark, sf_dir), "scope")


@query
def capture_totals(spark, sf_dir):
    return stats.capture_totals(samples.scored(spark, sf_dir), samples.packets(spark, sf_dir), "scope")


# ---- samples, sets, order


@query
def sample_n(spark, sf_dir):
    return head(sampling.sample_rows(samples.raw_scores(spark, sf_dir), 500), "flow_uid", "score_raw")


@query
def cap_rows(spark, sf_dir):
    return head(sampling.cap_rows(samples.table(spark, sf_dir, "orders"), 3000, "o_orderkey", 7), "o_orderkey", "o_totalprice")


@query
def replay_mix(spark, sf_dir):
    df = samples.raw_scores(spark, sf_dir).select("flow_uid", "scope")
    new, old = df.filter("scope <> 'view'"), df.filter("scope = 'view'")
    return sampling.mix_replay(new, old, 0.3).select("flow_uid", "from_replay")


@query
def train_val_split(spark, sf_dir):
    return sampling.train_val_split(samples.raw_scores(spark, sf_dir)).select("flow_uid", "is_val")


@query
def composition(spark, sf_dir):
    old = F.col("scope") == "view"
    row = samples.raw_scores(spark, sf_dir).agg(F.count_if(~old), F.count_if(old)).first()
    c = sampling.composition(row[0], row[1], cap=5000)
    return spark.range(1).select(F.lit(c.n_replay).cast("long").alias("n_replay"), F.lit(c.n_new).cast("long").alias("n_new"))


@query
def replay_seed(spark, sf_dir):
    df = samples.raw_scores(spark, sf_dir)
    return sampling.sample_rows(df, sampling.replay_seed_size(df.count())).select("flow_uid")


@query
def union_batches(spark, sf_dir):
    df = samples.raw_scores(spark, sf_dir).select("flow_uid", "scope")
    return df.filter("scope = 'click'").unionByName(df.filter("scope <> 'click'").select("scope", "flow_uid"))


@query
def dataset_assembly(spark, sf_dir):
    df = samples.table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")

    def dataset(status, attack):
        return df.filter(F.col("o_orderstatus") == status).select(
            F.col("o_orderkey").alias("seq"), price.alias(" Destination Port"), price.alias(" Fwd Header Length.1"),
            F.when(F.col("o_custkey") % 3 == 0, "BENIGN").otherwise(attack).alias("Attack"),
        )

    benign = df.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("seq"), price.alias("Dst Port"), F.lit("BENIGN").alias("Label")
    )
    sets = {"dos": (dataset("F", "DoS"), 900), "scan": (dataset("O", "Scan"), 400)}
    return flow_csv.assemble_datasets(spark, benign, sets, "seq", ["seq", "Dst Port", "Label"])


@query
def dataset_from_files(spark, sf_dir):
    """Attack rows of CSV files in file order, without an order column."""
    root, df = scratch(spark), samples.table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    benign = df.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("seq"), price.alias("Dst Port"), F.lit("BENIGN").alias("Label"))
    for status, attack in (("F", "DoS"), ("O", "Scan")):
        label = F.when(F.col("o_custkey") % 3 == 0, "BENIGN").otherwise(attack).alias("Attack")
        rows = df.filter(F.col("o_orderstatus") == status).repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
        rows = rows.select(F.col("o_orderkey").alias("seq"), price.alias(" Destination Port"), price.alias(" Fwd Header Length.1"), label)
        rows.write.option("header", True).csv(f"{root}/{attack}")
    sets = {"dos": (f"{root}/DoS", 900), "scan": (f"{root}/Scan", 400)}
    out = flow_csv.assemble_datasets(spark, benign, sets, columns=["seq", "Dst Port", "Label"])
    return out.select(F.col("seq").cast("long").alias("seq"), F.col("Dst Port").cast("double").alias("Dst Port"), "Label")


@query
def drop_column(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_tax").alias(" Fwd Header Length.1"))
    return df.drop(" Fwd Header Length.1")


@query
def sorted_rows(spark, sf_dir):
    df = samples.raw_scores(spark, sf_dir).select("flow_uid", "score_raw", "event_id")
    return ranks.row_numbers(df, [F.col("score_raw"), F.col("event_id")]).select("row", "flow_uid")


@query
def first_rows(spark, sf_dir):
    return head(sampling.first_rows(samples.raw_scores(spark, sf_dir), "event_id", 250), "flow_uid", "event_id")


@query
def last_rows(spark, sf_dir):
    return head(sampling.last_rows(samples.raw_scores(spark, sf_dir), "event_id", 10), "flow_uid", "event_id")


# ---- models and explanations


@query
def current_model(spark, sf_dir):
    events = samples.table(spark, sf_dir, "events")
    promotions = events.select(
        F.concat(F.lit("v"), (F.col("event_id") % 40).cast("string")).alias("model_version"),
        F.col("ts").alias("promoted_at"),
        F.when(F.col("event_type") == "error", "reject").otherwise("accept").alias("action"),
    )
    models = events.select(F.concat(F.lit("v"), (F.col("user_id") % 30).cast("string")).alias("model_version")).distinct()
    return current_version(promotions, models, "v0")


@query
def cached_explanations(spark, sf_dir):
    stored = lineitem(spark, sf_dir).select(
        line_uid().cast("string").alias("flow_uid"),
        F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("model_version"),
        F.col("l_extendedprice").alias("score"),
    )
    wanted = samples.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).cast("string").alias("flow_uid"))
    return ex.cached_explanations(wanted, stored, "m1").select("flow_uid", "model_version", "score")


@query
def waterfall_topk(spark, sf_dir):
    size = samples.table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0]
    df = samples.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("flow_uid"), F.lit("ae").alias("level"), F.lit(0.0).alias("base"),
        F.array(*[F.lit(f"f{i:02d}") for i in range(1, size + 1)]).alias("features"),
        F.transform("embedding", lambda v: v.cast("double")).alias("contributions"),
    )
    return ex.waterfall(df).select("flow_uid", "rank", "feature", F.round("contribution", 5).alias("contribution"))


@query
def explain_flows(spark, sf_dir):
    """Contributions of all features to both scores of every flow; base and contributions
    add up to the score, so nothing is left unexplained."""
    flows = stage_table(fl.build_flows(samples.packets(spark, sf_dir)))
    bundle = flow_bundle()
    df = ex.explain(flows, bundle, ex.background_sample(flows, bundle, 20), walks=10)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    left = F.abs(F.round(F.col("score") - F.col("base") - total, 6))
    return df.select("flow_uid", "level", F.round("score", 5).alias("score"), left.alias("unexplained"))


BACKGROUND = ((-1.5, 0.25), (-0.5, -1.0), (0.0, 0.75), (0.5, 2.0), (1.25, -0.25))


@query
def explain_exact(spark, sf_dir):
    """Contributions of both features of the tiny model to both scores, over all subsets."""
    df = lineitem(spark, sf_dir).withColumn("flow_uid", line_uid())
    out = ex.explain_exact(df, tiny_bundle(), np.array(BACKGROUND))
    parts = [F.round(F.get("contributions", i), 6).alias(f"contribution_{i + 1}") for i in range(2)]
    return out.select("flow_uid", "level", F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), *parts)


# ---- capture files


@query
def capture_ranges(spark, sf_dir):
    """Packets written as capture files and read back, each file by many byte ranges."""
    from tidewatch.sources import pcap

    folder = f"{scratch(spark)}/captures"
    files = max(4, samples.table(spark, sf_dir, "events").count() // 2_000_000)
    sizes = stage_table(samples.capture_files(spark, sf_dir, folder, files))
    total = sizes.agg(F.sum("bytes")).first()[0]
    df = pcap.read_pcap(spark, folder, part_bytes=max(1 << 16, min(pcap.PART_BYTES, total // 64)))
    return df.select(
        F.unix_micros("ts").alias("t_us"), *[samples.captured_ip(F.col(n)).alias(n) for n in ("src_ip", "dst_ip")],
        "src_port", "dst_port", "protocol", "payload_len", "tcp_flags", "tcp_window", "header_size",
    )


# ---- streams


@query
def stream_flows(spark, sf_dir):
    """Packets replayed as a file stream in four parts, flows collected at the end."""
    from tidewatch.streaming.flows import FlowStream
    from tidewatch.streaming.live import packet_stream

    root, packets = scratch(spark), samples.packets(spark, sf_dir)
    n, lo, hi = packets.agg(F.count(F.lit(1)), F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    files = max(1, n // 4_000_000)
    part = F.least(F.floor((F.unix_micros("ts") - lo) * 4 / (hi - lo + 1)), F.lit(3))
    for i in range(4):
        packets.filter(part == i).repartition(files).write.mode("append").parquet(f"{root}/packets")
    stream = FlowStream(spark, f"{root}/state", delay="1 second")
    stream.start(packet_stream(spark, f"{root}/packets", files_per_trigger=files), f"{root}/checkpoint").awaitTermination()
    stream.flush()
    return rounded(stream.flows()).drop("start_ts")


@query
def stream_restart(spark, sf_dir):
    """Two captures through one stream: a flush and a restart between them."""
    from tidewatch.streaming.flows import FlowStream
    from tidewatch.streaming.live import packet_stream

    root, packets = scratch(spark), samples.packets(spark, sf_dir)
    t = F.unix_micros("ts")
    n, middle = packets.agg(F.count(F.lit(1)), F.expr("(min(unix_micros(ts)) + max(unix_micros(ts))) div 2")).first()
    files = max(1, n // 4_000_000)
    for part in (packets.filter(t < middle), packets.filter(t >= middle)):
        part.repartition(files).write.mode("append").parquet(f"{root}/packets")
        stream = FlowStream(spark, f"{root}/state", delay="1 second")
        stream.start(packet_stream(spark, f"{root}/packets", files_per_trigger=files), f"{root}/checkpoint").awaitTermination()
        stream.flush()
    return rounded(stream.flows()).drop("start_ts")


@query
def live_scoring(spark, sf_dir):
    """Packets in, labelled flows out: each step of a stream scores the flows it ended."""
    from tidewatch.plans.engine import Engine
    from tidewatch.streaming.live import packet_stream, score_live

    root, packets = scratch(spark), samples.packets(spark, sf_dir)
    t = F.unix_micros("ts")
    n, middle = packets.agg(F.count(F.lit(1)), F.expr("(min(unix_micros(ts)) + max(unix_micros(ts))) div 2")).first()
    files = max(1, n // 4_000_000)
    for part in (packets.filter(t < middle), packets.filter(t >= middle)):
        part.repartition(files).write.mode("append").parquet(f"{root}/packets")
    bundle = flow_bundle().with_(confidence_scale=2.0)
    engine = Engine(spark, f"{root}/site", default_version=bundle.version)
    engine.save(bundle)
    stream = score_live(engine, f"{root}/stream", delay="1 second")
    stream.start(packet_stream(spark, f"{root}/packets", files_per_trigger=files), f"{root}/checkpoint").awaitTermination()
    stream.flush()
    scored = engine.results("live")
    return scored.select("flow_uid", "prediction", "confidence", "gmm_score", F.round("ae_score", 6).alias("ae_score"))


@query
def watched_folder(spark, sf_dir):
    """CSV files of two dialects scored as they are found; files with text for numbers are set aside."""
    from tidewatch.plans.engine import Engine
    from tidewatch.streaming.live import watch_directory

    root, df = scratch(spark), lineitem(spark, sf_dir).withColumn("flow_uid", line_uid().cast("string"))
    bad, price = F.col("l_suppkey") % 7 == 0, F.col("l_extendedprice")
    quantity = F.when(bad, "many").otherwise(F.col("l_quantity").cast("string"))
    for i, (part, columns) in enumerate((
        (~bad & (F.col("l_partkey") % 2 == 0), ["flow_uid", quantity.alias(" l_quantity"), price]),
        (~bad & (F.col("l_partkey") % 2 == 1), [price.alias("l_extendedprice "), "flow_uid", quantity.alias("l_quantity")]),
        (bad, ["flow_uid", quantity.alias("l_quantity"), price]),
    )):
        df.filter(part).select(*columns).repartition(2).write.option("header", True).csv(f"{root}/in/d{i}")
    engine = Engine(spark, f"{root}/site", default_version="tiny")
    engine.save(tiny_bundle().with_(confidence_scale=2.5))
    watch_directory(engine, f"{root}/in/*", f"{root}/checkpoint").awaitTermination()
    return engine.results("watch").select("flow_uid", "prediction", "confidence", "gmm_score")


# ---- training


@query
def weight_importance(spark, sf_dir):
    """Importance of the small network's weights over all rows."""
    b = tiny_bundle()
    x1, x2 = scoring.scaled(b)
    rows = lineitem(spark, sf_dir).select(x1.alias("x1"), x2.alias("x2"))
    omega = train_ae.importance(rows, ["x1", "x2"], b.layers, n=None)
    data = [(i, round(float(v), 6)) for i, v in enumerate(omega)]
    return spark.createDataFrame(data, "position int, importance double")


@query
def mixture_fit(spark, sf_dir):
    """Three components over the standardised numbers of all line items."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = lineitem(spark, sf_dir)
    fit = stats.scaler_fit(df, names).orderBy("position").collect()
    errors = df.select(F.array(*[F.abs((F.col(r["feature"]) - r["mean"]) / r["scale"]) for r in fit]).alias("errors"))
    weights, means, covs, trace = train_gmm.fit_mixture(errors, k=3, max_iter=10)
    rows = [(i, float(w), [float(v) for v in m], float(np.linalg.det(c))) for i, (w, m, c) in enumerate(zip(weights, means, covs))]
    return spark.createDataFrame(rows, "component int, weight double, mean array<double>, spread double")


STEP_FROM = {"weights": (0.4, 0.6), "means": ((15.0, 3.0), (35.0, 6.0)), "covs": ((80.0, 2.0, 9.0), (120.0, -3.0, 7.0))}


@query
def mixture_step(spark, sf_dir):
    """One round of expectation and maximisation over all line items, from fixed values."""
    numbers = F.array(F.col("l_quantity").cast("double"), (F.col("l_discount") * 100).cast("double"))
    covs = [[[a, b], [b, c]] for a, b, c in STEP_FROM["covs"]]
    rows = lineitem(spark, sf_dir).select(numbers.alias("e"))
    weights, means, covs, likelihood = train_gmm.mixture_step(rows, np.array(STEP_FROM["weights"]), np.array(STEP_FROM["means"]), np.array(covs))
    out = [(j, *[round(float(v), 6) for v in (weights[j], *means[j], covs[j][0, 0], covs[j][0, 1], covs[j][1, 1], likelihood)]) for j in range(2)]
    return spark.createDataFrame(out, "component int, weight double, mean_a double, mean_b double, aa double, ab double, bb double, likelihood double")


@query
def adaptation(spark, sf_dir):
    """A model trained from scratch on all flows: its review percentiles and threshold."""
    from tidewatch.plans.adapt import adapt_initial

    flows = fl.build_flows(samples.packets(spark, sf_dir))
    done = adapt_initial(flows, encoder=[16, 8], latent=6, components=3, epochs=5, max_iter=10)
    rows = [(name, float(v), float(done.bundle.threshold), done.n_rows) for name, v in done.percentiles.items()]
    return spark.createDataFrame(rows, "percentile string, score double, threshold double, rows long")
