"""Status counts, rates, percentiles, histograms, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import NO_LABEL
from tidewatch.functions.packet import TCP, UDP
from tidewatch.operators.ranks import quantiles
from tidewatch.operators.scoring import ATTACK, NORMAL

# Review percentiles, histogram bins, drift alert, candidates.
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]
BINS = 80
ALERT_RATE, ALERT_ROWS = 0.50, 20
CANDIDATES = 200


def _is(label: str) -> Column:
    return F.col("prediction") == label


def status_summary(df: DataFrame) -> DataFrame:
    given = F.col("human_label").isNotNull() & ~F.trim("human_label").isin("", NO_LABEL)
    attacks = F.count_if(_is(ATTACK))
    return df.agg(
        F.count(F.lit(1)).alias("flows"),
        (F.count(F.lit(1)) - attacks).alias("normal"),
        attacks.alias("attack"),
        F.count_if(given).alias("feedback"),
    )


def result_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is(NORMAL)).alias("normal"),
        F.count_if(_is(ATTACK)).alias("attack"),
        F.avg("confidence").alias("mean_confidence"),
    )


def attack_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows labelled Attack and the row count; 0.0 without rows or labels."""
    flag = _is(ATTACK).cast("double") if "prediction" in df.columns else F.lit(None).cast("double")
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(flag), F.lit(0.0)).alias("attack_rate"),
        F.count_if(F.coalesce(flag, F.lit(0.0)) == 1.0).alias("attacks"),
        F.count(F.lit(1)).alias("n"),
    )


def drift_alert(df: DataFrame, by: Sequence[str] = (), rate: float = ALERT_RATE, rows: int = ALERT_ROWS) -> DataFrame:
    """The groups whose attack rate calls for adaptation."""
    return attack_rate(df, by).filter((F.col("attack_rate") >= rate) & (F.col("n") >= rows))


def score_percentiles(df: DataFrame, score: str = "score_raw", by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Review percentiles, one row per percentile ``p1`` ... ``p99``."""
    if approx:
        points = F.array(*[F.lit(p / 100) for p in PERCENTILES])
        wide = df.groupBy(*by).agg(F.percentile_approx(score, points, F.lit(10_000)).alias("v"))
        names = F.array(*[F.lit(f"p{p}") for p in PERCENTILES])
        return wide.select(*by, F.explode(F.arrays_zip(names.alias("name"), F.col("v"))).alias("z")).select(
            *by, F.col("z.name").alias("percentile"), F.col("z.v").alias("value")
        )
    values = quantiles(df, score, [p / 100 for p in PERCENTILES], by)
    return values.select(
        *by, F.concat(F.lit("p"), F.rint(F.col("prob") * 100).cast("int").cast("string")).alias("percentile"), "value"
    )


def percentile_dict(df: DataFrame, score: str = "score_raw") -> dict[str, float]:
    return {r["percentile"]: r["value"] for r in score_percentiles(df, score).collect()}


def score_histogram(df: DataFrame, score: str = "score_raw", bins: int = BINS) -> DataFrame:
    """Equal bins over [min, max], the last one closed; empty bins are listed too."""
    x = F.col(score)
    spread = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    # All scores equal: half a unit on each side, as the usual histogram does.
    same = F.col("lo") == F.col("hi")
    spread = spread.select(
        F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    row = spread.first()
    if row["lo"] is None:
        return spread.select(F.lit(0).alias("bin"), "lo", "hi", F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = row["lo"], row["hi"]
    width = (hi - lo) / bins
    slot = F.least(F.floor((x - lo) / width).cast("int"), F.lit(bins - 1))
    counts = df.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(counts), "bin", "left")
    return full.select(
        "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def score_range(df: DataFrame, score: str = "score_raw") -> DataFrame:
    return df.agg(
        F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(score).alias("score_mean")
    )


def scaler_fit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every feature in one pass; deviation 0 becomes 1."""
    q = [F.col(f"`{f}`") for f in features]
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(q)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(q)],
    )
    triples = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"),
                F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
            )
            for i, f in enumerate(features)
        ]
    )
    return row.select(F.inline(triples))


def best_f1_threshold(
    df: DataFrame, score: str = "score_raw", truth: str = "label", candidates: int = CANDIDATES
) -> DataFrame:
    """Threshold with the best macro-F1 among evenly spaced candidates: one row.

    One pass bins the scores between candidates; everything after works on at most
    2 * candidates counts.
    """
    s = F.col(score)
    lo, hi = df.agg(F.min(s), F.max(s)).first()
    spark = df.sparkSession
    schema = "threshold double, f1 double"
    if lo is None:
        return spark.createDataFrame([], schema)
    step = (hi - lo) / (candidates - 1)

    def candidate(i: Column) -> Column:
        return F.when(i == candidates - 1, F.lit(hi)).otherwise(lo + i * step)

    # Smallest candidate above the score: the first one that calls the row an attack.
    guess = F.floor((s - lo) / step).cast("int") if step > 0 else F.lit(candidates)
    above = (
        F.when(s < candidate(guess), guess).when(s < candidate(guess + 1), guess + 1).otherwise(guess + 2)
    )
    slot = F.least(above, F.lit(candidates))
    attack = F.col(truth).cast("int")
    binned = df.groupBy(slot.alias("i")).agg(F.count_if(attack == 1).alias("pos"), F.count_if(attack == 0).alias("neg"))
    grid = spark.range(candidates + 1).select(F.col("id").cast("int").alias("i"))
    counts = grid.join(F.broadcast(binned), "i", "left").na.fill(0)
    run, whole = Window.orderBy("i"), Window.partitionBy()
    f = counts.select(
        "i", F.sum("pos").over(run).alias("tp"), F.sum("neg").over(run).alias("fp"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"),
    ).filter(F.col("i") < candidates)
    fn, tn = F.col("p") - F.col("tp"), F.col("n") - F.col("fp")

    def f1(true: Column, false_a: Column, false_b: Column) -> Column:
        bottom = 2 * true + false_a + false_b
        return F.when(bottom > 0, 2 * true / bottom)  # NULL: class in neither labels nor predictions

    attack_f1, normal_f1 = f1(F.col("tp"), F.col("fp"), fn), f1(tn, fn, F.col("fp"))
    present = F.filter(F.array(attack_f1, normal_f1), lambda v: v.isNotNull())
    macro = F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present)
    ranked = f.select("i", candidate(F.col("i")).alias("t"), macro.alias("f1"))
    best = ranked.agg(F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    zero = F.col("b.f1") <= 0.0
    return best.select(
        F.when(zero, F.lit(lo)).otherwise(F.col("b.t")).alias("threshold"),
        F.when(zero, 0.0).otherwise(F.col("b.f1")).alias("f1"),
    )


def choose_threshold(
    scores: DataFrame, mode: str = "auto", value: float | str | None = None, score: str = "score_raw"
) -> float:
    """``auto``: 5th percentile; ``percentile``: a named one; ``manual``: a number within 10 of the range."""
    if mode == "manual":
        lo, hi, _ = score_range(scores, score).first()
        if value is None or not lo - 10.0 <= float(value) <= hi + 10.0:
            raise ValueError(f"manual threshold {value} outside [{lo - 10.0}, {hi + 10.0}]")
        return float(value)
    name = "p5" if mode == "auto" else str(value)
    found = percentile_dict(scores, score)
    if name not in found:
        raise ValueError(f"no percentile {name}")
    return found[name]


def packet_counters(packets: DataFrame) -> DataFrame:
    """Packets by IP version and transport; other IP packets count as skipped."""
    transport = F.col("protocol").isin(TCP, UDP)
    ip = F.col("ip_version").isin(4, 6)
    return packets.agg(
        F.count_if(ip & transport).alias("packets_processed"),
        F.count_if(ip & (F.col("protocol") == TCP)).alias("packets_tcp"),
        F.count_if(ip & (F.col("protocol") == UDP)).alias("packets_udp"),
        F.count_if(F.col("ip_version") == 4).alias("packets_ipv4"),
        F.count_if(F.col("ip_version") == 6).alias("packets_ipv6"),
        F.count_if(ip & ~transport).alias("packets_skipped"),
    )


def capture_counters(scored: DataFrame, scope: str) -> DataFrame:
    """Per capture: flows, attacks; summed up by the caller as needed."""
    return scored.groupBy(scope).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(_is(ATTACK)).alias("attacks")
    )


def capture_totals(scored: DataFrame, packets: DataFrame, scope: str, errors: int = 0) -> DataFrame:
    """Captures, packets, flows, attacks, errors and the last capture: one row."""
    flows = scored.agg(
        F.count_distinct(scope).alias("captures"), F.count(F.lit(1)).alias("flows"),
        F.count_if(_is(ATTACK)).alias("attacks"), F.max(scope).alias("last_capture"),
    )
    total = packets.agg(F.count(F.lit(1)).alias("packets"))
    return flows.select(
        "captures", total.scalar().alias("packets"), "flows", "attacks", F.lit(errors).alias("errors"), "last_capture"
    )
