from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import explain as ex
from tidewatch.operators import routing, sampling, stats
from tidewatch.operators.bundle import current_version
from tidewatch.plans import adapt as ad
from tidewatch.schemas import FEEDBACK
from tidewatch.sources import tables


def macro_f1(truth, guess):
    out = []
    for c in sorted(set(truth) | set(guess)):
        tp = np.sum((truth == c) & (guess == c))
        wrong = np.sum((truth == c) != (guess == c))
        out.append(2 * tp / (2 * tp + wrong))
    return float(np.mean(out))


@pytest.mark.parametrize("kind", ["mixed", "separated", "all normal", "constant"])
def test_best_f1_against_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    scores, truth = rng.normal(0, 3, 150), rng.integers(0, 2, 150)
    if kind == "separated":
        scores = np.where(truth == 1, scores - 50, scores)
    if kind == "all normal":
        truth = truth * 0
    if kind == "constant":
        scores = np.full(150, 2.0)
    lo, hi = scores.min(), scores.max()
    best_t, best_f = lo, 0.0
    for t in np.linspace(lo, hi, 200):
        f = macro_f1(truth, (scores < t).astype(int))
        if f > best_f:
            best_t, best_f = t, f
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, truth)], "score_raw double, label int")
    got = stats.best_f1_threshold(df).first()
    assert (got["threshold"], got["f1"]) == pytest.approx((best_t, best_f), abs=1e-9)


def test_histogram_against_numpy(spark):
    x = np.concatenate([np.random.default_rng(1).normal(size=500), [4.0, 4.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "score_raw double")
    n, edges = np.histogram(x, bins=80)
    got = stats.score_histogram(df).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(n) and np.allclose([r["lo"] for r in got], edges[:-1])
    assert stats.score_histogram(df.filter("score_raw = 4.0")).agg(F.sum("n"), F.count("*")).first() == (2, 80)
    assert stats.score_histogram(df.limit(0)).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "prediction string, human_label string, confidence double, score_raw double, label int")
    assert stats.status_summary(empty).first() == (0, 0, 0, 0)
    assert stats.attack_rate(empty).first()["attack_rate"] == 0.0
    assert stats.attack_rate(spark.range(3)).first()["attack_rate"] == 0.0
    assert stats.best_f1_threshold(empty).count() == 0 and stats.percentile_dict(empty) == {}


def test_feedback_events(spark):
    t = datetime(2024, 1, 1)
    rows = [
        ("a", "Normal", "Attack", t, "set"), ("a", "Attack", "Attack", t + timedelta(1), "set"),
        ("b", "Normal", "Attack", t, "set"), ("b", None, None, t + timedelta(1), "clear"), ("c", "odd", "Normal", t, "set"),
    ]
    events = spark.createDataFrame(rows, FEEDBACK)
    got = {r.flow_uid: r.human_label for r in routing.effective_feedback(events).collect()}
    assert got == {"a": "Attack", "b": None, "c": "odd"}
    scored = spark.createDataFrame([("a", "Attack"), ("b", "Attack"), ("c", "Normal"), ("d", "Normal")], "flow_uid string, prediction string")
    shown = routing.effective_class(routing.with_feedback(scored, events))
    assert {r.flow_uid: (r.effective_label, r.human_confirmed) for r in shown.collect()} == {
        "a": ("Attack", True), "b": ("Attack", False), "c": ("odd", True), "d": ("Normal", False),
    }


def test_current_version_falls_back(spark):
    schema = "model_version string, action string, promoted_at timestamp"
    t = datetime(2024, 1, 1)
    promos = spark.createDataFrame([("x", "accept", t), ("gone", "accept", t + timedelta(1)), ("y", "reject", t + timedelta(2))], schema)
    models = spark.createDataFrame([("x",), ("y",)], "model_version string")
    assert current_version(promos, models, "d").first()[0] == "d"
    assert current_version(promos.filter("model_version <> 'gone'"), models, "d").first()[0] == "x"
    assert current_version(promos.limit(0), models, "d").first()[0] == "d"


def test_short_waterfall_and_missing_explanation(spark):
    df = spark.createDataFrame(
        [("a", "m", "ae", 1.0, ["p", "q"], [0.5, -2.0])],
        "flow_uid string, model_version string, level string, base double, features array<string>, contributions array<double>",
    )
    assert [(r["rank"], r["feature"]) for r in ex.waterfall(df).collect()] == [(1, "q"), (2, "p")]
    wanted = spark.createDataFrame([("a",), ("z",)], "flow_uid string")
    got = {r["flow_uid"]: r["level"] for r in ex.cached_explanations(wanted, df, "m").collect()}
    assert got == {"a": "ae", "z": None}
    assert ex.cached_explanations(wanted, df, "other").filter("level is not null").count() == 0


def test_mode_thresholds_and_shuffles(spark):
    assert ad.choose_mode(None) == ad.INITIAL and ad.choose_mode(spark.range(0)) == ad.INITIAL
    assert ad.choose_mode(spark.range(1)) == ad.INCREMENTAL
    scores = spark.range(101).select(F.col("id").cast("double").alias("score_raw"))
    assert stats.choose_threshold(scores) == pytest.approx(5.0)
    assert stats.choose_threshold(scores, "percentile", "p25") == pytest.approx(25.0)
    assert stats.choose_threshold(scores, "manual", -9.0) == -9.0
    for mode, value in (("manual", -11.0), ("manual", None), ("percentile", "p3")):
        with pytest.raises(ValueError):
            stats.choose_threshold(scores, mode, value)
    df = spark.range(50).coalesce(1)
    one, two = ([r.id for r in sampling.epoch_order(df, "id", 1, e).collect()] for e in (0, 1))
    assert one != two and sorted(one) == sorted(two) and one == [r.id for r in sampling.epoch_order(df, "id", 1, 0).collect()]


def test_keep_last_cuts_inside_one_batch(spark):
    df = spark.range(100).select("id", F.expr("id div 30").alias("batch"))
    for cap in (0, 5, 10, 40, 100, 500):
        got = sorted(r.id for r in tables.keep_last(df, "batch", "id", cap).collect())
        assert got == list(range(max(0, 100 - cap), 100)), cap
