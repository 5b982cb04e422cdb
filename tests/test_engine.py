import itertools
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.columns import quoted
from tidewatch.operators import explain as ex
from tidewatch.operators import flows as fl
from tidewatch.operators import scoring, stats
from tidewatch.operators.bundle import Bundle, as_table, from_row, random_bundle
from tidewatch.plans import adapt as ad
from tidewatch.plans import samples
from tidewatch.plans.engine import Engine
from tidewatch.schemas import FEATURES
from tidewatch.session import stage_table
from tidewatch.sources.tables import Buffer

SMALL = {"encoder": [12, 8], "latent": 6, "components": 2, "max_iter": 15, "partitions": 2}


def fresh():
    return tempfile.mkdtemp(prefix="tidewatch-test-")


@pytest.fixture(scope="module")
def flows(spark, sf):
    return stage_table(fl.build_flows(samples.packets(spark, sf), hot_rows=None))


@pytest.fixture(scope="module")
def bundle(flows):
    fit = stats.scaler_fit(flows, FEATURES).orderBy("position").collect()
    b = random_bundle().with_(
        version="m0", scaler_mean=np.array([r["mean"] for r in fit]), scaler_scale=np.array([r["scale"] for r in fit])
    )
    return b


def numpy_scores(pdf, b):
    x = (pdf[list(b.feature_names)].to_numpy() - b.scaler_mean) / b.scaler_scale
    errors = b.errors(x)
    d = x.shape[1]
    logs = []
    for w, m, c in zip(b.gmm_weights, b.gmm_means, b.gmm_covs):
        diff = errors - m
        quad = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff)
        logs.append(np.log(w) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + quad))
    return np.logaddexp.reduce(np.array(logs), axis=0)


def test_predict_matches_numpy(spark, flows, bundle):
    got = scoring.predict(flows, bundle, keep=["flow_uid"]).toPandas().sort_values("flow_uid")
    raw = numpy_scores(flows.toPandas().sort_values("flow_uid"), bundle)
    assert np.allclose(got["score_raw"], raw)
    assert list(got["prediction"]) == ["Attack" if s < bundle.threshold else "Normal" for s in raw]
    d = raw - bundle.threshold
    conf = (1 / (1 + np.exp(-np.abs(d / (np.percentile(np.abs(d), 95) / 3)))) - 0.5) * 2
    assert np.allclose(got["confidence"], np.round(conf, 4))


def test_the_model_runs_once_per_row(spark, flows, bundle):
    plan = scoring.score_rows(flows, bundle, ["flow_uid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") == 1
    # Only the kept column and the features are read.
    assert "end_reason" not in plan.split("ReadSchema")[1]


def test_confidence_edge_cases(spark):
    def conf(values, **kw):
        df = spark.createDataFrame([(float(v),) for v in values], "score_raw double")
        return scoring.classify(df, 45.0, **kw)

    assert conf([10.0]).first()["confidence"] == 0.9051
    flat = conf([45.0] * 5).collect()
    assert {(r["prediction"], r["confidence"]) for r in flat} == {("Normal", 0.0)}
    assert conf([]).count() == 0
    for n, alerts in ((19, 0), (20, 1)):
        df = conf([0.0] * ((n + 1) // 2) + [90.0] * (n // 2))
        assert stats.drift_alert(df).count() == alerts


def test_missing_features_are_named(flows, bundle):
    with pytest.raises(ValueError, match="Bwd IAT Std"):
        scoring.predict(flows.drop("Bwd IAT Std"), bundle)


def test_bundle_survives_storage(spark, bundle):
    back = from_row(as_table(spark, [bundle]).first())
    x = np.random.default_rng(0).normal(size=(4, 18))
    assert np.allclose(back.errors(x), bundle.errors(x)) and back.threshold == bundle.threshold


def test_explanations_add_up(spark, flows, bundle):
    some = flows.limit(12)
    start = ex.background_sample(flows, bundle, 10)
    got = ex.explain(some, bundle, start, walks=6).collect()
    assert len(got) == 24 and {r["level"] for r in got} == {"ae", "gmm"}
    for r in got:
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["score"], rel=1e-9, abs=1e-9)
    falls = ex.waterfall(spark.createDataFrame(got)).groupBy("flow_uid", "level").agg(F.count("*").alias("n")).collect()
    assert {r["n"] for r in falls} == {15}


def test_exact_contributions_equal_all_orders(spark):
    """Every order of the features with every background row, written out."""
    rng = np.random.default_rng(5)
    layers = [{"kernel": rng.normal(size=(4, 3)), "bias": rng.normal(size=3)}, {"kernel": rng.normal(size=(3, 4)), "bias": rng.normal(size=4)}]
    names = ("f1", "f2", "f3", "f4")
    small = Bundle(
        version="s", scaler_mean=np.zeros(4), scaler_scale=np.ones(4), layers=layers, gmm_weights=np.array([0.5, 0.5]),
        gmm_means=rng.normal(size=(2, 4)), gmm_covs=np.array([np.eye(4), 2 * np.eye(4)]), threshold=0.0, feature_names=names,
    )
    x, start = rng.normal(size=(7, 4)), rng.normal(size=(5, 4))
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "flow_uid string, f1 double, f2 double, f3 double, f4 double")
    mixture = small.mixture()
    for r in ex.explain_exact(df, small, start, partitions=3).collect():
        value = (lambda e: e.mean(1)) if r["level"] == "ae" else mixture.log_density
        want = np.zeros(4)
        orders = list(itertools.permutations(range(4)))
        for b in start:
            for order in orders:
                now = b.copy()
                for i in order:
                    before = value(small.errors(now[None]))[0]
                    now[i] = x[int(r["flow_uid"])][i]
                    want[i] += value(small.errors(now[None]))[0] - before
        assert np.allclose(r["contributions"], want / len(orders) / len(start))
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["score"])
    many = {(r["flow_uid"], r["level"]): r for r in ex.explain(df, small, start, walks=4000).collect()}
    for r in ex.explain_exact(df, small, start).collect():
        assert np.allclose(many[r["flow_uid"], r["level"]]["contributions"], r["contributions"], atol=0.25)
    with pytest.raises(ValueError, match="subsets"):
        ex.explain_exact(df, random_bundle(), start)


def test_buffer_keeps_the_newest_rows(spark):
    b = Buffer(spark, fresh(), cap=10)
    assert b.is_empty and b.load() is None
    assert b.add(spark.range(0)) == 0
    for i in range(4):
        assert b.add(spark.range(i * 4, i * 4 + 4).coalesce(1), token=f"t{i}") == 4
    assert b.add(spark.range(100), token="t3") == 0
    assert b.count == 10 and sorted(r.id for r in b.load().collect()) == list(range(6, 16))
    b.add(spark.range(50, 75).coalesce(1))
    assert sorted(r.id for r in b.load().collect()) == list(range(65, 75))
    assert b.sample(3, "id").count() == 3
    b.clear()
    assert b.is_empty and b.load() is None
    b.add(spark.range(3))
    assert b.count == 3


def test_two_writers_of_a_buffer_lose_nothing(spark):
    path = fresh()
    one, two = Buffer(spark, path), Buffer(spark, path)
    commit = one.ledger.commit

    def late(rows, version):
        if two.is_empty:
            two.add(spark.range(100, 105))  # the other writer takes this version first
        return commit(rows, version)

    one.ledger.commit = late
    assert one.add(spark.range(10)) == 10
    assert one.count == two.count == 15 and one.load().count() == 15


def test_threshold_keeps_the_scale_of_the_confidences(spark, flows, bundle):
    engine = Engine(spark, fresh(), default_version="m0")
    engine.save(bundle.with_(confidence_scale=7.0))
    stored = engine.predict(flows)
    before = stored.agg(F.sum("confidence")).first()[0]
    again = engine.set_threshold(engine.current().threshold)
    assert again.agg(F.sum("confidence")).first()[0] == pytest.approx(before, abs=1e-9)
    assert engine.results().count() == stored.count()


def test_feedback_routes_by_the_human_label(spark, bundle):
    engine = Engine(spark, fresh(), default_version="m0")
    engine.save(bundle)
    zero = spark.createDataFrame([("z", *[0.0] * 18)], ["flow_uid", *FEATURES])
    row = zero.withColumns({"prediction": F.lit("Attack"), "confidence": F.lit(0.85), "gmm_score": F.lit(20.0)})
    assert engine.feedback(row.withColumn("human_label", F.lit("Normal"))) == {"benign": 1, "attack": 0}
    assert engine.feedback(row.withColumn("human_label", F.lit("odd"))) == {"benign": 0, "attack": 1}
    assert engine.feedback_count == 2 and engine.buffer_stats()["buffer_max"] is None


def test_life_of_a_deployment(spark, flows, bundle):
    engine = Engine(spark, fresh(), default_version="m0")
    engine.save(bundle)
    assert engine.current_version() == "m0"
    stored = engine.predict(flows)
    n = flows.count()
    assert stored.count() == n and engine.results().count() == n
    assert engine.benign.count + engine.attack.count <= n

    first = engine.adapt(flows, epochs=6, **SMALL)
    assert first.mode == ad.INITIAL and engine.current_version() == "m0"
    assert first.bundle.threshold == pytest.approx(first.percentiles["p5"])
    again = engine.accept(first, flows, scope="all")
    assert engine.current_version() == first.bundle.version and again.count() == n
    flagged = again.filter("prediction = 'Attack'").count() / n
    assert flagged < 0.2
    assert engine.replay.count == int(n * 0.3)
    assert engine.results().select("model_version").distinct().first()[0] == first.bundle.version

    second = engine.adapt(flows, epochs=3, partitions=2, max_iter=5)
    assert second.mode == ad.INCREMENTAL and second.n_replay > 0
    assert second.bundle.parent == first.bundle.version and second.bundle.domains_seen[-1] == "adapted"
    engine.reject(second)
    assert engine.current_version() == first.bundle.version
    engine.accept(second, flows)
    assert engine.current_version() == second.bundle.version
    assert engine.replay.count == 2 * int(n * 0.3)

    tuned = engine.adapt(flows, mode=ad.FINETUNE, epochs=2, partitions=1, max_iter=4)
    assert tuned.scores.count() == n and tuned.history().count() == 2

    moved = engine.set_threshold(engine.current().threshold - 5)
    assert moved.count() == n

    told = engine.explain(flows.limit(3), flows, walks=4)
    assert told.count() == 6
    cached = engine.cached(flows.limit(5))
    assert cached.filter("level is not null").count() == 6
    engine.clear()
    assert engine.results() is None


def test_drift_pair(spark, flows):
    """Shifted traffic raises the alert; after adaptation about one in twenty is flagged."""
    fitted = ad.adapt_initial(flows, epochs=15, **SMALL)
    base = scoring.predict(flows, fitted.bundle, keep=["flow_uid"])
    assert stats.drift_alert(base).count() == 0
    lengths = [f for f in FEATURES if "Length" in f]
    shifted = flows
    pick = F.pmod(F.xxhash64("flow_uid"), F.lit(10)) < 6
    for f in lengths:
        shifted = shifted.withColumn(f, F.when(pick, quoted(f) * 25).otherwise(quoted(f)))
    for f in [f for f in FEATURES if "IAT" in f]:
        shifted = shifted.withColumn(f, F.when(pick, quoted(f) * 0.2).otherwise(quoted(f)))
    shifted = stage_table(shifted)
    assert stats.drift_alert(scoring.predict(shifted, fitted.bundle, keep=["flow_uid"])).count() == 1
    new = ad.adapt_initial(shifted, epochs=15, **SMALL)
    rate = stats.attack_rate(scoring.predict(shifted, new.bundle, keep=["flow_uid"])).first()["attack_rate"]
    assert rate < 0.2


def test_a_slow_writer_never_takes_a_used_number(spark):
    """Twelve batches while another writer holds an old view: nothing is lost."""
    root = tempfile.mkdtemp(prefix="tidewatch-test-")
    slow, fast = Buffer(spark, root), Buffer(spark, root)
    rows = spark.range(100).select(F.col("id").cast("string").alias("flow_uid"))
    fast.add(rows.limit(5), "first")
    seen, commit = [], slow.ledger.commit

    def late(lines, version):
        if not seen:
            seen.append(version)
            for i in range(12):
                fast.add(rows.limit(2), f"b{i}")
        return commit(lines, version)

    slow.ledger.commit = late
    assert slow.add(rows, "slow") == 100
    assert fast.count == 5 + 24 + 100 and fast.load().count() == 129
    assert len(fast.ledger.versions()) <= fast.ledger.keep
