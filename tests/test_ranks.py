import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ranks, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in np.concatenate([rng.exponential(5, 3000), np.full(2500, 2.0), [1e9, -1e9]])]
    rows += [("b", float(x)) for x in rng.integers(0, 4, 40)] + [("one", 7.0)]
    rows += [("flat", 3.5)] * 3000
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    return df, {g: np.array([v for k, v in rows if k == g]) for g in ("hot", "b", "one", "flat")}


def test_quantiles_are_equal_on_both_sides_of_the_limit(skewed):
    df, _ = skewed
    probs = [i / 37 for i in range(38)]
    found = [
        {(r.g, r.prob): r.value for r in ranks.quantiles(df, "v", probs, ["g"], group_limit=limit).collect()} for limit in (10**6, 30)
    ]
    assert found[0] == found[1]
    assert [ranks.quantile(df, "v", p, 10**6) for p in probs[::6]] == [ranks.quantile(df, "v", p, 10) for p in probs[::6]]


def test_ordered_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64).view(np.float64)
    edges = np.concatenate([2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1070, 1024), 0), [0.0, np.inf, 5e-324, 1.7976931348623157e308]])
    x = np.concatenate([raw[~np.isnan(raw)], edges, -edges, [np.nan]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    key = ranks.ordered_bits(F.col("x"))
    got = df.select("x", key.alias("k"), ranks.from_ordered_bits(key).alias("y")).collect()
    for r in got:
        bits = int(np.float64(abs(r.x)).view(np.int64)) if r.x == r.x else 0x7FF8 << 48
        assert r.k == (-bits if r.x < 0 else bits)
        assert r.y == r.x or (r.x != r.x and r.y != r.y)


def test_quantiles_with_null_groups_nan_and_infinities(spark):
    values = [float(v) for v in range(-50, 50)] + [float("inf"), float("-inf"), float("nan"), 1e-310, -0.0]
    rows = [(g, v) for g in (None, "a", "b") for v in values] + [("b", None), (None, 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    found = [
        sorted((str(r.g), r.prob, str(r.value)) for r in ranks.quantiles(df, "v", probs, ["g"], group_limit=limit).collect())
        for limit in (10**6, 10)
    ]
    assert found[0] == found[1] and len(found[0]) == 3 * len(probs)
    assert ranks.quantiles(df.limit(0), "v", probs, ["g"], group_limit=10).count() == 0


def test_no_row_meets_a_rank(spark):
    """However many ranks are wanted, the rows of a pass are those of the table."""
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    probs = [i / 200 for i in range(201)]
    got = {(r.g, r.prob): r.value for r in ranks.quantiles(df, "v", probs, ["g"], group_limit=100).collect()}
    want = {(r.g, r.prob): r.value for r in ranks.quantiles(df, "v", probs, ["g"]).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [10**6, 500])
def test_smallest_beyond_doubles(spark, limit):
    big = 2**62
    df = spark.range(2000).select("id", (F.lit(-big) + F.col("id") % 1000 + (F.col("id") % 3 - 1) * F.lit(2**60)).alias("o"))
    rows = sorted((r.o, r.id) for r in df.collect())
    for k in (1, 700, 1999):
        got = df.filter(ranks.smallest(df, F.col("o"), "id", k, group_limit=limit))
        assert sorted((r.o, r.id) for r in got.collect()) == rows[:k]


@pytest.mark.parametrize("limit", [10**6, 400, 30])
def test_quantiles_match_numpy(skewed, limit):
    df, data = skewed
    probs = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]
    got = {(r.g, r.prob): r.value for r in ranks.quantiles(df, "v", probs, ["g"], group_limit=limit).collect()}
    assert len(got) == 4 * len(probs)
    for (g, p), value in got.items():
        assert value == pytest.approx(np.percentile(data[g], p * 100), rel=1e-12), (g, p)


def test_quantile_of_whole_table(skewed):
    df, data = skewed
    every = np.concatenate(list(data.values()))
    for p in (0.0, 0.001, 0.05, 0.3, 0.5, 0.95, 0.9995, 1.0):
        for limit in (10, 10**6):
            assert ranks.quantile(df, "v", p, limit) == pytest.approx(np.percentile(every, p * 100), rel=1e-12)
    assert ranks.quantile(df.filter("g = 'one'"), "v", 0.95) == 7.0
    assert ranks.quantile(df.filter("v > 1e12"), "v", 0.95) is None


@pytest.mark.parametrize("limit", [10**6, 50])
def test_smallest_breaks_ties_by_id(spark, limit):
    df = spark.range(1000).select("id", F.lit(7).alias("o"))
    for k in (0, 1, 400, 1000, 2000):
        got = sorted(r.id for r in df.filter(ranks.smallest(df, F.col("o"), "id", k, limit)).collect())
        assert got == list(range(min(k, 1000)))


def test_sample_is_md5_order(spark):
    df = spark.range(500).withColumn("flow_uid", F.col("id").cast("string"))
    want = sorted((str(i) for i in range(500)), key=lambda u: hashlib.md5(f"{u}:42".encode()).hexdigest())[:77]
    assert sorted(r.flow_uid for r in sampling.sample_rows(df, 77).collect()) == sorted(want)
    assert sampling.sample_rows(df.repartition(7), 900).count() == 500
    split = sampling.train_val_split(df)
    assert split.filter("is_val").count() == 75
    assert sampling.train_val_split(df.limit(3)).filter("is_val").count() == 1


@pytest.mark.parametrize("k", [1, 60, 1990, 2999])
def test_hashed_cut_in_its_bracket(spark, k):
    df = spark.range(3000).select("id", sampling.hash_order("id", 5).alias("h"))
    want = sorted(r.id for r in df.orderBy("h").limit(k).collect())
    for limit in (10**6, 100):
        cut = ranks.smallest(df, sampling.hash_order("id", 5), "id", k, limit, uniform=sampling.HASH_RANGE)
        assert sorted(r.id for r in df.filter(cut).collect()) == want
    # A wrong promise of uniformity only costs time.
    skew = ranks.smallest(df, F.col("id"), "id", k, 100, uniform=sampling.HASH_RANGE)
    assert df.filter(skew).count() == k


def test_mix_and_composition(spark):
    new, replay = spark.range(70).select(F.col("id").cast("string").alias("flow_uid")), spark.range(100, 200).select(
        F.col("id").cast("string").alias("flow_uid")
    )
    mixed = sampling.mix_replay(new, replay, 0.3)
    assert mixed.filter("from_replay").count() == 30 and mixed.count() == 100
    assert sampling.mix_replay(new, replay, 0.0).count() == 70
    assert sampling.mix_replay(new, replay, 1.0).count() == 170
    assert sampling.composition(10**6, 10**6) == sampling.Composition(10**6, 10**6)
    assert sampling.composition(10**6, 10**6, cap=288_000, replay_cap=86_400) == sampling.Composition(86_400, 201_600)
    assert sampling.composition(100, 0) == sampling.Composition(0, 100)
    assert sampling.replay_seed_size(1000) == 300 and sampling.replay_seed_size(10**6, cap=86_400) == 86_400
    assert sampling.cap_rows(new, None).count() == 70 and sampling.cap_rows(new, 10).count() == 10


def test_first_last_and_row_numbers(spark):
    df = spark.range(300).select((F.col("id") * 3).alias("seq"), F.md5(F.col("id").cast("string")).alias("name"))
    assert [r.seq for r in sampling.last_rows(df, "seq", 2).orderBy("seq").collect()] == [894, 897]
    assert [r.seq for r in sampling.first_rows(df, "seq", 2).orderBy("seq").collect()] == [0, 3]
    numbered = ranks.row_numbers(df.repartition(6), [F.col("name")]).collect()
    names = sorted(r.name for r in numbered)
    assert {r["row"]: r["name"] for r in numbered} == {i + 1: n for i, n in enumerate(names)}


def test_keys_of_large_groups_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x * 37 % 1000)

    df = spark.range(2000).select(F.col("id").alias("uid"), counted("id").alias("x"))
    got = ranks.quantiles(df, "x", [0.5, 0.95], group_limit=100).orderBy("prob").collect()
    assert [r["value"] for r in got] == [499.5, 949.05]
    assert seen.value <= 3 * 2000  # two for the stored keys and their filter, one for the count of the groups
