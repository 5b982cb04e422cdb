import numpy as np

from tidewatch.llm import balltree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in good:
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    return out


def run(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return {tuple(r) for r in balltree.top_k(table, table.filter("vec_id % 50 = 0"), **more).collect()}


def test_equals_brute_force_over_several_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(600)]
    rows += [(i, rows[i % 7][1]) for i in range(600, 700)]  # ties
    assert run(spark, rows, shard_rows=60) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (None, [9.0, 9.0]), (50, [0.5, 0.5]), (-50, [3e18, 3e18])]
    got = {(q, r, i) for q, r, i, _ in run(spark, rows)}
    assert got == {(q, r, i) for q, r, i, _ in brute(rows)}
    assert run(spark, []) == set()


def test_queries_shorter_than_candidates(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0 + i % 3][: 1 + i % 3]) for i in range(1, 90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    short = spark.createDataFrame([(3, [3.0]), (500, [2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.top_k(vectors, short, 4, shard_rows=20).collect())
    want = []
    for q, query in ((3, [3.0]), (500, [2.0])):
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, query)), i) for i, v in rows if i != q)
        want += [(q, n + 1, i, -score) for n, (score, i) in enumerate(scores[:4])]
    assert got == want
