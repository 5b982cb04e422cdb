from collections import Counter

from tidewatch.llm import mixing


def test_budget_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)],
        "_m_domain string, _m_lang string, _m_source string, capacity long",
    )
    weights = {"_m_domain": {}, "_m_lang": {}}
    quota = {r._m_source: r.quota for r in mixing.budgets(leaves, 800, weights).collect()}
    # Halves to web and books, halves of web to en and de; what "a" lacks goes to "b".
    assert quota == {"a": 10, "b": 190, "c": 200, "d": 400}
    quota = {r._m_source: r.quota for r in mixing.budgets(leaves, 2700, weights).collect()}
    assert quota == {"a": 10, "b": 840, "c": 850, "d": 1000} and sum(quota.values()) == 2700
    quota = {r._m_source: r.quota for r in mixing.budgets(leaves, 9999, weights).collect()}
    assert quota == {"a": 10, "b": 1000, "c": 1000, "d": 1000}


def test_epochs_and_prefix(make_docs):
    rows = [(i, "one two three", "en", "src0") for i in range(200)] + [(1000 + i, "x y", "de", "src7") for i in range(20)]
    taken = Counter((r.doc_id, r.lang) for r in mixing.mix(make_docs(rows), 100, {}, 3).collect())
    assert set(taken.values()) <= {1, 2, 3}
    small = sum(n for (_, lang), n in taken.items() if lang == "de")
    big = sum(n for (_, lang), n in taken.items() if lang == "en")
    assert small == 60 and 3 * big <= 640 - 120 and 3 * (big + 1) > 640 - 120


def test_odd_rows(make_docs, odd_docs, clash):
    assert mixing.mix(make_docs([])).count() == 0
    out = mixing.mix(odd_docs, 100, {}, 2)
    assert out.count() > 0
    again = sorted(map(str, mixing.mix(odd_docs, 100, {}, 2).collect()))
    assert sorted(map(str, out.collect())) == again
    assert mixing.mixing_stage(None, clash, "").columns == clash.columns
