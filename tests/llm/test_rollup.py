import pytest

from tidewatch.llm import rollup
from tidewatch.llm.common import shared_folder
from tidewatch.llm.tokens import token_ids


def totals(r):
    return {(t.source, t.lang, t.tokenizer_version): (t.n_docs, t.n_tokens) for t in r.totals().collect()}


def test_inserts_revisions_deletes_and_repeats(spark, make_docs):
    docs = make_docs([(1, "a b c", "en", "s"), (2, "d-e", "en", "s"), (2, "d-e", "en", "s"), (3, None, None, None)])
    r = rollup.TokenRollup(spark, shared_folder(spark, "rollup"))
    assert totals(r) == {}
    one = rollup.counted(docs, "words-1")
    assert r.commit("load", rollup.inserts(one))
    assert totals(r) == {("s", "en", "words-1"): (3, 5), (None, None, "words-1"): (1, 0)}
    assert not r.commit("load", rollup.inserts(one))
    assert r.commit("recount", rollup.revisions(one, rollup.counted(docs, "words-2")))
    assert totals(r) == {("s", "en", "words-2"): (3, 9), (None, None, "words-2"): (1, 0)}
    assert r.commit("gone", rollup.deletes(rollup.counted(docs.filter("doc_id = 2"), "words-2")))
    assert r.commit("nothing", rollup.inserts(one.limit(0)))
    assert totals(r) == {("s", "en", "words-2"): (1, 3), (None, None, "words-2"): (1, 0)}


def test_second_writer_of_a_batch_fails_to_rename(spark, make_docs):
    r = rollup.TokenRollup(spark, shared_folder(spark, "rollup"))
    rows = rollup.inserts(rollup.counted(make_docs([(1, "a b")]), "words-1"))
    aside = [f"{r.folder}/aside-{i}" for i in range(2)]
    for path in aside:
        rows.groupBy(*rollup.GROUP).agg(rollup.F.sum("sign").alias("n_docs"), rollup.F.sum("n_tokens").alias("n_tokens")).write.parquet(path)
    assert r._rename(aside[0], r._path("b")) and not r._rename(aside[1], r._path("b"))
    assert totals(r) == {("src0", "en", "words-1"): (1, 2)}


def test_vocabulary_version(odd_docs):
    got = sorted((r.n_tokens for r in rollup.counted(odd_docs, "bpe-50k").collect()))
    assert got == sorted(len(token_ids().encode(r.text or "")) // 4 for r in odd_docs.collect())
    with pytest.raises(ValueError, match="unknown"):
        rollup.counted(odd_docs, "nope")


def test_query_over_the_vocabulary_equals_brute_force(spark, sf):
    from tidewatch.llm import registry

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if len((r.text or "").encode().split()) >= rollup.MIN_WORDS:
            docs, tokens = want.get((r.source, r.lang, "bpe-50k"), (0, 0))
            want[r.source, r.lang, "bpe-50k"] = (docs + 1, tokens + len(token_ids().ids(r.text)) // 4)
    got = registry.queries()["op9_token_counts_bpe"](spark, sf).collect()
    assert want and {(t.source, t.lang, t.tokenizer_version): (t.n_docs, t.n_tokens) for t in got} == want
