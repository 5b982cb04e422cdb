import hashlib
import random
import zlib

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tidewatch.llm import runs


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(s, min_length, min_exponent):
    """Every stretch with a period, by trying all periods from the smallest up."""
    out = set()
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            size = j + p - i
            if size >= max(min_length, min_exponent * p) and not any(
                all(s[x] == s[x + q] for x in range(i, i + size - q)) for q in range(1, p)
            ):
                out.add((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 5])
    s = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 6)
        p = min(p, n - a)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


def test_lyndon_arrays_and_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(1500):
        s = random_words(rng)
        order = sorted(set(s))
        assert runs.lyndon_array([order.index(x) for x in s], len(order)) == brute_lyndon(s)
        words = [f"w{x}" for x in s]
        for limits in ((6, 4), (2, 2), (4, 3)):
            assert runs.find_runs(words, *limits) == brute_runs(words, *limits)


def test_long_and_regular_texts():
    n = 100_000
    assert runs.find_runs(["a"] * n) == [(0, n, 1)]
    assert runs.find_runs(["a", "b"] * n) == [(0, 2 * n, 2)]
    assert runs.find_runs([str(i) for i in range(n)]) == []
    assert runs.find_runs([str(i % 300) for i in range(n)]) == [(0, n, 300)]
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    assert runs.find_runs(b) == []  # a Fibonacci word has no fourth power


def planted_words(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted_words(doc_id, runs.WORD.findall(text or ""))
    found = brute_runs(words, 6, 4)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in found)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed)]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark, tmp_path, make_docs):
    rng = random.Random(5)
    rows = [r for r in ODD if r[0] != 5]
    rows += [(100 + i, " ".join(f"w{x}" for x in random_words(rng)), "en", "a") for i in range(300)]
    rows += [(1000 + i, "\n".join(f"v{rng.randrange(40)}" for _ in range(200)), "en", "a") for i in range(60)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r[c] for c in COLUMNS) for r in runs.op13_runs(spark, str(tmp_path)).collect()]
    want = [expected(r[0], r[1]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 30


def test_real_texts_equal_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in runs.op13_runs(spark, sf).collect()}
    assert set(got) == set(docs)
    short = [d for d, text in docs.items() if len(text or "") < 1500]
    assert len(short) > 50 and all(got[d] == expected(d, docs[d]) for d in short)


def test_odd_rows_clash_and_empty(make_docs, odd_docs, clash):
    found = {(r.doc_id, r.text): r for r in runs.with_runs(odd_docs).collect()}
    long_text = next(r for key, r in found.items() if key[0] == 5)
    assert long_text.runs[0].asDict() == {"start": 0, "length": 30_000, "period": 1} and long_text.collapsed == "long"
    assert found[1, None].n_words == 0 and found[1, None].runs == [] and found[1, None].collapsed == ""
    mixed = runs.with_runs(clash.withColumn("RUNS", F.lit("mine")))
    assert mixed.count() == 10 and set(mixed.columns) == set(clash.columns) | {"runs", "collapsed"}
    assert all(r.kept == "x" for r in mixed.collect())
    assert runs.with_runs(make_docs([])).count() == 0
    body = odd_docs.withColumnRenamed("text", "collapsed")
    assert sorted(r.n_words for r in runs.with_runs(body, "collapsed").collect()) == sorted(r.n_words for r in runs.with_runs(odd_docs).collect())
    with pytest.raises(ValueError):
        runs.with_runs(odd_docs, min_exponent=1)
