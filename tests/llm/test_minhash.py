import random

import pytest
from odd_rows import ODD

from tidewatch.llm import minhash
from tidewatch.llm.components import components


def brute(rows, words, percent):
    sets = []
    for doc, text in rows:
        tokens = (text or "").encode().lower().split()
        width = min(words, len(tokens))
        sets.append((doc, frozenset(tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)) if tokens else frozenset()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(s), find(d), d == find(d)) for d, s in sets if d is not None)


def got(docs, words, percent):
    return sorted(tuple(r) for r in minhash.near_duplicates(docs, words, percent).collect() if r.doc_id is not None)


@pytest.fixture(scope="module")
def chains():
    """Groups of copies, near copies and chains whose ends are not similar."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, doc = [], 0
    for length in (1, 2, 3, 12, 60, 200):
        base = [word() for _ in range(length)]
        for step in range(14):
            rows.append((doc, " ".join(base)))
            doc += rng.randint(1, 3)
            if step % 4 != 3:
                base = [*base]
                base[rng.randrange(length)] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(make_docs, chains, words, percent):
    assert got(make_docs(chains), words, percent) == brute(chains, words, percent)


def test_odd_rows_repeats_and_ids_with_two_texts(make_docs):
    rows = [(r[0], r[1]) for r in ODD] + [(6, "another text under the id of six"), (3000, "another text under the id of six"), (9, "Two Words"), (10, "two  words")]
    assert got(make_docs(rows), 3, 85) == brute(rows, 3, 85)
    null = [r for r in minhash.near_duplicates(make_docs(rows)).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in null] == [(None, True)]
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_leftovers_of_star_rounds_are_compared(make_docs, chains, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    assert got(make_docs(chains), 3, 85) == brute(chains, 3, 85)


def test_stage_keeps_one_of_each_group(make_docs, clash):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words that are not the same"), (4, "")]
    out = minhash.dedup_stage(None, make_docs(rows), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert minhash.dedup_stage(None, clash, "").columns == clash.columns


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in range(301)} == {0} and {out[i] for i in range(1000, 1200)} == {1000} and 5000 not in out
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_unlike_texts_of_one_id(make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (1, b), (1, a, "de", "z"), (2, a), (5, a), (5, c), (None, a), (7, None), (7, "")]
    out = [(r.doc_id, r.text or "") for r in minhash.dedup_stage(None, make_docs(rows), "").collect()]
    texts = sorted(t for d, t in out if d is not None)
    assert texts == ["", a, b, c] and (1, b) in out and (5, c) in out and (None, a) in out and len(out) == 5


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_many_near_copies_around_the_limit(make_docs, monkeypatch, block):
    """600 texts of one base, pairwise similarities 0.78 to 0.88; few and many blocks."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for doc in range(600):
        own = [*base]
        for at in rng.sample(range(130), rng.choice((1, 2, 3, 3, 4, 5))):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((doc, " ".join(own)))
    assert got(make_docs(rows), 3, 85) == brute(rows, 3, 85)


def test_block_of_sets_equals_pairwise_links():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(60)]
    wanted = {(i, k) for i in range(60) for k in range(i) if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[k])) >= 30 * len(np.union1d(sets[i], sets[k]))}
    for held in (0, 20, 59):
        block = minhash._Block(30)
        for i in range(held):
            block.add(i, i, sets[i])
        joined = {(max(p), min(p)) for i in range(60) for p in block.links(i, i, sets[i])}
        assert joined <= wanted

        def parts(pairs):
            root = list(range(60))
            for a, b in sorted(pairs):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        assert parts(joined) == parts({p for p in wanted if p[1] < held})
