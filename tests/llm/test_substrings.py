import hashlib
import random
import tempfile

import numpy as np
import pytest
from odd_rows import ODD

from tidewatch.llm import substrings


def brute(texts, span=200):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] = seen.get(b[i : i + span], 0) + 1
    out = []
    for b in data:
        runs = substrings.merged([(i, i + span) for i in range(len(b) - span + 1) if seen[b[i : i + span]] > 1])
        kept, at = b"", 0
        for start, stop in runs:
            kept, at = kept + b[at:start], stop
        kept += b[at:]
        out.append((len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = text(420), text(260)
    out = [text(rng.randint(0, 300)) + passage + text(rng.randint(0, 300)) for _ in range(12)]
    out += [text(90) + passage[:230] + other + passage[150:], passage, passage[:250], other[:199], other[:200], "z" * 1000, "ab" * 300 + text(50)]
    out += [text(500) for _ in range(3)]
    near = text(900)
    out += [near[:i] + "X" + near[i:] for i in (10, 300, 450, 455, 880)]
    return out


def got(docs, spark):
    with tempfile.TemporaryDirectory() as folder:
        docs.write.parquet(f"{folder}/documents.parquet")
        return sorted(tuple(r)[1:] for r in substrings.op5_substrings(spark, folder).collect())


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_equals_brute_force(spark, make_docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = [*rows(), *[t for _, t, *_ in ODD if not t or len(t) < 1000]]
    assert got(make_docs(list(enumerate(texts))), spark) == brute(texts)


def test_repeated_rows_nulls_and_empty_table(spark, make_docs, clash):
    text = "repeated row " * 30
    docs = make_docs([(1, text), (1, text), (None, None), (None, "x"), (2, "x")])
    result = {(r[0], r[1]) for r in got(docs, spark)}
    assert (len(text), len(text)) in result and (1, 0) in result and (0, 0) in result
    assert got(make_docs([]), spark) == []
    assert substrings.remove_repeats(clash).count() == 10


def test_collection_finds_common_prefixes(tmp_path):
    rng = random.Random(1)
    side = substrings.SIDE
    pool = [bytes(rng.choice(b"ab") for _ in range(side)) for _ in range(3)]
    cases = []
    for _ in range(40):
        left, right = rng.choice(pool), rng.choice(pool)
        cut = rng.randint(0, side)
        left = bytes(rng.choice(b"ab") for _ in range(cut)) + left[cut:]
        cases.append((left[rng.choice([0, 0, 30]) :], right[: rng.choice([side, side, 70])], rng.randint(0, 1)))
    lefts, rights, group = zip(*cases, strict=True)
    flags = substrings.Collection(list(lefts), list(rights), np.array(group), str(tmp_path)).build()
    for i, (left, right, g) in enumerate(cases):
        for a in range(side + 1):
            window = (left[len(left) - a :], right[: side - a], g)
            fits = a <= len(left) and side - a <= len(right)
            want = fits and any(
                j != i and a <= len(x) and side - a <= len(y) and (x[len(x) - a :], y[: side - a], h) == window for j, (x, y, h) in enumerate(cases)
            )
            assert flags[i, a] == want


def test_ranges_cover_all_places_once():
    places = [a for lo, hi in substrings.RANGES for a in range(lo, hi + 1)]
    assert places == list(range(substrings.SIDE + 1))


def test_no_key_has_many_unlike_pieces(spark, make_docs, monkeypatch):
    seen, built = [], substrings._built

    def watched(parts):
        seen.append(parts.groupBy("key").agg(substrings.F.countDistinct("body").alias("m")).agg(substrings.F.max("m")).first()[0])
        return built(parts)

    monkeypatch.setattr(substrings, "HOT", 8)
    monkeypatch.setattr(substrings, "_built", watched)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(230)
    texts = [text(rng.randint(0, 150)) + passage[: rng.choice([230, 230, 215])] + text(rng.randint(0, 150)) for _ in range(60)]
    assert got(make_docs(list(enumerate(texts))), spark) == brute(texts)
    assert len(seen) == 1 and seen[0] <= 8
