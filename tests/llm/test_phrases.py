import random
import re
from collections import Counter

import numpy as np
from odd_rows import ODD
from pyspark.sql import functions as F

from tidewatch.llm import phrases
from tidewatch.llm.automata import Automaton, compose, summed, union


def test_machines_sum_and_compose_like_counters():
    rng = np.random.default_rng(3)
    for _ in range(150):
        machines, total = [], Counter()
        for _ in range(rng.integers(1, 6)):
            n, size = int(rng.integers(1, 5)), int(rng.integers(0, 40))
            rows = [rng.integers(1, 5, size).astype(np.uint64) for _ in range(n)]
            labels, weights, _ = summed(rows, np.ones(size, dtype=np.int64))
            counted = Counter(zip(*[c.tolist() for c in rows], strict=True))
            machine = Automaton.load(Automaton.build(labels, weights).closed().dump())
            paths, found = machine.paths()[-1]
            assert dict(zip(zip(*[c.tolist() for c in paths], strict=True), found.tolist(), strict=True)) == counted
            machines.append(machine)
            total.update(counted)
        whole = union(machines)
        for machine in (whole, whole.closed(), union([whole])):
            for n in range(1, 5):
                asked = [rng.integers(1, 6, 60).astype(np.uint64) for _ in range(n)]
                want = [total[p] for p in zip(*[c.tolist() for c in asked], strict=True)]
                assert compose(asked, machine).tolist() == want


def test_closing_shares_states():
    rows = [(a, b, c) for a in range(1, 30) for b in range(1, 5) for c in range(1, 5)]
    labels = [np.array(c, dtype=np.uint64) for c in zip(*rows, strict=True)]
    whole = Automaton.build(labels, np.ones(len(rows), dtype=np.int64))
    assert whole.arcs == 29 + 29 * 4 + 29 * 16 and whole.closed().arcs == 29 + 4 + 4


def brute(rows, min_count, percent, top):
    """The contract, phrase by phrase."""
    counts, total = {}, Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in frequent.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * f >= percent * a for q, f in frequent.items()):
                continue
            cuts = [(2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts(rng, n):
    vocabulary = ["Alpha", "beta", "gamma", "delta", "É", "tab\tword", "x.y", "new", "York,", "City"]
    out = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        if i % 3 == 0:
            words += ["the", "quick", "brown", "fox"]
        out.append((i, " ".join(words), rng.choice(["en", "de", None]), "a"))
    return out


def test_equals_brute_force(make_docs, monkeypatch):
    rows = texts(random.Random(2), 250) + [r for r in ODD if r[0] != 5]
    want = brute(rows, 5, 80, 40)
    assert result(phrases.collocations(make_docs(rows), min_count=5, top=40)) == want
    assert len({r[0] for r in want}) >= 3 and max(r[1] for r in want) == 40


def test_small_blocks_give_the_same(make_docs, monkeypatch, spark):
    # Blocks, unions and the bitmap at sizes where each is used many times over.
    rows = texts(random.Random(4), 200)
    want = brute(rows, 4, 80, 2000)
    for name, value in (("BLOCK", 50), ("UNITE", 20), ("RANGE_WORDS", 10), ("FILTER_BITS", 1 << 10)):
        monkeypatch.setattr(phrases, name, value)
    assert result(phrases.collocations(make_docs(rows).repartition(3), min_count=4)) == want


def test_long_text_clash_and_empty(make_docs, clash):
    rows = [(1, "long " * 100_000, "en", "a"), (2, None, "en", "a"), (3, "!" * 100_000 + "a" * 100_000, "en", "a")]
    got = result(phrases.collocations(make_docs(rows)))
    # One candidate of each length; the shorter ones lie in the longer.
    assert [r[:7] for r in got] == [("en", 1, "long long long long", 99_997, 100_000, 99_998, 100_001)]
    assert result(phrases.collocations(make_docs([]))) == []
    names = {"n": F.lit("x"), "label": F.lit(1), "range": F.lit(2), "l1": F.lit("y"), "phrase": F.lit("z")}
    assert result(phrases.collocations(clash.withColumns(names), min_count=2)) == brute(ODD, 2, 80, 2000)
