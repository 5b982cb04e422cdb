import itertools

import numpy as np

from tidewatch.llm.crf import LinearChain, train


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    chain = LinearChain(list("abc"), {}, np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([3, 1, 5, 2, 5])
    scores = rng.normal(size=(lengths.sum(), 3))
    got = chain.viterbi(scores, lengths)
    at = 0
    for n in lengths:
        part = scores[at : at + n]
        total = lambda y: chain.start[y[0]] + sum(part[i, l] for i, l in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=int(n)), key=total)
        assert tuple(got[at : at + n]) == best
        at += n


def test_training_uses_neighbours():
    rows = []
    for first in "ab":
        rows += [([[f"w={first}"], ["w=x"], ["w=x"]], [first.upper()] * 3)] * 5
    chain = train(rows, ["A", "B"], rounds=60)
    for positions, tags in (rows[0], rows[-1]):
        scores = chain.scores([chain.numbers(p) for p in positions])
        assert [chain.labels[i] for i in chain.viterbi(scores, np.array([3]))] == tags


def test_no_sequences():
    chain = LinearChain(["O"], {}, np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1))
    assert len(chain.viterbi(np.zeros((0, 1)), np.zeros(0, dtype=int))) == 0
