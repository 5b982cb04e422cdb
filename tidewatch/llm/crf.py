"""A linear-chain conditional random field in numpy: training and Viterbi in batches."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Scores ``emit[feature, label]``, ``move[label, label]`` and ``start[label]``.

    A sequence is a list of positions, each an array of feature numbers.
    """

    def __init__(self, labels: list[str], features: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.labels, self.features, self.emit, self.move, self.start = labels, features, emit, move, start

    def numbers(self, names: list[str]) -> np.ndarray:
        """Known features of a position; unknown ones carry no weight."""
        known = self.features
        return np.array([known[n] for n in names if n in known], dtype=np.int64)

    def scores(self, positions: list[np.ndarray]) -> np.ndarray:
        """Emission scores, a row per position."""
        out = np.zeros((len(positions), len(self.labels)))
        sizes = np.array([len(p) for p in positions])
        if sizes.sum():
            np.add.at(out, np.repeat(np.arange(len(positions)), sizes), self.emit[np.concatenate(positions)])
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of sequences laid end to end; all sequences advance together.

        Ties go to the label that comes first.
        """
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        longest = int(sorted_lengths[0]) if len(lengths) else 0
        best = np.zeros(int(lengths.sum()), dtype=np.int64)
        back: list[np.ndarray] = []
        state = self.start + scores[begin] if longest else None
        final = np.zeros(len(order), dtype=np.int64)
        for t in range(1, longest):
            live = int(np.searchsorted(-sorted_lengths, -t, side="left"))
            if live < len(state):
                final[live : len(state)] = state[live:].argmax(axis=1)
                state = state[:live]
            options = state[:, :, None] + self.move[None]
            back.append(options.argmax(axis=1))
            state = options.max(axis=1) + scores[begin[:live] + t]
        if longest:
            final[: len(state)] = state.argmax(axis=1)
            at = final.copy()
            for t in range(longest - 1, -1, -1):
                live = int(np.searchsorted(-sorted_lengths, -t, side="left"))
                best[begin[:live] + t] = at[:live]
                if t:
                    at[:live] = back[t - 1][np.arange(live), at[:live]]
        return best


def train(
    sequences: list[tuple[list[list[str]], list[str]]],
    labels: list[str],
    rounds: int = 80,
    ridge: float = 0.02,
    rate: float = 0.5,
    only_first: str | None = None,
) -> LinearChain:
    """Fit by gradient ascent on the conditional log-likelihood, with forward-backward.

    Full batches with per-weight step sizes, so the result depends on the rows alone.
    Positions with the feature ``only_first`` can have the first label only.
    """
    names = sorted({f for positions, _ in sequences for p in positions for f in p})
    features = {n: i for i, n in enumerate(names)}
    number = {label: i for i, label in enumerate(labels)}
    n, width = len(sequences), len(labels)
    lengths = np.array([len(y) for _, y in sequences])
    longest = int(lengths.max())
    # Dense over (sequence, step): feature lists become pairs (cell, feature).
    cells, used = [], []
    gold = np.full((n, longest), -1)
    for i, (positions, tags) in enumerate(sequences):
        for t, (position, tag) in enumerate(zip(positions, tags, strict=True)):
            gold[i, t] = number[tag]
            cells += [i * longest + t] * len(position)
            used += [features[f] for f in position]
    cells, used = np.array(cells), np.array(used)
    # Sums per cell and per feature over sorted pairs.
    cell_starts, by_use = np.flatnonzero(np.diff(cells, prepend=-1)), np.argsort(used, kind="stable")
    filled, use_starts = cells[cell_starts], np.flatnonzero(np.diff(used[by_use], prepend=-1))
    there = gold >= 0
    observed = np.zeros((n * longest, width))
    observed[np.flatnonzero(there), gold[there]] = 1.0
    emit, move, start = np.zeros((len(names), width)), np.zeros((width, width)), np.zeros(width)
    gold_move = np.zeros((width, width))
    np.add.at(gold_move, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1.0)
    gold_start = np.bincount(gold[:, 0], minlength=width).astype(float)
    barred = np.full(width, -1e6)
    barred[0] = 0.0
    if only_first in features:
        emit[features[only_first]] = barred
    squares = [np.full_like(w, 1e-8) for w in (emit, move, start)]
    for _ in range(rounds):
        score = np.zeros((n * longest, width))
        score[filled] = np.add.reduceat(emit[used], cell_starts, axis=0)
        score = score.reshape(n, longest, width)
        forward, alive = np.zeros((n, longest, width)), there[:, :, None]
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(alive[:, t], _lse(forward[:, t - 1][:, :, None] + move) + score[:, t], forward[:, t - 1])
        backward = np.zeros((n, longest, width))
        for t in range(longest - 2, -1, -1):
            onward = _lse((move[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :]).transpose(0, 2, 1))
            backward[:, t] = np.where(alive[:, t + 1], onward, 0.0)
        total = _lse(forward[:, -1][:, :, None])[:, 0]
        node = np.exp(forward + backward - total[:, None, None]) * alive
        expected_move = np.zeros((width, width))
        for t in range(1, longest):
            edge = forward[:, t - 1][:, :, None] + move + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            expected_move += (np.exp(edge) * alive[:, t][:, :, None]).sum(axis=0)
        slope = np.add.reduceat((observed - node.reshape(-1, width))[cells[by_use]], use_starts, axis=0)
        slopes = [slope - ridge * emit, gold_move - expected_move - ridge * move, gold_start - node[:, 0].sum(axis=0) - ridge * start]
        for weight, g, square in zip((emit, move, start), slopes, squares, strict=True):
            square += g * g
            weight += rate * g / np.sqrt(square)
        if only_first in features:
            emit[features[only_first]] = barred
    return LinearChain(labels, features, emit, move, start)


def _lse(x: np.ndarray) -> np.ndarray:
    """Log of summed exponentials over the middle axis."""
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
