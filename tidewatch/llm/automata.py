"""Weighted acyclic automata over 64-bit labels, in arrays.

A machine spells label sequences: layer ``d`` holds the arcs that spell a path's label
``d``, sorted by source state and label, so each state's arcs are a slice.  An arc carries
the count of the path so far, if that path itself was counted.  States without arcs are one
state, the end.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np

from tidewatch.llm.hashing import mix, odd

_LABEL, _WEIGHT, _TARGET, _SIZE = odd(4)


@dataclass
class Layer:
    first: np.ndarray  # by source state: its first arc; one more at the end
    label: np.ndarray  # uint64
    weight: np.ndarray  # int64
    target: np.ndarray  # states of the next layer


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before; the first does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def summed(labels: list[np.ndarray], weights: np.ndarray, lead: np.ndarray | None = None) -> tuple:
    """Rows (lead, labels) sorted, equal ones with their weights summed."""
    keys = [*labels[::-1]] + ([lead] if lead is not None else [])
    order = np.lexsort(keys)
    labels = [c[order] for c in labels]
    lead = None if lead is None else lead[order]
    at = np.flatnonzero(_changes(*labels, *([lead] if lead is not None else [])))
    total = np.add.reduceat(weights[order], at) if len(at) else weights[:0]
    return [c[at] for c in labels], total, None if lead is None else lead[at]


def _expand(first: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``states``, arc) of all arcs of the states, in order."""
    size = first[states + 1] - first[states]
    owner = np.repeat(np.arange(len(states)), size)
    begins = np.cumsum(size) - size
    return owner, np.arange(len(owner)) - begins[owner] + first[states][owner]


class Automaton:
    def __init__(self, layers: list[Layer]):
        self.layers = layers

    @property
    def arcs(self) -> int:
        return sum(len(x.label) for x in self.layers)

    @classmethod
    def build(cls, labels: list[np.ndarray], weights: np.ndarray) -> Automaton:
        """From sorted distinct sequences of one length: a state opens where a path leaves the one before."""
        layers, new, source = [], np.zeros(len(weights), dtype=bool), np.zeros(len(weights), dtype=np.int64)
        for d, label in enumerate(labels):
            new = _changes(label) | new if len(label) else new
            at = np.flatnonzero(new)
            last = d == len(labels) - 1
            n_sources = int(source[-1]) + 1 if len(source) else 1
            first = np.searchsorted(source[at], np.arange(n_sources + 1))
            target = np.zeros(len(at), dtype=np.int64) if last else np.arange(len(at))
            layers.append(Layer(first, label[at], weights[at] if last else np.zeros(len(at), dtype=np.int64), target))
            source = np.cumsum(new) - 1
        return cls(layers)

    def closed(self) -> Automaton:
        """The same machine with states of equal arcs made one, from the ends back."""
        layers = [Layer(x.first, x.label, x.weight, x.target) for x in self.layers]
        for d in range(len(layers) - 1, 0, -1):
            x = layers[d]
            size = np.diff(x.first)
            arc = mix(x.label * _LABEL + x.weight.astype(np.uint64) * _WEIGHT + x.target.astype(np.uint64) * _TARGET)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(arc, dtype=np.uint64)])
            key = sums[x.first[1:]] - sums[x.first[:-1]] + size.astype(np.uint64) * _SIZE
            _, one, name = np.unique(key, return_index=True, return_inverse=True)
            like = one[name]
            # Equal hashes are only made one if their arcs are equal.
            if (size[like] != size).any():
                continue
            owner, arcs = _expand(x.first, like)
            if any((c[arcs] != c).any() for c in (x.label, x.weight, x.target)):
                continue
            _, arcs = _expand(x.first, one)
            first = np.concatenate([[0], np.cumsum(size[one])])
            layers[d] = Layer(first, x.label[arcs], x.weight[arcs], x.target[arcs])
            layers[d - 1].target = name[layers[d - 1].target]
        return Automaton(layers)

    def paths(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """By length: labels of all paths and the weight of their last arc."""
        out, labels, states = [], [], np.zeros(1, dtype=np.int64)
        for x in self.layers:
            owner, arcs = _expand(x.first, states)
            labels = [c[owner] for c in labels] + [x.label[arcs]]
            out.append((labels, x.weight[arcs]))
            states = x.target[arcs]
        return out

    def dump(self) -> bytes:
        def small(c: np.ndarray) -> np.ndarray:
            top = int(c.max()) if len(c) else 0
            return c.astype(np.min_scalar_type(top))

        return pickle.dumps([(small(np.diff(x.first)), x.label, small(x.weight), small(x.target)) for x in self.layers], protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        return cls(
            [
                Layer(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), label, weight.astype(np.int64), target.astype(np.int64))
                for size, label, weight, target in pickle.loads(data)
            ]
        )


def union(machines: list[Automaton]) -> Automaton:
    """All paths of all machines; the weights of equal paths are summed."""
    layers: list[Layer] = []
    depth = max(len(m.layers) for m in machines)
    # Which state of which machine stands behind each state of the union.
    ours = np.zeros(len(machines), dtype=np.int64)
    theirs = None
    n_sources = 1
    for d in range(depth):
        parts = [m.layers[d] if d < len(m.layers) else None for m in machines]
        n_states = np.array([0 if x is None else len(x.first) - 1 for x in parts])
        n_arcs = np.array([0 if x is None else len(x.label) for x in parts])
        if theirs is None:
            theirs = np.cumsum(n_states) - n_states
        some = [x for x in parts if x is not None]
        shift = (np.cumsum(n_arcs) - n_arcs)[[x is not None for x in parts]]
        first = np.concatenate([x.first[:-1] + s for x, s in zip(some, shift, strict=True)] + [[n_arcs.sum()]]).astype(np.int64)
        label = np.concatenate([x.label for x in some])
        weight = np.concatenate([x.weight for x in some])
        deeper = np.array([0 if d + 1 >= len(m.layers) else len(m.layers[d + 1].first) - 1 for m in machines])
        base = np.cumsum(deeper) - deeper
        target = np.concatenate(
            [np.full(len(x.label), -1) if d + 1 >= len(m.layers) else x.target + b for m, x, b in zip(machines, parts, base, strict=True) if x is not None]
        )
        owner, arcs = _expand(first, theirs)
        source, label, weight, target = ours[owner], label[arcs], weight[arcs], target[arcs]
        order = np.lexsort((label, source))
        source, label, weight, target = source[order], label[order], weight[order], target[order]
        new = _changes(source, label) if len(label) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        total = np.add.reduceat(weight, at) if len(at) else weight
        last = d == depth - 1
        layers.append(
            Layer(
                np.searchsorted(source[at], np.arange(n_sources + 1)), label[at], total,
                np.zeros(len(at), dtype=np.int64) if last else np.arange(len(at)),
            )
        )
        goes_on = target >= 0
        ours, theirs, n_sources = (np.cumsum(new) - 1)[goes_on], target[goes_on], max(len(at), 1)
    return Automaton(layers)


def compose(labels: list[np.ndarray], counts: Automaton) -> np.ndarray:
    """Weights of the sequences in ``counts``, walked together layer by layer; 0 where it has none.

    The sequences, of one length, are an acceptor of their own: those that share a prefix
    share the walk.
    """
    n = len(labels[0])
    if n == 0 or len(labels) > len(counts.layers):
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort(labels[::-1])
    new = np.zeros(n, dtype=bool)
    state, weight = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    source = np.zeros(n, dtype=np.int64)  # by sequence: its state in the acceptor
    for d, column in enumerate(labels):
        own = column[order]
        new = new | _changes(own)
        at = np.flatnonzero(new)
        x = counts.layers[d]
        names = np.unique(x.label)
        width = len(names) + 1
        found = np.searchsorted(names, own[at])
        known = found < len(names)
        known[known] = names[found[known]] == own[at][known]
        begin = state[source[at]]
        arc_source = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
        keys = arc_source * width + np.searchsorted(names, x.label)
        wanted = begin * width + found
        arc = np.searchsorted(keys, wanted)
        hit = known & (begin >= 0) & (arc < len(keys))
        hit[hit] = keys[arc[hit]] == wanted[hit]
        weight = np.where(hit, x.weight[np.where(hit, arc, 0)] if len(keys) else 0, 0)
        state = np.where(hit, x.target[np.where(hit, arc, 0)] if len(keys) else -1, -1)
        source = np.cumsum(new) - 1
    out = np.zeros(n, dtype=np.int64)
    out[order] = weight[source]
    return out
