"""Near duplicates by min-max hashing, banding and confirmation on full shingle sets.

Signatures: each of ``HASHES`` permutations of a text's shingle hashes gives two values,
its minimum and its maximum, so a signature of 160 values costs 80 evaluations per
shingle.  Minima and maxima go to different bands; 32 bands of five rows find a pair of
similarity 0.8 with all but 3 in a million.

Links: texts of equal shingle sets are one node.  In ``STAR_ROUNDS`` rounds each node
that shares a bucket with another component is compared with one centre, so a round
costs one comparison per node and most near copies find their component.  Buckets that
still hold several components are then compared in full: they are put together by their
largest component, and the nodes outside it ("few") meet all nodes of these buckets.
A task holds a block of few, at most ``BLOCK`` shingles and one text, as an inverted
index and streams the others past it; it emits only links that join components it has
not joined yet.  So no candidate pair that could join two components is left untested,
and a group of n near copies, even of mutually unlike ones, makes rows in proportion to
n as long as its few fit one block, and n times the number of blocks beyond.

Defined cases: a null or empty text, or white space only, has an empty set and no
links; a text shorter than a shingle is one shingle, its whole word sequence; rows of
equal id are one vertex with the links of all its rows; rows without an id link with
nothing and have a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh_name, join_checked, map_rows, stage_table, table
from tidewatch.llm.components import components
from tidewatch.llm.hashing import Ranges, mix, odd

HASHES = 80
ROWS = 5
BANDS = 2 * HASHES // ROWS
STAR_ROUNDS = 3
BLOCK = 1 << 20  # shingles of one block
SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
COMPARED = "a long, b long, linked boolean"

_MULTIPLY, _ADD, _FOLD = odd(HASHES), odd(HASHES), odd(64)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word; A-Z lower-cased, words parted by space and U+0009-000D."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[0::2], edges[1::2]
    return mix(Ranges(raw).of(start, stop) + (stop - start).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words."""
    own = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(own):
        return own
    width = min(words, len(own))
    out = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out += own[i : i + len(out)] * _FOLD[i]
    return np.unique(mix(out))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Band hashes of the min-max signature."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(HASHES, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        block = shingles[None, at : at + 1024] * _MULTIPLY[:, None]
        block += _ADD[:, None]
        np.minimum(low, block.min(axis=1), out=low)
        np.maximum(high, block.max(axis=1), out=high)
    values = np.concatenate([low, high]).reshape(BANDS, ROWS)
    return mix((values * _FOLD[:ROWS]).sum(axis=1, dtype=np.uint64) + _FOLD[ROWS + 1] * np.arange(BANDS, dtype=np.uint64))


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """Per row: set size, a 128-bit key of the set, and its band hashes (stored)."""

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = shingle_set(text, words)
                key = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype=np.int64)
                bands = band_keys(found).view(np.int64).tolist() if len(found) and doc is not None else []
                rows.append((doc, len(found), int(key[0]), int(key[1]), bands))
            yield rows

    return stage_table(map_rows(docs.select("doc_id", "text"), run, SKETCH))


def compare(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Whether the full shingle sets of each pair (a, b) reach the similarity (stored)."""
    pairs = stage_table(pairs)
    needed = stage_table(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = stage_table(join_checked(docs.select("doc_id", "text"), needed, ["doc_id"], "left_semi", row_bytes=16))
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        last, kept = None, None
        for batch in batches:
            rows = []
            for a, b, one, two in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if kept is None or two != last:
                    last, kept = two, shingle_set(two, words)
                own = shingle_set(one, words)
                both = len(np.intersect1d(own, kept, assume_unique=True))
                union = len(own) + len(kept) - both
                rows.append((a, b, bool(union) and 100 * both >= percent * union))
            yield rows

    return stage_table(map_rows(pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b"), run, COMPARED))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def links(nodes: DataFrame, tested: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of linked nodes; ``nodes``: (node, n, bands), one per distinct set.

    ``tested`` are pairs (a, b, linked) whose links are known.
    """
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = stage_table(
        banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    )
    members = stage_table(banded.join(shared, "bucket"))
    labels = components(tested.filter("linked").select("a", "b"))
    for turn in range(STAR_ROUNDS):
        members = _open_buckets(members, labels)
        if members.isEmpty():
            return labels
        # Every bucket names a centre; a node takes the first of those outside its component.
        order = F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.lit(0), "node")
        centers = members.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), order).alias("c"))
        met = members.join(centers, "bucket").filter(F.col("label") != F.col("c.label"))
        first = F.min(F.struct(F.xxhash64("c.node", F.lit(turn)) if turn else F.lit(0), F.col("c.node").alias("node")))
        star = met.groupBy("node").agg(first.alias("c")).select(F.col("node").alias("x"), F.col("c.node").alias("y"))
        pairs = _ordered(star).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = stage_table(tested.unionByName(compare(pairs, docs, words, percent)))
        labels = components(tested.filter("linked").select("a", "b"))
    members = _open_buckets(members, labels)
    if members.isEmpty():
        return labels
    found = _block_links(members, docs, words, percent)
    return components(tested.filter("linked").select("a", "b").unionByName(found))


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their ``label``, of the buckets that hold several components (stored)."""
    named = stage_table(_labelled(members.select("bucket", "node", "n"), labels, ["node"]).withColumnRenamed("label_node", "label"))
    spread = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return stage_table(named.join(stage_table(spread.filter("low < high").select("bucket")), "bucket"))


def _block_links(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components whose nodes share a bucket and are similar (stored)."""
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
    main = stage_table(sizes.groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("unit")))
    units = stage_table(members.join(main, "bucket").groupBy("unit", "node").agg(F.max("label").alias("label"), F.max("n").alias("n")))
    few = F.col("label") != F.col("unit")
    blocks = units.groupBy("unit").agg(
        F.ceil(F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(1)) / BLOCK).alias("few_blocks"),
        F.ceil(F.sum("n") / BLOCK).alias("all_blocks"),
    )
    rows = units.join(stage_table(blocks), "unit")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    held = rows.filter(few).select("unit", "node", "label", own("few_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(0).alias("side"))
    passing = rows.select("unit", "node", "label", every("few_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(1).alias("side"))
    needed = stage_table(units.select(F.col("node").alias("doc_id")).distinct())
    texts = stage_table(join_checked(docs.select(F.col("doc_id"), "text"), needed, ["doc_id"], "left_semi", row_bytes=16))
    both = held.unionByName(passing).join(texts.withColumnRenamed("doc_id", "node"), "node")
    keys = ["unit", "i", "j"]
    both = both.repartition(*keys).sortWithinPartitions(*keys, "side", "node").select(*keys, "side", "node", "label", "text")

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        key, block = None, None
        for batch in batches:
            found = []
            columns = (batch[c] for c in ("unit", "i", "j", "side", "node", "label", "text"))
            for unit, i, j, side, node, label, text in zip(*columns, strict=True):
                if (unit, i, j) != key:
                    key, block = (unit, i, j), _Block(percent)
                if side == 0:
                    block.add(node, label, shingle_set(text, words))
                else:
                    found.extend(block.links(node, label, shingle_set(text, words)))
            yield found

    return stage_table(map_rows(both, run, "a long, b long")).distinct()


class _Block:
    """Shingle sets as an inverted index, and the components joined through them."""

    def __init__(self, percent: int):
        self._percent, self._root = percent, {}
        self._nodes, self._labels, self._sets = [], [], []
        self._values = None

    def add(self, node: int, label: int, shingles: np.ndarray) -> None:
        self._nodes.append(node)
        self._labels.append(label)
        self._sets.append(shingles)

    def _index(self) -> None:
        self._sizes = np.array([len(s) for s in self._sets], dtype=np.int64)
        values = np.concatenate([*self._sets, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(values, kind="stable")
        self._owners = np.repeat(np.arange(len(self._sets)), self._sizes)[order]
        self._values, first = np.unique(values[order], return_index=True)
        self._ends = np.append(first, len(values))
        self._sets = []

    def _find(self, label: int) -> int:
        while (up := self._root.get(label, label)) != label:
            self._root[label] = label = self._root.get(up, up)
        return label

    def links(self, node: int, label: int, shingles: np.ndarray) -> Iterator[tuple]:
        """Links of a passing set with held ones of components not joined with it so far."""
        if self._values is None:
            self._index()
        if not len(self._values):
            return
        at = np.minimum(np.searchsorted(self._values, shingles), len(self._values) - 1)
        at = at[self._values[at] == shingles]
        start, count = self._ends[at], self._ends[at + 1] - self._ends[at]
        # All owner lists of the shared shingles, end to end.
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(at) else start
        owners = self._owners[np.arange(count.sum()) + shift]
        both = np.bincount(owners, minlength=len(self._sizes))
        for other in np.flatnonzero((both > 0) & (100 * both >= self._percent * (self._sizes + len(shingles) - both))).tolist():
            one, two = self._find(label), self._find(self._labels[other])
            if one != two:
                self._root[max(one, two)] = min(one, two)
                yield max(node, self._nodes[other]), min(node, self._nodes[other])


def _labelled(rows: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the component so far of each of the columns as ``label_<column>``."""
    for c in columns:
        named = labels.select(F.col("node").alias(c), F.col("component").alias(f"label_{c}"))
        rows = join_checked(rows, named, [c], "left", row_bytes=16).withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return rows


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = sketch(docs, words)
    filled = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    copies = stage_table(copies.select("k1", "k2", "rep"))
    named = join_checked(filled, copies, ["k1", "k2"], "left", row_bytes=32).withColumn("rep", F.coalesce("rep", "doc_id"))
    # An id whose rows have different sets ties their representatives together.
    tied = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    tied = join_checked(named.select("doc_id", "rep"), stage_table(tied.select("doc_id")), ["doc_id"], "left_semi", row_bytes=16)
    ties = stage_table(
        tied.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("linked")).distinct()
    )
    nodes = named.filter("rep = doc_id").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands")
    found = links(nodes, ties, docs, words, percent)
    # A row's links: to its set's representative, and from there to the component.
    joined = join_checked(
        join_checked(rows.drop("bands"), copies, ["k1", "k2"], "left", row_bytes=32).withColumn(
            "rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
        ),
        found.withColumnRenamed("node", "rep"),
        ["rep"],
        "left",
        row_bytes=16,
    )
    component = F.coalesce("component", "rep")
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays.

    Unlike texts of one id are documents of their own here: the text with the smallest
    hash goes by the id, the others by a hash of id and text above 2^62.  Of rows with
    equal id and text the smallest stays.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.min(text).alias("_first"))
    repeated = stage_table(repeated.filter("m > 1").select(F.col("doc_id").alias("_again"), "_first"))
    vertex = fresh_name(docs, "_vertex")
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(*docs.columns, F.col("doc_id").alias(vertex))
    if not repeated.isEmpty():
        same = F.col("doc_id") == F.col("_again")
        again = join_checked(docs, repeated, same, row_bytes=32)
        again = again.select(*[docs[c] for c in docs.columns], F.when(text == F.col("_first"), F.col("doc_id")).otherwise(own).alias(vertex))
        again = again.groupBy(vertex).agg(F.min(F.struct(*docs.columns)).alias("_row"))
        again = stage_table(again.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], vertex))
        rows = join_checked(rows, repeated, same, "left_anti", row_bytes=32).unionByName(again)
    verdicts = near_duplicates(rows.select(F.col(vertex).alias("doc_id"), "text"), words=5, percent=80)
    gone = stage_table(verdicts.filter("NOT kept").select(F.col("doc_id").alias(vertex)).distinct())
    return join_checked(rows, gone, [vertex], "left_anti", row_bytes=16).select(*docs.columns)


def op10_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
