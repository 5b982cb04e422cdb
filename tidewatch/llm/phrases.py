"""Phrase collocations from count transducers (weighted acyclic automata).

A phrase of up to four words is scored by how often it occurs against its parts, cut where
the score is lowest.  All counts are exact, over all texts.

1. Words are counted per language: a table of (language, label, word, count).  A label is a
   64-bit hash of language and word, the symbol of the automata; equal labels are taken as
   equal words.
2. Phrases are counted length by length.  Only a phrase whose two parts without its last and
   first word are frequent can be; a bitmap of the frequent ones, of at most
   ``FILTER_BITS`` bits, tells which places to count (a wrong yes costs work, no result).
   Each task sorts the n-grams of ``BLOCK`` words, builds a transducer from them, range of
   prefixes by range, and closes it from the ends (states with equal arcs are one).
3. Per range of prefixes (the first two words) the shards' transducers are united with
   their weights summed, some ``UNITE`` arcs at a time, and pruned to frequent paths.
4. Parts of phrases are looked up by composition: in each range the parts asked for form an
   acceptor that is walked together with the range's transducer.  Single words come from
   the table of words.
5. Scores, containment in longer phrases and the first ``top`` of each language are native
   joins and windows; the last one in two steps, so that no task holds a language.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows
count again, ids play no part; ties are ordered by count, then phrase; an empty table gives
an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.automata import Automaton, compose, summed, union
from tidewatch.llm.common import join_checked, stage_table, table
from tidewatch.llm.hashing import Ranges, mix, odd
from tidewatch.session import ship_package

MIN_COUNT = 30
MAX_WORDS = 4
CONTAINED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
BLOCK = 1 << 21  # words worked on together
UNITE = 1 << 22  # arcs united together
RANGE_WORDS = 1 << 21  # words of the corpus per range of prefixes
MIN_RANGES = 64
FILTER_BITS = 1 << 27
BITS_PER_KEY = 32

_FOLD, _SIZE, _LANG = odd(MAX_WORDS), odd(1), odd(1)
_INSIDE, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LABELS = [f"l{i + 1}" for i in range(MAX_WORDS)]


def words_of(text: str | None, lang: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, stops, pieces, labels) of a text's words, A-Z lower-cased."""
    data = (text or "").encode("utf-8", "replace").lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind == _INSIDE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[0::2], edges[1::2]
    if not len(start):
        return data, start, stop, start, np.zeros(0, dtype=np.uint64)
    pieces = np.cumsum(kind == _BREAK)[start]
    seed = np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), dtype=np.uint64)
    labels = mix(Ranges(raw).of(start, stop) + (stop - start).astype(np.uint64) * _SIZE + seed * _LANG)
    return data, start, stop, pieces, labels


def _keys(labels: list[np.ndarray]) -> np.ndarray:
    """A hash of each label sequence; of one label, the label."""
    if len(labels) == 1:
        return labels[0]
    total = np.zeros(len(labels[0]), dtype=np.uint64)
    for i, column in enumerate(labels):
        total += column * _FOLD[i]
    return mix(total)


def _ranges(labels: list[np.ndarray], bits: int) -> np.ndarray:
    """The range of prefixes a phrase of two words or more belongs to."""
    return (_keys(labels[:2]) >> np.uint64(64 - bits)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, label, word, n) of all words (stored)."""

    def rows(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        names, labels, words, counts = [], [], [], []
        by_lang: dict[str, list[tuple]] = {}
        for item in waiting:
            by_lang.setdefault(item[0], []).append(item[1])
        for lang, items in by_lang.items():
            sizes = np.array([len(x[4]) for x in items])
            ends = np.cumsum(sizes)
            found, at, n = np.unique(np.concatenate([x[4] for x in items]), return_index=True, return_counts=True)
            owner = np.searchsorted(ends, at, side="right")
            for doc, place in zip(owner.tolist(), (at - (ends - sizes)[owner]).tolist(), strict=True):
                data, start, stop, _, _ = items[doc]
                words.append(data[start[place] : stop[place]])
            names.extend([lang] * len(found))
            labels.append(found.view(np.int64))
            counts.append(n)
        if names:
            columns = [pa.array(names), pa.array(np.concatenate(labels)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "label", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                item = words_of(text, lang)
                if len(item[4]):
                    waiting.append((lang, item))
                    size += len(item[4])
                if size >= BLOCK:
                    yield from rows(waiting)
                    waiting, size = [], 0
        yield from rows(waiting)

    counted = docs.mapInArrow(run, "lang string, label long, word string, n long")
    return stage_table(counted.groupBy("lang", "label", "word").agg(F.sum("n").alias("n")))


def frequent_bits(spark: SparkSession, frequent: DataFrame) -> Broadcast:
    """A bitmap of the keys of a stored table, of a bounded size, for all tasks."""
    size = 1 << 16
    wanted = frequent.count() * BITS_PER_KEY
    while size < wanted and size < FILTER_BITS:
        size *= 2
    place = F.col("key").bitwiseAND(F.lit(size - 1))
    cells = frequent.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(key & {size - 1} & 63 AS INT))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, dtype=np.uint64)
    if found.num_rows:
        bits[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shard_transducers(docs: DataFrame, n: int, frequent: Broadcast, range_bits: int) -> DataFrame:
    """(range, machine): transducers of the ``n``-grams of each block of words, cut by range."""

    def machines(labels: np.ndarray, pieces: np.ndarray) -> Iterator[tuple[int, bytes]]:
        m = len(labels) - n + 1
        if m < 1:
            return
        # Parts of n - 1 words that are frequent, by place; both parts of an n-gram must be.
        part = _marked(frequent.value, _keys([labels[i : len(labels) - n + 2 + i] for i in range(n - 1)]))
        places = np.flatnonzero((pieces[:m] == pieces[n - 1 :]) & part[:m] & part[1:])
        if not len(places):
            return
        grams = [labels[places + i] for i in range(n)]
        grams, counts, lead = summed(grams, np.ones(len(places), dtype=np.int64), _ranges(grams, range_bits))
        cuts = np.flatnonzero(np.diff(lead)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lead)], strict=True):
            yield int(lead[begin]), Automaton.build([g[begin:end] for g in grams], counts[begin:end]).closed().dump()

    def flush(labels: list, pieces: list) -> Iterator[pa.RecordBatch]:
        if not labels:
            return
        sizes = [int(p[-1]) + 2 for p in pieces]
        shift = np.cumsum(sizes) - sizes
        numbers = np.concatenate([p + s for p, s in zip(pieces, shift, strict=True)])
        ranges, blobs, size = [], [], 0
        for where, blob in machines(np.concatenate(labels), numbers):
            ranges.append(where)
            blobs.append(blob)
            size += len(blob)
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "machine"])
                ranges, blobs, size = [], [], 0
        if ranges:
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "machine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, pieces, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                *_, piece, own = words_of(text, lang)
                if len(own) >= n:
                    labels.append(own)
                    pieces.append(piece)
                    size += len(own)
                if size >= BLOCK:
                    yield from flush(labels, pieces)
                    labels, pieces, size = [], [], 0
        yield from flush(labels, pieces)

    return docs.mapInArrow(run, "range long, machine binary")


def united(shards: DataFrame, n: int, min_count: int) -> DataFrame:
    """(range, n, l1 ..., key, count) of the paths of all shards that are frequent (stored)."""
    names = [*_LABELS, "key", "count"]

    def rows(where: int, machine: Automaton | None) -> Iterator[pa.RecordBatch]:
        if machine is None:
            return
        labels, weight = machine.paths()[n - 1]
        keep = weight >= min_count
        labels = [c[keep] for c in labels]
        if not keep.any():
            return
        size = len(labels[0])
        padded = [*[c.view(np.int64) for c in labels], *[np.zeros(size, dtype=np.int64)] * (MAX_WORDS - n)]
        columns = [np.full(size, where), np.full(size, n), *padded, _keys(labels).view(np.int64), weight[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["range", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, total, waiting, arcs = None, None, [], 0
        for batch in batches:
            for own, blob in zip(batch["range"].to_pylist(), batch["machine"], strict=True):
                if own != where:
                    yield from rows(where, union(waiting) if waiting else total)
                    where, total, waiting, arcs = own, None, [], 0
                machine = Automaton.load(blob.as_py())
                waiting.append(machine)
                arcs += machine.arcs
                if arcs > UNITE:
                    total = union(waiting)
                    # The sum so far counts as little, or it would be united with every shard.
                    waiting, arcs = [total], 0
        yield from rows(where, union(waiting) if waiting else total)

    schema = ", ".join(f"{c} long" for c in ("range", "n", *names))
    return stage_table(shards.repartition("range").sortWithinPartitions("range").mapInArrow(run, schema))


def look_up(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """(p1 ..., cut, side, f): the counts of parts (range, p1 ..., cut, side, m, l1 ...) of ``m`` words."""
    named = [f"p{i + 1}" for i in range(MAX_WORDS)]
    schema = ", ".join(f"{c} long" for c in (*named, "cut", "side", "f"))

    def column(rows: pa.Table, name: str) -> np.ndarray:
        return rows[name].combine_chunks().to_numpy(zero_copy_only=False)

    def run(frequent: pa.Table, asked: pa.Table) -> pa.Table:
        machines, lengths = [], column(frequent, "n")
        for n in np.unique(lengths).tolist():
            own = lengths == n
            labels = [column(frequent, c)[own].view(np.uint64) for c in _LABELS[:n]]
            labels, weights, _ = summed(labels, column(frequent, "count")[own])
            machines.append(Automaton.build(labels, weights))
        sizes = column(asked, "m")
        found = np.zeros(len(sizes), dtype=np.int64)
        if machines:
            whole = union(machines).closed()
            for m in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == m)
                found[own] = compose([column(asked, c)[own].view(np.uint64) for c in _LABELS[:m]], whole)
        return pa.Table.from_arrays([*[asked[c] for c in (*named, "cut", "side")], pa.array(found)], names=[*named, "cut", "side", "f"])

    return counts.groupBy("range").cogroup(parts.groupBy("range")).applyInArrow(run, schema)


def _range_column(first: str, second: str, bits: int) -> Column:
    """As ``_ranges``, on two label columns."""

    @F.arrow_udf("long")
    def number(a: pa.Array, b: pa.Array) -> pa.Array:
        labels = [x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)]
        return pa.array(_ranges(labels, bits), pa.int64())

    return number(F.col(first), F.col(second))


def _parts(candidates: DataFrame, bits: int) -> DataFrame:
    """Each part of two words or more of each candidate: first parts are side 0, rests side 1."""
    zero = F.lit(0).cast("long")
    wanted = []
    for n in range(3, MAX_WORDS + 1):
        for cut in range(1, n):
            for side, at, m in ((0, 0, cut), (1, cut, n - cut)):
                if m < 2:
                    continue
                own = [F.col(f"p{at + i + 1}").alias(f"l{i + 1}") if i < m else zero.alias(f"l{i + 1}") for i in range(MAX_WORDS)]
                numbers = [F.lit(v).cast("long").alias(c) for c, v in (("cut", cut), ("side", side), ("m", m), ("n", n))]
                wanted.append(F.struct(*numbers, *own))
    rows = candidates.select(*[f"p{i + 1}" for i in range(MAX_WORDS)], "n", F.explode(F.array(*wanted)).alias("part"))
    rows = rows.filter("part.n = n").select(*[f"p{i + 1}" for i in range(MAX_WORDS)], "part.cut", "part.side", "part.m", *[f"part.{c}" for c in _LABELS])
    return rows.withColumn("range", _range_column("l1", "l2", bits))


def _contained(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates without those that a longer one holds nearly as often."""
    named = [f"p{i + 1}" for i in range(MAX_WORDS)]
    zero = F.lit(0).cast("long")
    inner = []
    for m in range(2, MAX_WORDS):
        for at in range(MAX_WORDS - m + 1):
            own = [F.col(f"p{at + i + 1}").alias(f"q{i + 1}") if i < m else zero.alias(f"q{i + 1}") for i in range(MAX_WORDS)]
            fits = (F.col("n") > m) & (F.col("n") >= at + m)
            inner.append(F.when(fits, F.struct(*own)))
    longer = candidates.filter("n > 2").select("a", F.explode(F.array_compact(F.array(*inner))).alias("q"))
    best = longer.groupBy("q").agg(F.max("a").alias("longest"))
    best = stage_table(best.select(*[F.col(f"q.q{i + 1}").alias(f"p{i + 1}") for i in range(MAX_WORDS)], "longest"))
    joined = join_checked(candidates, best, named, "left", row_bytes=64)
    return joined.filter(f"longest IS NULL OR 100 * longest < {percent} * a").drop("longest")


def _scored(n: int) -> Column:
    """The lowest score of a phrase of ``n`` words over its cuts: (score, cut, l, r)."""
    cuts = []
    for k in range(1, n):
        left = "c1" if k == 1 else f"f{k}_0"
        right = f"c{n}" if k == n - 1 else f"f{k}_1"
        score = F.expr(f"cast(cast(a AS decimal(38, 0)) * {SCALE} div ({left} + {right}) AS long)")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, percent: int = CONTAINED_PERCENT, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = count_words(texts)
    totals = stage_table(words.groupBy("lang").agg(F.sum("n").alias("n_words")))
    size = totals.agg(F.sum("n_words")).first()[0] or 0
    bits = max(MIN_RANGES, -(-size // RANGE_WORDS)).bit_length()
    known = stage_table(words.filter(F.col("n") >= min_count).select("lang", "label", "word", F.col("n").alias("c"), F.col("label").alias("key")))
    levels, frequent = [], known
    for n in range(2, MAX_WORDS + 1):
        filled = frequent_bits(spark, frequent)
        frequent = united(shard_transducers(texts, n, filled, bits), n, min_count)
        filled.unpersist()
        levels.append(frequent)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    named = [f"p{i + 1}" for i in range(MAX_WORDS)]
    candidates = counts.select(*[F.col(c).alias(p) for c, p in zip(_LABELS, named, strict=True)], "n", F.col("count").alias("a"))
    looked = look_up(counts.select("range", "n", *_LABELS, "count"), _parts(candidates, bits))
    columns = [(k, side) for k in range(1, MAX_WORDS) for side in (0, 1)]
    pivot = looked.groupBy(*named).agg(
        *[F.max(F.when((F.col("cut") == k) & (F.col("side") == s), F.col("f"))).alias(f"f{k}_{s}") for k, s in columns]
    )
    pivot = stage_table(pivot)
    rows = _contained(candidates, percent)
    rows = join_checked(rows, pivot, named, "left", row_bytes=128)
    for i in range(MAX_WORDS):
        own = [F.col("label").alias(f"p{i + 1}"), F.col("word").alias(f"w{i + 1}"), F.col("c").alias(f"c{i + 1}")]
        lang = ["lang"] if i == 0 else []
        rows = join_checked(rows, known.select(*own, *lang), [f"p{i + 1}"], "left", row_bytes=F.length(f"w{i + 1}") + 64)
    best = F.coalesce(*[F.when(F.col("n") == n, _scored(n)) for n in range(2, MAX_WORDS + 1)])
    rows = rows.select("lang", F.concat_ws(" ", *[f"w{i + 1}" for i in range(MAX_WORDS)]).alias("phrase"), "a", best.alias("best"))
    rows = stage_table(rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A part of a language keeps what can be among its first; few are left to number.
    salted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    named_totals = totals.select("lang", F.col("n_words").alias("n"))
    return join_checked(ranked.drop("part"), named_totals, ["lang"], row_bytes=64).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op11_phrases(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
