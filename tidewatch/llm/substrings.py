"""Exact removal of repeated byte strings, by column-wise construction of suffix orders.

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere else.

1. Anchors.  Of the ``GRAM``-byte grams inside each ``SPAN``-byte window the one with the
   smallest hash (the rightmost of equals) is the window's anchor.  Equal windows have
   equal anchors at equal places, so every repeat shows as two occurrences of one
   anchor.  Anchors whose hash occurs once in the corpus are done.
2. Contexts.  An occurrence's context is what any window through it can reach: ``SIDE``
   bytes before and after the gram.  Contexts that are equal as a whole are one text with
   a count; a count of two settles all its windows.
3. Construction.  The distinct contexts of an anchor are the documents of a collection.
   From their right ends, one symbol per document each round is put in front of its
   suffix: the new order follows from sorting the column's Burrows-Wheeler transform by
   symbol (the rank step), the common prefixes of neighbours from minima over the last
   column's.  Transform and common prefixes are files, written column after column.  The
   gram is one symbol, that stands for its anchor and counts ``GRAM`` bytes.  Suffixes
   that share ``SPAN`` bytes with a neighbour begin repeated windows.
4. Spans of windows go back to all occurrences of the context, and to the documents.

An anchor with more than ``HOT`` distinct contexts is split by the place of the window:
windows that begin ``a`` bytes before the gram, for ranges of ``a`` that double, each
range keyed by the bytes all its windows share.  Equal pieces count as one again.  A key
with more than ``HOT`` distinct pieces has its range halved, at last to single places,
where the piece is the window itself: equal ones are counted, none is built.  So a key
brings at most ``HOT`` unlike pieces into a task.

Hashes are 64 bits; grams, contexts and pieces with equal hashes are taken as equal.

Defined cases: a null text is empty; texts under ``SPAN`` bytes lose nothing; repeated
rows are documents of their own, so each repeats the other; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_checked, map_rows, stage_table, table
from tidewatch.llm.hashing import Ranges, mix, odd
from tidewatch.session import ship_package

SPAN = 200
GRAM = 100
SIDE = SPAN - GRAM
HOT = 2_000
COLLECTION = 4_000  # contexts built together
SEGMENT = 1 << 20
_ORDER = np.uint64(SEGMENT * 2 - 1)
_FOLD = odd(8)
# Ranges of window places: one for an anchor with few contexts; for one with many they
# double away from either end.
WHOLE = ((0, SIDE),)
_NEAR = tuple((1 << i, min((2 << i) - 1, SIDE // 2)) for i in range(6))
RANGES = ((0, 0), *_NEAR, *[(max(SIDE - hi, SIDE // 2 + 1), SIDE - lo) for lo, hi in reversed(_NEAR)], (SIDE, SIDE))


def anchors(raw: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of a byte string."""
    grams = mix(ranges.every(GRAM))
    found = []
    for begin in range(0, len(raw) - SPAN + 1, SEGMENT):
        part = grams[begin : begin + SEGMENT + SIDE]
        key = (part & ~_ORDER) | (_ORDER - np.arange(len(part), dtype=np.uint64))
        width = 1
        while 2 * width <= SIDE + 1:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = SIDE + 1 - width
        key = np.minimum(key[: len(key) - rest], key[rest:])
        found.append(np.unique((_ORDER - (key & _ORDER)).astype(np.int64)) + begin)
    places = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    return places, grams[places]


def contexts(places: np.ndarray, size: int, ranges: Ranges) -> np.ndarray:
    """A hash of each anchor's context."""
    left, right = np.maximum(places - SIDE, 0), np.minimum(places + GRAM + SIDE, size)
    return mix(
        ranges.of(left, places) * _FOLD[0] + (places - left).astype(np.uint64) * _FOLD[1]
        + ranges.of(places + GRAM, right) * _FOLD[2] + (right - places).astype(np.uint64) * _FOLD[3]
    )


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _emitted(docs: DataFrame, whole: bool) -> DataFrame:
    """Anchors of every text: their hashes, and if ``whole`` context, row and place."""
    names = ("gram", "ctx", "doc_id", "part", "place") if whole else ("gram",)
    types = {"gram": pa.int64(), "ctx": pa.int64(), "doc_id": pa.int64(), "part": pa.int64(), "place": pa.int32()}

    def batch_of(columns: dict[str, list[np.ndarray]], owners: list, counts: list[int]) -> pa.RecordBatch:
        arrays = []
        for name in names:
            if name == "doc_id":
                values = pa.array(owners, types[name]).take(pa.array(np.repeat(np.arange(len(owners)), counts)))
            else:
                values = pa.array(np.concatenate(columns[name]), types[name])
            arrays.append(values)
        return pa.RecordBatch.from_arrays(arrays, names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list[np.ndarray]] = {n: [] for n in names}
            owners, counts = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = _raw(text)
                if len(data) < SPAN:
                    continue
                raw = np.frombuffer(data, dtype=np.uint8)
                ranges = Ranges(raw)
                places, grams = anchors(raw, ranges)
                columns["gram"].append(grams.view(np.int64))
                if whole:
                    columns["ctx"].append(contexts(places, len(raw), ranges).view(np.int64))
                    columns["part"].append(np.full(len(places), zlib.crc32(data)))
                    columns["place"].append(places)
                owners.append(doc)
                counts.append(len(places))
                if sum(counts) > 200_000:
                    yield batch_of(columns, owners, counts)
                    columns, owners, counts = {n: [] for n in names}, [], []
            if owners:
                yield batch_of(columns, owners, counts)

    ship_package(docs.sparkSession)
    schema = "gram long, ctx long, doc_id long, part long, place int" if whole else "gram long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Collection:
    """Contexts as a collection whose suffixes grow by a column each round.

    ``lefts`` and ``rights`` are byte strings on either side of the gram, ``group`` the
    number of the anchor each context belongs to.  The files hold, column after column,
    the transform (the symbol in front of each suffix, in suffix order) and the common
    prefixes of neighbours.  Documents are aligned at the gram, so suffixes of other
    columns cannot lie between two that share ``SPAN`` bytes: a round reads the last
    column and appends the next, and costs one step per document.
    """

    def __init__(self, lefts: list[bytes], rights: list[bytes], group: np.ndarray, folder: str):
        self.m = len(lefts)
        self.group = group
        self.rights, self.right_size = _columns([r[::-1] for r in rights])
        self.lefts, self.left_size = _columns([x[::-1] for x in lefts])
        self._files = [os.path.join(folder, name) for name in ("transform", "prefixes")]
        self.order = np.arange(self.m)  # documents in the order of their last suffixes
        self._append(np.full(self.m, -1, dtype=np.int16), np.zeros(self.m, dtype=np.int16))

    def _append(self, transform: np.ndarray, prefixes: np.ndarray) -> None:
        for path, column in zip(self._files, (transform, prefixes), strict=True):
            with open(path, "ab") as out:
                column.tofile(out)

    def _last(self, path: str) -> np.ndarray:
        with open(path, "rb") as column:
            column.seek(-2 * self.m, os.SEEK_END)
            return np.fromfile(column, dtype=np.int16)

    def insert(self, symbols: np.ndarray, weight: int) -> np.ndarray:
        """Put a symbol in front of each document's last suffix (-1: none, at its end).

        Returns, per document, the longest prefix its new suffix has in common with a
        neighbour.
        """
        prefixes = self._last(self._files[1])
        transform = symbols[self.order]
        ranks = np.argsort(transform, kind="stable")  # the rank step: by symbol, then by suffix
        ordered = transform[ranks]
        grown = np.zeros(self.m, dtype=np.int16)
        same = np.flatnonzero((ordered[1:] == ordered[:-1]) & (ordered[1:] >= 0)) + 1
        grown[same] = weight + _minima(prefixes, ranks[same - 1] + 1, ranks[same] + 1)
        self.order = self.order[ranks]
        self._append(transform, grown)
        longest = np.empty(self.m, dtype=np.int16)
        longest[self.order] = np.maximum(grown, np.append(grown[1:], np.int16(0)))
        return longest

    def build(self) -> np.ndarray:
        """Per context, whether the window that begins ``a`` bytes before the gram repeats."""
        width = self.rights.shape[1]
        for column in range(width):
            # Right parts end together at the gram: shorter ones begin in later rounds.
            step = column - (width - self.right_size)
            self.insert(np.where(step >= 0, self.rights[np.arange(self.m), step], np.int16(-1)), 1)
        repeated = np.zeros((self.m, SIDE + 1), dtype=bool)
        repeated[:, 0] = self.insert(self.group.astype(np.int16), GRAM) >= SPAN
        for column in range(self.lefts.shape[1]):
            live = self.left_size > column
            repeated[:, column + 1] = (self.insert(np.where(live, self.lefts[:, column], np.int16(-1)), 1) >= SPAN) & live
        return repeated


def _columns(reversed_parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in reversed_parts])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int16)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(reversed_parts), dtype=np.uint8)
    return out, sizes


def _minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:stop]`` for each pair; no range is empty."""
    if not len(start):
        return values[:0]
    order = np.argsort(start, kind="stable")
    bounds = np.stack([start[order], stop[order]], axis=1).ravel()
    padded = np.append(values, values[-1:])
    out = np.empty(len(start), dtype=values.dtype)
    out[order] = np.minimum.reduceat(padded, bounds)[::2]
    return out


def pieces(data: bytes, place: int, ranges: tuple) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(lo, hi, shared core, left, right) of a context per range of window places."""
    yield from parted(data[max(0, place - SIDE) : place], data[place + GRAM : place + GRAM + SIDE], ranges)


def parted(left: bytes, right: bytes, ranges: tuple) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """The same from what lies on either side of the gram."""
    for lo, hi in ranges:
        if lo > len(left) or SIDE - hi > len(right):
            continue
        near, far = left[len(left) - lo :], right[: SIDE - hi]
        yield lo, hi, near + b"\0" + far, left[max(0, len(left) - hi) :], right[: SIDE - lo]


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _key(gram: int, lo: int, core: bytes) -> int:
    return _hash(gram.to_bytes(8, "little", signed=True) + bytes([lo]) + core)


def _body(near: bytes, far: bytes) -> int:
    return _hash(near + b"\0" + far + len(near).to_bytes(2, "little"))


PIECE = "gram long, ctx long, lo int, hi int, key long, body long, near binary, far binary"


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pieces of the wanted contexts (gram, ctx, doc_id, part, place, hot), from one occurrence each."""
    per_doc = wanted.groupBy("doc_id", "part").agg(F.collect_list(F.struct("gram", "ctx", "place", "hot")).alias("wanted"))
    per_doc = stage_table(per_doc)  # a document's own anchors, at most one per byte
    ids = stage_table(per_doc.select("doc_id").distinct())
    names, ids = per_doc.withColumnRenamed("doc_id", "_doc"), ids.withColumnRenamed("doc_id", "_doc")
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    # Only texts that are asked for are shuffled.
    texts = join_checked(docs.select("doc_id", "text"), ids, same, "left_semi", row_bytes=16)
    keyed = texts.withColumn("_part", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = keyed.join(names, same & (F.col("_part") == F.col("part")))

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                data = _raw(text)
                for w in wanted:
                    for lo, hi, core, near, far in pieces(data, w["place"], RANGES if w["hot"] else WHOLE):
                        key = _key(w["gram"], lo, core) if w["hot"] else w["gram"]
                        rows.append((w["gram"], w["ctx"], lo, hi, key, _body(near, far), near, far))
                if len(rows) > 20_000:
                    yield rows
                    rows = []
            yield rows

    return stage_table(map_rows(joined.select("text", "wanted"), run, PIECE))


def _split(parts: DataFrame) -> DataFrame:
    """``parts`` with the range of every key of more than ``HOT`` distinct pieces halved, as often as it takes."""

    def halves(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows: list[tuple] = []
            for gram, ctx, lo, hi, near, far in zip(*(batch[c] for c in ("gram", "ctx", "lo", "hi", "near", "far")), strict=True):
                middle = (lo + hi) // 2
                for a, b, core, left, right in parted(near, far, ((lo, middle), (middle + 1, hi))):
                    rows.append((gram, ctx, a, b, _key(gram, a, core), _body(left, right), left, right))
            yield rows

    done = []
    while True:
        # Undivided anchors have few contexts; a single place has one piece a key.
        wide = parts.filter((F.col("lo") < F.col("hi")) & (F.col("hi") - F.col("lo") < SIDE))
        unlike = wide.groupBy("key", "body").agg(F.count(F.lit(1))).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        large = stage_table(unlike.filter(F.col("m") > HOT).select("key"))
        if large.isEmpty():
            break
        done.append(join_checked(parts, large, ["key"], "left_anti", row_bytes=16))
        again = join_checked(parts, large, ["key"], "left_semi", row_bytes=16)
        parts = stage_table(map_rows(again.select("gram", "ctx", "lo", "hi", "near", "far"), halves, PIECE))
    for rows in done:
        parts = parts.unionByName(rows)
    return parts


def _built(parts: DataFrame) -> DataFrame:
    """(key, body, runs) for each distinct piece: window places that repeat."""
    distinct = parts.groupBy("key", "body").agg(F.min("near").alias("near"), F.min("far").alias("far"))
    ordered = distinct.repartition("key").sortWithinPartitions("key", "body")

    def solve(rows: list[tuple]) -> list[tuple]:
        group = np.unique([r[0] for r in rows], return_inverse=True)[1]
        with tempfile.TemporaryDirectory() as folder:
            repeated = Collection([r[2] for r in rows], [r[3] for r in rows], group, folder).build()
        out = []
        for (key, body, _, _), flags in zip(rows, repeated, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            if len(edges):
                out.append((key, body, [{"lo": int(a), "hi": int(b) - 1} for a, b in edges.reshape(-1, 2)]))
        return out

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(batch["key"], batch["body"], batch["near"], batch["far"], strict=True):
                # Collections are whole keys; a key's rows follow each other.
                if len(waiting) >= COLLECTION and row[0] != waiting[-1][0]:
                    yield solve(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield solve(waiting)

    return stage_table(map_rows(ordered, run, "key long, body long, runs array<struct<lo:int,hi:int>>"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, part, spans) of rows with repeated strings; ``part`` is the text's CRC-32 (stored)."""
    again = stage_table(_emitted(docs, False).groupBy("gram").count().filter("count > 1").select("gram"))
    hits = stage_table(_emitted(docs, True).join(again, "gram", "left_semi"))
    pick = F.xxhash64("doc_id", "part", "place")
    distinct = stage_table(
        hits.groupBy("gram", "ctx").agg(
            F.count(F.lit(1)).alias("n"), *[F.min_by(c, pick).alias(c) for c in ("doc_id", "part", "place")]
        )
    )
    counts = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    mixed = stage_table(counts.select("gram", (F.col("m") > HOT).alias("hot")))
    parts = _split(_fetched(docs, distinct.join(mixed, "gram")))
    built = _built(parts.filter("lo < hi"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(SIDE).alias("hi")))
    alone = distinct.filter("n > 1").select("gram", "ctx", whole.alias("runs"))
    # Pieces that several contexts share repeat as a whole.
    shared = stage_table(parts.groupBy("key", "body").count().filter("count > 1").select("key", "body"))
    full = parts.join(shared, ["key", "body"]).select("gram", "ctx", F.array(F.struct("lo", "hi")).alias("runs"))
    found = parts.join(built, ["key", "body"]).select(
        "gram", "ctx",
        F.filter(
            F.transform("runs", lambda r: F.struct(F.greatest(r["lo"], F.col("lo")).alias("lo"), F.least(r["hi"], F.col("hi")).alias("hi"))),
            lambda r: r["lo"] <= r["hi"],
        ).alias("runs"),
    )
    marks = stage_table(alone.unionByName(full).unionByName(found).select("gram", "ctx", F.explode("runs").alias("run")))
    marks = stage_table(marks.distinct())
    spans = hits.join(marks, ["gram", "ctx"]).select(
        "doc_id", "part", F.greatest(F.col("place") - F.col("run.hi"), F.lit(0)).alias("start"),
        (F.col("place") - F.col("run.lo") + SPAN).alias("stop"),
    )
    return stage_table(spans.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: spans taken out and the bytes left."""
    spans = repeated_spans(docs).withColumnsRenamed({"doc_id": "_doc", "part": "_of"})
    keyed = docs.select("doc_id", "text").withColumn("_part", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_part") == F.col("_of"))
    joined = join_checked(keyed, spans, on, "left", row_bytes=F.size("spans") * 24)

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows, held = [], 0
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data = _raw(text)
                removed = merged([(s["start"], min(s["stop"], len(data))) for s in found or []])
                parts, at = [], 0
                for start, stop in removed:
                    parts.append(data[at:start])
                    at = stop
                kept = b"".join([*parts, data[at:]])
                rows.append((doc, len(data), [{"start": a, "stop": b} for a, b in removed], kept))
                held += len(kept)
                if held > 8 << 20:
                    yield rows
                    rows, held = [], 0
            yield rows

    schema = "doc_id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary"
    return map_rows(joined.select("doc_id", "text", "spans"), run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if start >= stop:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def op5_substrings(spark, sf_dir) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
