"""Runs (periodic stretches of words) from Lyndon arrays by Baier grouping.

A run is a maximal stretch with a smallest period that fits into it at least
``min_exponent`` times.  Every run holds a Lyndon word of the length of its period under
the order of words or under the reverse order, so it is found in two steps.

1. Grouping, phase one of a suffix sorter: places are grouped by word.  From the highest
   group down, each place of the group at hand has the nearest place to its left that is
   not done and in a lower group; such a left neighbour's Lyndon word grows by the
   group's, and it moves to a new group just above its old one (the higher, the more
   members of the group point at it).  When a group's turn comes, the common word of its
   members is the longest Lyndon word that begins there: the Lyndon array, under either
   order, without a suffix array.
2. Extension: a Lyndon root is a candidate if the stretch after it repeats as often as a
   run of ``min_exponent`` demands of its first root.  Its longest common extensions to
   the right and to the left, by comparing words, give the run; a root inside a run
   already found with its period is the same run.

Both take time linear in the text but for sorting its distinct words.  A text is worked on
by itself, whole, in one task: memory is in proportion to the longest text.

Defined cases: a null, empty or blank text has no words and no runs, its collapsed text is
empty; rows are independent, so repeated rows and null ids get their own equal results; an
empty table gives an empty result; further columns pass through, but for columns named
like a result, whatever the case, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidewatch.llm.common import fresh_name, table
from tidewatch.session import ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 6
MIN_EXPONENT = 4
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_array(ranks: list[int], n_ranks: int) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; ranks are 0 to n_ranks - 1."""
    n = len(ranks)
    out = [1] * n
    # The places not done yet, as a linked list; one spare cell beyond either end.
    left, right = [*range(-1, n - 1), -1], [*range(1, n + 1), 0]
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(n_ranks)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    alive = [len(m) for m in members]
    length = [1] * n_ranks
    below, above = list(range(-1, n_ranks - 1)), [*range(1, n_ranks), -1]

    def open_group(old: int, by: int) -> int:
        """A new empty group just above ``old``, for its word and ``by`` more words."""
        new, higher = len(members), above[old]
        members.append([])
        alive.append(0)
        length.append(length[old] + by)
        below.append(old)
        above.append(higher)
        above[old] = below[higher] = new
        return new

    def move_all(pointed: list[int], by: int) -> None:
        """Each of the places, all pointed at equally often, has its word grow by ``by``."""
        made: dict[int, int] = {}
        for place in pointed:
            old = group[place]
            new = made.get(old)
            if new is None:
                if alive[old] == 1:
                    length[old] += by
                    continue
                new = made[old] = open_group(old, by)
            alive[old] -= 1
            alive[new] += 1
            group[place] = new
            members[new].append(place)

    current = n_ranks - 1
    while current >= 0:
        if alive[current]:
            size = length[current]
            pointed: list[int] = []
            for place in members[current]:
                if group[place] != current:
                    continue
                out[place] = size
                before, after = left[place], right[place]
                left[after] = before
                right[before] = after
                pointed.append(before)
            if len(pointed) == 1:
                place = pointed[0]
                if place >= 0:
                    old = group[place]
                    if alive[old] == 1:
                        length[old] += size
                    else:
                        new = open_group(old, size)
                        alive[old] -= 1
                        alive[new] = 1
                        group[place] = new
                        members[new].append(place)
            else:
                counts: dict[int, list[int]] = {}
                for place, times in Counter(pointed).items():
                    if place >= 0:
                        counts.setdefault(times, []).append(place)
                # The more of the group point at a place, the higher it gets.
                for times in sorted(counts, reverse=True):
                    move_all(counts[times], times * size)
        current = below[current]
    return out


def common_right(ids: np.ndarray, a: int, b: int) -> int:
    """Length of the longest common stretch that begins at ``a`` and at ``b > a``."""
    n, done, step = len(ids), 0, 16
    while b + done < n:
        size = min(step, n - b - done)
        unlike = ids[a + done : a + done + size] != ids[b + done : b + done + size]
        first = int(unlike.argmax())
        if unlike[first]:
            return done + first
        done += size
        step *= 2
    return done


def common_left(ids: np.ndarray, a: int, b: int) -> int:
    """Length of the longest common stretch that ends before ``a`` and before ``b > a``."""
    done, step = 0, 16
    while done < a:
        size = min(step, a - done)
        unlike = (ids[a - done - size : a - done] != ids[b - done - size : b - done])[::-1]
        first = int(unlike.argmax())
        if unlike[first]:
            return done + first
        done += size
        step *= 2
    return done


def find_runs(words: list[str], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    if len(words) < max(min_length, min_exponent):
        return []
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    ranks = [order[w] for w in words]
    ids, top = np.array(ranks, dtype=np.int64), len(order) - 1
    found: set[tuple[int, int, int]] = set()
    for own in (ranks, [top - r for r in ranks]):
        roots = np.array(lyndon_array(own, top + 1), dtype=np.int64)
        found.update(_extended(ids, roots, min_length, min_exponent))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _extended(ids: np.ndarray, roots: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """The runs that the Lyndon roots ``roots`` (by place) extend to."""
    n = len(ids)
    # A run's first root begins within its first period: what follows repeats so long.
    ahead = (min_exponent - 2) * roots
    places = np.flatnonzero(np.arange(n) + roots + np.maximum(ahead, 1) <= n) if min_exponent > 2 else np.arange(n)
    for offset in ("first", "last") if min_exponent > 2 else ():
        at = places if offset == "first" else places + ahead[places] - 1
        places = places[ids[at] == ids[at + roots[places]]]
    ends: dict[int, int] = {}
    for place, period in zip(places.tolist(), roots[places].tolist(), strict=True):
        if place + period <= ends.get(period, -1):
            continue
        if place + period > n:
            continue
        right = common_right(ids, place, place + period)
        if right < (min_exponent - 2) * period:
            continue
        start = place - common_left(ids, place, place + period)
        length = place + period + right - start
        if length >= 2 * period:
            ends[period] = start + length
        if length >= max(min_length, min_exponent * period):
            yield start, length, period


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by spaces, without those after the first period of any run."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return " ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def with_runs(
    docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``docs`` with ``n_words``, its ``runs`` and the ``collapsed`` text; ``min_exponent`` is 2 or more."""
    if min_exponent < 2:
        raise ValueError("a run holds its period at least twice")
    added = _parse_datatype_string(RESULT)
    names = {f.name for f in added}
    kept = [c for c in docs.columns if c.lower() not in names]
    if text not in kept:
        source = fresh_name(docs, "_text")
        docs, drop = docs.withColumn(source, F.col(text)), [source]
        kept.append(source)
    else:
        source, drop = text, []
    rows = docs.select(*kept)
    schema = StructType([*rows.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for value in batch.column(source).to_pylist():
                words = WORD.findall(value or "")
                runs = find_runs(words, min_length, min_exponent)
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(collapse(words, runs))
            new = [pa.array(v, f.type) for v, f in zip((sizes, found, texts), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *arrow.names])

    ship_package(docs.sparkSession)
    return rows.mapInArrow(run, schema).drop(*drop)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of the query, one document in ten with a periodic end.

    With h = crc32(doc_id), g = h div 10 and n words: if h mod 10 is 0 each word i >= a is
    word a + (i - a) mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  A null
    id has no such end.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    blank = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.trim(F.coalesce("text", F.lit("")), blank)
    chosen = docs.select("doc_id", "text", h.alias("h"), trimmed.alias("trimmed"))
    words = F.split("trimmed", "[\\x20\\x09-\\x0D]+")
    # Arrays of one: each step is computed once for a text.
    steps = """
        element_at(transform(array(named_struct('w', words, 'g', h div 10)), d ->
          element_at(transform(array(named_struct('a', cast(d.g % size(d.w) as int))), e ->
            element_at(transform(array(cast(1 + (size(d.w) - e.a) div (3 + d.g % 8) as int)), p ->
              concat(slice(d.w, 1, e.a),
                flatten(array_repeat(slice(d.w, e.a + 1, p), cast((size(d.w) - e.a) div p as int))),
                slice(d.w, e.a + 1, cast((size(d.w) - e.a) % p as int)))), 1)), 1)), 1)
    """
    changed = chosen.withColumn("words", F.when((F.col("h") % 10 == 0) & (F.col("trimmed") != ""), words))
    return changed.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(F.expr(steps), " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark, sf_dir) -> DataFrame:
    found = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Greatest exact length / period; ties to the smallest start, then the smallest period.
    better = (
        "(x, y) -> case when x.length * y.period <> y.length * x.period "
        "then case when x.length * y.period > y.length * x.period then -1 else 1 end "
        "when x.start <> y.start then case when x.start < y.start then -1 else 1 end "
        "when x.period <> y.period then case when x.period < y.period then -1 else 1 end else 0 end"
    )
    best = F.get(F.expr(f"array_sort(runs, {better})"), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
