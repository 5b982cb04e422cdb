"""Exact order statistics and quantiles without gathering a group in one task.

Groups up to ``GROUP_LIMIT`` rows use the exact built-ins.  If a group is larger, all
ranks of all groups are found together by digits: values become 64-bit whole numbers in
the same order, and four passes, from the highest 16 bits to the lowest, count the rows
per digit among those that still share the digits of a wanted rank.  A histogram has at
most 65 536 cells, is combined before the shuffle and adds up over partitions; a running
sum over it says in which cell each rank lies.  Rows are never paired with ranks, sorted
or gathered, and nothing depends on an estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage, stage_table

GROUP_LIMIT = 1_000_000
SMALL_SIDE = 100_000
SMALL_BYTES = 16 << 20
ACCURACY = 10_000
DIGIT = 16
_NAN = 0x7FF8 << 48


def join_small(
    df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = SMALL_SIDE, stored: bool = False
) -> DataFrame:
    """Join a usually small table: broadcast if its rows and bytes prove it small, else shuffle.

    The shuffled join is left to adaptive execution, which splits skewed keys.
    ``stored`` says the small side is already materialised.
    """
    small = small if stored else cut_lineage(small)
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))
    rows, size = small.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= limit and size <= SMALL_BYTES:
        small = F.broadcast(small)
    return df.join(small, on, how)


def ordered_bits(x: Column) -> Column:
    """A double as a whole number of the same order: its bits, negated below zero.

    Exponent and fraction come from exact arithmetic on powers of two.  Both zeros are 0,
    and NaN is above all, as in sorting.
    """
    size = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))
    power = F.pow(F.lit(2.0), guess)
    # The logarithm may be off by one next to a power of two.
    exponent = guess + F.when(size >= 2 * power, 1).when((size < power) & (guess > -1022), -1).otherwise(0)
    fraction = (size / F.pow(F.lit(2.0), exponent) * float(1 << 52)).cast("long")
    bits = (exponent + 1022).cast("long") * F.lit(1 << 52) + fraction
    bits = F.when(F.isnan(x), F.lit(_NAN)).when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(0x7FF << 52)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits).cast("long")


def from_ordered_bits(key: Column) -> Column:
    """The double of ``ordered_bits``."""
    bits = F.abs(key)
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    normal = (fraction + 1.0) * F.pow(F.lit(2.0), exponent - 1023)
    value = F.when(bits == _NAN, F.lit(float("nan"))).when(exponent == 0, fraction * 2.0**-1022).otherwise(normal)
    return F.when(key < 0, -value).otherwise(value)


def values_at(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, rank, key) for ``targets`` (g, rank): the keys at 0-based ranks among the ``rows`` (g, key) of a group.

    ``rows`` are worked out once and stored: a key is a long expression, which a digit, a filter
    and a join on it would each repeat.  From the second digit on, another copy holds those
    that share the first digit of a wanted rank.
    """
    rows = stage_table(rows)
    wanted = F.struct("rank", F.col("rank").alias("base"))
    state = cut_lineage(targets.groupBy("g").agg(F.collect_set(wanted).alias("ranks")).withColumn("prefix", F.lit(0).cast("long")))
    for step in range(64 // DIGIT):
        low = 64 - DIGIT * (step + 1)
        if step == 0:
            # Two's complement: the highest digit is signed.
            live = rows.withColumn("prefix", F.lit(0).cast("long"))
        else:
            live = rows.withColumn("prefix", F.shiftright("key", low + DIGIT))
            live = join_small(live, state.select("g", "prefix"), ["g", "prefix"], "left_semi", stored=True)
            if step == 1:
                rows = stage_table(live.select("g", "key"))
                live = rows.withColumn("prefix", F.shiftright("key", low + DIGIT))
        cells = live.groupBy("g", "prefix", F.shiftright("key", low).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("cell"))
        cells = cells.withColumn("under", upto - F.col("n"))
        inside = cells.join(state, ["g", "prefix"]).withColumn(
            "ranks", F.expr("filter(ranks, r -> r.base >= under AND r.base < under + n)")
        )
        kept = inside.filter(F.size("ranks") > 0).select(
            "g", F.col("cell").alias("prefix"), F.expr("transform(ranks, r -> struct(r.rank AS rank, r.base - under AS base))").alias("ranks")
        )
        state = cut_lineage(kept)
    return state.select("g", F.explode("ranks.rank").alias("rank"), F.col("prefix").alias("key"))


def _between(low: Column, high: Column, at: Column) -> Column:
    """Interpolation as the built-in exact percentile does it, to the last bit."""
    value = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
    return F.when((F.ceil(at) == F.floor(at)) | (low == high), low).otherwise(value)


def quantiles(
    df: DataFrame, x: str | Column, probs: Sequence[float], by: Sequence[str] = (), group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Linear-interpolation quantiles per group: columns ``by``, ``prob``, ``value``.

    NULLs are left out; a group without values has no rows.
    """
    x = F.col(x) if isinstance(x, str) else x
    keys = list(by) or ["_all"]
    rows = df.select(*by, x.cast("double").alias("x")).filter(F.col("x").isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(1))
    points = F.array(*[F.lit(float(p)) for p in probs])

    def exact(part: DataFrame) -> DataFrame:
        # The built-in keeps the distinct values of a group in memory: at most GROUP_LIMIT.
        found = part.groupBy(*keys).agg(F.percentile("x", points).alias("v"))
        pairs = F.arrays_zip(points.alias("prob"), F.col("v").alias("value"))
        return found.select(*by, F.inline(pairs))

    grouped = rows.select(F.struct(*keys).alias("g"), ordered_bits(F.col("x")).alias("key"))
    counts = cut_lineage(grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    if counts.filter(F.col("n") > group_limit).isEmpty():
        return exact(rows)
    at = (F.col("n") - 1) * F.col("prob")
    wanted = counts.withColumn("prob", F.explode(points)).withColumns({"low": F.floor(at), "at": at})
    wanted = wanted.withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    targets = wanted.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = values_at(grouped, targets).withColumn("value", from_ordered_bits(F.col("key")))

    def at_rank(name):
        return values.select("g", F.col("rank").alias(name), F.col("value").alias(f"v_{name}"))

    both = wanted.join(at_rank("low"), ["g", "low"]).join(at_rank("high"), ["g", "high"])
    return both.select(*[F.col(f"g.`{c}`").alias(c) for c in by], "prob", _between(F.col("v_low"), F.col("v_high"), F.col("at")).alias("value"))


MARGIN = 0.002
DRIVER_VALUES = 100_000


def quantile(df: DataFrame, x: str | Column, prob: float, group_limit: int = GROUP_LIMIT) -> float | None:
    """One quantile of a whole table as a number; None when it is empty.

    Two passes: a sketch gives two values around the wanted rank, then rows outside are
    counted and the few between are looked at.  Where those would be many, or the
    sketch missed, the general way takes over.
    """
    x = F.col(x) if isinstance(x, str) else x
    rows = df.select(x.cast("double").alias("x")).filter(F.col("x").isNotNull())
    edges = F.array(F.lit(max(prob - MARGIN, 0.0)), F.lit(min(prob + MARGIN, 1.0)))
    n, edge = rows.agg(F.count(F.lit(1)), F.percentile_approx("x", edges, F.lit(ACCURACY))).first()
    if n == 0:
        return None
    at = prob * (n - 1)
    low = int(at)
    if 2 * MARGIN * n <= min(DRIVER_VALUES, group_limit):
        lo = edge[0] if prob > MARGIN else float("-inf")
        hi = edge[1] if prob < 1 - MARGIN else float("inf")
        v = F.col("x")
        between = F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v)))
        under, at_lo, at_hi, middle = rows.agg(
            F.count_if(v < lo), F.count_if(v == lo), F.count_if(v == hi), between
        ).first()

        def value(rank: int) -> float | None:
            rank -= under
            if 0 <= rank < at_lo:
                return lo
            rank -= at_lo
            if 0 <= rank < len(middle):
                return middle[rank]
            return hi if 0 <= rank - len(middle) < at_hi else None

        first, second = value(low), value(min(low + 1, n - 1))
        if first is not None and second is not None:
            return first if at == low or first == second else (low + 1 - at) * first + (at - low) * second
    row = quantiles(df, x, [prob], group_limit=group_limit).first()
    return None if row is None else row["value"]


def kth_value(df: DataFrame, order: Column, k: int, count: int, group_limit: int = GROUP_LIMIT) -> int:
    """The ``k``-th smallest of a whole-number column, exact over all 64 bits."""
    order = order.cast("long")
    if count <= group_limit:
        return df.select(order.alias("o")).orderBy("o").limit(k).agg(F.max("o")).first()[0]
    one = F.struct(F.lit(1).alias("all")).alias("g")
    target = df.sparkSession.range(1).select(one, F.lit(k - 1).cast("long").alias("rank"))
    return values_at(df.select(one, order.alias("key")), target).first()["key"]


def smallest(
    df: DataFrame, order: Column, uid: str, k: int, group_limit: int = GROUP_LIMIT, count: int | None = None,
    uniform: int | None = None,
) -> Column:
    """A predicate for exactly the ``k`` rows smallest by ``(order, uid)``.

    ``order`` is a whole number; ``uid`` is unique.
    ``uniform`` says that ``order`` is a hash spread evenly over [0, uniform): the cut is
    then looked for where it must nearly be, and elsewhere only if it is not there.
    """
    if k <= 0:
        return F.lit(False)
    count = df.count() if count is None else count
    if k >= count:
        return F.lit(True)
    id_ = F.col(uid)
    if count <= group_limit:
        first = df.select(order.alias("o"), id_.alias("u")).orderBy("o", "u").limit(k)
        cut = first.agg(F.max(F.struct("o", "u"))).first()[0]
        return (order < cut["o"]) | ((order == cut["o"]) & (id_ <= cut["u"]))
    if uniform is not None:
        middle, slack = k / count, 8.0 * (k * (count - k) / count) ** 0.5 / count
        lo, hi = int((middle - slack) * uniform), int((middle + slack) * uniform) + 1
        under, inside = df.agg(F.count_if(order < lo), F.count_if((order >= lo) & (order < hi))).first()
        if under < k <= under + inside and inside < count:
            near = df.filter((order >= lo) & (order < hi))
            if k == under + inside:
                return order < hi
            # Rows below the bracket are below any cut inside it.
            return smallest(near, order, uid, k - under, group_limit, inside)
    value = kth_value(df, order, k, count, group_limit)
    under, equal = df.agg(F.count_if(order < value), F.count_if(order == value)).first()
    if under + equal == k:
        return order <= value
    # Equal order values are rare: hashes, or numbers meant to be unique.
    tied = df.filter(order == value).select(id_.alias("u"))
    last = tied.orderBy("u").limit(k - under).agg(F.max("u")).first()[0]
    return (order < value) | ((order == value) & (id_ <= last))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row") -> DataFrame:
    """Add 1, 2, ... in the given order to a table of any size.

    The sort is distributed; each partition numbers its own rows, and the partition
    sizes (one row per partition) give the offsets.
    """
    sorted_rows = cut_lineage(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    )
    part, local = F.shiftright("_slot", 33), F.col("_slot").bitwiseAND((1 << 33) - 1)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
    numbered = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select(
        (F.col("_before") + local + 1).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )
