"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_checked, stage_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is its smallest node.

    Each round every node moves to the neighbour, or itself, whose hash is smallest, and
    links are rewritten to where their ends went.  Hashes in place of ids keep long
    chains short: the number of rounds grows with the logarithm of a path.  All steps
    are aggregations and joins of stored tables; a hub only counts once per map task.
    """
    edges = stage_table(links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")))
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.unionByName(both.select("a", F.col("a").alias("b")))
        parent = stage_table(near.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.xxhash64("b")).alias("to")))
        moves.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = parent.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = join_checked(join_checked(edges, a, ["a"], row_bytes=16), b, ["b"], row_bytes=16)
        edges = stage_table(
            moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
    if not moves:
        return links.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("component")).limit(0)
    roots = moves[0]
    for later in moves[1:]:
        step = later.select(F.col("node").alias("to"), F.col("to").alias("next"))
        roots = stage_table(
            join_checked(roots, step, ["to"], "left", row_bytes=16).select("node", F.coalesce("next", "to").alias("to"))
        )
    smallest = stage_table(roots.groupBy("to").agg(F.min("node").alias("component")))
    return stage_table(join_checked(roots, smallest, ["to"], row_bytes=16).select("node", "component"))
