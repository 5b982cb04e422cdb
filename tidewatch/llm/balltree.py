"""Exact top-k by inner product: a ball tree per shard, branch and bound per query.

Candidates are dealt to shards of about ``SHARD_ROWS`` vectors by a hash of their id.
Each shard is built into a ball tree once and stored as one row.  Queries travel in
blocks.  A query visits the nodes of a shard in the order of their upper bound
``q.c + |q| r``; when the best bound left is below its current k-th score, the shard is
done (equal bounds are still opened, a tie may go to a smaller id).

The k-th score is shared: every block first searches one shard, which gives each query
a floor, then groups of shards; inside a group the k-th score found so far goes on to
the next shard, and every group starts from the floor.

Scores are exact: components are whole numbers, products are summed in doubles while
they stay below 2^53, else as Python integers (saturating at 64 bits in the result).

Defined cases: rows whose vector or id is null, or whose vector has a null or
non-finite component, take no part; shorter vectors count as padded by zeros; a query
never returns rows of its own id; a repeated query id is one query (its smallest
vector); repeated candidates each count; fewer than k candidates are all returned; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, stage_table, table

K = 5
EVERY = 50
SHARD_ROWS = 4096
BLOCK_ROWS = 512
LEAF_ROWS = 96
GROUP_SHARDS = 8
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes in arrays; children of node i at ``left[i]``, ``right[i]`` (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.left, self.right, spans, centers, radii = [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            node = len(spans)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = node
            rows = order[start:stop]
            points = vectors[rows]
            center = points.mean(axis=0)
            away = points - center
            distance = np.sqrt((away * away).sum(axis=1))
            spans.append((start, stop))
            centers.append(center)
            radii.append(distance.max())
            self.left.append(-1)
            self.right.append(-1)
            if stop - start > leaf_rows and radii[-1] > 0:
                far = points[distance.argmax()]
                other = points[((points - far) ** 2).sum(axis=1).argmax()]
                middle = (stop - start) // 2
                split = np.argpartition(points @ (other - far), middle)
                order[start:stop] = rows[split]
                todo += [(start, start + middle, node, 0), (start + middle, stop, node, 1)]
        self.ids, self.vectors, self.spans = ids[order], vectors[order], spans
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.largest = float(np.abs(vectors).max(initial=0.0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, a row per query, safe against rounding."""
        length = np.sqrt((queries * queries).sum(axis=1))
        raw = queries @ self.centers.T + length[:, None] * self.radii[None, :]
        scale = length[:, None] * (np.sqrt((self.centers**2).sum(axis=1)) + self.radii)[None, :]
        return raw + 1e-9 * scale + 1e-6

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, best: list, floor: float, k: int) -> list:
        """``best`` (score, -id pairs, a min-heap of k at most) after this shard."""
        exact = self.largest * float(np.abs(query).max(initial=0.0)) * len(query) < 2.0**53
        least = best[0][0] if len(best) == k else floor
        nodes = [(-bounds[0], 0)]
        while nodes and -nodes[0][0] >= least:
            _, node = heapq.heappop(nodes)
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= least:
                        heapq.heappush(nodes, (-bounds[child], child))
                continue
            start, stop = self.spans[node]
            scores = self.vectors[start:stop] @ query if exact else _whole(self.vectors[start:stop], query)
            for i in np.flatnonzero(scores >= least):
                found = (int(scores[i]), -int(self.ids[start + i]))
                if -found[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            least = best[0][0] if len(best) == k else floor
        return best


def _whole(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    factors = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(v, factors, strict=True)) for v in vectors], dtype=object)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Whole-number components, padded to ``width``."""
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _packed(rows: DataFrame, key: str, build, width: int) -> DataFrame:
    """One row (key, data) per value of ``key``: its ids and vectors, built and pickled.

    ``key`` holds a bounded number of rows by construction: rows are dealt by a hash.
    Vectors are padded to ``width``.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        data = build(group["vec_id"].to_numpy(), _matrix(group["embedding"].combine_chunks(), width))
        return pa.table({key: group[key][:1], "data": pa.array([pickle.dumps(data)], pa.binary())})

    from tidewatch.session import ship_package

    ship_package(rows.sparkSession)
    return stage_table(rows.groupBy(key).applyInArrow(run, f"{key} long, data binary"))


def _dealt(rows: DataFrame, key: str, per: int) -> tuple[DataFrame, int]:
    count = max(1, -(-rows.count() // per))
    return rows.withColumn(key, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(count)).cast("long")), count


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of query block and shard; those of one ``bundle`` follow each other."""

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        current, best, ids, matrix, floors = None, {}, [], None, []

        def done() -> list[tuple]:
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            return [(int(q), -other, clip(score)) for q, found in best.items() for score, other in found]

        for batch in batches:
            for bundle, block, floor, data in zip(batch["bundle"], batch["block_data"], batch["floors"], batch["data"], strict=True):
                if bundle != current:
                    if best:
                        yield done()
                    current, (ids, matrix) = bundle, pickle.loads(block)
                    known = dict(floor or [])
                    floors = [known.get(int(q), -np.inf) for q in ids]
                    best = {int(q): [] for q in ids}
                tree = pickle.loads(data)
                bounds = tree.bounds(matrix)
                for i, q in enumerate(ids):
                    tree.search(int(q), matrix[i], bounds[i], best[int(q)], floors[i], k)
        if best:
            yield done()

    columns = pairs.select("bundle", "block_data", "floors", "data")
    return map_rows(columns, run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query."""
    usable = F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    clean = lambda df: df.filter(F.coalesce(usable, F.lit(False))).select("vec_id", "embedding")
    sharded, shards = _dealt(stage_table(clean(vectors)), "shard", shard_rows)
    blocked, _ = _dealt(stage_table(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))), "block", BLOCK_ROWS)
    longest = [df.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0] for df in (sharded, blocked)]
    trees = _packed(sharded, "shard", BallTree, max(longest))
    blocks = _packed(blocked, "block", lambda ids, matrix: (ids, matrix), max(longest)).withColumnRenamed("data", "block_data")
    no_floor = F.lit(None).cast("array<struct<q:long,s:long>>")
    home = F.col("block") % shards
    seeds = blocks.withColumns({"shard": home, "bundle": F.col("block"), "floors": no_floor}).join(trees, "shard")
    first = stage_table(_search(seeds, k))
    kth = _best(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    floors = (
        blocked.select("vec_id", "block").join(kth, "vec_id").groupBy("block")
        .agg(F.collect_list(F.struct(F.col("vec_id").alias("q"), F.col("score").alias("s"))).alias("floors"))
    )  # a block holds about BLOCK_ROWS queries
    spread = (
        blocks.join(floors, "block", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
        .filter(F.col("shard") != home)
        .withColumn("bundle", F.struct("block", F.floor(F.col("shard") / GROUP_SHARDS)).cast("string"))
    )
    pairs = spread.join(trees, "shard").repartition("bundle").sortWithinPartitions("bundle", "shard")
    rest = _search(pairs, k)
    return _best(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_top_k(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
