"""Exact top-k inner products with one KD-tree per shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their id. A task reads one
shard at a time, builds its tree (median splits on the widest side, tight bounding boxes) and
then streams the queries past it. For a query and a box the largest possible inner product is
known, so nodes are visited in the order of that bound and the search ends when the bound falls
below the k-th best score so far.

The k-th score is propagated: each query first searches the shard it lives in, and what it finds
there is the bar it takes to all others. Only candidates that reach the bar leave a shard.

Components become ``floor(256 * x)``; scores are whole numbers, exact below 2**53. Ties go to the
smaller id, so equal vectors stay apart. Vectors that are null or hold null or non-finite
components take no part; vectors of another length than the query score on no candidate list
of it; those without components score 0 among themselves. A null id takes no part. Rows are told apart by a number of
their own: each row of a repeated id is a query with ``k`` results, and a candidate for all rows but
itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.plans.settle import settle

_LEAF = 32
_ROWS = "vec_id bigint, v array<bigint>"
_FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v``: whole-number vectors of the rows that take part."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * 256).cast("bigint"))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull())
        .filter(~F.coalesce(bad, F.lit(True)))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))
    )


class KdTree:
    """Median splits until ``_LEAF`` rows, with the tight box of every node."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.numbers, self.ids, self.rows = numbers, ids, rows
        self.low, self.high, self.children, self.member = [], [], [], []
        self._build(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, at: np.ndarray) -> int:
        node = len(self.children)
        own = self.rows[at]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.member.append(at)
        if len(at) > _LEAF and len(low):
            side = int((high - low).argmax())
            if high[side] > low[side]:  # else all rows are equal
                order = at[np.argsort(own[:, side], kind="stable")]
                half = len(order) // 2
                self.children[node] = (self._build(order[:half]), self._build(order[half:]))
                self.member[node] = None
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, bar: float) -> list[tuple]:
        """Up to ``k`` of ``(score, id)``, best first; none below ``bar``, none of the row ``own``."""
        found: list[tuple[float, int]] = []  # heap of (score, -id), the worst on top
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            worst = max(bar, found[0][0]) if len(found) == k else bar
            if -top < worst:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bound[child] >= worst:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            at = self.member[node]
            scores = self.rows[at] @ query
            near = scores >= worst
            own_rows = self.numbers[at[near]].tolist(), self.ids[at[near]].tolist()
            for score, number, i in zip(scores[near].tolist(), *own_rows, strict=True):
                if number == own:
                    continue
                if len(found) < k:
                    heapq.heappush(found, (score, -i))
                elif (score, -i) > found[0]:
                    heapq.heapreplace(found, (score, -i))
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def _search(dealt: DataFrame, k: int) -> DataFrame:
    """``dealt``: ``shard, kind, row, vec_id, v, bar``, per shard first its vectors (0), then queries (1)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, trees = None, [], None
        for batch in batches:
            shards = np.array(batch.column("shard").to_pylist(), dtype=np.int64)
            kinds = np.array(batch.column("kind").to_pylist(), dtype=np.int64)
            ids = np.array(batch.column("vec_id").to_pylist(), dtype=np.int64)
            numbers = np.array(batch.column("row").to_pylist(), dtype=np.int64)
            bars = batch.column("bar").to_pylist()
            vectors = batch.column("v").to_pylist()
            starts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist()]
            out: tuple[list, ...] = ([], [], [], [])
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, waiting, trees = shards[a], [], None
                if kinds[a] == 0:
                    waiting += zip(numbers[a:b].tolist(), ids[a:b].tolist(), vectors[a:b], strict=True)
                    continue
                if trees is None:
                    trees, waiting = _trees(waiting), []
                _answer(trees, numbers[a:b], ids[a:b], vectors[a:b], bars[a:b], k, out)
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, out, strict=True)), schema=schema)

    return dealt.mapInArrow(run, _FOUND)


def _trees(rows: list[tuple[int, int, list[int]]]) -> dict[int, KdTree]:
    """One tree for each vector length."""
    by: dict[int, list] = {}
    for row in rows:
        by.setdefault(len(row[2]), []).append(row)
    return {
        n: KdTree(
            np.array([r[0] for r in own]), np.array([r[1] for r in own]),
            np.array([r[2] for r in own], dtype=float).reshape(len(own), n),
        )
        for n, own in by.items()
    }


def _answer(trees: dict[int, KdTree], numbers, ids, vectors, bars, k: int, out, block: int = 256) -> None:
    for a in range(0, len(ids), block):
        lengths = [len(v) for v in vectors[a : a + block]]
        for n in set(lengths) & set(trees):
            at = [a + i for i, m in enumerate(lengths) if m == n]
            queries = np.array([vectors[i] for i in at], dtype=float).reshape(len(at), n)
            bounds = trees[n].bounds(queries)
            for i, query, bound in zip(at, queries, bounds, strict=True):
                bar = -math.inf if bars[i] is None else bars[i]
                for score, found in trees[n].best(query, int(numbers[i]), bound, k, bar):
                    for column, value in zip(out, (int(numbers[i]), int(ids[i]), found, int(score))):
                        column.append(value)


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 2048, column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row whose id
    ``every`` divides."""
    spark = vectors.sparkSession
    # the numbers are written with the rows, so they stay
    rows, seen = settle(quantised(vectors, column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, math.ceil(seen["rows"] / shard_rows))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = rows.select(home.alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "v").withColumn(
        "bar", F.lit(None).cast("bigint")
    )
    queries = rows.filter(F.col("vec_id") % every == 0)

    def search(asked: DataFrame) -> DataFrame:
        dealt = points.unionByName(asked).repartition(parts, "shard")
        return _search(dealt.sortWithinPartitions("shard", "kind", "vec_id", "row"), k)

    own = queries.select(home.alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "v").withColumn(
        "bar", F.lit(None).cast("bigint")
    )
    first, _ = settle(search(own), "home-shard")
    # the k-th score at home, where there are k; each query has at most k rows here
    bars = first.groupBy("row").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar")
    )
    others = (
        queries.join(bars, "row", "left")
        .withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
        .filter(F.col("shard") != home)
        .select("shard", F.lit(1).alias("kind"), "row", "vec_id", "v", "bar")
    )
    both = first.unionByName(search(others)) if shards > 1 else first
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        both.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
