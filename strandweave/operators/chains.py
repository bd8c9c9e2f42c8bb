"""Non-branching chains by pointer doubling.

``x -> y`` is a link when it is the only edge out of ``x`` and the only edge into ``y``, so
every node has at most one link in each direction. Doubling the back pointers finds the
head, position and offset of every node in log2(longest chain) joins on unique keys.

Before that, stretches of neighbouring node numbers are walked by one task each: paths inside a
stretch become one step, so the joins see only steps from stretch to stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.graph import Graph
from strandweave.plans.settle import settle, table


@dataclass(frozen=True)
class Chains:
    """``nodes(nid, head, pos, offset, cyclic)`` for all nodes of the graph, and
    ``links(src, dst, edge_len)``. A cycle is cut before its smallest node."""

    nodes: DataFrame
    links: DataFrame


def single_out(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of their source."""
    return (
        edges.groupBy("src")
        .agg(
            F.count("*").alias("n"),
            F.min("dst").alias("dst"),
            F.min("edge_len").alias("edge_len"),
        )
        .filter("n = 1")
        .drop("n")
    )


def _single_in(edges: DataFrame) -> DataFrame:
    return (
        edges.groupBy("dst")
        .agg(F.count("*").alias("n"), F.min("src").alias("src"))
        .filter("n = 1")
        .select("src", "dst")
    )


def links_of(graph: Graph) -> DataFrame:
    return single_out(graph.edges).join(_single_in(graph.edges), ["src", "dst"])


_STRETCH = 1 << 20
_RUNS = (
    "nid bigint, run bigint, pos bigint, offset bigint, closed boolean, "
    "to bigint, steps bigint, length bigint, low bigint, low_pos bigint, low_offset bigint"
)


def _walked(prev: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First node, position and offset of every node along ``prev`` (-1: none); last, which nodes are on no cycle."""
    linked = prev >= 0
    head = np.where(linked, prev, np.arange(len(prev)))
    pos, offset = linked.astype(np.int64), np.where(linked, ahead[prev], 0)
    left = -1
    while True:
        done = prev[head] < 0
        n = len(done) - int(done.sum())
        if not n or n == left:
            return head, pos, offset, done
        left = n
        pos, offset, head = pos + pos[head], offset + offset[head], head[head]


def _lowest(prev: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The smallest node of each cycle; ``on`` are the nodes on cycles."""
    low, back = np.arange(len(prev)), np.where(on, prev, np.arange(len(prev)))
    while True:
        lower = np.minimum(low, low[back])
        if (lower == low).all():
            return np.unique(low[on])
        low, back = lower, back[back]


def _stretch_runs(src: np.ndarray, dst: np.ndarray, ahead: np.ndarray) -> list[pa.Array]:
    order = np.argsort(src)
    src, dst, ahead = src[order], dst[order], ahead[order]
    at = np.minimum(np.searchsorted(src, dst), len(src) - 1)
    inside = src[at] == dst
    prev = np.full(len(src), -1, np.int64)
    prev[at[inside]] = np.flatnonzero(inside)
    head, pos, offset, done = _walked(prev, ahead)
    closed = ~done
    if closed.any():  # whole cycles, cut before their smallest node
        prev[_lowest(prev, closed)] = -1
        head, pos, offset, _ = _walked(prev, ahead)
    last = ~inside
    # nodes are in ascending order, so the first of a run in that order is its smallest
    _, first, group = np.unique(head, return_index=True, return_inverse=True)
    low = first[group]

    def at_last(values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int64(), mask=~last)

    return [
        pa.array(src), pa.array(src[head]), pa.array(pos), pa.array(offset), pa.array(closed),
        at_last(dst), at_last(pos + 1), at_last(offset + ahead), at_last(src[low]), at_last(pos[low]), at_last(offset[low]),
    ]


def _runs(links: DataFrame, stretch: int) -> DataFrame:
    """Every node with a link, by the path it is on inside its stretch of about ``stretch`` neighbouring nodes.

    ``run`` is the path's first node, ``closed`` a whole cycle. The last node of a path that leaves its stretch tells where
    it leads ``to``, over how many steps and bases, and the path's smallest node. Paths enter a stretch at their first
    node, so ``to`` is again a ``run`` or has no link.
    """
    schema = pa.schema([(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in (c.split() for c in _RUNS.split(", "))])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            if n:
                columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3)]
                whole = pa.RecordBatch.from_arrays(_stretch_runs(*columns), schema=schema)
                yield from (whole.slice(a, 1 << 16) for a in range(0, n, 1 << 16))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= stretch:
                yield from found()
                held, n = [], 0
        yield from found()

    ranged = links.select("src", "dst", "edge_len").repartitionByRange("src").sortWithinPartitions("src")
    return ranged.mapInArrow(find, _RUNS)


def _walk_back(links: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """Double back pointers of ``links(src, dst, steps, edge_len)`` until all chain heads are found.

    Returns ``(nid, ptr, pos, offset, done)`` and whether nodes on cycles are left over:
    a round settles some node of every linear chain, so a round that settles none has only
    cycles in front of it.
    """
    heads = links.join(links.select(F.col("dst").alias("src")), "src", "left_anti").select("src")
    start = (
        links.withColumnRenamed("dst", "nid")
        .join(heads.withColumn("at_head", F.lit(True)), "src", "left")
        .select(
            "nid",
            F.col("src").alias("ptr"),
            F.col("steps").alias("pos"),
            F.col("edge_len").alias("offset"),
            F.coalesce("at_head", F.lit(False)).alias("done"),
        )
    )
    state, seen = settle(start, label, open=F.count_if(~F.col("done")))
    left = seen.get("open", 0)
    while left:
        hop = state.select(
            F.col("nid").alias("ptr"),
            F.col("ptr").alias("ptr2"),
            F.col("pos").alias("pos2"),
            F.col("offset").alias("offset2"),
            F.col("done").alias("done2"),
        )
        moved = (
            state.filter("not done")
            .join(hop, "ptr")
            .select(
                "nid",
                F.col("ptr2").alias("ptr"),
                (F.col("pos") + F.col("pos2")).alias("pos"),
                (F.col("offset") + F.col("offset2")).alias("offset"),
                F.col("done2").alias("done"),
            )
        )
        state, seen = settle(
            state.filter("done").unionByName(moved), label, open=F.count_if(~F.col("done"))
        )
        if seen.get("open", 0) == left:
            return state, True
        left = seen.get("open", 0)
    return state, False


def _around_cycles(ring: DataFrame) -> DataFrame:
    """``(nid, head, pos, offset)`` on cycles of ``ring(src, dst, steps, edge_len)``, counted from each cycle's smallest node.

    Windows of predecessors double; each keeps its smallest node and the way from there.
    When a round lowers no label, all windows of that width agree and cover the cycle.
    """
    zero = F.lit(0).cast("bigint")
    ahead = F.col("src") < F.col("dst")
    state, _ = settle(
        ring.select(
            F.col("dst").alias("nid"),
            F.col("src").alias("ptr"),
            "steps",
            F.col("edge_len").alias("length"),
            F.least("src", "dst").alias("low"),
            F.when(ahead, F.col("steps")).otherwise(zero).alias("pos"),
            F.when(ahead, F.col("edge_len")).otherwise(zero).alias("offset"),
        ),
        "cycle",
    )
    while True:
        hop = state.select(
            F.col("nid").alias("ptr"), *[F.col(c).alias(c + "2") for c in ("ptr", "steps", "length", "low", "pos", "offset")]
        )
        lower = F.col("low2") < F.col("low")
        state, seen = settle(
            state.join(hop, "ptr").select(
                "nid",
                F.col("ptr2").alias("ptr"),
                (F.col("steps") + F.col("steps2")).alias("steps"),
                (F.col("length") + F.col("length2")).alias("length"),
                F.least("low", "low2").alias("low"),
                F.when(lower, F.col("steps") + F.col("pos2")).otherwise(F.col("pos")).alias("pos"),
                F.when(lower, F.col("length") + F.col("offset2")).otherwise(F.col("offset")).alias("offset"),
                lower.alias("lowered"),
            ),
            "cycle",
            lowered=F.count_if(F.col("lowered")),
        )
        state = state.drop("lowered")
        if not seen.get("lowered"):
            return state.select("nid", F.col("low").alias("head"), "pos", "offset")


def _whole_cycles(around: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs on cycles, counted from the smallest of all nodes of their cycle instead of the smallest run."""
    placed = around.withColumnRenamed("nid", "run").join(runs, "run")
    cycles = placed.groupBy("head").agg(
        F.min("low").alias("lowest"),
        F.min_by(F.struct((F.col("pos") + F.col("low_pos")).alias("pos"), (F.col("offset") + F.col("low_offset")).alias("offset")), "low").alias("at"),
        F.sum("steps").alias("around"),
        F.sum("length").alias("around_len"),
    )
    return placed.join(cycles, "head").select(
        "run", F.col("lowest").alias("head"), (F.col("pos") - F.col("at.pos")).alias("run_pos"),
        (F.col("offset") - F.col("at.offset")).alias("run_offset"), "around", "around_len",
    )


def chain_table(graph: Graph, stretch: int = _STRETCH) -> Chains:
    links = table(links_of(graph), "links")
    inside = table(_runs(links, stretch), "runs")
    leaving = inside.filter("to is not null").drop("nid", "pos", "offset", "closed")
    steps = leaving.select(F.col("run").alias("src"), F.col("to").alias("dst"), "steps", F.col("length").alias("edge_len"))
    state, cycles_left = _walk_back(steps, "chain")
    zero, none, linear = F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.lit(False).alias("cyclic")
    done = state.filter("done").select("nid", F.col("ptr").alias("head"), "pos", "offset")
    starts = done.select(
        F.col("nid").alias("run"), "head", F.col("pos").alias("run_pos"), F.col("offset").alias("run_offset"),
        none.alias("around"), none.alias("around_len"),
    )
    if cycles_left:
        on_cycle = state.filter("not done").select("nid")
        ring = table(steps.join(on_cycle.withColumnRenamed("nid", "dst"), "dst", "left_semi"), "ring")
        starts = starts.unionByName(_whole_cycles(_around_cycles(ring), leaving))
    at, off = F.coalesce("run_pos", zero) + F.col("pos"), F.coalesce("run_offset", zero) + F.col("offset")
    wraps = F.col("around").isNotNull() & (at < 0)
    placed = inside.filter("not closed").select("nid", "run", "pos", "offset").join(starts, "run", "left").select(
        "nid",
        F.coalesce("head", "run").alias("head"),
        F.when(wraps, at + F.col("around")).otherwise(at).alias("pos"),
        F.when(wraps, off + F.col("around_len")).otherwise(off).alias("offset"),
        F.col("around").isNotNull().alias("cyclic"),
    )
    rings = inside.filter("closed").select("nid", F.col("run").alias("head"), "pos", "offset", F.lit(True).alias("cyclic"))
    # the last nodes of chains have no link onward
    ends = done.join(steps.select(F.col("src").alias("nid")), "nid", "left_anti").select("*", linear)
    placed = placed.unionByName(rings).unionByName(ends)
    alone = (
        graph.nodes.select("nid")
        .join(links.select(F.explode(F.array("src", "dst")).alias("nid")), "nid", "left_anti")
        .select("nid", F.col("nid").alias("head"), zero.alias("pos"), zero.alias("offset"), linear)
    )
    return Chains(table(placed.unionByName(alone), "chains"), links)
