"""The strand-symmetric overlap graph as two tables, and its basic edits.

``nodes(nid, ...)`` and ``edges(src, dst, edge_len, overlap_len, identity)``. A read has two
nodes, ``2*i`` forward and ``2*i + 1`` reversed, so the mirror of a node is ``nid ^ 1``.
An overlap of a read with itself never enters the graph, hence no edge has ``src = dst``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import flip
from strandweave.plans.ordering import with_index
from strandweave.plans.settle import settle, table

EDGE_COLUMNS = ["src", "dst", "edge_len", "overlap_len", "identity"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def with_edges(self, edges: DataFrame) -> "Graph":
        return replace(self, edges=edges.select(*EDGE_COLUMNS))

    def settled(self, label: str) -> tuple["Graph", int, int]:
        """Both tables written out, with their row counts."""
        nodes, n = settle(self.nodes, f"{label}-nodes")
        edges, m = settle(self.edges, f"{label}-edges")
        return Graph(nodes, edges), n["rows"], m["rows"]

    def edges_settled(self, label: str) -> tuple["Graph", int]:
        edges, m = settle(self.edges, f"{label}-edges")
        return Graph(self.nodes, edges), m["rows"]


def _best_edge() -> Column:
    # the order alone holds all values, so they are shuffled once
    return F.max(F.struct("overlap_len", "identity", (-F.col("edge_len")).alias("shorter")))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): longest overlap, then highest identity, then shortest."""
    return edges.groupBy("src", "dst").agg(_best_edge().alias("b")).select(
        "src", "dst", (-F.col("b.shorter")).alias("edge_len"), "b.overlap_len", "b.identity"
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("nid")).distinct()


def mirror(edges: DataFrame) -> DataFrame:
    """Each edge as seen from the other strand; attributes are carried over."""
    return edges.withColumns({"src": flip(F.col("dst")), "dst": flip(F.col("src"))})


def from_edges(edges: DataFrame) -> Graph:
    return Graph(nodes_of(edges), edges.select(*EDGE_COLUMNS))


def intern_reads(overlaps: DataFrame) -> DataFrame:
    """``reads(read_key, idx)``: every ``name:start-end`` of the overlaps, numbered by name."""
    keys = overlaps.select(
        F.explode(
            F.array(F.expr("left(source, length(source)-1)"), F.expr("left(sink, length(sink)-1)"))
        ).alias("read_key")
    ).distinct()
    return table(with_index(keys, ["read_key"], "idx"), "reads")


def build(overlaps: DataFrame) -> Graph:
    """Two directed edges and two nodes per read from overlap rows.

    Node rows carry ``node_id`` and, split at the last ``:``, the read name and its region.
    """
    reads = intern_reads(overlaps)

    def lookup(side: str) -> DataFrame:
        return reads.select(
            F.col("read_key").alias(f"{side}_key"), F.col("idx").alias(f"{side}_idx")
        )

    def nid(side: str) -> Column:
        reversed_ = F.when(F.right(F.col(side), F.lit(1)) == "-", 1).otherwise(0)
        return F.col(f"{side}_idx") * 2 + reversed_

    placed = (
        overlaps.withColumns(
            {s + "_key": F.expr(f"left({s}, length({s})-1)") for s in ("source", "sink")}
        )
        .join(lookup("source"), "source_key")
        .join(lookup("sink"), "sink_key")
        .withColumns({"a": nid("source"), "b": nid("sink")})
    )
    forward = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("edge_len"))
    back = F.struct(
        flip(F.col("b")).alias("src"),
        flip(F.col("a")).alias("dst"),
        F.col("rc_edge_len").alias("edge_len"),
    )
    edges = placed.select(
        F.explode(F.array(forward, back)).alias("e"), "overlap_len", "identity"
    ).select("e.src", "e.dst", "e.edge_len", "overlap_len", "identity")
    return Graph(describe_nodes(reads), dedupe_edges(edges))


def describe_nodes(reads: DataFrame) -> DataFrame:
    span = F.substring_index("read_key", ":", -1)
    name = F.expr("left(read_key, length(read_key) - length(substring_index(read_key, ':', -1)) - 1)")
    return reads.select(
        F.explode(F.array(F.lit("+"), F.lit("-"))).alias("ori"),
        F.col("idx"),
        F.col("read_key"),
        name.alias("read"),
        F.substring_index(span, "-", 1).cast("bigint").alias("cov_start"),
        F.substring_index(span, "-", -1).cast("bigint").alias("cov_end"),
    ).select(
        (F.col("idx") * 2 + F.when(F.col("ori") == "-", 1).otherwise(0)).alias("nid"),
        F.concat("read_key", "ori").alias("node_id"),
        "read",
        "cov_start",
        "cov_end",
        "ori",
    )


def remove_edges(graph: Graph, doomed: DataFrame, mirrored: bool = True) -> Graph:
    """Drop edges listed in ``doomed(src, dst)``, by default with their mirrors."""
    pairs = doomed.select("src", "dst")
    if mirrored:
        pairs = pairs.unionByName(mirror(pairs)).distinct()
    return graph.with_edges(graph.edges.join(pairs, ["src", "dst"], "left_anti"))


def add_edges(graph: Graph, extra: DataFrame, mirrored: bool = True) -> Graph:
    """Append edges whose (src, dst) is still free; mirrors are added unless switched off."""
    extra = extra.select(*EDGE_COLUMNS)
    if mirrored:
        extra = extra.unionByName(mirror(extra))
    fresh = dedupe_edges(extra).join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return graph.with_edges(graph.edges.unionByName(fresh))


def delete_reads(graph: Graph, doomed: DataFrame) -> Graph:
    """Delete the nodes in ``doomed(nid)`` in both orientations, and every edge touching them."""
    reads = doomed.select(F.shiftright("nid", 1).alias("read_idx")).distinct()
    nodes = (
        graph.nodes.withColumn("read_idx", F.shiftright("nid", 1))
        .join(reads, "read_idx", "left_anti")
        .drop("read_idx")
    )
    edges = (
        graph.edges.withColumns({"a": F.shiftright("src", 1), "b": F.shiftright("dst", 1)})
        .join(reads.select(F.col("read_idx").alias("a")), "a", "left_anti")
        .join(reads.select(F.col("read_idx").alias("b")), "b", "left_anti")
    )
    return Graph(nodes, edges.select(*EDGE_COLUMNS))


def repeated_pairs(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` that several edges share."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1").select("src", "dst")


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Out-edges numbered 1.. by (edge_len, dst) within each source.

    The rank is the global sorted position minus the position of the source's first edge,
    so the edges of a hub are numbered by many tasks.
    """
    placed = table(with_index(edges, ["src", "edge_len", "dst"], "at"), "ranked")
    first = placed.groupBy("src").agg(F.min("at").alias("first"))
    return placed.join(first, "src").select(
        "src", "dst", "edge_len", (F.col("at") - F.col("first") + 1).alias("edge_rank")
    )


def degrees(graph: Graph) -> DataFrame:
    """``degrees(nid, n_in, n_out)`` of every node, zero where it has no edge."""
    ends = graph.edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("nid"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("nid"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    blank = graph.nodes.select("nid", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return (
        ends.unionByName(blank)
        .groupBy("nid")
        .agg(F.sum("i").cast("bigint").alias("n_in"), F.sum("o").cast("bigint").alias("n_out"))
    )


def graph_stats(graph: Graph) -> DataFrame:
    """Node and edge counts and their ratio (null without edges)."""
    tagged = graph.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(
        graph.edges.select(F.lit(0).alias("n"), F.lit(1).alias("m"))
    )
    return tagged.agg(F.sum("n").alias("n_nodes"), F.sum("m").alias("n_edges")).withColumn(
        "nodes_per_edge", F.try_divide(F.col("n_nodes").cast("double"), F.col("n_edges").cast("double"))
    )


def symmetry_violations(graph: Graph) -> DataFrame:
    """Nodes without a mirror and edges without a mirror edge; empty on a sound graph."""
    alone = graph.nodes.select("nid").join(
        graph.nodes.select(flip(F.col("nid")).alias("nid")), "nid", "left_anti"
    )
    pairs = graph.edges.select("src", "dst")
    one_way = pairs.join(mirror(pairs), ["src", "dst"], "left_anti")
    none = F.lit(None).cast("bigint")
    return alone.select(F.lit("node").alias("kind"), F.col("nid").alias("src"), none.alias("dst")).unionByName(
        one_way.select(F.lit("edge").alias("kind"), "src", "dst")
    )


def require_symmetry(graph: Graph) -> Graph:
    found = symmetry_violations(graph).limit(5).collect()
    if found:
        raise ValueError(f"graph is not strand-symmetric, for example: {found}")
    return graph
