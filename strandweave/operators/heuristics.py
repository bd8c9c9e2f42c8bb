"""Heuristic edge and chain removal. Every rule judges the graph as it was before the step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.chains import chain_table, single_out
from strandweave.operators.graph import Graph, degrees, dedupe_edges, delete_reads, mirror, remove_edges


def remove_multi_edges(graph: Graph) -> Graph:
    return graph.with_edges(dedupe_edges(graph.edges))


def short_edges(edges: DataFrame, ratio: float) -> DataFrame:
    """Out-edges of branching nodes whose overlap is small beside the node's longest."""
    longest = edges.groupBy("src").agg(
        F.max("overlap_len").alias("longest"), F.count("*").alias("n_out")
    )
    limit = F.floor(F.col("longest").cast("double") * F.lit(ratio) + 0.499).cast("bigint")
    return (
        edges.join(longest.filter("n_out >= 2"), "src")
        .filter(F.col("overlap_len") < limit)
        .select("src", "dst")
    )


def remove_short_edges(graph: Graph, ratio: float) -> Graph:
    return remove_edges(graph, short_edges(graph.edges, ratio))


def weak_edges(edges: DataFrame) -> DataFrame:
    """Out-edges of branching nodes other than the one of highest identity."""
    best = edges.groupBy("src").agg(
        F.max_by("dst", F.struct(F.col("identity"), -F.col("edge_len"), -F.col("dst"))).alias("best")
    )
    return edges.join(best, "src").filter("dst != best").select("src", "dst")


def remove_weak_edges(graph: Graph, mirrored: bool = True) -> Graph:
    """Keep the highest identity per branching node. ``mirrored=False`` drops ``dst -> src``
    instead of the mirror edge, which breaks strand symmetry."""
    weak = weak_edges(graph.edges)
    if mirrored:
        return remove_edges(graph, weak)
    back = weak.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return remove_edges(graph, weak.unionByName(back).distinct(), mirrored=False)


def internal_chain_nodes(graph: Graph, max_ext: int) -> DataFrame:
    """Nodes of simple chains of at most ``max_ext`` between two branching nodes."""
    chains = chain_table(graph)
    deg = degrees(graph)
    inner = chains.nodes.filter("not cyclic").join(deg, "nid")
    simple = (F.col("n_in") == 1) & (F.col("n_out") == 1)
    lengths = (
        inner.groupBy("head")
        .agg(
            F.count(F.when(simple, 1)).alias("n_simple"),
            F.max_by(F.struct("nid", "n_out", "n_in"), "pos").alias("last"),
            F.max(F.when(F.col("pos") == 0, F.col("n_in"))).alias("head_in"),
        )
        .filter(F.col("n_simple").between(1, max_ext) & (F.col("head_in") == 1))
    )
    # the branching end is the chain's own last node, or the node the last one points to
    last_simple = (F.col("last.n_in") == 1) & (F.col("last.n_out") == 1)
    beyond = graph.edges.select(F.col("src").alias("last_nid"), F.col("dst").alias("end"))
    out = deg.select(F.col("nid").alias("end"), F.col("n_out").alias("end_out"))
    inside = lengths.filter(~last_simple & (F.col("last.n_out") >= 2)).select("head")
    onward = (
        lengths.filter(last_simple)
        .select("head", F.col("last.nid").alias("last_nid"))
        .join(beyond, "last_nid")
        .join(out, "end")
        .filter("end_out >= 2")
        .select("head")
    )
    # a chain counts only when a branching node leads into it
    led = (
        graph.edges.join(deg.filter("n_out >= 2").select(F.col("nid").alias("src")), "src", "left_semi")
        .select(F.col("dst").alias("head"))
        .distinct()
    )
    heads = inside.unionByName(onward).join(led, "head", "left_semi")
    return inner.filter(simple).join(heads, "head", "left_semi").select("nid")


def cut_internal_chains(graph: Graph, max_ext: int) -> Graph:
    return delete_reads(graph, internal_chain_nodes(graph, max_ext))


def biloop_edges(graph: Graph, max_ext: int) -> DataFrame:
    """Edges ``w -> x`` bypassed by ``w -> v`` and an unbranched walk from ``v`` to ``x``.

    The walk follows single out-edges for at most ``max_ext`` steps and stops before a node
    it has already passed; ``x`` is any node on it. ``w -> x`` goes when its overlap is the
    smaller one.
    """
    step = single_out(graph.edges).select(F.col("src").alias("at"), F.col("dst").alias("to"))
    walk = step.select(F.col("at").alias("v"), F.col("to").alias("x"), F.array("at", "to").alias("seen"))
    for _ in range(max_ext - 1):
        ahead = step.select(F.col("at").alias("x"), "to")
        go = F.col("to").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("to")), F.lit(False))
        walk = walk.join(ahead, "x", "left").select(
            "v",
            F.when(go, F.col("to")).otherwise(F.col("x")).alias("x"),
            F.when(go, F.array_append("seen", F.col("to"))).otherwise(F.col("seen")).alias("seen"),
        )
    into = graph.edges.select(F.col("src").alias("w"), F.col("dst").alias("v"), F.col("overlap_len").alias("near"))
    past = graph.edges.select(F.col("src").alias("w"), F.col("dst").alias("x"), F.col("overlap_len").alias("far"))
    return (
        walk.select("v", F.explode("seen").alias("x"))
        .filter("v != x")
        .join(into, "v")
        .join(past, ["w", "x"])
        .filter("near > far")
        .select(F.col("w").alias("src"), F.col("x").alias("dst"))
        .distinct()
    )


def cut_biloops(graph: Graph, max_ext: int) -> Graph:
    return remove_edges(graph, biloop_edges(graph, max_ext))


__all__ = [
    "biloop_edges",
    "cut_biloops",
    "cut_internal_chains",
    "internal_chain_nodes",
    "mirror",
    "remove_multi_edges",
    "remove_short_edges",
    "remove_weak_edges",
    "short_edges",
    "weak_edges",
]
