"""Weakly connected components by alternating large-star and small-star steps
(Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.graph import Graph, delete_reads
from strandweave.plans.settle import settle


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u != v")
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. All pairs have u > v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    others = pairs.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _lowest_next(pairs: DataFrame) -> DataFrame:
    """``(u, m)``: every node with the smallest of itself and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _moved(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """Pairs between the nodes that ``low(u, m)`` sends their ends to."""
    ends = pairs.join(low.withColumnRenamed("m", "a"), "u").join(low.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
    return ends.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(graph: Graph) -> DataFrame:
    """``(nid, comp)``: every node, also dangling edge targets, with its component's smallest node.

    Only minima are grouped, so a node linked to a third of the graph is a partial
    aggregate and a splittable join key, never a collected list. The loop ends when a round
    leaves the pair set unchanged (row count and hash fingerprint).

    Before the loop every node is replaced by its smallest neighbour, as long as that halves the pairs: neighbours stay
    connected and a component keeps its smallest node, so the rounds rewrite far fewer rows.
    """
    pairs = (
        graph.edges.filter("src != dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    mark = F.bit_xor(F.xxhash64("u", "v"))
    pairs, seen = settle(pairs, "star", mark=mark)
    sent, halved = [], bool(seen["rows"])
    while halved:
        low, before = settle(_lowest_next(pairs), "lowest")[0], seen["rows"]
        pairs, seen = settle(_moved(pairs, low), "star", mark=mark)
        sent.append(low)
        halved = 0 < seen["rows"] <= before // 2
    while seen["rows"]:
        previous = (seen["rows"], seen.get("mark"))
        pairs, seen = settle(_small_star(_large_star(pairs)), "star", mark=mark)
        if (seen["rows"], seen.get("mark")) == previous:
            break
    linked = pairs.select(F.col("u").alias("nid"), F.col("v").alias("comp"))
    for low in reversed(sent):
        linked = low.join(linked.withColumnRenamed("nid", "m"), "m", "left").select(
            F.col("u").alias("nid"), F.coalesce("comp", "m").alias("comp")
        )
    everyone = graph.nodes.select("nid").unionByName(
        graph.edges.select(F.explode(F.array("src", "dst")).alias("nid"))
    ).distinct()
    return everyone.join(linked, "nid", "left").select("nid", F.coalesce("comp", "nid").alias("comp"))


def component_sizes(parts: DataFrame) -> DataFrame:
    """Number of nodes per component, largest first."""
    return (
        parts.groupBy("comp")
        .agg(F.count("*").alias("n_nodes"))
        .orderBy(F.desc("n_nodes"), "comp")
    )


def small_component_nodes(parts: DataFrame, min_nodes: int = 2) -> DataFrame:
    small = parts.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") < min_nodes)
    return parts.join(small, "comp", "left_semi").select("nid")


def isolated_nodes(graph: Graph) -> DataFrame:
    """Nodes alone in their component: exactly those no edge touches."""
    touched = graph.edges.select(F.explode(F.array("src", "dst")).alias("nid")).distinct()
    return graph.nodes.select("nid").join(touched, "nid", "left_anti")


def small_components(graph: Graph, min_nodes: int = 2) -> DataFrame:
    """Nodes in components of fewer than ``min_nodes`` oriented nodes.

    For the default of 2 an anti-join answers the question without the component loop.
    """
    if min_nodes <= 2:
        return isolated_nodes(graph)
    return small_component_nodes(components(graph), min_nodes)


def remove_small_components(graph: Graph, min_nodes: int = 2) -> Graph:
    """Delete small components in both orientations."""
    return delete_reads(graph, small_components(graph, min_nodes))
