"""Graph and contig statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.chains import chain_table
from strandweave.operators.graph import Graph, degrees
from strandweave.plans.ordering import weighted_cut


def degree_histogram(graph: Graph) -> DataFrame:
    """``(direction, degree, n_nodes)`` for in- and out-degrees, zero included."""
    return (
        degrees(graph)
        .select(
            F.explode(
                F.array(
                    F.struct(F.lit("in").alias("direction"), F.col("n_in").alias("degree")),
                    F.struct(F.lit("out").alias("direction"), F.col("n_out").alias("degree")),
                )
            ).alias("d")
        )
        .groupBy("d.direction", "d.degree")
        .agg(F.count("*").alias("n_nodes"))
    )


def compressible_fraction(graph: Graph) -> DataFrame:
    """Share of nodes with one edge in and one out; 0.0 on an empty graph."""
    simple = (F.col("n_in") == 1) & (F.col("n_out") == 1)
    return (
        degrees(graph)
        .agg(F.count_if(simple).alias("n_compressible"), F.count("*").alias("n_nodes"))
        .withColumn(
            "fraction",
            F.coalesce(
                F.try_divide(F.col("n_compressible").cast("double"), F.col("n_nodes").cast("double")),
                F.lit(0.0),
            ),
        )
    )


def branching_topk(graph: Graph, k: int) -> DataFrame:
    """The ``k`` branching nodes with most edges, smaller node first among equals."""
    return (
        degrees(graph)
        .filter("n_in > 1 or n_out > 1")
        .orderBy(F.desc(F.col("n_in") + F.col("n_out")), "nid")
        .limit(k)
    )


def tip_lengths(graph: Graph, max_walk: int = 1000) -> DataFrame:
    """``(nid, length)``: edges walked from each node without in-edges while the way is single.

    The walk covers the node's chain, plus one step when its last node has a single
    out-edge into a node with several in-edges; it is cut off at ``max_walk``.
    """
    deg = degrees(graph)
    chains = chain_table(graph).nodes.join(deg, "nid")
    return (
        chains.groupBy("head")
        .agg(
            F.max("pos").alias("steps"),
            F.max_by("n_out", "pos").alias("last_out"),
            F.min_by("n_in", "pos").alias("first_in"),
        )
        .filter("first_in = 0")
        .select(
            F.col("head").alias("nid"),
            F.least(
                F.col("steps") + F.when(F.col("last_out") == 1, 1).otherwise(0),
                F.lit(max_walk).cast("bigint"),
            ).alias("length"),
        )
    )


def largest(contigs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest ``length`` per group; 0 on empty input without groups."""
    if keys:
        return contigs.groupBy(*keys).agg(F.max("length").alias("largest"))
    return contigs.agg(F.coalesce(F.max("length"), F.lit(0).cast("bigint")).alias("largest"))


def n50(contigs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Smallest ``length`` in the longest-first prefix that holds half of all bases; 0 on
    empty input without groups.

    Without groups the length is found on bounded histograms; with groups rows are first counted
    per length, so a window runs over the distinct lengths of its group only.
    """
    if not keys:
        total = contigs.agg(F.sum("length")).first()[0] or 0
        cut = weighted_cut(contigs, -F.col("length"), F.col("length"), (total + 1) // 2) if total else None
        found = -cut[0] if cut else 0
        return contigs.sparkSession.range(1).select(F.lit(found).cast("bigint").alias("n50"))
    counts = contigs.groupBy(*keys, "length").agg((F.count("*") * F.col("length")).alias("bases"))
    group = Window.partitionBy(*keys)
    down = group.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.select(
        *keys,
        "length",
        F.sum("bases").over(down).alias("so_far"),
        F.sum("bases").over(group).alias("total"),
    ).filter(F.col("so_far") * 2 >= F.col("total"))
    return reached.groupBy(*keys).agg(F.max("length").alias("n50"))
