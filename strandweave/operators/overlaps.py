"""Classify best alignments and derive the overlap rows of the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import percent_identity, region_key, single
from strandweave.operators import alignments as aln
from strandweave.params import Params
from strandweave.plans.settle import table

INTERNAL, FIRST_IN, SECOND_IN, SHORT, PROPER = (
    "internal",
    "first_contained",
    "second_contained",
    "too_short",
    "proper",
)


def _with_regions(best: DataFrame, regions: DataFrame) -> DataFrame:
    def side(letter: str) -> DataFrame:
        return regions.select(
            F.col("name").alias(f"{letter}name"),
            F.col("cov_start").alias(f"{letter}cs"),
            F.col("cov_end").alias(f"{letter}ce"),
        )

    return best.join(side("q"), "qname").join(side("t"), "tname")


def _clipped(coords: str) -> dict[str, Column]:
    """Start and end on both reads after clipping to the covered regions."""
    c = F.col
    plus = c("strand") == "+"
    if coords == "observed":
        # clipped, but still counted from the start of the whole read
        return {
            "qs": F.greatest("qstart", "qcs"),
            "qe": F.least("qend", "qce"),
            "ts": F.greatest("tstart", "tcs"),
            "te": F.least("tend", "tce"),
        }
    # trim both reads by the same amount at each end, then count from the region start
    zero = F.lit(0).cast("bigint")
    t_low = F.greatest(zero, c("tcs") - c("tstart"))
    t_high = F.greatest(zero, c("tend") - c("tce"))
    left = F.greatest(zero, c("qcs") - c("qstart"), F.when(plus, t_low).otherwise(t_high))
    right = F.greatest(zero, c("qend") - c("qce"), F.when(plus, t_high).otherwise(t_low))
    return {
        "qs": c("qstart") + left - c("qcs"),
        "qe": c("qend") - right - c("qcs"),
        "ts": c("tstart") + F.when(plus, left).otherwise(right) - c("tcs"),
        "te": c("tend") - F.when(plus, right).otherwise(left) - c("tcs"),
    }


def classify(best: DataFrame, regions: DataFrame, params: Params) -> DataFrame:
    """Add ``class`` and the strand-normalised coordinates b1,e1,l1,b2,e2,l2."""
    c = F.col
    plus = c("strand") == "+"
    clip = _clipped(params.coords)
    l1, l2 = c("qce") - c("qcs"), c("tce") - c("tcs")
    # generated as one row, which keeps the optimizer from copying these expressions into
    # every later use of them
    spot = F.struct(
        clip["qs"].alias("b1"),
        clip["qe"].alias("e1"),
        l1.alias("l1"),
        F.when(plus, clip["ts"]).otherwise(l2 - clip["te"]).alias("b2"),
        F.when(plus, clip["te"]).otherwise(l2 - clip["ts"]).alias("e2"),
        l2.alias("l2"),
    )
    both = _with_regions(best, regions)
    placed = both.select(*both.columns, F.inline(F.array(spot)))
    head1, head2 = c("b1"), c("b2")
    tail1, tail2 = c("l1") - c("e1"), c("l2") - c("e2")
    span1, span2 = c("e1") - c("b1"), c("e2") - c("b2")
    overhang = F.least(head1, head2) + F.least(tail1, tail2)
    allowed = F.ceil(
        F.greatest(span1, span2).cast("double") * F.lit(single(params.overhang_ratio))
    ).cast("bigint")
    label = (
        F.when(overhang > allowed, INTERNAL)
        .when((head1 <= head2) & (tail1 <= tail2), FIRST_IN)
        .when((head1 >= head2) & (tail1 >= tail2), SECOND_IN)
        .when(F.least(span1, span2) + overhang < params.min_overlap_length, SHORT)
        .otherwise(PROPER)
    )
    return placed.withColumn("class", label)


def overlap_edges(classified: DataFrame) -> DataFrame:
    """One row per proper overlap: the edge, its mirror edge and both lengths."""
    c = F.col
    q_key = region_key(c("qname"), c("qcs"), c("qce"))
    t_key = region_key(c("tname"), c("tcs"), c("tce"))
    against = F.when(c("strand") == "+", "-").otherwise("+")
    q_plus, q_minus = F.concat(q_key, F.lit("+")), F.concat(q_key, F.lit("-"))
    t_same, t_other = F.concat(t_key, c("strand")), F.concat(t_key, against)
    query_first = c("b1") > c("b2")
    lead = c("b1") - c("b2")
    trail = (c("l2") - c("e2")) - (c("l1") - c("e1"))
    sign = F.when(query_first, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    return classified.filter(c("class") == PROPER).select(
        "qname",
        "tname",
        F.when(query_first, q_plus).otherwise(t_same).alias("source"),
        F.when(query_first, t_same).otherwise(q_plus).alias("sink"),
        F.when(query_first, t_other).otherwise(q_minus).alias("rc_source"),
        F.when(query_first, q_minus).otherwise(t_other).alias("rc_sink"),
        (sign * lead).alias("edge_len"),
        (sign * trail).alias("rc_edge_len"),
        F.greatest(c("e1") - c("b1"), c("e2") - c("b2")).alias("overlap_len"),
        percent_identity(c("nmatch"), c("block_len")).cast("double").alias("identity"),
    )


def contained_reads(classified: DataFrame) -> DataFrame:
    """Reads that any alignment shows to lie inside another read."""
    return (
        classified.filter(F.col("class").isin(FIRST_IN, SECOND_IN))
        .select(
            F.when(F.col("class") == FIRST_IN, F.col("qname"))
            .otherwise(F.col("tname"))
            .alias("name")
        )
        .distinct()
    )


def low_depth_reads(regions: DataFrame, params: Params) -> DataFrame:
    return regions.filter(F.col("max_depth") < params.min_overlap_count).select("name")


def drop_reads(overlaps: DataFrame, names: DataFrame) -> DataFrame:
    """Overlaps that touch none of ``names``."""
    return overlaps.join(
        names.select(F.col("name").alias("qname")), "qname", "left_anti"
    ).join(names.select(F.col("name").alias("tname")), "tname", "left_anti")


def keep_overlaps(classified: DataFrame, regions: DataFrame, params: Params) -> DataFrame:
    unwanted = contained_reads(classified).unionByName(low_depth_reads(regions, params)).distinct()
    return drop_reads(overlap_edges(classified), unwanted).select(*OVERLAP_COLUMNS)


OVERLAP_COLUMNS = [
    "qname",
    "tname",
    "source",
    "sink",
    "rc_source",
    "rc_sink",
    "edge_len",
    "rc_edge_len",
    "overlap_len",
    "identity",
]


def reads_in_overlaps(overlaps: DataFrame) -> DataFrame:
    """Number of different reads named by the overlaps."""
    names = overlaps.select(F.explode(F.array("qname", "tname")).alias("name"))
    return names.agg(F.countDistinct("name").alias("n_reads"))


@dataclass(frozen=True)
class Filtered:
    """Result of the whole filtering stage."""

    overlaps: DataFrame
    regions: DataFrame
    classified: DataFrame


def filter_alignments(alignments: DataFrame, params: Params = Params()) -> Filtered:
    """Alignments to overlaps: one lazy plan up to the covered regions, which are settled
    because both classification sides and the depth rule read them."""
    passed = aln.passing(alignments, params)
    regions = table(aln.regions(passed, params), "regions")
    classified = classify(aln.best_per_pair(passed), regions, params)
    return Filtered(keep_overlaps(classified, regions, params), regions, classified)
