"""Read filtering, depth budgets and genome-size estimation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import mean_quality
from strandweave.params import Params
from strandweave.plans.ordering import weighted_cut
from strandweave.plans.settle import table


def read_stats(reads: DataFrame) -> DataFrame:
    """``(rec_no, name, len, mean_q)``; lengths in bytes, qualities as arithmetic mean."""
    length = F.octet_length("seq").cast("bigint")
    return reads.select("rec_no", "name", length.alias("len"), mean_quality(F.col("qual"), length).alias("mean_q"))


def filter_reads(stats: DataFrame, params: Params = Params()) -> DataFrame:
    return stats.filter(
        (F.col("len") >= params.min_read_length)
        & (F.col("mean_q") >= F.lit(params.min_base_quality).cast("float"))
    )


def longest_cut(stats: DataFrame, budget: int) -> tuple[int, int] | None:
    """Length and ``rec_no`` of the last read of ``longest_within``; None where all reads are taken."""
    by_length = table(stats.groupBy("len").agg((F.count("*") * F.col("len")).alias("bases")), "lengths")
    cut = weighted_cut(by_length, -F.col("len"), F.col("bases"), max(budget, 1))
    if cut is None:
        return None
    length, before = -cut[0], cut[1]
    wanted = -(-(max(budget, 1) - before) // length)
    tied = stats.filter(F.col("len") == length)
    return length, weighted_cut(tied, F.col("rec_no"), F.lit(1), wanted)[0]


def within_cut(cut: tuple[int, int] | None, length: str = "len", rec_no: str = "rec_no") -> Column:
    """Whether a read is not behind ``longest_cut``."""
    if cut is None:
        return F.lit(True)
    return (F.col(length) > cut[0]) | ((F.col(length) == cut[0]) & (F.col(rec_no) <= cut[1]))


def longest_within(stats: DataFrame, budget: int) -> DataFrame:
    """Longest reads first, up to and including the one whose running total reaches ``budget``.

    Equal lengths follow ``rec_no``; at least one read is taken. The cut is found on a
    histogram of lengths and then, inside the one length where it falls, on a histogram of
    record numbers, so no task ever sorts the reads.
    """
    cut = longest_cut(stats, budget)
    return stats if cut is None else stats.filter(within_cut(cut))


def select_reads(reads: DataFrame, chosen: DataFrame, on: str = "rec_no") -> DataFrame:
    return reads.join(chosen.select(on), on, "left_semi")


def coverage_estimate(alignments: DataFrame) -> DataFrame:
    """``(total_bases, total_aligned, coverage, genome_size)`` from all alignment rows.

    Query lengths count once per read, as stated by its first row.
    """
    per_read = alignments.groupBy("qname").agg(
        F.min_by("qlen", "line_no").alias("qlen"), F.sum(F.col("qend") - F.col("qstart")).alias("aligned")
    )
    coverage = F.try_divide(F.col("total_aligned").cast("double"), F.col("total_bases").cast("double"))
    return (
        per_read.agg(F.sum("qlen").alias("total_bases"), F.sum("aligned").alias("total_aligned"))
        .withColumn("coverage", coverage)
        .withColumn(
            "genome_size",
            F.floor(F.try_divide(F.col("total_bases").cast("double"), F.col("coverage"))).cast("bigint"),
        )
    )


def depth_sample(reads: DataFrame, genome_size: int, coverage: float, ticket, tickets: int) -> DataFrame:
    """Keep each read with probability ``genome_size * coverage / total bases``.

    ``ticket`` is a column of numbers in ``[0, tickets)`` that depends on the read alone, so
    the sample is the same whatever the partitioning. Fails on empty input.
    """
    total = reads.agg(F.sum("len")).first()[0]
    if not total:
        raise ValueError("no bases to sample from")
    share = min(1.0, genome_size * coverage / total)
    return reads.filter(ticket < F.lit(share * tickets))


def name_ticket(name: str = "name", seed: int = 0):
    """A repeatable ticket in ``[0, 2**30)`` per read name; use with ``tickets=2**30``."""
    return F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(1 << 30))


__all__ = [
    "coverage_estimate",
    "depth_sample",
    "filter_reads",
    "longest_cut",
    "longest_within",
    "name_ticket",
    "read_stats",
    "select_reads",
    "within_cut",
]
