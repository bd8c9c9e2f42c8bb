"""Alignment rows: filters, best row per read pair, interval depth, covered regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequence import percent_identity, single
from strandweave.params import Params
from strandweave.plans.ordering import prefix_sum


def reject_reason(params: Params) -> Column:
    """First failing test of an alignment row, or null when it passes all."""
    identity = percent_identity(F.col("nmatch"), F.col("block_len"))
    return (
        F.when(F.col("qname") == F.col("tname"), "self")
        .when(
            (F.col("qend") - F.col("qstart") < params.min_overlap_length)
            | (F.col("tend") - F.col("tstart") < params.min_overlap_length),
            "short",
        )
        .when(F.coalesce(identity < single(params.min_percent_identity), F.lit(True)), "identity")
    )


def passing(alignments: DataFrame, params: Params) -> DataFrame:
    return alignments.filter(reject_reason(params).isNull())


def filter_counts(alignments: DataFrame, params: Params) -> DataFrame:
    """Rows per outcome; a row counts only under the first test it fails."""
    reason = F.coalesce(reject_reason(params), F.lit("pass")).alias("reason")
    return alignments.groupBy(reason).agg(F.count("*").alias("n_rows"))


def _sides(passed: DataFrame) -> DataFrame:
    """Both reads of every alignment as rows (name, length, start, end, line_no)."""
    return passed.select(
        "line_no",
        F.explode(
            F.array(
                F.struct(
                    F.col("qname").alias("name"),
                    F.col("qlen").alias("length"),
                    F.col("qstart").alias("start"),
                    F.col("qend").alias("end"),
                ),
                F.struct(
                    F.col("tname").alias("name"),
                    F.col("tlen").alias("length"),
                    F.col("tstart").alias("start"),
                    F.col("tend").alias("end"),
                ),
            )
        ).alias("s"),
    ).select("s.*", "line_no")


def read_lengths(passed: DataFrame) -> DataFrame:
    """Each read with the length stated by its first row."""
    return _sides(passed).groupBy("name").agg(F.min_by("length", "line_no").alias("length"))


def best_per_pair(passed: DataFrame) -> DataFrame:
    """Longest block per unordered read pair, the earliest line among equals.

    An aggregate rather than a window: partial results combine before the shuffle, so a
    pair with very many rows never gathers in one task.
    """
    row = F.struct(*passed.columns)
    rank = F.struct(F.col("block_len"), -F.col("line_no"))
    return (
        passed.groupBy(
            F.least("qname", "tname").alias("_a"), F.greatest("qname", "tname").alias("_b")
        )
        .agg(F.max_by(row, rank).alias("r"))
        .select("r.*")
    )


def _depth_steps(intervals: DataFrame) -> DataFrame:
    """Positions where the depth changes: (name, pos, delta, running, next_pos)."""
    ends = intervals.select(
        "name",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("pos"), F.lit(1).cast("bigint").alias("delta")),
                F.struct(F.col("end").alias("pos"), F.lit(-1).cast("bigint").alias("delta")),
            )
        ).alias("e"),
    ).select("name", "e.*")
    steps = ends.groupBy("name", "pos").agg(F.sum("delta").alias("delta")).filter("delta != 0")
    return prefix_sum(steps, ["name"], "pos", "delta")


def interval_depth(intervals: DataFrame) -> DataFrame:
    """Run-length depth of ``intervals(name, start, end)``; runs of depth 0 are left out."""
    return (
        _depth_steps(intervals.filter("start < end"))
        .filter("running > 0")
        .select(
            "name",
            F.col("pos").alias("start"),
            F.col("next_pos").alias("end"),
            F.col("running").alias("depth"),
        )
    )


def _stretches(steps: DataFrame, above: int) -> DataFrame:
    """``(name, cov_start, cov_end)`` of every stretch with depth above ``above``."""
    before = F.col("running") - F.col("delta")
    rises = (before <= above) & (F.col("running") > above)
    falls = (before > above) & (F.col("running") <= above)
    # rises and falls alternate, so a stretch ends where the next crossing lies; a read has
    # at most as many crossings as bases, however many alignments it has
    stop = F.lead("pos").over(Window.partitionBy("name").orderBy("pos"))
    return (
        steps.filter(rises | falls)
        .withColumn("cov_end", stop)
        .filter(rises)
        .select("name", F.col("pos").alias("cov_start"), "cov_end")
    )


def _longest() -> Column:
    span = F.col("cov_end") - F.col("cov_start")
    return F.max_by(
        F.struct("cov_start", "cov_end"), F.when(span.isNotNull(), F.struct(span, -F.col("cov_start")))
    )


def covered_regions(intervals: DataFrame, above: int) -> DataFrame:
    """Longest stretch with depth strictly above ``above`` per name, and the maximum depth.

    The earliest of equally long stretches wins; names without one get (0, 0).
    """
    return _regions(intervals, above).drop("length")


def _regions(intervals: DataFrame, above: int, lengths: DataFrame | None = None) -> DataFrame:
    """One aggregate over stretches, depths and stated lengths instead of joins by name."""
    steps = _depth_steps(intervals.filter("start < end"))
    facts = _stretches(steps, above).unionByName(
        steps.select("name", F.col("running").alias("depth")), allowMissingColumns=True
    )
    if lengths is None:
        lengths = intervals.select("name").limit(0).withColumns(
            {"length": F.lit(0).cast("bigint"), "line_no": F.lit(0).cast("bigint")}
        )
    facts = facts.unionByName(lengths, allowMissingColumns=True)
    zero = F.lit(0).cast("bigint")
    return (
        facts.groupBy("name")
        .agg(
            F.min_by("length", "line_no").alias("length"),
            _longest().alias("r"),
            F.max("depth").alias("max_depth"),
        )
        .select(
            "name",
            "length",
            F.coalesce("r.cov_start", zero).alias("cov_start"),
            F.coalesce("r.cov_end", zero).alias("cov_end"),
            F.coalesce("max_depth", zero).alias("max_depth"),
        )
    )


def intervals_of(passed: DataFrame) -> DataFrame:
    """Aligned interval of each read in every passing row, also of non-best duplicates."""
    return _sides(passed).select("name", "start", "end")


def regions(passed: DataFrame, params: Params) -> DataFrame:
    """``regions(name, length, cov_start, cov_end, max_depth)`` of every registered read."""
    sides = _sides(passed)
    return _regions(
        sides.select("name", "start", "end"),
        params.min_overlap_count,
        sides.select("name", "length", "line_no"),
    )
