"""Distributed numbering, cuts and prefix sums: no window ever sees a whole table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from strandweave.plans.settle import settle, table

_FANOUT = 1024


def with_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the 0-based rank of each row in ``order`` (a total order) as ``name``.

    Rows are range-partitioned and sorted; only the per-partition row counts, one row
    per shuffle partition, are accumulated in one place.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    ranged = table(ranged, f"index-{name}")
    sizes = ranged.groupBy("_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        ranged.join(shift, "_part")
        .withColumn(name, F.col("_seq") + F.col("_shift"))
        .drop("_part", "_seq", "_shift")
    )


def weighted_cut(df: DataFrame, key: Column, weight: Column, target: int) -> tuple[int, int] | None:
    """Smallest key at which the running sum of ``weight`` in key order reaches ``target``.

    Returns that key and the sum before it, or None when the total stays below
    ``target``. Each round aggregates into at most 1024 buckets and narrows to the one
    that crosses, so only bounded histograms reach the driver.
    """
    rows = df.select(key.cast("bigint").alias("k"), weight.cast("bigint").alias("w"))
    lo, hi, total = rows.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if total is None or total < target:
        return None
    before = 0
    while lo < hi:
        width = -(-(hi - lo + 1) // _FANOUT)
        bucket = F.expr(f"(k - ({lo})) div {width}")
        found = (
            rows.filter(F.col("k").between(lo, hi))
            .groupBy(bucket.cast("bigint").alias("b"))
            .agg(F.sum("w").alias("w"))
            .collect()
        )
        for b, w in sorted((r["b"], r["w"]) for r in found):
            if before + w >= target:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            before += w
    return lo, before


def prefix_sum(
    df: DataFrame, keys: list[str], pos: str, value: str, span: int = 4096, levels: int = 2
) -> DataFrame:
    """Add ``running`` (inclusive sum of ``value`` by ``pos``) and ``next_pos`` per key.

    ``(keys, pos)`` must be unique. A key may be arbitrarily long: positions are cut into blocks of ``span``, the
    blocks' sums into blocks of blocks, and so on for ``levels``; a window runs inside one block or, at the top, over one
    row for each ``span ** levels`` positions.
    """
    return _scanned(df, [*keys], pos, value, pos, span, levels).withColumnRenamed("_head", "next_pos")


def _scanned(df: DataFrame, keys: list[str], pos: str, value: str, head: str, span: int, levels: int) -> DataFrame:
    """Add ``running`` and ``_head``, the ``head`` of the key's next row."""
    level = f"_{levels}"
    block, total, first, local, after = (f"{n}{level}" for n in ("_blk", "_sum", "_first", "_local", "_after"))
    if not levels:
        over = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumn(
            "running", F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, 0))
        ).withColumn("_head", F.lead(head).over(over))
    inside = Window.partitionBy(*keys, block).orderBy(pos)
    rows = (
        df.withColumn(block, F.floor(F.col(pos) / F.lit(span)).cast("bigint"))
        .withColumn(local, F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(after, F.lead(head).over(inside))
    )
    # taken from the windowed rows, whose partitioning this aggregate can reuse
    blocks = rows.groupBy(*keys, block).agg(F.sum(value).alias(total), F.min_by(head, pos).alias(first))
    above = _scanned(blocks, keys, block, total, first, span, levels - 1)
    carry = above.select(*keys, block, (F.col("running") - F.col(total)).alias("_carry"), "_head")
    return (
        rows.join(carry, [*keys, block])
        .withColumn("running", F.col(local) + F.col("_carry"))
        .withColumn("_head", F.coalesce(after, "_head"))
        .drop(block, local, after, "_carry")
    )


def running(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``key`` that come before in ``order``.

    ``key`` and ``value`` must not be null. One key may hold any share of the rows: they are range
    partitioned by key and order, each task streams over its sorted rows with one number carried, and
    a key that goes on in a later partition is continued by one carry row there. As partitions are
    ranges, only the first key of a partition can have a carry, so there are fewer carries than
    partitions, however many rows and keys there are. Rows that ``order`` leaves equal follow each other in any order.
    """
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    target = StructType([*df.schema.fields, StructField("_part", LongType()), StructField(name, LongType())])
    arrow = to_arrow_schema(target)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(key).dictionary_encode()
            runs = codes.indices.to_numpy(zero_copy_only=False)
            sizes = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            base = np.repeat(before[starts], np.diff(np.append(starts, len(runs))))
            before = before - base
            keys = codes.dictionary
            if keys[runs[0]].as_py() == last:
                before[: starts[1] if len(starts) > 1 else len(runs)] += carry
            last, carry = keys[runs[-1]].as_py(), int(before[-1] + sizes[-1])
            columns = [*batch.columns, pa.array(np.full(len(runs), part)), pa.array(before)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    done = table(ranged.mapInArrow(scan, target), f"running-{name}")
    sums = done.groupBy("_part", key).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.select("_part", key, F.sum("_sum").over(earlier).alias("_carry")).filter("_carry > 0")
    return (
        done.join(F.broadcast(carries), ["_part", key], "left")
        .withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0)))
        .drop("_part", "_carry")
    )


__all__ = ["prefix_sum", "running", "settle", "weighted_cut", "with_index"]
