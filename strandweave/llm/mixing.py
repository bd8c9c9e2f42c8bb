"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sources, ordered by code point with null last, weigh ``weights`` in turn. They share ``share`` times
   all words; a source stops at ``epochs`` times its own words and the excess goes to the others by weight.
2. A source is one run of words, its documents in ascending ``doc_id``, cut into blocks of ``block``
   words (the last may be shorter). Blocks are the seats: a source's votes are its target in blocks, and seats go
   to the highest quotients votes / (2 k + 1), never more than ``epochs`` times the source's blocks.
   The lowest quotient that gets a seat is found by aggregates over one row for each source; equal
   quotients go to the smaller source.
3. A source's seats are dealt to its shards of ``shard`` blocks by the same rule, with blocks as votes. As all
   shards but the last are equal, a shard's quota follows from four numbers by arithmetic, so a source with
   a third of all rows needs no step of its own.
4. A shard with quota q and n blocks takes every block q div n times, and q mod n blocks once more: those
   that a seeded hash of source, shard and block puts first. A document takes what its words take.

So a source's taken words differ from its target by a block or two, no document passes ``epochs`` times its
words, and equal input and seed give equal rows, whatever the partitioning. Null and empty texts have size 0 and take 0.
Rows of equal id and source are ordered by size, so repeated rows are interchangeable. A table without rows
gives none, one without words has targets of 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandweave.plans.ordering import running, with_index
from strandweave.plans.settle import table

WEIGHTS = (5, 2, 1)
_OUT = "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"
_PROBES = 32


def filled(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """Add ``target`` to ``sources (weight, size, ...)``: the common level times weight, at most ``epochs * size``.

    The level only rises from round to round, each round is one aggregate of one row.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= epochs * F.col("size")
        stopped, spent, weight = sources.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, epochs * F.col("size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if stopped == full or not weight:
            break
        full, level = stopped, (share * total - spent) / weight
    return sources.withColumn(
        "target", F.least((epochs * F.col("size")).cast("double"), F.col("weight") * F.lit(level))
    )


def _seats(votes: Column, cap: Column, scale: float) -> Column:
    """Seats at 1 / ``scale`` votes for a seat: the quotients votes / (2 k + 1) from 1 / (2 * scale) up."""
    return F.least(F.floor(votes * F.lit(scale) + F.lit(0.5)).cast("bigint"), cap)


def apportioned(parties: DataFrame, votes: str, cap: str, seats: int, order: str) -> DataFrame:
    """Add ``quota``: ``seats`` dealt to the highest quotients votes / (2 k + 1), at most ``cap`` each."""
    v, c = F.col(votes), F.col(cap)

    def dealt(scales: list[float]) -> list[int]:
        return [n or 0 for n in parties.agg(*[F.sum(_seats(v, c, s)) for s in scales]).first()]

    low, high = 0.0, 2.0
    while dealt([high])[0] < seats:
        if dealt([high * 2])[0] == dealt([high * 1e6])[0]:  # all seats there are have been dealt
            return parties.withColumn("quota", _seats(v, c, high * 2))
        low, high = high, high * 2
    while True:
        scales = sorted({low + (high - low) * i / (_PROBES + 1) for i in range(1, _PROBES + 1)} - {low, high})
        if not scales:
            break
        for scale, n in zip(scales, dealt(scales)):
            if n <= seats:
                low = scale
            if n == seats:
                return parties.withColumn("quota", _seats(v, c, scale))
            if n > seats:
                high = scale
                break
    if dealt([high])[0] == seats:
        return parties.withColumn("quota", _seats(v, c, high))
    # equal quotients: between neighbouring scales a party gains its tied seat, in ``order``
    sure = parties.withColumn("quota", _seats(v, c, low))
    left = seats - dealt([low])[0]
    tied = sure.filter(_seats(v, c, high) > F.col("quota")).select(order)
    more = with_index(tied, [order], "_place").filter(F.col("_place") < left)
    return sure.join(more, order, "left").withColumn(
        "quota", F.col("quota") + F.when(F.col("_place").isNull(), 0).otherwise(1)
    ).drop("_place")


def shard_quota(quota: int, blocks: int, shard: int, index: int, epochs: int) -> int:
    """Seats of shard ``index`` when ``quota`` seats go to a source's shards, votes being their blocks."""
    full = (blocks - 1) // shard
    if not full:
        return quota
    rest = blocks - full * shard

    def before(k: int) -> int:
        """Seats dealt before the last shard's seat ``k``: its own, and the others' of no lower quotient."""
        return k + full * ((shard * (2 * k + 1) + rest) // (2 * rest))

    low, high = 0, quota + 1
    while low < high:
        mid = (low + high) // 2
        if before(mid) < quota:
            low = mid + 1
        else:
            high = mid
    last = max(min(low, epochs * rest), quota - epochs * full * shard)
    if index == full:
        return last
    return (quota - last) // full + (index < (quota - last) % full)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_turns(tree: str, index: int, blocks: int, shard: int, quota: int, epochs: int, seed: int) -> np.ndarray:
    """How often each block of one shard is taken."""
    n = min(shard, blocks - index * shard)
    every, more = divmod(shard_quota(quota, blocks, shard, index, epochs), n)
    turns = np.full(n, every, np.int64)
    key = (zlib.crc32(tree.encode()) << 32 | zlib.crc32(f"{seed}:{index}".encode())) + np.arange(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        ranks = _mixed(_mixed(key.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    turns[np.argsort(ranks, kind="stable")[:more]] += 1
    return turns


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    block: int = 16,
    shard: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs (doc_id, source, text)``."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = table(
        docs.select(
            F.coalesce(F.concat(F.lit("+"), "source"), F.lit(",")).alias("tree"),  # "," sorts after "+"
            F.col("doc_id").cast("bigint").alias("doc_id"),
            words.cast("bigint").alias("size"),
        ),
        "sizes",
    )
    sums = rows.groupBy("tree").agg(F.sum("size").alias("size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = with_index(sums, ["tree"], "place").withColumn("weight", turn).drop("place")
    sources = table(filled(table(ranked, "weights"), share, epochs), "targets")
    sources = sources.withColumn("blocks", F.ceil(F.col("size") / block).cast("bigint")).withColumn(
        "votes", F.when(F.col("size") > 0, F.col("target") * F.col("blocks") / F.col("size")).otherwise(0.0)
    )
    seats = round(sources.agg(F.sum("votes")).first()[0] or 0)
    dealt = apportioned(sources.withColumn("cap", epochs * F.col("blocks")), "votes", "cap", seats, "tree")
    dealt = table(
        dealt.select("tree", F.col("size").alias("source_size"), "target", "blocks", "quota"), "quotas"
    )
    placed = running(rows, "tree", ["doc_id", "size"], "size", "start").join(dealt, "tree")
    arrow = to_arrow_schema(StructType.fromDDL(_OUT))

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns_of = lru_cache(256)(
            lambda tree, index, blocks, quota: block_turns(tree, index, blocks, shard, quota, epochs, seed)
        )
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("tree", "start", "size", "blocks", "quota")}
            taken = []
            for tree, start, size, blocks, quota in zip(*c.values()):
                words, end = 0, start + size
                while start < end:
                    index = start // (block * shard)
                    base = index * shard * block
                    stop = min(end, base + block * shard)
                    first, last = (start - base) // block, (stop - 1 - base) // block
                    turns = turns_of(tree, index, blocks, quota)
                    words += int(turns[first : last + 1].sum()) * block
                    words -= int(turns[first]) * (start - base - first * block)
                    words -= int(turns[last]) * (base + (last + 1) * block - stop)
                    start = stop
                taken.append(words)
            columns = [batch.column(k) for k in ("doc_id", "size", "source_size", "target")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken, pa.int64())], schema=arrow)

    return placed.mapInArrow(take, _OUT)
