"""Column functions on sequences, qualities, identities and node ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# fixed values: complement of each base letter, case folded, other letters kept
_BASES = "ATCGNatcgn"
_COMPLEMENTS = "TAGCNTAGCN"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), _BASES, _COMPLEMENTS)


def flip(nid: Column) -> Column:
    """The same read in the other orientation."""
    return nid.bitwiseXOR(F.lit(1).cast("bigint"))


@F.arrow_udf(LongType())
def phred_total(qual: pa.Array) -> pa.Array:
    """Sum of Phred scores (byte - 33, not below 0) of each string, one pass per batch.

    Scores stay single bytes, so a batch of long strings takes about its own size twice.
    """
    return phred_sums(qual)


def phred_sums(qual: pa.Array) -> pa.Array:
    qual = qual.cast(pa.large_string())
    offsets = np.frombuffer(qual.buffers()[1], dtype=np.int64)[qual.offset : qual.offset + len(qual) + 1]
    data = qual.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    scores = np.maximum(raw, 33) - np.uint8(33)
    at = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    # one string after the other: summed at once, all bytes would be widened first
    sums = [int(scores[a:b].sum(dtype=np.int64)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return pa.array(sums, type=pa.int64())


def mean_quality(qual: Column, length: Column) -> Column:
    """Arithmetic mean of Phred scores in single precision; null for an empty read."""
    total = phred_total(F.coalesce(qual, F.lit("")))
    return F.try_divide(total.cast("float"), length.cast("float")).cast("float")


def percent_identity(nmatch: Column, block_len: Column) -> Column:
    """Matches per block in percent, rounded to single precision after each step."""
    share = F.try_divide(nmatch.cast("float"), block_len.cast("float")).cast("float")
    return (share * F.lit(100.0).cast("float")).cast("float")


def single(value: float) -> float:
    """A Python float rounded to single precision and widened again."""
    return float(np.float32(value))


def region_key(name: Column, start: Column, end: Column) -> Column:
    return F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


_NODE_ID = r"^([^:]*):(\d+)-(\d+)([+-])$"


def node_id_parts(node_id: Column) -> dict[str, Column]:
    """Name, start, end, orientation and validity of ids of the form ``read:5-10+``."""

    def part(i: int) -> Column:
        return F.regexp_extract(node_id, _NODE_ID, i)

    start, end = part(2).try_cast("bigint"), part(3).try_cast("bigint")
    return {
        "read": part(1),
        "start": start,
        "end": end,
        "ori": part(4),
        "valid": F.coalesce(start < end, F.lit(False)),
    }
