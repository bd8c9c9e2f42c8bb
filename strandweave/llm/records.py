"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

File format, one file per task, records in ascending ``doc_id`` order over all files:

    record   = length (8 bytes) | masked crc of those 8 bytes (4) | payload | masked crc of payload (4)
    payload  = width (1 byte: 2 or 4) | ids, little-endian, of that width

All integers are little-endian and unsigned; a masked crc is the CRC-32 rotated right by 15
bits plus 0xa282ead8, as length-delimited record files commonly have it. ``width`` is 2 where
the vocabulary fits 16 bits.

The index is a Parquet table with one row per record. It is the commit: a task names its file
after its own attempt and returns the index rows, so files of lost or repeated attempts are
named by no row. Both live in the cluster's shared folder.

Null text counts as empty and gives one end id. Equal ids (and a null ``doc_id``, which comes
first) keep all their rows, ordered by a hash of the text. An empty table gives an empty index. Other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.common import filesystem, text_key
from strandweave.llm.wordpieces import encode_slices, encoder
from strandweave.plans.settle import shared_dir

_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_INDEX = (
    "doc_id bigint, shard string, shard_no int, seq bigint, offset bigint, size bigint, "
    "before bigint, n_tokens bigint"
)
#: bytes of neighbouring records read at once
_READ_AHEAD = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """Payload of the record at ``at`` and the place after it; raises on any damage."""
    if at + _HEAD.size > len(data):
        raise ValueError("record header is cut off")
    length, crc = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError("record length is damaged")
    start, end = at + _HEAD.size, at + _HEAD.size + length
    payload = data[start:end]
    if len(payload) != length or _TAIL.unpack_from(data, end)[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload, end + _TAIL.size


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    return bytes([width]) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unpack_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


@dataclass(frozen=True)
class Written:
    index: DataFrame
    folder: str


def write_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> Written:
    """Encode ``docs`` (``doc_id, text``), end each with ``end_id`` and write files and index."""
    spark = docs.sparkSession
    home = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex[:12]}"
    schema = _arrow(_INDEX)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(home)
        coder = encoder(vocabulary)
        width = 2 if coder.size <= 65536 and end_id < 65536 else 4
        last = np.array([end_id], dtype="<u4")
        no = TaskContext.get().partitionId()
        name = f"{no:06d}-{uuid.uuid4().hex}.rec"
        out, at, seq, before = None, 0, 0, 0
        try:
            for batch in batches:
                ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for start, coded in encode_slices(coder, texts):
                    rows = {n: [] for n in schema.names}
                    frames = []
                    for doc_id, raw in zip(ids_of[start : start + len(coded)], coded, strict=True):
                        ids = np.concatenate([np.frombuffer(raw, "<u4"), last])
                        framed = frame(pack_ids(ids, width))
                        frames.append(framed)
                        row = (doc_id, name, no, seq, at, len(framed), before, len(ids))
                        for column, value in zip(rows.values(), row, strict=True):
                            column.append(value)
                        at, seq, before = at + len(framed), seq + 1, before + len(ids)
                    if out is None:
                        fs.create_dir(f"{root}/shards", recursive=True)
                        out = fs.open_output_stream(f"{root}/shards/{name}")
                    out.write(b"".join(frames))
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
        finally:
            if out is not None:
                out.close()

    # rows of one id, null ids for example, are ordered by a hash, so that they fill as many tasks as they need
    order = [F.col("doc_id"), text_key()]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(write, _INDEX).write.parquet(f"{home}/index")
    return Written(spark.read.schema(_INDEX).parquet(f"{home}/index"), home)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_records(index: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Read the records the rows of ``index`` name, in any order, and check every frame.

    Gives ``doc_id, shard_no, before, n_tokens, ids_crc32``, with ``ids`` the array of ids as well. Rows
    that follow each other in a file are fetched together, a shuffled index record by record.
    """
    ddl = "doc_id bigint, shard_no int, before bigint, n_tokens bigint, ids_crc32 bigint" + (
        ", ids array<bigint>" if ids else ""
    )
    schema = _arrow(ddl)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        open_name, file = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = {n: [] for n in schema.names}
            at = 0
            while at < len(rows):
                first, end = rows[at], at + 1
                stop = first["offset"] + first["size"]
                while (
                    end < len(rows)
                    and rows[end]["shard"] == first["shard"]
                    and rows[end]["offset"] == stop
                    and stop - first["offset"] < _READ_AHEAD
                ):
                    stop += rows[end]["size"]
                    end += 1
                if first["shard"] != open_name:
                    if file is not None:
                        file.close()
                    open_name = first["shard"]
                    file = fs.open_input_file(f"{root}/shards/{open_name}")
                data = file.read_at(stop - first["offset"], first["offset"])
                place = 0
                for row in rows[at:end]:
                    payload, place = unframe(data, place)
                    found = unpack_ids(payload)
                    out["doc_id"].append(row["doc_id"])
                    out["shard_no"].append(row["shard_no"])
                    out["before"].append(row["before"])
                    out["n_tokens"].append(len(found))
                    out["ids_crc32"].append(zlib.crc32(found.tobytes()))
                    if ids:
                        out["ids"].append(found.tolist())
                at = end
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if file is not None:
            file.close()

    return index.mapInArrow(read, ddl)


def record_rows(written: Written) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, as read back from the files.

    ``start`` counts the ids of all records before: the place inside the file plus the ids of
    earlier files, of which there is one total per file.
    """
    totals = written.index.groupBy("shard_no").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("shard_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    rows = read_records(written.index, written.folder)
    return rows.join(shift, "shard_no").select(
        "doc_id", (F.col("before") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32"
    )


def shuffled(spark: SparkSession, written: Written, seed: int) -> DataFrame:
    """The index in a seeded random order, as a training reader would follow it."""
    return written.index.orderBy(F.xxhash64("shard", "seq", F.lit(seed)), "shard", "seq")
