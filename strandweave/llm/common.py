"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.plans.settle import settle

#: words as the contracts define them: runs without space, tab, LF, VT, FF and CR
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """A-Z to a-z, everything else as it is."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


def slices(batch: pa.RecordBatch, rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and, a row being the least, about ``size`` bytes."""
    start = 0
    while start < batch.num_rows:
        n = min(rows, batch.num_rows - start)
        while n > 1 and batch.slice(start, n).nbytes > size:
            n = -(-n // 2)
        yield batch.slice(start, n)
        start += n


def map_batches(
    df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list] | None], schema: str
) -> DataFrame:
    """Apply ``rows`` (columns in, columns out) to slices of each Arrow batch of every partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = rows(part.to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.mapInArrow(run, schema)


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder all executors share (local, HDFS, S3, GCS)."""
    return pafs.FileSystem.from_uri(uri)


def text_key() -> Column:
    """What tells rows of one id apart: a hash of the text, null as the empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_rows(docs: DataFrame, named: DataFrame, label: str, key: Column | None = None, most: int = 100_000) -> DataFrame:
    """Rows of ``docs`` that ``named (doc_id, text_key, kept)`` keeps; of rows equal in both keys, null ids included, one.

    ``key`` is the text's key as ``named`` has it. The names of what goes are written first, so their number is
    known: up to ``most``, some 100 bytes each, are broadcast and the texts stay where they are, more are joined by a shuffle.
    """
    own = next(n for n in map("_text_key{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    keyed = docs.withColumn(own, text_key() if key is None else key)

    def by(names: DataFrame, rows: int, how: str) -> DataFrame:
        names = F.broadcast(names) if rows <= most else names
        same = keyed["doc_id"].eqNullSafe(names["doc_id"]) & (keyed[own] == names["text_key"])
        return keyed.join(names, same, how)

    dropped, n = settle(named.filter(~F.col("kept")).select("doc_id", "text_key").distinct(), f"{label}-dropped")
    copies = named.filter("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    doubled, m = settle(copies.drop("n"), f"{label}-doubled")
    kept = by(dropped.unionByName(doubled), n["rows"] + m["rows"], "left_anti")
    if m["rows"]:
        kept = kept.unionByName(by(doubled, m["rows"], "left_semi").dropDuplicates(["doc_id", own]))
    return kept.drop(own)
