"""Text files as byte ranges that begin and end with a record, so that no text is shuffled.

A file is cut into ranges of some bytes. A first pass counts the lines (for FASTA also the headers) that begin in each
range; their sums say which line begins first in a range, and so, for records of four lines, where its
first record begins, whatever letters the lines begin with. A range is read from there and beyond its end until its last record is
whole. Only one row for each range passes between the tasks.

Files are opened by ``pyarrow.fs`` (local, HDFS, S3, GCS). A compressed file (``.gz``, ``.bz2``, ``.zst``) is one range, read from its
beginning, so it should be one of many parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandweave.plans.settle import shared_dir

RANGE_BYTES = 128 << 20
_CHUNK = 4 << 20
_LEAST_CHUNK = 64 << 10
# small ranges are read together by one task: enough tasks for a cluster, but none that has next to nothing to read
_TASKS = 64
_TASK_BYTES = 1 << 20, 32 << 20
_ROWS = 20_000
_HIDDEN = ("_", ".")

_SCHEMAS = {
    "counts": "text string, file string, start bigint, stop bigint, n_lines bigint, n_headers bigint",
    "lines": "file string, line_no bigint, value string",
    "records": "file string, rec bigint, header string, seq string, plus string, qual string",
    "contigs": "file string, contig bigint, length bigint",
}
_TYPES = {"string": pa.string(), "bigint": pa.int64()}


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes ``start`` to ``stop`` of a file, with the lines and headers that begin before, and the path (a file or the
    folder of its parts) it was found by."""

    file: str
    start: int
    stop: int
    line: int = 0
    header: int = 0
    text: str = ""


@dataclass(frozen=True)
class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: tuple[Range, ...]


def _together(ranges: list[Range]) -> list[Ranges]:
    """Neighbouring ranges in tasks of at least some bytes; a larger range has its own task."""
    least, most = _TASK_BYTES
    wanted = min(max(sum(r.stop - r.start for r in ranges) // _TASKS, least), most)
    tasks, held, size = [], [], 0
    for part in ranges:
        held.append(part)
        size += part.stop - part.start
        if size >= wanted:
            tasks.append(Ranges(tuple(held)))
            held, size = [], 0
    return [*tasks, Ranges(tuple(held))] if held or not tasks else tasks


def _opened(file: str):
    system, path = pafs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def _compressed(file: str) -> bool:
    return file.endswith((".gz", ".bz2", ".zst"))


def _unzipped_lines(file: str) -> Iterator[bytes]:
    system, path = pafs.FileSystem.from_uri(file)
    with system.open_input_stream(path, compression="detect") as f:
        held: list[bytes] = []
        while data := f.read(_CHUNK):
            first, *more = data.split(b"\n")
            held.append(first)
            if more:
                for line in (b"".join(held), *more[:-1]):
                    yield line[:-1] if line.endswith(b"\r") else line
                held = more[-1:]
        if line := b"".join(held):
            yield line[:-1] if line.endswith(b"\r") else line


def _qualified(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path, without those that Spark hides, with their sizes."""
    uri = _qualified(path)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, inner = pafs.FileSystem.from_uri(uri)
    prefix = uri[: len(uri) - len(inner)]
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(inner))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(_HIDDEN))


def lines_from(part: Range) -> Iterator[bytes]:
    """The lines that begin in a range, without their ends, then those after it as long as they are asked for.

    The first yield of a line that begins behind the range is preceded by a None.
    """
    if _compressed(part.file):
        yield from _unzipped_lines(part.file)
        return
    # a small range reads no more than about its own bytes
    step = min(max(part.stop - part.start + 1, _LEAST_CHUNK), _CHUNK)
    with _opened(part.file) as f:
        size = f.size()
        at = max(part.start - 1, 0)
        f.seek(at)
        data, place = f.read(step), at  # ``place`` is the offset of data[0]
        cursor = 0
        if part.start > 0:  # the rest of a line that began before
            while True:
                end = data.find(b"\n", cursor)
                if end >= 0:
                    cursor = end + 1
                    break
                place += len(data)
                data, cursor = f.read(step), 0
                if not data:
                    return
        told = False
        while place + cursor < size:
            if not told and place + cursor >= part.stop:
                told = True
                yield None
            end = data.find(b"\n", cursor)
            if end < 0:
                parts = [data[cursor:]]
                while end < 0:
                    place += len(data)
                    data, cursor = f.read(step), 0
                    if not data:
                        break
                    end = data.find(b"\n")
                    parts.append(data if end < 0 else data[:end])
                line = b"".join(parts)
                cursor = end + 1 if end >= 0 else 0
            else:
                line, cursor = data[cursor:end], end + 1
            yield line[:-1] if line.endswith(b"\r") else line
            if not data:
                return


def _own_lines(part: Range) -> Iterator[bytes]:
    for line in lines_from(part):
        if line is None:
            return
        yield line


def _records(part: Range) -> Iterator[tuple]:
    """Records of four lines whose first line begins in the range; a file's last one may lack lines."""
    number, inside, held = part.line, True, []
    for line in lines_from(part):
        if line is None:
            inside = False
            if not held:
                return
            continue
        if held or number % 4 == 0:
            if not held and not inside:
                return
            held.append(line.decode())
            if len(held) == 4:
                yield (part.file, number // 4, *held)
                held = []
                if not inside:
                    return
        number += 1
    if held:
        yield (part.file, (number - 1) // 4, *held, *[None] * (4 - len(held)))


def _contigs(part: Range) -> Iterator[tuple]:
    """Bases of each contig in the lines of the range; a contig may go on in the next range. Bases before a file's first
    header have contig 0."""
    contig, length = part.header, 0
    for line in _own_lines(part):
        line = line.strip()
        if line.startswith(b">"):
            if length:
                yield part.file, contig, length
            contig, length = contig + 1, 0
        else:
            length += len(line.decode())
    if length:
        yield part.file, contig, length


def _counts(part: Range) -> Iterator[tuple]:
    n = headers = 0
    for line in _own_lines(part):
        n += 1
        headers += line.lstrip().startswith(b">")
    yield part.text, part.file, part.start, part.stop, n, headers


def _lines(part: Range) -> Iterator[tuple]:
    for i, line in enumerate(_own_lines(part)):
        yield part.file, part.line + i, line.decode()


_READ = {"counts": _counts, "lines": _lines, "records": _records, "contigs": _contigs}


class RangeReader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.options = kind, dict(options)

    def partitions(self) -> list[Ranges]:
        if self.kind != "counts":
            system, path = pafs.FileSystem.from_uri(_qualified(self.options["ranges"]))
            rows = pq.read_table(path, filesystem=system).to_pylist()
            rows.sort(key=lambda r: (r["file"], r["start"]))
            return _together([Range(r["file"], r["start"], r["stop"], r["line"], r["header"]) for r in rows])
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        found = []
        for path in self.options["paths"].split("\n"):
            for file, length in _files(path):
                step = max(length, 1) if _compressed(file) else size
                found += [Range(file, a, min(a + step, length), text=path) for a in range(0, length, step)]
        return _together(found)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in _SCHEMAS[self.kind].split(", ")]
        schema = pa.schema([(n, _TYPES[t]) for n, t in fields])
        rows: list[tuple] = []
        held = 0
        for row in (row for part in partition.ranges for row in _READ[self.kind](part)):
            rows.append(row)
            held += sum(len(v) for v in row if isinstance(v, str))
            if len(rows) == _ROWS or held > 4 * _CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class RangeSource(DataSource):
    """``spark.read.format("strandweave_ranges")`` with the options ``kind``, ``paths`` and ``ranges``."""

    @classmethod
    def name(cls) -> str:
        return "strandweave_ranges"

    def schema(self) -> str:
        return _SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["kind"], self.options)


def _read(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    spark.dataSource.register(RangeSource)
    return spark.read.format("strandweave_ranges").options(kind=kind, **options).load()


def read_ranges(
    spark: SparkSession, path: str | list[str], kind: str, range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``lines (file, line_no, value)``, ``records (file, rec, header, seq, plus, qual)`` or ``contigs (file, contig,
    length)`` of text files, and the counts ``(text, file, start, n_lines, n_headers)`` of their ranges. Numbers count from
    0 in each file, contigs from 1; a contig can have a row for each range. ``text`` is the given path a file belongs to.

    The counts are written to the session's shared folder, where the second pass finds them.
    """
    paths = "\n".join([path] if isinstance(path, str) else path)
    counts = _read(spark, "counts", paths=paths, rangeBytes=str(range_bytes))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = f"{shared_dir(spark)}/strandweave-ranges-{uuid.uuid4().hex}"
    counts.select(
        "text", "file", "start", "stop", "n_lines", "n_headers",
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("line"),
        F.coalesce(F.sum("n_headers").over(before), F.lit(0)).alias("header"),
    ).write.parquet(ranges)
    return _read(spark, kind, ranges=ranges), spark.read.parquet(ranges).select("text", "file", "start", "n_lines", "n_headers")
