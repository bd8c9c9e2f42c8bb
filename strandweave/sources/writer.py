"""A text sink that lays stretches of one line next to each other.

A line may be many rows: a row with ``open`` set has no line end, the next row goes on in its line. Rows are range-partitioned by
their place in the file, each task writes its own stretch of the file, and the part files in their order are the
file. So a line of any length passes through as many tasks as its bases need.

A task writes to a file of its attempt; the driver names the files of the attempts that count when all are done, so a lost
executor or a task that ran twice leaves no part behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_TEMPORARY = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    size: int


class StretchWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._folder()
        task = TaskContext.get()
        name = f"{folder}/{_TEMPORARY}/{self.run}/{task.partitionId():06d}-{task.taskAttemptId()}"
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        size = 0
        with system.open_output_stream(name) as out:
            for batch in iterator:
                for value, more in zip(batch.column("value"), batch.column("open").to_pylist()):
                    line = (value.as_py() or "").encode() + (b"" if more else b"\n")
                    out.write(line)
                    size += len(line)
        return Written(task.partitionId(), name, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for number, message in enumerate(m for m in done if m.size):
            system.move(message.name, f"{folder}/part-{number:06d}.txt")
        system.open_output_stream(f"{folder}/_SUCCESS").close()
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, system: pafs.FileSystem, folder: str) -> None:
        own = f"{folder}/{_TEMPORARY}"
        if system.get_file_info(own).type != pafs.FileType.NotFound:
            system.delete_dir(own)


class StretchSink(DataSource):
    """``df.write.format("strandweave_stretches")`` for rows ``(value, open)`` in their order."""

    @classmethod
    def name(cls) -> str:
        return "strandweave_stretches"

    def schema(self) -> str:
        return "value string, open boolean"

    def writer(self, schema, overwrite: bool) -> StretchWriter:
        return StretchWriter(self.options["path"])


def write_stretches(rows: DataFrame, path: str, order: list[str]) -> None:
    """Write ``rows (value, open, ...)`` sorted by ``order`` as one text over part files; ``path`` must be new."""
    rows.sparkSession.dataSource.register(StretchSink)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value", "open")
    placed.write.format("strandweave_stretches").mode("append").save(path)
