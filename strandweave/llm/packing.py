"""Pack documents into sequences of at most ``capacity`` tokens: linear grouping, then best fit.

Lengths are whole numbers up to ``capacity``, so the plan needs no more than one count per
length, whatever the size of the corpus:

1. Large pieces (over ``capacity / 6`` tokens), longest first, form ``groups`` groups of equal
   cardinality; in each, lengths are rounded up to its longest.
2. Column generation (Gilmore-Gomory) finds how often to use each configuration of those few
   sizes; whole multiples are taken, the rest of the demand goes to step 4.
3. Actual pieces replace the rounded ones, longest first, which leaves more room than planned.
4. Small pieces and the rest go, longest first, to the sequence with the least room that fits.

A plan is a list of runs: "pieces of this length, numbers a to b among their equals, go one by
one to sequences s, s+1, ... at this offset". Its size depends on ``capacity`` and ``groups``
alone. Each piece gets its number among equals from a running count inside its partition
plus the counts of earlier partitions, and then looks its run up.

Null text is an empty document, which still holds its end id. Repeated rows are packed as often as
they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import map_batches
from strandweave.llm.wordpieces import encode_slices, encoder
from strandweave.plans.settle import table

_PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
)
#: how many times smaller than a sequence a piece may be and still count as large
_LARGE = 6


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, ids: bool = False) -> DataFrame:
    """Tokenize, append ``end_id`` and cut. ``nth`` counts equal lengths within partition ``part``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = _PIECES + (", ids binary" if ids else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at, coded in encode_slices(coder, texts):
                rows: list[tuple] = []
                for doc_id, raw in zip(doc_ids[at : at + len(coded)], coded, strict=True):
                    raw += end
                    for i, (start, n) in enumerate(cuts(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + n)]
                        row = (doc_id, i, start, n, zlib.crc32(own), part, met[n])
                        rows.append((*row, own) if ids else row)
                        met[n] += 1
                columns = [list(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
                )

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """How often each configuration is used in an optimal fractional packing of few sizes."""
    k = len(sizes)
    width, need = np.array(sizes), np.array(demand, dtype=float)
    columns = [[capacity // s if i == j else 0 for i in range(k)] for j, s in enumerate(sizes)]
    inverse = np.diag([1.0 / columns[j][j] for j in range(k)])
    level = inverse @ need
    most = capacity // min(sizes)
    places = np.arange(capacity + 1)[None, :] - width[:, None]
    fits, places = places >= 0, np.maximum(places, 0)
    for _ in range(40 * k):
        price = inverse.sum(axis=0)
        # the most valuable configuration of at most `most` pieces, by number of pieces
        best, choice = np.zeros(capacity + 1), []
        for _ in range(most):
            value = np.where(fits, best[places] + price[:, None], 0.0)
            pick = value.argmax(axis=0)
            top = value[pick, np.arange(capacity + 1)]
            better = top > best + 1e-12
            choice.append(np.where(better, pick, -1))
            best = np.where(better, top, best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = [0] * k, capacity
        for pick in reversed(choice):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        step = inverse @ np.array(column, dtype=float)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= step[out]
        others = np.arange(k) != out
        inverse[others] -= step[others, None] * inverse[out]
        columns[out] = column
        level = np.maximum(inverse @ need, 0)
    return [(c, float(x)) for c, x in zip(columns, level, strict=True) if x > 1e-9]


class _Rooms:
    """Open sequences by the room they have left, as runs of neighbouring numbers."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def put(self, room: int, first: int, n: int) -> None:
        if not self.runs[room]:
            bisect.insort(self.rooms, room)
        self.runs[room].append((first, n))

    def tightest(self, length: int) -> int | None:
        at = bisect.bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.rooms[bisect.bisect_left(self.rooms, room)]
        return run


def plan(counts: dict[int, int], capacity: int, groups: int = 96) -> np.ndarray:
    """Runs ``(length, first number, pieces, first sequence, offset)`` for the pieces counted."""
    runs: list[tuple[int, int, int, int, int]] = []
    rooms, opened = _Rooms(), 0
    left: list[tuple[int, int, int]] = []  # (length, first number, pieces) for best fit
    large: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        if length == capacity:
            runs.append((length, 0, n, opened, 0))
            opened += n
        elif length * _LARGE > capacity:
            large.append((length, 0, n))
        else:
            left.append((length, 0, n))

    # 1. groups of equal cardinality, each a list of (length, first number, pieces)
    total = sum(n for _, _, n in large)
    target, grouped, filled = -(-total // groups) if total else 0, [], 0
    for length, first, n in large:
        while n:
            if not grouped or filled == target:
                grouped.append([])
                filled = 0
            m = min(n, target - filled)
            grouped[-1].append((length, first, m))
            first, n, filled = first + m, n - m, filled + m

    if grouped:
        sizes = [g[0][0] for g in grouped]
        demand = [sum(n for _, _, n in g) for g in grouped]
        # groups rounded to one size count as one for the configurations
        merged: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(sizes):
            merged[s].append(i)
        distinct = sorted(merged, reverse=True)
        queues = {s: [x for i in merged[s] for x in grouped[i]] for s in distinct}
        wanted = [sum(demand[i] for i in merged[s]) for s in distinct]
        # 2. and 3.
        chosen = configurations(distinct, wanted, capacity)
        for column, level in sorted(chosen, key=lambda c: -c[1]):
            slots = [s for s, c in zip(distinct, column, strict=True) for _ in range(c)]
            n = int(level + 1e-9)
            have = {s: sum(m for _, _, m in queues[s]) for s in set(slots)}
            n = min([n, *(have[s] // slots.count(s) for s in set(slots))])
            if n:
                taken = [_take(queues[s], n) for s in slots]
                _fill(taken, n, opened, capacity, runs, rooms)
                opened += n
        left += [x for s in distinct for x in queues[s]]

    # 4. best fit, longest first
    left.sort(key=lambda x: (-x[0], x[1]))
    for length, first, n in left:
        while n:
            room = rooms.tightest(length)
            if room is None:
                m = -(-n // (capacity // length))
                rooms.put(capacity, opened, m)
                opened += m
                room = capacity
            start, wide = rooms.take(room)
            each = room // length
            full = min(wide, n // each)
            if full:
                for j in range(each):
                    runs.append((length, first + j * full, full, start, capacity - room + j * length))
                first, n = first + each * full, n - each * full
                if room - each * length:
                    rooms.put(room - each * length, start, full)
                if wide > full:
                    rooms.put(room, start + full, wide - full)
            else:  # fewer pieces than one sequence takes
                for j in range(n):
                    runs.append((length, first + j, 1, start, capacity - room + j * length))
                if room - n * length:
                    rooms.put(room - n * length, start, 1)
                if wide > 1:
                    rooms.put(room, start + 1, wide - 1)
                n = 0
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _take(queue: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The first ``n`` pieces of a group's queue."""
    taken = []
    while n:
        length, first, have = queue[0]
        m = min(n, have)
        taken.append((length, first, m))
        if m == have:
            queue.pop(0)
        else:
            queue[0] = (length, first + m, have - m)
        n -= m
    return taken


def _fill(taken, n: int, opened: int, capacity: int, runs: list, rooms: _Rooms) -> None:
    """Place one piece of each slot in ``n`` new sequences; neighbours with equal lengths form a run."""
    edges = {0, n}
    for slot in taken:
        at = 0
        for _, _, m in slot:
            at += m
            edges.add(at)
    cut = sorted(edges)
    for a, b in zip(cut, cut[1:], strict=False):
        offset = 0
        for slot in taken:
            at = 0
            for length, first, m in slot:
                if at <= a < at + m:
                    runs.append((length, first + a - at, b - a, opened + a, offset))
                    offset += length
                    break
                at += m
        if capacity - offset:
            rooms.put(capacity - offset, opened + a, b - a)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    groups: int = 96,
    ids: bool = False,
) -> DataFrame:
    """Where each piece goes: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    With ``ids`` the pieces carry their ids as little-endian unsigned 32-bit bytes too.
    """
    spark = docs.sparkSession
    rows = table(pieces(docs, vocabulary, capacity, end_id, ids), "pieces")
    per_part = table(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most one row per length
    counted = per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()
    runs = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in counted}, capacity, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    named = rows.join(base, ["length", "part"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])
    ddl = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
        + (", ids binary" if ids else "")
        + ", sequence_id bigint, offset bigint"
    )

    def place(batch: dict[str, list]) -> dict[str, list]:
        known = runs.value
        length = np.array(batch["length"], dtype=np.int64)
        number = np.array(batch["nth"], dtype=np.int64) + np.array(batch["base"], dtype=np.int64)
        key = known[:, 0] * (1 << 48) + known[:, 1]
        at = np.searchsorted(key, length * (1 << 48) + number, side="right") - 1
        found = known[at] if len(at) else known[:0]
        return {c: batch[c] for c in kept} | {
            "sequence_id": found[:, 3] + number - found[:, 1],
            "offset": found[:, 4],
        }

    return map_batches(named.select(*kept, "nth", "base"), place, ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)`` from ``pack(..., ids=True)``; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return grouped.select("sequence_id", "n_tokens", F.expr("transform(parts, p -> p.ids)").alias("ids"))
