"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

1. Each task counts the words of its documents and gives its counts on whenever ``_FLUSH`` different
   words are held; sums over all tasks make the vocabulary.
2. Every word's bits go into a blocked Bloom filter of its length (eight lanes of 64 bits, one bit in each). Blocks
   are merged by ``bit_or`` on the cluster. A filter has about ``bits`` bits a word, a power of two of blocks. Lengths are taken
   in batches of at most ``batch_bytes``, and a length above that in several parts by hash, so a
   broadcast is bounded whatever the vocabulary and each part only sees its own probes.
3. Every word is changed by each deletion, and by each replacement with a greater letter of the corpus' own;
   insertions and the other replacements are the same pairs seen from the other side. Hashes of the changed words follow
   from the word's by arithmetic, and only those whose bits are all set are spelled out.
4. These meet the vocabulary by an equality join on the text, which drops the filters' false
   positives. A pair counts for both its words.
5. ``root`` follows ``form`` by pointer doubling; n at least doubles on each step, so six joins do.

A word is near at most some 50 letters times its length of others, so no group is larger, and counts of a frequent word are combined
before they are shuffled. Null and empty texts have no words; a null id writes nothing before the colon. Repeated
rows count as often as they occur. A table without words gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.settle import settle, table

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FLUSH = 200_000
_LANES = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
_PROBES = 1 << 20


def document_words(doc_id: int | None, text: str | None) -> Counter[str]:
    """The words of one document after its own deletions, with their number."""
    if not text:
        return Counter()
    # bytes are lowered in A-Z alone
    runs = Counter(_RUN.findall(text.encode().lower().decode()))
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    words: Counter[str] = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if not h % 97:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        words[run] += n
    return words


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """``(word, n)`` over all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= least_length]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"]
            )

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                for word, n in document_words(ids[i].as_py(), texts[i].as_py()).items():
                    held[word] = held.get(word, 0) + n
                if len(held) >= _FLUSH:
                    yield given()
                    held.clear()
        yield given()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    counts = rows.mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(_BASE)
        out = np.multiply.accumulate(out)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of ``words`` (code points of words of one length), not yet mixed."""
    return (words + np.uint64(1)) @ _powers(words.shape[1])[::-1]


def _masks(h: np.ndarray) -> np.ndarray:
    """One bit in each of the eight lanes, as (n, 8)."""
    picks = _mixed(h ^ np.uint64(0xD6E8FEB86659FD93))[:, None] >> (np.arange(_LANES, dtype=np.uint64) * np.uint64(6))
    return np.uint64(1) << (picks & np.uint64(63))


class Filter:
    """The part of one length's blocked Bloom filter that holds hashes of ``part`` among ``parts``."""

    def __init__(self, blocks: int, parts: int, part: int) -> None:
        self.blocks, self.parts, self.part = blocks, parts, part
        self.lanes = np.zeros((blocks, _LANES), np.uint64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` that may be in the filter; none of what it holds is missed."""
        mixed = _mixed(hashes)
        at = np.arange(len(mixed))
        if self.parts > 1:
            at = np.flatnonzero(mixed >> np.uint64(40) & np.uint64(self.parts - 1) == np.uint64(self.part))
            mixed = mixed[at]
        rows = (mixed & np.uint64(self.blocks - 1)).astype(np.int64)
        masks = _masks(mixed)
        first = np.flatnonzero(self.lanes[rows, 0] & masks[:, 0])
        rest = self.lanes[rows[first]] & masks[first]
        return at[first[(rest == masks[first]).all(axis=1)]]


def _power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def filter_plan(lengths: dict[int, int], bits: int, batch_bytes: int) -> list[list[tuple[int, int, int, int]]]:
    """Batches of ``(length, blocks, parts, part)`` from the number of words by length."""
    batches: list[list[tuple[int, int, int, int]]] = []
    size = batch_bytes
    for length, n in sorted(lengths.items()):
        blocks = _power_of_two(n * bits / (64 * _LANES))
        parts = _power_of_two(blocks * 8 * _LANES / batch_bytes)
        for part in range(parts):
            cost = blocks // parts * 8 * _LANES
            if size + cost > batch_bytes:
                batches.append([])
                size = 0
            batches[-1].append((length, max(1, blocks // parts), parts, part))
            size += cost
    return batches


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Deletions and replacements by greater letters of ``words``, all of one length.

    Yields ``(length, word number, place, new code point or 0, hash)``, at most about ``_PROBES`` at once
    and no more than one place of one word beyond.
    """
    m = len(words[0])
    step = max(1, _PROBES // (m * (len(alphabet) + 1)))
    places = max(1, _PROBES // (len(alphabet) + 1))
    powers = _powers(m)
    for a in range(0, len(words), step):
        points = np.stack([_points(w) for w in words[a : a + step]]) + np.uint64(1)
        terms = points * powers[::-1]
        whole = terms.sum(axis=1, dtype=np.uint64)
        # without place i: what stands before has one power less, what follows stays
        prefix = np.zeros((len(points), m), np.uint64)
        if m > 1:
            prefix[:, 0] = 0
            shorter = points[:, :-1] * powers[: m - 1][::-1]
            prefix[:, 1:] = np.add.accumulate(shorter, axis=1)
        suffix = whole[:, None] - np.add.accumulate(terms, axis=1)
        for b in range(0, m, places):
            e = min(m, b + places)
            n = np.repeat(np.arange(len(points)) + a, e - b)
            at = np.tile(np.arange(b, e), len(points))
            # equal neighbours give the same word when either is left out
            same = np.zeros((len(points), e - b), bool)
            lo = max(b, 1)
            same[:, lo - b :] = points[:, lo:e] == points[:, lo - 1 : e - 1]
            kept = ~same.ravel()
            yield m - 1, n[kept], at[kept], np.zeros(kept.sum(), np.uint64), (prefix + suffix)[:, b:e].ravel()[kept]
            old = points[:, b:e, None] - np.uint64(1)
            greater = alphabet[None, None, :] > old
            w, i, c = np.nonzero(greater)
            letter = alphabet[c]
            change = (letter - old[w, i, 0]) * powers[m - 1 - (i + b)]
            yield m, w + a, i + b, letter, whole[w] + change


def near_pairs(words: DataFrame, bits: int = 16, batch_bytes: int = 16 << 20) -> DataFrame:
    """``(word, n, near, near_n)`` for every two words of ``words (word, n)`` one edit apart, both ways round."""
    spark = words.sparkSession
    # one row for each length and one for each letter: code points are 117 at most here
    lengths = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint64)
    found = None
    for number, batch in enumerate(filter_plan(lengths, bits, batch_bytes)):
        shards: dict[int, list[tuple[int, int, int]]] = {}
        for length, blocks, parts, part in batch:
            shards.setdefault(length, []).append((blocks, parts, part))

        def bits_of(batches: Iterable[pa.RecordBatch], shards=shards) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                groups: dict[int, list[str]] = {}
                for word in rows.column(0).to_pylist():
                    groups.setdefault(len(word), []).append(word)
                for length, group in groups.items():
                    mixed = _mixed(np.concatenate([
                        _hashes(np.stack([_points(w) for w in group[i : i + max(1, _PROBES // length)]]))
                        for i in range(0, len(group), max(1, _PROBES // length))
                    ]))
                    masks = _masks(mixed)
                    for blocks, parts, part in shards.get(length, ()):
                        mine = mixed >> np.uint64(40) & np.uint64(parts - 1) == np.uint64(part)
                        at = (mixed[mine] & np.uint64(blocks - 1)).astype(np.int64)
                        lanes = masks[mine].view(np.int64)
                        n = len(at)
                        columns = [np.full(n, length), np.full(n, part), at, *lanes.T]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns],
                            ["length", "part", "at", *[f"l{i}" for i in range(_LANES)]],
                        )

        schema = "length bigint, part bigint, at bigint, " + ", ".join(f"l{i} bigint" for i in range(_LANES))
        named = words.filter(F.length("word").isin(list(shards))).select("word")
        merged = named.mapInArrow(bits_of, schema).groupBy("length", "part", "at").agg(
            *[F.expr(f"bit_or(l{i})").alias(f"l{i}") for i in range(_LANES)]
        )
        filters: dict[tuple[int, int], Filter] = {
            (length, part): Filter(blocks, parts, part) for length, v in shards.items() for blocks, parts, part in v
        }
        for r in table(merged, f"filter-{number}").toLocalIterator():  # batch_bytes at most
            filters[r["length"], r["part"]].lanes[r["at"]] = np.array(r[3:], np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(filters)

        def probe(batches: Iterable[pa.RecordBatch], shared=shared, shards=shards) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, list[Filter]] = {}
            for (length, _), f in shared.value.items():
                by_length.setdefault(length, []).append(f)
            for rows in batches:
                groups: dict[int, list[int]] = {}
                all_words, counts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for i, word in enumerate(all_words):
                    groups.setdefault(len(word), []).append(i)
                for length, group in groups.items():
                    if length not in by_length and length - 1 not in by_length:
                        continue
                    out: tuple[list, list, list] = ([], [], [])
                    for to, n, at, letter, hashes in edits([all_words[i] for i in group], alphabet):
                        for f in by_length.get(to, ()):
                            for k in f.may_hold(hashes).tolist():
                                row, i = group[n[k]], int(at[k])
                                word = all_words[row]
                                new = chr(int(letter[k])) if to == length else ""
                                out[0].append(word)
                                out[1].append(counts[row])
                                out[2].append(word[:i] + new + word[i + 1 :])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                        ["word", "n", "near"],
                    )

        longer = [*shards, *[k + 1 for k in shards]]
        asked = words.filter(F.length("word").isin(longer)).select("word", "n")
        positives = table(asked.mapInArrow(probe, "word string, n bigint, near string"), f"positives-{number}")
        shared.unpersist()
        found = positives if found is None else found.unionByName(positives)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    held = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found.join(held, "near")
    both = F.explode(
        F.array(
            F.struct("word", "n", "near", "near_n"),
            F.struct(
                F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
            ),
        )
    )
    return pairs.select(both.alias("p")).select("p.*")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs (doc_id, text)``."""
    words = table(vocabulary(docs), "words")
    # of equal n the smallest near word: the greatest of (n, -order) is the least of (-n, word)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    pairs = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(pairs, "word", "left")
    leads = -F.col("best.m") >= 2 * F.col("n")
    forms = table(
        joined.select(
            "word",
            F.when(leads, F.col("best.w")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(leads, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    hops = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = hops.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved, seen = settle(
            hops.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("on")),
            "roots",
            moved=F.count_if("on"),
        )
        hops = moved.select("word", "root")
        if not seen["moved"]:
            break
    return forms.join(hops, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
