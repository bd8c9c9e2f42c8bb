"""Exact n-gram Jaccard join in the metric space of Jaccard distances.

A text is the set of its five-word shingles; texts with distance at most ``radius`` link. Almost
all distances are 1, so pivots drawn from all sets would tell nothing: every set would lie on every
boundary. Pivots are therefore drawn where sets agree:

1. *Regions.* Of a set of n shingles any n - ceil(0.8 n) + 1 hold one that a set within the radius
   has too. Each set names that many, rare ones first, and sets that name the same shingle form a
   region. Which shingles are frequent is counted over all batches; it only decides the order
   and so the size of regions, never which pairs are found.
2. *First pivots.* The member with the fewest rare shingles is its region's first pivot; what is within the radius of
   it is one component with it.
3. *Voronoi cells.* A region above ``_CELL`` members that is not one component is cut by ``_PIVOTS`` of its members: each member's
   home is the cell of the nearest one, and it is replicated into every cell whose pivot is farther by no more than
   the triangle inequality allows for a set within the radius. Any two sets within the radius so meet in a
   home of one of them. Cells are cut again like regions; a region whose cells would hold more than
   twice its members, as its members are all equally far from each other, stays as it is.
4. *Joins.* Regions and cells are joined in rounds of more and more pivots, until each pair was a pivot's pair once; pairs of one
   component need no test, and links of a round join components for the next one.

Distances in 2 to 4 are compared on parity sketches of 1024 bits: the bits in which two sketches
differ are a metric of their own, and at least one shingle each that only one set has. Pairs of long sets are then compared on
sketches as long as the sets. What the sketches do not exclude is measured exactly, on the whole sets. So no pair of texts within the radius is lost, and a region of near
copies costs a few pairs a member. Equal sets are one member. Sets are named by 64 bits; where two sets of
one name differ in a second hash of 64 bits, their names are made from that one.

Texts without words, null texts included, have the empty set and no links. Fewer than five words are
one shingle. Repeated rows and repeated ids are rows of their own; a component's id is its smallest
``doc_id`` that is not null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import keep_rows, map_batches, text_key
from strandweave.operators.components import components
from strandweave.operators.graph import Graph, nodes_of
from strandweave.plans.settle import settle, table

_U = np.uint64
WORDS = 5
#: 64-bit words of a parity sketch
_SKETCH = 16
_BITS = [f"s{i}" for i in range(_SKETCH)]
#: sets above this size also have a sketch of about as many bits as they have shingles
_LONG = 1500
#: pivots of the first round of joins, and how many times as many each further one has
_FIRST, _MORE = 32, 16
#: members above which a region is cut into cells, and pivots that cut it
_CELL, _PIVOTS = 4096, 8
#: members of one join key: larger regions are joined block by block
_BLOCK = 4096
#: the most frequent shingles that are told to all tasks, 16 bytes each
_TOLD = 1 << 18
#: sets whose texts are looked up by a broadcast of their ids, some 32 bytes each
_ASKED = 250_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(2026).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(size, _BASE, dtype=_U)
    down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = 1 << max(12, int(len(raw) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    if not text:
        return np.zeros(0, dtype=_U)
    words = word_hashes(text)
    width = min(WORDS, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    joined = words[:n].copy()
    for i in range(1, width):
        joined = joined * _STEP + words[i : i + n]
    return np.unique(mix(joined + _U(width)))


def digest(found: np.ndarray, seed: int = 0) -> int | None:
    return xxhash.xxh3_64_intdigest(found.tobytes(), seed) - (1 << 63) if len(found) else None


def name_of(found: np.ndarray, clashing: frozenset[int]) -> int | None:
    """The set's name: its digest, or a second one where other sets have that digest too."""
    own = digest(found)
    return digest(found, 1) if own in clashing else own


def sketch(found: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles falls to i. Bits in which two sketches differ need at
    least one shingle each that only one set has."""
    odd = np.bincount((found % _U(64 * _SKETCH)).astype(np.int64), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def long_sketch(found: np.ndarray) -> bytes | None:
    """The same with about as many bits as the set has shingles, of long sets alone."""
    if len(found) <= _LONG:
        return None
    bits = 1 << (len(found) - 1).bit_length()
    odd = np.bincount((found % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def differing(left: bytes, right: bytes) -> int:
    """Bits in which two long sketches differ; the longer one is folded to the shorter one's bits."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def apart(left: str, right: str) -> str:
    """SQL: the bits in which the sketches of two sides differ."""
    return " + ".join(f"bit_count({left}.{b} ^ {right}.{b})" for b in _BITS)


def named(found: np.ndarray, frequent: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles a set names, rare ones first, then by how often they are met (``n``), and how
    many rare ones it has."""
    at = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    common = frequent[at] == found if len(frequent) else np.zeros(len(found), dtype=bool)
    rare, most = found[~common], len(found) + percent * len(found) // -100 + 1
    if len(rare) >= most:
        return rare[:most], len(rare)
    often = found[common][np.argsort(n[at[common]], kind="stable")]
    return np.concatenate([rare, often[: most - len(rare)]]), len(rare)


_FREQUENT = np.int32(1 << 30)
_KNOWN = "doc_id bigint, text_key bigint, n_shingles bigint, digest bigint, second bigint, " + ", ".join(
    f"{b} bigint" for b in _BITS
) + ", long binary, met bigint"


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, second, s0..., met``: a row for each document, digests and sketch null
    for the empty set, and, with ``met``, one for each shingle (``digest``) that stands in
    ``met`` > 1 different sets of a batch."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        n = len(batch["doc_id"])
        out: dict[str, list] = {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "met": [None] * n}
        out |= {k: [] for k in ("n_shingles", "digest", "second", "long", *_BITS)}
        different: dict[int, np.ndarray] = {}
        for text in batch["text"]:
            found = shingles(text)
            own = digest(found)
            out["n_shingles"].append(len(found))
            out["digest"].append(own)
            out["second"].append(digest(found, 1))
            out["long"].append(long_sketch(found))
            bits = sketch(found).tolist() if own is not None else [None] * _SKETCH
            for name, value in zip(_BITS, bits):
                out[name].append(value)
            if own is not None:
                different[own] = found
        if different:
            value, count = np.unique(np.concatenate(list(different.values())), return_counts=True)
            value, count = value[count > 1], count[count > 1]
            out["digest"] += value.view(np.int64).tolist()
            out["met"] += count.tolist()
            for name in ("doc_id", "text_key", "n_shingles", "second", "long", *_BITS):
                out[name] = out[name] + [None] * len(value)
        return out

    return map_batches(docs.select("doc_id", "text", text_key().alias("text_key")), rows, _KNOWN)


def frequent_shingles(known: DataFrame, n_docs: int, share: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles met most often, with how often: those in at least every ``share``-th set and in 8 sets,
    or, where more than ``_TOLD`` are, in so many more sets that no more are left."""
    counts = known.filter(F.col("met").isNotNull()).groupBy("digest").agg(F.sum("met").alias("n"))
    least = max(8, n_docs // share)
    counts = table(counts.filter(F.col("n") >= least), "frequent")
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # 64 rows at most
    told, power = 0, 64
    for size in sorted(sizes, reverse=True):
        told += size["count"]
        if told > _TOLD:
            break
        power = size["power"]
    rows = counts.filter(F.col("n") >= float(2**power)).toPandas()
    value, n = rows["digest"].to_numpy(dtype=np.int64).view(_U), rows["n"].to_numpy(dtype=np.int64)
    order = np.argsort(value)
    return value[order], n[order]


def _region_rows(docs: DataFrame, percent: int, shared, clashing: frozenset[int]) -> DataFrame:
    """``key, rare, digest`` for each set a task meets, once; ``shared`` is a broadcast of the frequent shingles."""
    names = ["key", "rare", "digest"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            size = 0
            texts = batch.column("text")
            for i in range(len(texts)):
                found = shingles(texts[i].as_py())
                own = name_of(found, clashing)
                if own is not None and own not in met:
                    if len(met) < 1_000_000:  # more copies than that only cost rows
                        met.add(own)
                    keys, rare = named(found, *shared.value, percent)
                    columns[0].append(keys.view(np.int64))
                    # above _FREQUENT in the region of a frequent shingle
                    columns[1].append(rare + _FREQUENT * (np.arange(len(keys), dtype=np.int32) >= rare))
                    columns[2].append(np.full(len(keys), own, dtype=np.int64))
                    size += len(keys)
                if size and (size > 200_000 or i + 1 == len(texts)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)
                    columns, size = ([], [], []), 0

    return docs.select("text").mapInArrow(run, "key bigint, rare int, digest bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """``key, digest, rare, pivot`` of the regions with at least two members, the pivot the first by
    rare shingles.

    Rows come sorted, so a region of any size passes as a stream.
    """
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("rare", pa.int32()), ("pivot", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row: key, digest, pivot, given out, rare
        for batch in batches:
            key = np.asarray(batch.column("key"))
            name = np.asarray(batch.column("digest"))
            rare = np.asarray(batch.column("rare"))
            waiting = False
            pivot_before = None
            if held is not None and len(key):
                same = held[0] == key[0]
                waiting = same and not held[3]
                pivot_before = held[2] if same else None
                key = np.concatenate([[held[0]], key])
                name = np.concatenate([[held[1]], name])
                rare = np.concatenate([[held[4]], rare]).astype(np.int32)
            if not len(key):
                continue
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
            key, name, rare = key[fresh], name[fresh], rare[fresh]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(first) - 1
            size = np.bincount(group)
            pivot = name[first][group]
            if pivot_before is not None:
                pivot[group == 0] = pivot_before
            out = size[group] > 1
            if held is not None:
                carried = held[3]
                if carried and pivot_before is not None:
                    out[group == 0] = True
                if not waiting:
                    out[0] = False  # given out before, or alone in its region
            last_group = group[-1]
            given = bool(out[-1]) or bool(
                held is not None and held[3] and last_group == 0 and pivot_before is not None
            )
            held = (int(key[-1]), int(name[-1]), int(pivot[-1]), given, int(rare[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[out]) for x in (key, name, rare, pivot)], schema=schema
                )

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "rare", "digest")
    return sorted_rows.mapInArrow(run, "key bigint, digest bigint, rare int, pivot bigint")


def _regions(shared: DataFrame) -> DataFrame:
    """One key for each different set of members, a rare shingle's if there is one: in a frequent one's
    region the rare shingles of a pair count as not shared."""
    signed = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"),
        (F.max("rare") >= int(_FREQUENT)).alias("frequent"),
        F.bit_xor(F.xxhash64("digest")).alias("x"),
        F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"),
    )
    kept = signed.groupBy("size", "x", "y").agg(F.min_by("key", F.struct("frequent", "key")).alias("key")).select("key", "size")
    return shared.join(kept, "key")


class _Space:
    """Sets named by their digests, ``info (digest, n_shingles, doc_id, s0...)``, and links between them."""

    def __init__(self, docs: DataFrame, info: DataFrame, percent: int, clashing: frozenset[int]):
        self.docs, self.info, self.percent, self.clashing = docs, info, percent, clashing

    def may_link(self, left: str, right: str) -> str:
        """SQL: what sizes and sketches of two sides leave open, bits of the sketches at most shingles apart."""
        n = f"({left}.n_shingles + {right}.n_shingles)"
        return (
            f"least({left}.n_shingles, {right}.n_shingles) * 100 >= greatest({left}.n_shingles, {right}.n_shingles) * {self.percent}"
            f" AND ({apart(left, right)}) * {100 + self.percent} <= {n} * {100 - self.percent}"
        )

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that may link."""
        side = self.info.select("digest", "n_shingles", *_BITS).hint("merge")
        wide = pairs.join(side.alias("p"), F.col("a") == F.col("p.digest")).join(
            side.alias("q"), (F.col("b") == F.col("q.digest")) & F.expr(self.may_link("p", "q"))
        )
        return wide.select("a", "b", F.least("p.n_shingles", "q.n_shingles").alias("least"))

    def _long(self, pairs: DataFrame) -> DataFrame:
        """The pairs of long sets whose long sketches do not keep them apart."""
        percent = self.percent
        side = lambda x: self.info.filter(F.col("long").isNotNull()).select(
            F.col("digest").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("long").alias(f"l_{x}")
        ).hint("merge")

        def compare(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, n, m, x, y in zip(*[batch[k] for k in ("a", "b", "n_a", "n_b", "l_a", "l_b")], strict=True):
                if differing(x, y) * (100 + percent) <= (n + m) * (100 - percent):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), compare, "a bigint, b bigint")

    def links(self, pairs: DataFrame, label: str) -> tuple[DataFrame, int]:
        """Those of the pairs ``a, b`` that link, 100 * both >= percent * either, by their whole sets."""
        near, seen = settle(pairs, f"{label}-near", long=F.count_if(F.col("least") > _LONG))
        if seen.get("long"):
            short = near.filter(F.col("least") <= _LONG).select("a", "b")
            near, seen = settle(short.unionByName(self._long(near.filter(F.col("least") > _LONG))), f"{label}-nearer")
        near = near.select("a", "b")
        if not seen["rows"]:
            return near, 0
        percent, clashing = self.percent, self.clashing
        asked = near.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        first, asked_n = settle(
            self.info.join(asked, "digest", "left_semi").select("doc_id", F.col("digest").alias("want")), f"{label}-asked"
        )
        if asked_n["rows"] <= _ASKED:
            first = F.broadcast(first)

        def rows(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"digest": [], "members": []}
            for text, want in zip(batch["text"], batch["want"], strict=True):
                found = shingles(text)
                if name_of(found, clashing) == want:  # an id may stand on several rows
                    out["digest"].append(want)
                    out["members"].append(found.tobytes())
            return out

        texts = self.docs.select("doc_id", "text").join(first, self.docs["doc_id"].eqNullSafe(first["doc_id"]))
        found = map_batches(texts.select("text", "want"), rows, "digest bigint, members binary")
        sets = table(found.dropDuplicates(["digest"]), f"{label}-sets").hint("merge")
        side = lambda x: sets.select(F.col("digest").alias(x), F.col("members").alias(f"m_{x}"))
        wide = near.join(side("a"), "a").join(side("b"), "b")

        def measure(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, left, right in zip(batch["a"], batch["b"], batch["m_a"], batch["m_b"], strict=True):
                x, y = np.frombuffer(left, _U), np.frombuffer(right, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        found, n = settle(map_batches(wide, measure, "a bigint, b bigint"), f"{label}-links")
        return found, n["rows"]


def _labels(links: DataFrame) -> DataFrame:
    """``digest, comp`` of all linked sets."""
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(Graph(nodes_of(edges), edges))
    return table(found.select(F.col("nid").alias("digest"), "comp"), "labels")


def _labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("digest"))
    return members.join(comps, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))


def _undecided(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The members of regions that are more than one component, with their ``comp``."""
    labelled = _labelled(members.drop("comp"), comps)
    split = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    return labelled.join(split.select("key"), "key", "left_semi")


#: of the pivots those that are farther from all before them than twice their reach: nearer ones would share their sets
_SPACED = (
    "aggregate(pivots, slice(pivots, 1, 0), (kept, p) -> "
    f"CASE WHEN forall(kept, k -> {apart('k', 'p')} > 2 * floor(p.n_shingles * {{0}})) THEN concat(kept, array(p)) ELSE kept END)"
)


def cells(
    members: DataFrame, percent: int, most: int = _CELL, pivots: int = _PIVOTS
) -> tuple[DataFrame, list[dict[str, int]]]:
    """``members (key, size, digest, home, n_shingles, s0..., ...)`` with regions of more than ``most`` cut into cells.

    ``home`` tells whether a set is at home in its cell, and in all it was cut from. A set of n shingles links only with
    sets that differ from it in n * (100 - percent) / percent shingles at most, its reach. With p the pivot nearest to x and
    y within reach of x, d(y, p) is at most d(y, q) + 2 * reach for any pivot q, so y is in the cell that is x's home.
    Returns also, for each level, how many sets were in large regions, in cells of accepted cuts and in regions left whole.
    """
    columns = members.columns
    reach = F.floor(F.col("n_shingles") * (100 - percent) / percent)
    done, open_, levels = members.filter(F.col("size") <= most), members.filter(F.col("size") > most), []
    while True:
        open_, seen = settle(open_, "large")
        if not seen["rows"]:
            return done, levels
        some = (
            open_.withColumn("place", F.xxhash64("digest", "key"))
            .filter(F.pmod("place", "size") < 4 * pivots)
            .groupBy("key")
            .agg(F.array_sort(F.collect_list(F.struct("place", "n_shingles", *_BITS))).alias("pivots"))
        )
        chosen = some.select("key", F.slice(F.expr(_SPACED.format((100 - percent) / percent)), 1, pivots).alias("pivots"))

        def away(p: Column) -> Column:
            return functools.reduce(Column.__add__, [F.bit_count(p[b].bitwiseXOR(F.col(b))) for b in _BITS])

        near = F.array_min("far")
        spread = (
            open_.join(chosen, "key")
            .withColumn("far", F.transform("pivots", away))
            .withColumn("own_cell", F.array_position("far", near).cast("int") - 1)
            .withColumn("limit", near + 2 * reach)
            .select(*columns, "own_cell", "limit", F.posexplode("far").alias("cell", "distance"))
            .filter(F.col("distance") <= F.col("limit"))
            .select(
                *[c for c in columns if c != "home"],
                (F.col("home") & (F.col("cell") == F.col("own_cell"))).alias("home"),
                F.xxhash64("key", "cell").alias("cell_key"),
            )
        )
        spread = table(spread, "cells")
        sizes = spread.groupBy("key", "size", "cell_key").agg(F.count(F.lit(1)).alias("cell_size"))
        parts = table(sizes, "cell-sizes")
        held = parts.groupBy("key", "size").agg(F.sum("cell_size").alias("rows"), F.max("cell_size").alias("largest"))
        good = held.filter((F.col("rows") <= 2 * F.col("size")) & (F.col("largest") <= 0.9 * F.col("size"))).select("key")
        accepted = (
            spread.join(good, "key", "left_semi")
            .join(parts.select("key", "cell_key", "cell_size"), ["key", "cell_key"])
            .withColumns({"key": F.col("cell_key"), "size": F.col("cell_size")})
            .select(*columns)
        )
        accepted, cut = settle(accepted, "accepted")
        whole, left = settle(open_.join(good, "key", "left_anti"), "whole")
        levels.append({"large": seen["rows"], "cut": cut["rows"], "whole": left["rows"]})
        done = done.unionByName(accepted.filter(F.col("size") <= most)).unionByName(whole)
        open_ = accepted.filter(F.col("size") > most)


def _joined(live: DataFrame, space: _Space, low: int, high: int) -> DataFrame:
    """Pairs ``a, b`` of a region's pivots, those at places from ``low`` to ``high``, with its later members."""
    percent = space.percent
    blocks = F.expr(f"(size - 1) div {_BLOCK}")
    p = live.filter((F.col("place") >= low) & (F.col("place") < high)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks))
    )
    q = live.withColumn("block", F.expr(f"place div {_BLOCK}"))
    return (
        p.alias("p")
        .join(
            q.alias("q"),
            (F.col("p.key") == F.col("q.key"))
            & (F.col("p.block") == F.col("q.block"))
            & (F.col("p.comp") != F.col("q.comp"))
            & (F.col("p.home") | F.col("q.home"))
            & ((F.col("p.place") < F.col("q.place")) | ((F.col("p.place") == F.col("q.place")) & (F.col("p.digest") < F.col("q.digest"))))
            # in a frequent shingle's region: rare shingles of either side are not in the other set, or
            # the pair meets in a rare one's region
            & (
                (F.col("p.own") + F.col("q.own")) * (100 + percent)
                <= (F.col("p.n_shingles") + F.col("q.n_shingles")) * (100 - percent)
            )
            & F.expr(space.may_link("p", "q")),
        )
        .select(
            F.least("p.digest", "q.digest").alias("a"),
            F.greatest("p.digest", "q.digest").alias("b"),
            F.least("p.n_shingles", "q.n_shingles").alias("least"),
        )
        .distinct()
    )


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, comp`` of each row, ``comp`` null for the empty set."""
    docs = docs.select("doc_id", "text")
    known, counted = settle(described(docs), "described", docs=F.count_if(F.col("met").isNull()))
    rows = known.filter(F.col("met").isNull())
    frequent = frequent_shingles(known, counted.get("docs") or 0)
    sets = rows.filter(F.col("digest").isNotNull()).groupBy("digest", "second")
    info = table(
        sets.agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"), *[F.first(b).alias(b) for b in (*_BITS, "long")]),
        "sets",
    )
    # some ten names among ten billion sets
    twice = info.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect()
    clashing = frozenset(r["digest"] for r in twice)
    if clashing:
        name = F.when(F.col("digest").isin(list(clashing)), F.col("second")).otherwise(F.col("digest"))
        rows, info = rows.withColumn("digest", name), info.withColumn("digest", name)
    space = _Space(docs, info, percent, clashing)
    shared_list = docs.sparkSession.sparkContext.broadcast(frequent)
    shared = table(_shared(_region_rows(docs, percent, shared_list, clashing)), "shared")
    shared_list.unpersist()
    members = table(_regions(shared), "regions")

    star = members.filter("digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b"))
    links, n = space.links(space.near(star.distinct()), "first")
    comps = _labels(links) if n else None
    own = F.greatest(F.col("rare") - int(_FREQUENT), F.lit(0)).alias("own")
    plain = members.select("key", "size", "digest", own, F.lit(True).alias("home"))
    wide = _undecided(plain, comps).drop("comp").join(info.select("digest", "n_shingles", *_BITS).hint("merge"), "digest")
    cut, _ = cells(table(wide, "undecided"), percent)
    members = cut.withColumn("place", F.pmod(F.xxhash64("digest", "key"), F.col("size")))

    low, high = 0, _FIRST
    while True:
        live, seen = settle(
            _undecided(members.filter(F.col("size") > low), comps), "apart", largest=F.max("size")
        )
        if not seen["rows"]:
            break
        more, n = space.links(_joined(live, space, low, high), "round")
        if n:
            links = links.unionByName(more)
            comps = _labels(links)
        if seen["largest"] <= high:
            break
        low, high, members = high, _MORE * high, live
    return _labelled(rows.select("doc_id", "text_key", "n_shingles", "digest"), comps).drop("digest")


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``)."""
    rows = table(_components(docs, percent), "components")
    least = rows.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_component(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the smallest id that is not null, of
    equal ids the one whose text has the smallest hash, of rows equal in both any one. Texts without words are
    components of their own, rows equal in id and text among them one."""
    rows = table(_components(docs, percent), "components")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = rows.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(place).alias("f"))
    own = (F.col("f.text_key") == F.col("text_key")) & F.col("f.doc_id").eqNullSafe(F.col("doc_id"))
    named = rows.join(first, "comp", "left").select("doc_id", "text_key", (F.col("f").isNull() | own).alias("kept"))
    return keep_rows(docs, named, "near-copies")
