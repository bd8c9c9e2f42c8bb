"""A Merkle manifest of a corpus, with versions of its tree for tampered rows.

Each document is a leaf, the leaves of a source in ascending ``doc_id`` form a tree of runs of three, and
the sources' roots, ordered by source, form the tree above them.

A tree is cut into aligned blocks of 3 ** ``LEVELS`` leaves. One block is a ``PersistentTree``: nodes are
never changed, and a tampered leaf makes a new version that copies the ancestors of that leaf and shares
all other nodes. The blocks' roots are the leaves of the next round of blocks, so a tree of n leaves
takes log(n) / log(729) rounds, and a source with a third of all rows is as many blocks as its rows need.
A version goes on above its block wherever its document lies: the siblings on the way from a block to
the root are looked up once for each block, and the copied ancestors follow from them by hashing,
as an expression on the document's row. No group is larger than a block.

A digest is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. The row's parts are
``doc_id, source, lang, n_chars, text``, each ``-`` where it is null and else the number of its UTF-8
bytes, ``:`` and the value. Equal ids of one source are ordered by their leaf, so repeated rows and
null ids (first) have a defined place; a row whose id is null is never tampered. Rows of a null source are a source of
their own, before all others. A table without rows gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandweave.plans.ordering import running
from strandweave.plans.settle import settle, table

ARITY = 3
LEVELS = 6
SPAN = ARITY**LEVELS

_PARTS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "path array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class PersistentTree:
    """Versions of a tree over ``leaves``; ``grow`` levels at least, and until one node remains.

    A node is a number; its digest and children never change. ``root`` is the first version's root.
    """

    def __init__(self, leaves: list[str], grow: int = 0) -> None:
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.height = 0
        level = list(range(len(leaves)))
        while len(level) > 1 or self.height < grow:
            level = [self._node(tuple(level[i : i + ARITY])) for i in range(0, len(level), ARITY)]
            self.height += 1
        self.root = level[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join(self.digests[c] for c in children)))
        self.children.append(children)
        return len(self.digests) - 1

    def _way(self, root: int, place: int) -> list[tuple[int, int]]:
        """(node, which child) from ``root`` down to the leaf at ``place``."""
        way = []
        for level in reversed(range(self.height)):
            turn = place // ARITY**level % ARITY
            way.append((root, turn))
            root = self.children[root][turn]
        return way

    def replaced(self, root: int, place: int, leaf: str) -> int:
        """The root of a new version of ``root`` that has ``leaf`` at ``place``: height + 1 new nodes."""
        way = self._way(root, place)
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, turn in reversed(way):
            family = self.children[parent]
            node = self._node((*family[:turn], node, *family[turn + 1 :]))
        return node

    def siblings(self, root: int, place: int) -> list[dict[str, str]]:
        """What stands left and right of the way from the leaf at ``place`` up to ``root``."""
        out = []
        for parent, turn in reversed(self._way(root, place)):
            names = [self.digests[c] for c in self.children[parent]]
            out.append({"left": "".join(names[:turn]), "right": "".join(names[turn + 1 :])})
        return out


def _value(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: str = "text") -> Column:
    """Leaf of a row; ``text`` names the column that holds the text."""
    return F.sha2(F.concat(*[_value(text if p == "text" else p) for p in _PARTS]), 256)


def _blocks(nodes: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Build all blocks of ``nodes (tree, place, digest, changed, ...)``.

    Adds ``block``, ``root`` (of the block), ``version`` (the block's root after ``digest`` became
    ``changed``, null where nothing changed) and ``path``. Returns them with the largest block number.
    """
    rows = nodes.withColumn("block", F.expr(f"place div {SPAN}"))
    schema = StructType(rows.schema.fields + StructType.fromDDL(f"root string, version string, {_PATH}").fields)
    arrow = to_arrow_schema(schema)

    def block(group: pa.Table) -> pa.Table:
        leaves, changed = group["digest"].to_pylist(), group["changed"].to_pylist()
        # a block after which another one follows is full; one that stands alone ends at its own root
        tree = PersistentTree(leaves, LEVELS if group["block"][0].as_py() else 0)
        roots, versions = [tree.digests[tree.root]] * len(leaves), []
        paths = [tree.siblings(tree.root, i) for i in range(len(leaves))]
        for i, leaf in enumerate(changed):
            versions.append(None if leaf is None else tree.digests[tree.replaced(tree.root, i, leaf)])
        added = [pa.array(v, arrow.field(k).type) for k, v in (("root", roots), ("version", versions), ("path", paths))]
        return pa.Table.from_arrays([*[c.combine_chunks() for c in group.columns], *added], schema=arrow)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # rows of a block that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None or not kept.num_rows else pa.concat_tables([kept, rows])
            names = list(zip(kept["tree"].to_pylist(), kept["block"].to_pylist()))
            ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for a, b in zip([0, *ends], ends):
                yield from block(kept.slice(a, b - a)).to_batches()
            kept = kept.slice(ends[-1] if ends else 0)
        if kept is not None and kept.num_rows:
            yield from block(kept).to_batches()

    ordered = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    done, seen = settle(ordered.mapInArrow(build, schema), label, last=F.max("block"))
    return done, seen["last"] or 0


def _climbed(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks over ``nodes`` and ``(tree, root)`` of every tree."""
    rounds = []
    while True:
        done, last = _blocks(nodes, f"{label}-{len(rounds)}")
        rounds.append(done)
        tops = done.filter(f"place % {SPAN} = 0")
        if not last:
            return rounds, tops.select("tree", "root")
        nodes = tops.select(
            "tree", F.col("block").alias("place"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("changed")
        )


def _descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's rows with what ``above`` says of their tree, ``above`` itself being the way
    from their block up, which ends with their tree's own."""
    told = [c for c in above.columns if c not in ("tree", "above")]
    for done in reversed(rounds[1:]):
        step = done.join(above, [c for c in ("tree", "block") if c in above.columns])
        above = step.select("tree", F.col("place").alias("block"), F.concat("path", "above").alias("above"), *told)
    return rounds[0].join(above, [c for c in ("tree", "block") if c in above.columns])


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs``.

    ``tampered`` is an expression on the columns ``doc_id, source, lang, n_chars, text`` that gives the
    text to be checked against the manifest (default: what lost its line feeds where 2 divides the crc32
    of the decimal id). A row whose expression gives its own text has not been tampered with.
    """
    rows = docs.select(*_PARTS)
    if tampered is None:
        even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
        tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = rows.withColumn("_text", tampered)
    same = F.col("_text").eqNullSafe(F.col("text"))
    leaves = table(
        rows.select(
            F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("tree"),
            "doc_id",
            leaf_digest().alias("digest"),
            F.when(~same, leaf_digest("_text")).alias("changed"),
            F.lit(1).cast("bigint").alias("one"),
        ),
        "leaves",
    )
    placed = running(leaves, "tree", ["doc_id", "digest", "changed"], "one", "place").drop("one")
    rounds, roots = _climbed(placed, "blocks")

    # the tree over the sources; its one key is a constant
    sources = roots.select(F.lit("").alias("all"), "tree", F.col("root").alias("digest"), F.lit(1).cast("bigint").alias("one"))
    ranked = running(sources, "all", ["tree"], "one", "place")
    tops, root = _climbed(
        ranked.select(
            F.lit("").alias("tree"), "place", "digest", F.lit(None).cast("string").alias("changed"), F.col("tree").alias("source")
        ),
        "sources",
    )
    none = F.array().cast("array<struct<left: string, right: string>>")
    ways = _descended(tops, root.select("tree", none.alias("above"))).select(
        F.col("source").alias("tree"), F.concat("path", "above").alias("above"), F.col("digest").alias("subroot")
    )
    joined = _descended(rounds, table(ways, "sources-ways"))
    top = root.first()  # one row

    def sides(part: str) -> Column:
        return F.array_join(F.transform(part, lambda s: F.concat(s["left"], s["right"])), "")

    own = F.coalesce("version", joined["root"])
    folded = F.aggregate("above", own, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    return joined.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(top["root"] if top else None).cast("string").alias("root"),
        F.sha2(F.concat(sides("path"), sides("above")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
