"""Text sinks. Rows are range-partitioned by their place, so the part files, taken in
order, are the file; no task holds more than its own stretch, not of a line either."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.unitigs import sequence_chunks
from strandweave.sources.writer import write_stretches

# fixed values: node colours by out-degree
_COLOURS = [(0, "gray"), (1, "black"), (2, "blue"), (5, "orange")]
_COLOUR_ABOVE = "red"
_HELD = 4 << 20  # bytes of text that a batch holds


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write ``value`` sorted by ``order``."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def _zipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = [v.encode() for v in batch.column("value").to_pylist()]
        columns = [batch.column("rec_no"), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["rec_no", "size", "data"])


def _unzipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        texts, held = [], 0
        for size, data in zip(batch.column("size").to_pylist(), batch.column("data").to_pylist()):
            texts.append(codec.decompress(data, size, asbytes=True).decode() if size else "")
            held += size
            if held > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
                texts, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select("rec_no", F.concat_ws("\n", "header", "seq", "plus", "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, compressed: bool = False) -> None:
    """Records in the order of ``rec_no``; ``compressed`` part files are gzip. Records are shuffled compressed either way."""
    packed = fastq_lines(reads).mapInArrow(_zipped, "rec_no bigint, size bigint, data binary")
    ordered = packed.repartitionByRange("rec_no").sortWithinPartitions("rec_no").select("size", "data")
    # the fast level: bases have two bits each, which more effort does not make fewer
    options = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"} if compressed else {}
    ordered.mapInArrow(_unzipped, "value string").write.options(**options).text(path)


def fasta_lines(sizes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Header line and sequence lines of each unitig, from ``(unitig_id, length, topology)``
    and ``(unitig_id, chunk, seq)``."""
    head = sizes.select(
        "unitig_id",
        F.lit(-1).cast("bigint").alias("chunk"),
        F.format_string(
            ">unitig_%d len=%dbp topology=%s", F.col("unitig_id"), F.col("length"), F.col("topology")
        ).alias("value"),
    )
    return head.unionByName(chunks.select("unitig_id", "chunk", F.col("seq").alias("value")))


def write_fasta(sizes: DataFrame, pieces: DataFrame, path: str, width: int = 10_000) -> None:
    write_lines(fasta_lines(sizes, sequence_chunks(pieces, width)), path, ["unitig_id", "chunk"])


def _name(unitig_id: str, topology: str) -> Column:
    return F.concat(F.lit("unitig_"), F.col(unitig_id).cast("string"), F.lit("_"), F.col(topology))


def _tabbed(*parts) -> Column:
    return F.concat_ws("\t", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def gfa_lines(
    sizes: DataFrame,
    edges: DataFrame,
    placed: DataFrame,
    pieces: DataFrame | None = None,
    width: int = 10_000,
) -> DataFrame:
    """``(section, a, b, part, value, open)``: header, segments, circular links, links, read lines.

    A segment line holds all bases of its unitig; without ``pieces`` it has ``*`` and the length. With them it is
    several rows, all but the last one ``open``: its beginning, ``width`` bases each, and its end, so that no row
    or group grows with a unitig.
    """
    zero = F.lit(0).cast("bigint")

    def section(
        k: int, df: DataFrame, a: Column, b: Column, value: Column, part: Column = zero, more: bool = False
    ) -> DataFrame:
        return df.select(
            F.lit(k).alias("section"), a.alias("a"), b.alias("b"), part.cast("bigint").alias("part"), value.alias("value"),
            F.lit(more).alias("open"),
        )

    named = sizes.withColumn("name", _name("unitig_id", "topology"))
    uid = F.col("unitig_id")
    rows = section(0, sizes.sparkSession.range(1), zero, zero, F.lit("H\tVN:Z:1.0"))
    if pieces is None:
        length = F.concat(F.lit("LN:i:"), F.col("length").cast("string"))
        rows = rows.unionByName(section(1, named, uid, zero, _tabbed("S", F.col("name"), "*", length)))
    else:
        chunks = sequence_chunks(pieces, width)
        begin = F.concat(_tabbed("S", F.col("name")), F.lit("\t"))
        rows = (
            rows.unionByName(section(1, named, uid, zero, begin, F.lit(-1), True))
            .unionByName(section(1, chunks, uid, zero, F.col("seq"), F.col("chunk"), True))
            .unionByName(section(1, named, uid, zero, F.lit(""), F.lit((1 << 62))))
        )
    for turn, strand in enumerate("+-"):
        rows = rows.unionByName(
            section(
                2, named.filter("topology = 'c'"), uid, F.lit(turn).cast("bigint"),
                _tabbed("L", F.col("name"), strand, F.col("name"), strand, "0M"),
            )
        )
    kind = sizes.select("unitig_id", "topology")
    links = edges.join(kind.withColumnsRenamed({"unitig_id": "from_id", "topology": "from_t"}), "from_id").join(
        kind.withColumnsRenamed({"unitig_id": "to_id", "topology": "to_t"}), "to_id"
    )
    rows = rows.unionByName(
        section(
            3, links, F.col("from_id"), F.col("to_id"),
            _tabbed(
                "L", _name("from_id", "from_t"), F.col("from_ori"), _name("to_id", "to_t"), F.col("to_ori"),
                F.concat(F.col("overlap_len").cast("string"), F.lit("M")),
            ),
        )
    )
    region = F.format_string("%s:%d-%d", F.col("read"), F.col("cov_start"), F.col("cov_end"))
    return rows.unionByName(
        section(
            4, placed.join(kind, "unitig_id"), uid, F.col("pos").cast("bigint"),
            _tabbed(
                "a", _name("unitig_id", "topology"), F.col("utg_start").cast("string"), region, F.col("ori"),
                F.col("utg_end").cast("string"),
            ),
        )
    )


def write_gfa(path: str, *tables: DataFrame, **options) -> None:
    write_stretches(gfa_lines(*tables, **options), path, ["section", "a", "b", "part", "value"])


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(section, a, b, value)`` of a directed graph with nodes coloured by out-degree."""

    def quoted(col: str) -> Column:
        safe = F.replace(F.replace(F.col(col), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), safe, F.lit('"'))

    out = edges.groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("n_out"))
    degree = F.coalesce("n_out", F.lit(0).cast("bigint"))
    colour = F.when(degree <= _COLOURS[0][0], _COLOURS[0][1])
    for most, name in _COLOURS[1:]:
        colour = colour.when(degree <= most, name)
    colour = colour.otherwise(_COLOUR_ABOVE)
    frame = [
        (0, 0, "digraph overlaps {"),
        (0, 1, "  graph [rankdir=LR, splines=true];"),
        (0, 2, "  node [shape=ellipse, fontsize=10];"),
        (4, 0, "}"),
    ]
    around = nodes.sparkSession.createDataFrame(frame, "section int, a bigint, value string").select(
        "section", "a", F.lit(0).cast("bigint").alias("b"), "value"
    )
    node_rows = nodes.join(out, "nid", "left").select(
        F.lit(1).alias("section"), F.col("nid").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.concat(F.lit("  "), quoted("node_id"), F.lit(" [style=filled fillcolor="), colour, F.lit(" ];")).alias("value"),
    )
    ids = nodes.select("nid", "node_id")
    edge_rows = (
        edges.join(ids.withColumnsRenamed({"nid": "src", "node_id": "from_node"}), "src")
        .join(ids.withColumnsRenamed({"nid": "dst", "node_id": "to_node"}), "dst")
        .select(
            F.lit(3).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"),
            F.concat(F.lit("  "), quoted("from_node"), F.lit(" -> "), quoted("to_node"), F.lit(";")).alias("value"),
        )
    )
    return around.unionByName(node_rows).unionByName(edge_rows)


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_lines(dot_lines(nodes, edges), path, ["section", "a", "b"])
