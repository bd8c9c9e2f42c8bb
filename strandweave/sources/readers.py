"""Readers for FASTQ, FASTA and PAF text, and for stored overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.sources.ranges import RANGE_BYTES, read_ranges

PAF_FIELDS = [
    ("qname", "string"),
    ("qlen", "bigint"),
    ("qstart", "bigint"),
    ("qend", "bigint"),
    ("strand", "string"),
    ("tname", "string"),
    ("tlen", "bigint"),
    ("tstart", "bigint"),
    ("tend", "bigint"),
    ("nmatch", "bigint"),
    ("block_len", "bigint"),
    ("mapq", "smallint"),
]


def read_fastq(
    spark: SparkSession, path: str | list[str], strict: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``reads(rec_no, name, header, seq, plus, qual)`` from 4-line records.

    ``name`` is the first word of the header without its ``@``. With ``strict`` a header
    without ``@`` or a record without a sequence line fails the job. A file holds whole
    records; ``rec_no`` follows file order, then position. Files are read by ranges of whole records, so texts stay where
    they are read.
    """
    records, ranges = read_ranges(spark, path, "records", range_bytes)
    if strict:
        sound = F.col("header").startswith("@") & F.col("seq").isNotNull()
        records = records.withColumn(
            "header",
            F.when(F.coalesce(sound, F.lit(False)), F.col("header")).otherwise(
                F.raise_error(F.concat(F.lit("malformed FASTQ record: "), F.coalesce("header", F.lit(""))))
            ),
        )
    # one row for each file: records of later files follow earlier ones
    files = ranges.groupBy("file").agg(F.ceil(F.sum("n_lines") / 4).cast("bigint").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shift = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return records.join(shift, "file").select(
        (F.col("rec") + F.col("shift")).alias("rec_no"),
        F.split(F.regexp_replace("header", "^@", ""), r"\s+")[0].alias("name"),
        "header",
        "seq",
        "plus",
        "qual",
    )


def sequences_by_name(reads: DataFrame) -> DataFrame:
    """``(name, seq)`` where the last record of a name counts."""
    return reads.groupBy("name").agg(F.max_by("seq", "rec_no").alias("seq"))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select("line_no", "value", F.split("value", "\t").alias("f"))


def parse_paf(lines: DataFrame) -> DataFrame:
    """``alignments`` from ``lines(line_no, value)``: at least 12 fields, all of them well
    typed; other rows, comments and blank lines are left out."""
    rows = _fields(lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")))
    typed = [F.get("f", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(PAF_FIELDS)]
    sign = F.get("f", F.lit(4))
    typed[4] = F.when(sign == "", "+").otherwise(F.left(sign, F.lit(1))).alias("strand")
    return (
        rows.filter(F.size("f") >= len(PAF_FIELDS)).select("line_no", *typed).dropna("any")
        .filter((F.col("mapq") >= 0) & (F.col("mapq") <= 255))
        .filter((F.col("qlen") >= 0) & (F.col("tlen") >= 0) & (F.col("nmatch") >= 0) & (F.col("block_len") >= 0))
    )


def parse_paf_loose(lines: DataFrame) -> DataFrame:
    """``(line_no, qname, qstart, qend, tname, nmatch)``: at least 10 fields, numbers that do
    not parse count as 0."""
    rows = _fields(lines).filter(F.size("f") >= 10)

    def number(i: int) -> Column:
        value = F.get("f", F.lit(i)).try_cast("bigint")
        return F.when(value >= 0, value).otherwise(F.lit(0).cast("bigint"))

    return rows.select(
        "line_no",
        F.get("f", F.lit(0)).alias("qname"),
        number(2).alias("qstart"),
        number(3).alias("qend"),
        F.get("f", F.lit(5)).alias("tname"),
        number(9).alias("nmatch"),
    )


def parse_paf_spans(lines: DataFrame) -> DataFrame:
    """``(line_no, qname, qlen, qstart, qend)`` for size estimation; bad numbers fail the job."""
    rows = _fields(lines)
    return rows.select(
        "line_no",
        F.get("f", F.lit(0)).alias("qname"),
        *[F.get("f", F.lit(i)).cast("bigint").alias(n) for i, (n, _) in list(enumerate(PAF_FIELDS))[1:4]],
    )


def read_paf(
    spark: SparkSession, path: str | list[str], form: str = "strict", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Alignment rows of PAF files; ``line_no`` is the number of the line in its file."""
    parse = {"strict": parse_paf, "loose": parse_paf_loose, "spans": parse_paf_spans}[form]
    return parse(read_ranges(spark, path, "lines", range_bytes)[0])


def contig_lengths(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, contig, length)`` of a FASTA file; contigs without bases are left out.

    Ranges give the bases they hold of each contig, and only these numbers are added up. The files of a folder are the
    parts of one text: bases before a part's first header go on with the last contig of the parts before it, which counts
    under the file of its header.
    """
    parts, ranges = read_ranges(spark, path, "contigs", range_bytes)
    files = ranges.groupBy("text", "file").agg(F.sum("n_headers").alias("n"))
    before = Window.partitionBy("text").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("n") > 0, F.struct("file", "n")), ignorenulls=True).over(before)
    # no row for the bases before the first header of a text, which belong to no contig
    open_ = files.select("file", latest.alias("_c")).filter("_c is not null").select("file", F.lit(0).cast("bigint").alias("contig"), "_c")
    placed = parts.join(open_, ["file", "contig"], "left").filter("contig > 0 or _c is not null")
    return (
        placed.groupBy(F.coalesce("_c.file", "file").alias("file"), F.coalesce("_c.n", "contig").alias("contig"))
        .agg(F.sum("length").alias("length"))
        .filter("length > 0")
    )


def write_overlaps(overlaps: DataFrame, path: str) -> None:
    overlaps.write.parquet(path)


def read_overlaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
