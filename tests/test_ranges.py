"""Ranges of text files against their whole lines, and lines written in stretches."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.sources import readers
from strandweave.sources.ranges import Range, RangeReader, lines_from, read_ranges
from strandweave.sources.writer import write_stretches


def fastq(rng, n, end="\n"):
    """Records whose qualities often begin with @, as headers do."""
    out = []
    for i in range(n):
        size = rng.randint(0, 30)
        quality = "".join(rng.choice("@@IJ+>") for _ in range(size))
        out += [f"@r{i} x", "".join(rng.choices("ACGT", k=size)), rng.choice(["+", "+@"]), quality]
    return out, end.join(out)


@pytest.mark.parametrize("end,tail", [("\n", ""), ("\n", "\n"), ("\r\n", "\r\n")])
@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_of_ranges_are_the_lines(tmp_path, end, tail, size):
    lines, text = fastq(random.Random(size), 12, end)
    lines[5:5] = ["", "x" * 300, ""]
    data = (end.join(lines) + tail).encode()
    path = tmp_path / "a.fq"
    path.write_bytes(data)
    got = []
    for at in range(0, len(data), size):
        for line in lines_from(Range(f"file://{path}", at, min(at + size, len(data)))):
            if line is None:
                break
            got.append(line.decode())
    assert got == lines


@pytest.mark.parametrize("size", [13, 100, 1 << 20])
def test_fastq_records_of_ranges(spark, tmp_path, size):
    rng, want = random.Random(size), []
    for name in ("b.fq", "a.fq", "c.fq"):
        lines, text = fastq(rng, rng.randint(1, 40))
        (tmp_path / name).write_text(text + rng.choice(["", "\n"]))
        want.append((name, lines))
    (tmp_path / "_hidden").write_text("no record")
    (tmp_path / "empty.fq").write_text("")
    whole = [line for _, lines in sorted(want) for line in lines]
    rows = readers.read_fastq(spark, str(tmp_path), range_bytes=size).orderBy("rec_no").collect()
    assert [r.rec_no for r in rows] == list(range(len(whole) // 4))
    assert [line for r in rows for line in (r.header, r.seq, r.plus, r.qual)] == whole


def test_no_text_is_shuffled(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq(random.Random(1), 30)[1])
    plan = readers.read_fastq(spark, str(tmp_path), range_bytes=50)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("BatchScan strandweave_ranges")[0]
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert "BatchScan strandweave_ranges" in plan and before
    assert all("Broadcast" in line or "seq" not in line for line in exchanges)
    spans, _ = read_ranges(spark, str(tmp_path), "records", 50)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_small_ranges_share_tasks(spark, tmp_path):
    lines, text = fastq(random.Random(2), 4000)
    (tmp_path / "a.fq").write_text(text)
    tasks = RangeReader("counts", {"paths": str(tmp_path), "rangebytes": "64"}).partitions()
    ranges = [r for task in tasks for r in task.ranges]
    assert len(tasks) == 1 and len(ranges) == -(-len(text) // 64)
    assert [(r.start, r.stop) for r in ranges] == [(a, min(a + 64, len(text))) for a in range(0, len(text), 64)]
    records, _ = read_ranges(spark, str(tmp_path), "records", 64)
    assert records.rdd.getNumPartitions() == 1 and records.count() == 4000


def test_malformed_records(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nII\nb\nAC\n+\nII\n")
    with pytest.raises(Exception, match="malformed FASTQ record: b"):
        readers.read_fastq(spark, str(tmp_path)).collect()
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nII\n@b\n")
    assert [r.seq for r in readers.read_fastq(spark, str(tmp_path), strict=False).orderBy("rec_no").collect()] == ["AC", None]


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_contigs_over_ranges(spark, tmp_path, size):
    rng, want, text = random.Random(size), [], "ACGT\n"
    for i in range(20):
        bases = "".join(rng.choices("ACGTN", k=rng.choice([0, 3, 50, 200])))
        text += f"{rng.choice(['', ' '])}>c{i}\n" + "".join(bases[a : a + 17] + "\n" for a in range(0, len(bases), 17))
        if bases:
            want.append((i + 1, len(bases)))
    (tmp_path / "a.fa").write_text(text)
    got = readers.contig_lengths(spark, str(tmp_path / "a.fa"), range_bytes=size).collect()
    assert sorted((r.contig, r.length) for r in got) == want


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_contigs_over_part_files(spark, tmp_path, size):
    parts = ["AC\n", "GT\n>a\nACGT\nAC\n", "GGG\n", "TT\n>b\n>c\nA\n", "CC\n>d\n", "A" * 70 + "\n"]
    for i, text in enumerate(parts):
        (tmp_path / f"part-{i:05d}.txt").write_text(text)
    got = readers.contig_lengths(spark, str(tmp_path), range_bytes=size).collect()
    assert sorted((r.file[-9:-4], r.contig, r.length) for r in got) == [("00001", 1, 11), ("00003", 2, 3), ("00004", 1, 70)]
    # files named one by one are texts of their own
    alone = readers.contig_lengths(spark, [str(p) for p in sorted(tmp_path.glob("part-*"))], range_bytes=size).collect()
    assert sorted((r.file[-9:-4], r.contig, r.length) for r in alone) == [("00001", 1, 6), ("00003", 2, 1)]


def test_paf_line_numbers(spark, tmp_path):
    row = "q\t10\t0\t9\t+\tt\t10\t0\t9\t8\t9\t60"
    (tmp_path / "a.paf").write_text("# note\n\n" + row + "\nbad\n" + row.replace("q", "p") + "\tx\n")
    got = readers.read_paf(spark, str(tmp_path / "a.paf"), range_bytes=16).orderBy("line_no").collect()
    assert [(r.line_no, r.qname) for r in got] == [(2, "q"), (4, "p")]


def test_a_line_over_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    lines = ["".join(rng.choices("ACGT", k=rng.choice([0, 5, 4000]))) for _ in range(9)]
    rows = []
    for i, line in enumerate(lines):
        rows += [(i, j, line[a : a + 100], True) for j, a in enumerate(range(0, len(line), 100))]
        rows.append((i, 10**6, "", False))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "line int, part int, value string, open boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        write_stretches(df, str(tmp_path / "out"), ["line", "part"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 3 and (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_temporary").exists()
    assert "".join(p.read_text() for p in parts) == "".join(line + "\n" for line in lines)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select(
        F.col("id"), F.when(F.col("id") == 57, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("value"), F.lit(False).alias("open")
    )
    with pytest.raises(Exception, match="broken"):
        write_stretches(rows, str(tmp_path / "out"), ["id"])
    assert not list((tmp_path / "out").glob("part-*"))
