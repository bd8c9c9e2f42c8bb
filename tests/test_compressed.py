"""Compressed FASTQ parts are written, and read with the records of plain ones."""

import gzip
import random

from strandweave.sources import readers, sinks


def test_compressed_parts_hold_the_same_records(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"r{i}", f"@r{i} x", "".join(rng.choices("ACGT", k=rng.randrange(900))), "+", "@") for i in range(300)]
    rows = [(*r[:5], "@" * len(r[3])) for r in rows]
    reads = spark.createDataFrame(rows, "rec_no bigint, name string, header string, seq string, plus string, qual string").repartition(5)
    sizes, texts = {}, {}
    for kind in (False, True):
        path = tmp_path / f"fq{kind}"
        sinks.write_fastq(reads, str(path), compressed=kind)
        parts = sorted(path.glob("part-*"))
        assert all(p.suffix == (".gz" if kind else ".txt") for p in parts)
        sizes[kind] = sum(p.stat().st_size for p in parts)
        texts[kind] = b"".join(gzip.decompress(p.read_bytes()) if kind else p.read_bytes() for p in parts)
        assert sorted(map(tuple, readers.read_fastq(spark, str(path)).collect())) == rows
    assert texts[True] == texts[False] and sizes[True] < sizes[False] / 3


def test_lines_of_a_compressed_file(spark, tmp_path, monkeypatch):
    from strandweave.sources import ranges

    monkeypatch.setattr(ranges, "_CHUNK", 7)
    text = b"a\r\nlonger than a chunk of this file\n\nb\nlast without an end"
    file = tmp_path / "x.txt.gz"
    # two members, as block-wise writers make them
    file.write_bytes(gzip.compress(text[:20]) + gzip.compress(text[20:]))
    got = list(ranges.lines_from(ranges.Range(f"file://{file}", 0, file.stat().st_size)))
    assert got == [b"a", b"longer than a chunk of this file", b"", b"b", b"last without an end"]
