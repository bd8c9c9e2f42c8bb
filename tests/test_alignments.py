import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions.sequence import node_id_parts, phred_sums, reverse_complement
from strandweave.operators import alignments as al
from strandweave.operators import completion as cp
from strandweave.operators import overlaps as ov
from strandweave.operators import reads as rd
from strandweave.operators import stats as st
from strandweave.params import Params
from strandweave.plans.ordering import prefix_sum, weighted_cut, with_index
from strandweave.sources import readers

INTERVALS = "name string, start bigint, end bigint"


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no bigint, value string")


def test_region_ties_and_threshold(spark):
    def region(rows, above):
        return al.covered_regions(spark.createDataFrame(rows, INTERVALS), above).first()

    tie = [("r", 0, 10), ("r", 20, 30)]
    assert tuple(region(tie, 0)) == ("r", 0, 10, 1)
    at = [("r", 0, 10)] * 3
    assert tuple(region(at, 3)) == ("r", 0, 0, 3)
    assert tuple(region(at, 2)) == ("r", 0, 10, 3)


def test_depth_matches_counting_across_blocks(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        s = rng.randrange(20000)
        rows.append((rng.choice("ab"), s, s + rng.randrange(1, 9000)))
    counts = {}
    for name, s, e in rows:
        for p in range(s, e):
            counts[name, p] = counts.get((name, p), 0) + 1
    got = {}
    for r in al.interval_depth(spark.createDataFrame(rows, INTERVALS)).collect():
        for p in range(r["start"], r["end"]):
            assert (r["name"], p) not in got
            got[r["name"], p] = r["depth"]
    assert got == counts


def test_phred_sums_stay_small():
    rng = random.Random(4)
    rows = ["".join(chr(rng.randint(20, 126)) for _ in range(n)) for n in (0, 5, 0, 0, 300, 1, 0)] + ["é\u4e00", ""]
    want = [sum(max(b - 33, 0) for b in r.encode()) for r in rows]
    assert phred_sums(pa.array(rows)).to_pylist() == want
    assert phred_sums(pa.array(rows)[3:8]).to_pylist() == want[3:8]
    assert phred_sums(pa.array([], pa.string())).to_pylist() == []
    long = pa.array(["I" * 1_000_000] * 20)
    tracemalloc.start()
    assert phred_sums(long).to_pylist() == [40_000_000] * 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * long.nbytes


def test_tasks_do_not_grow_with_the_input(spark):
    def widest(n):
        rows = spark.range(n).select(F.format_string("r%d", F.col("id") % (n // 4)).alias("name"), F.col("id").alias("start"))
        depth = al.interval_depth(rows.withColumn("end", F.col("start") + 10))
        return depth.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        few, many = widest(100_000), widest(800_000)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert many[0] > few[0] and many[1] < 4 * few[1]


def test_prefix_sum_and_index(spark):
    rows = [("k", p, v) for p, v in zip(range(0, 4000, 7), range(1000))]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    out = prefix_sum(df, ["k"], "pos", "v", span=50).orderBy("pos").collect()
    total = 0
    for r, (_, p, v) in zip(out, rows):
        total += v
        assert (r["pos"], r["running"]) == (p, total)
    assert [r["next_pos"] for r in out] == [p for _, p, _ in rows[1:]] + [None]
    numbered = with_index(df.repartition(7), ["pos"], "i").orderBy("pos").collect()
    assert [r["i"] for r in numbered] == list(range(len(rows)))


def test_weighted_cut(spark):
    rng = random.Random(3)
    values = [rng.randrange(-5000, 5_000_000) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    ordered = sorted(values)
    for n in (1, 250, 500):
        assert weighted_cut(df, F.col("v"), F.lit(1), n)[0] == ordered[n - 1]
    assert weighted_cut(df, F.col("v"), F.lit(1), 501) is None


@pytest.mark.parametrize("budget", [0, 1, 9, 10, 11, 34, 35, 1000])
def test_longest_budget(spark, budget):
    rows = [(1, 5), (2, 10), (3, 10), (4, 10), (5, 3)]
    got = {r["rec_no"] for r in rd.longest_within(spark.createDataFrame(rows, "rec_no bigint, len bigint"), budget).collect()}
    want, total = set(), 0
    for rec, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if want and total >= budget:
            break
        want.add(rec)
        total += n
    assert got == want


def test_strand_flip_can_go_negative(spark):
    best = spark.createDataFrame(
        [(0, "q", 5000, 0, 3000, "-", "t", 6000, 0, 5900, 2900, 3000)],
        "line_no bigint, qname string, qlen bigint, qstart bigint, qend bigint, strand string, tname string, "
        "tlen bigint, tstart bigint, tend bigint, nmatch bigint, block_len bigint",
    )
    regions = spark.createDataFrame(
        [("q", 5000, 0, 4000, 9), ("t", 6000, 2000, 5900, 9)],
        "name string, length bigint, cov_start bigint, cov_end bigint, max_depth bigint",
    )
    row = ov.classify(best, regions, Params()).first()
    assert (row["b2"], row["e2"], row["l2"]) == (3900 - 5900, 3900 - 2000, 3900)


def test_paf_rows_that_are_dropped(spark):
    good = "a\t10\t0\t5\t+\tb\t20\t1\t6\t4\t5\t60"
    text = [good, "# note", "", "a\t10\t0", good.replace("\t60", "\tx"), good.replace("+", ""), good + "\ttp:A:P"]
    got = readers.parse_paf(lines(spark, text)).orderBy("line_no").collect()
    assert [(r["line_no"], r["strand"]) for r in got] == [(0, "+"), (5, "+"), (6, "+")]
    loose = readers.parse_paf_loose(lines(spark, [good.replace("\t0\t5", "\tx\t5"), "a\tb"])).collect()
    assert [(r["qstart"], r["qend"], r["nmatch"]) for r in loose] == [(0, 5, 4)]


ONE = [
    "mol7\t2000\t100\t700\t+\tcontig_a\t900\t50\t650\t540\t600\t30",
    "mol7\t2000\t300\t925\t+\tcontig_b\t950\t10\t635\t500\t625\t30",
]
TWO = ONE + [
    "mol9\t2400\t0\t700\t+\tcontig_a\t900\t100\t800\t665\t700\t30",
    "mol9\t2400\t40\t760\t+\tcontig_b\t950\t60\t780\t612\t720\t30",
]


def test_bridges(spark):
    one = cp.find_bridges(readers.parse_paf_loose(lines(spark, ONE)), 500, 0.8).collect()
    assert [tuple(r)[:5] for r in one] == [("contig_a", "contig_b", 1, 600, 600)]
    assert abs(tuple(one[0])[5] - (540 / 600 + 500 / 625) / 2) < 1e-12
    two = cp.find_bridges(readers.parse_paf_loose(lines(spark, TWO)), 500, 0.8).collect()
    assert [(r["support_reads"], r["edge_len"]) for r in two] == [(2, 700)]
    assert cp.find_bridges(readers.parse_paf_loose(lines(spark, ONE)), 640, 0.8).count() == 0


def test_node_ids(spark):
    df = spark.createDataFrame([("r1:5-10+",), ("r1:10-5+",), ("r1:5-10",)], "id string")
    got = df.select(*[c.alias(k) for k, c in node_id_parts(F.col("id")).items()]).collect()
    assert tuple(got[0]) == ("r1", 5, 10, "+", True)
    assert [r["valid"] for r in got] == [True, False, False]
    rc = spark.createDataFrame([("acGTNx",)], "s string").select(reverse_complement(F.col("s"))).first()[0]
    assert rc == "xNACGT"


def test_fastq_round_trip(spark, tmp_path):
    from strandweave.sources import sinks

    text = "".join(f"@r{i} extra words\nACGT{'A' * i}\n+\n@@@@{'I' * i}\n" for i in range(20))
    (tmp_path / "in.fq").write_text(text)
    reads = readers.read_fastq(spark, str(tmp_path / "in.fq"))
    rows = reads.orderBy("rec_no").collect()
    assert [r["name"] for r in rows] == [f"r{i}" for i in range(20)]
    stats = {r["name"]: (r["len"], r["mean_q"]) for r in rd.read_stats(reads).collect()}
    assert stats["r0"] == (4, 31.0)
    sinks.write_fastq(reads, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == text
    (tmp_path / "bad.fq").write_text("r0\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_fasta_lengths_and_n50(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\nAC\n>empty\n>y desc\nACG\n")
    got = readers.contig_lengths(spark, str(tmp_path / "a.fa"))
    assert sorted(r["length"] for r in got.collect()) == [3, 6]
    assert st.n50(got.select("length")).first()["n50"] == 6
    assert st.n50(got.select("length").limit(0)).first()["n50"] == 0
    assert st.largest(got.select("length").limit(0)).first()["largest"] == 0


def test_order_and_partitions_do_not_matter(spark, sf):
    from strandweave.workload import fixtures as fx

    rows = fx.virtual_alignments(spark, sf)
    a = ov.filter_alignments(rows, Params()).overlaps
    b = ov.filter_alignments(rows.repartition(13, "tname").orderBy(F.desc("block_len")), Params()).overlaps
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
