"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from pyspark.sql import functions as F
from strandweave.plans.settle import table
from strandweave.session import tune
from strandweave.workload import fixtures as fx

# one per family; check.py runs all of them
NAMES = [
    "read_stats", "longest_budget", "coverage_estimate", "bernoulli_depth", "fastq_records", "paf_rows",
    "contig_lengths", "n50_by_lang", "filter_reasons", "best_per_pair", "interval_depth_suppliers",
    "covered_region", "overlap_class_coclip", "kept_overlaps", "add_bridge_edges", "ranked_edges",
    "transitive_reduce_dense", "multi_edge_dedup", "short_edge_removal", "weak_edge_removal", "degree_histogram",
    "tip_trim", "components", "biloop_cut", "internal_chain_cut", "chains", "unitig_edges", "strong_bridges",
]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, db, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_assembly_is_one_exact_stretch(spark, sf):
    import hashlib

    done = entry.queries()["unitig_sequence"](spark, sf).orderBy("chunk").collect()
    text = "".join(r["seq"] for r in done)
    letters = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
    genome = "".join(hashlib.md5(str(i).encode()).hexdigest()[0] for i in range(108000)).translate(letters)
    back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert len(text) == 99634 and (text in genome or back in genome)


def test_reads_are_cut_without_a_shuffle_of_bases(spark, sf):
    plan = fx.virtual_sequences(spark, sf)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange" in line]
    # bases are made above the only exchange
    assert len(shuffled) == 1 and plan.index("md5") < plan.index("Exchange")


def test_a_task_reads_a_bounded_share_of_a_table(spark):
    rows = table(tune(spark).range(1 << 23).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b")), "wide")
    # 134 MB that do not compress, on 8 cores
    assert rows.rdd.getNumPartitions() >= 16
