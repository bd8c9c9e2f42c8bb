import pytest
from pyspark.sql import functions as F
from helpers import graph_of, symmetric
from strandweave import assembly as asm
from strandweave.operators import unitigs as ut
from strandweave.operators.graph import Graph
from strandweave.sources import sinks

A, B, C, D, X, Y = 0, 2, 4, 6, 8, 10
SEQ = "ACGTTGCAGG"


def small(spark):
    """A ring of four and a chain of two; every read is ten bases, all of it covered."""
    rows = symmetric([(A, B, 1, 9, 90), (B, C, 2, 8, 90), (C, D, 3, 7, 90), (D, A, 4, 6, 90), (X, Y, 4, 6, 90)])
    graph = graph_of(spark, rows)
    nodes = graph.nodes.selectExpr(
        "nid", "concat('r', nid div 2, ':0-10', if(nid % 2 = 0, '+', '-')) as node_id",
        "concat('r', nid div 2) as read", "bigint(0) as cov_start", "bigint(10) as cov_end",
        "if(nid % 2 = 0, '+', '-') as ori",
    )
    return Graph(nodes, graph.edges)


def test_gfa_and_fasta(spark, tmp_path):
    graph = small(spark)
    reads = spark.createDataFrame([(f"r{i}", SEQ) for i in range(6)], "name string, seq string")
    done = asm.finish(graph, None, reads, graph.edges)
    sinks.write_gfa(str(tmp_path / "gfa"), done.sizes, done.unitigs.edges, done.layout, done.pieces(), width=3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "gfa").glob("part-*"))).split("\n")
    assert text.pop() == ""
    assert text[0] == "H\tVN:Z:1.0"
    assert [t.split("\t")[1] for t in text if t[0] == "S"] == ["unitig_0_c", "unitig_2_l"] or len([t for t in text if t[0] == "S"]) == 2
    assert len([t for t in text if t[0] == "L"]) == 2 and all(t.endswith("0M") for t in text if t[0] == "L")
    assert len([t for t in text if t[0] == "a"]) == 6
    ring = next(t for t in text if t[0] == "S" and "_c\t" in t).split("\t")[2]
    assert ring == SEQ[:1] + SEQ[:2] + SEQ[:3] + SEQ[:4]
    chain = next(t for t in text if t[0] == "S" and "_l\t" in t).split("\t")[2]
    assert chain == SEQ[:4] + SEQ
    bare = sinks.gfa_lines(done.sizes, done.unitigs.edges, done.layout).collect()
    assert any("*\tLN:i:14" in r["value"] for r in bare)
    # the last record of a name counts, and a read without one is an error
    doubled = reads.withColumn("rec_no", F.lit(1)).unionByName(
        reads.withColumns({"seq": F.lit("N" * len(SEQ)), "rec_no": F.lit(0)})
    )
    same = asm.finish(graph, None, doubled, graph.edges).pieces().collect()
    assert sorted(same) == sorted(done.pieces().collect())
    with pytest.raises(Exception, match="no sequence for read r3"):
        asm.finish(graph, None, reads.filter("name <> 'r3'"), graph.edges).pieces().collect()
    sinks.write_fasta(done.sizes, done.pieces(), str(tmp_path / "fa"), width=5)
    got = "".join(p.read_text() for p in sorted((tmp_path / "fa").glob("part-*"))).split(">")[1:]
    bodies = {"".join(r.split("\n")[1:]): r.split("\n")[0] for r in got}
    assert set(bodies) == {ring, chain}
    assert bodies[ring].endswith("len=10bp topology=c") and bodies[chain].endswith("len=14bp topology=l")


def test_compat_layout(spark):
    graph = small(spark)
    found = ut.drop_twins(ut.compress(graph))
    true = {r["utg_end"] for r in ut.layout(found.members, graph.nodes).filter("pos = 3").collect()}
    whole = {r["utg_end"] for r in ut.layout(found.members, graph.nodes, compat=True).filter("pos = 3").collect()}
    assert true == {10} and whole == {16}


def test_dot(spark, tmp_path):
    graph = small(spark)
    sinks.write_dot(graph.nodes, graph.edges, str(tmp_path / "dot"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*")))
    assert text.startswith("digraph overlaps {") and text.rstrip().endswith("}")
    assert '  "r0:0-10+" -> "r1:0-10+";' in text and 'fillcolor=gray' in text and text.count("->") == 10
