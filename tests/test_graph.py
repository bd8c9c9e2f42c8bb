import random

import pytest
from pyspark.sql import functions as F

from helpers import (
    components_by_hand, edges_df, graph_of, nids, pairs, random_rows, symmetric, transitive_by_hand, unitigs_by_hand,
)
from strandweave.operators import chains as ch
from strandweave.operators import components as cc
from strandweave.operators import graph as gr
from strandweave.operators import heuristics as hs
from strandweave.operators import reduction as red
from strandweave.operators import stats as st
from strandweave.operators import tips as tp
from strandweave.operators import unitigs as ut

A, B, C, D, E_, X = 0, 2, 4, 6, 8, 10


def sound(graph):
    return gr.symmetry_violations(graph).count() == 0


def test_transitive_triangle(spark):
    rows = symmetric([(A, B, 10, 90, 99), (B, C, 10, 90, 99), (A, C, 20, 80, 99)])
    graph = red.reduce_transitive(graph_of(spark, rows), 10)
    assert pairs(graph.edges) == {(A, B), (B, C), (C ^ 1, B ^ 1), (B ^ 1, A ^ 1)}
    assert sound(graph)


@pytest.mark.parametrize("seed", range(2))
def test_transitive_matches_the_sequential_rule(spark, seed):
    rows = random_rows(seed, 14, 90)
    got = pairs(red.transitive_edges(graph_of(spark, rows), 10))
    assert got == transitive_by_hand(rows, 10)


def test_transitive_on_a_hub(spark):
    """One node with edges to and from nearly everything."""
    rows = [(0, 2 * i, 10 + i, 500, 90) for i in range(1, 24)]
    rows += [(2 * i, 2 * i + 2, 3 + i % 17, 400, 95) for i in range(1, 23)]
    rows = symmetric(rows)
    assert pairs(red.transitive_edges(graph_of(spark, rows), 10)) == transitive_by_hand(rows, 10)


def test_short_edges_with_mirror(spark):
    rows = symmetric([(A, B, 5, 100, 99), (A, C, 5, 79, 99), (A, D, 5, 80, 99)])
    assert pairs(hs.short_edges(edges_df(spark, rows), 0.8)) == {(A, C)}
    graph = hs.remove_short_edges(graph_of(spark, rows), 0.8)
    assert (C ^ 1, A ^ 1) not in pairs(graph.edges) and sound(graph)


def test_weak_and_multi_edges(spark):
    rows = [(A, B, 5, 100, 90.0), (A, B, 7, 100, 95.0), (A, B, 6, 90, 99.0), (A, C, 5, 10, 96.0)]
    best = gr.dedupe_edges(edges_df(spark, rows)).filter(F.col("dst") == B).first()
    assert (best["edge_len"], best["identity"]) == (7, 95.0)
    graph = graph_of(spark, symmetric(rows))
    assert pairs(hs.remove_weak_edges(graph).edges) == {(A, C), (C ^ 1, A ^ 1)}
    again = gr.dedupe_edges(gr.dedupe_edges(edges_df(spark, rows)))
    assert again.count() == 2


def test_bridges_and_deletion(spark):
    graph = graph_of(spark, symmetric([(A, B, 5, 100, 90)]), extra_nodes=[X, X ^ 1])
    extra = edges_df(spark, [(A, B, 1, 1, 1.0), (B, X, 9, 50, 88.0)])
    grown = gr.add_edges(graph, extra)
    assert pairs(grown.edges) == {(A, B), (B ^ 1, A ^ 1), (B, X), (X ^ 1, B ^ 1)}
    assert grown.edges.filter("src = 0").first()["edge_len"] == 5
    one_sided = gr.add_edges(graph, extra, mirrored=False)
    assert gr.symmetry_violations(one_sided).count() == 1
    with pytest.raises(ValueError):
        gr.require_symmetry(one_sided)
    left = gr.delete_reads(grown, spark.createDataFrame([(B ^ 1,)], "nid bigint"))
    assert nids(left.nodes) == {A, A ^ 1, X, X ^ 1} - {A, A ^ 1} | {A, A ^ 1}
    assert left.edges.count() == 0


def test_isolated_nodes_go(spark):
    graph = graph_of(spark, symmetric([(A, B, 5, 100, 90)]), extra_nodes=[X, X ^ 1])
    assert nids(cc.remove_small_components(graph).nodes) == {A, A ^ 1, B, B ^ 1}
    assert nids(cc.remove_small_components(graph, 3).nodes) == set()


@pytest.mark.parametrize("seed", range(1))
def test_components_match_union_find(spark, seed):
    rows = random_rows(seed, 60, 45)
    got = {r["nid"]: r["comp"] for r in cc.components(graph_of(spark, rows)).collect()}
    assert got == components_by_hand(rows)


def test_long_path_is_one_component(spark):
    rows = [(2 * i, 2 * ((i * 37 + 1) % 101), 1, 1, 1.0) for i in range(100) if i != (i * 37 + 1) % 101]
    got = {r["nid"]: r["comp"] for r in cc.components(graph_of(spark, rows)).collect()}
    assert got == components_by_hand(rows)


def test_bubble_chains_are_not_rewritten(spark, monkeypatch):
    rows = []
    for i, o in enumerate(random.Random(1).sample(range(1, 200), 150)):
        if i:
            rows += [(last * 2, 10_000 + 20 * i + k * 2, 1, 1, 1.0) for k in range(8)]
            rows += [(10_000 + 20 * i + k * 2, o * 2, 1, 1, 1.0) for k in range(8)]
        last = o
    written, plain = [], cc.settle

    def counted(df, label, **metrics):
        done, seen = plain(df, label, **metrics)
        written.append(seen["rows"])
        return done, seen

    monkeypatch.setattr(cc, "settle", counted)
    got = {r["nid"]: r["comp"] for r in cc.components(graph_of(spark, rows)).collect()}
    assert got == components_by_hand(rows) and len(set(got.values())) == 1
    assert sum(written) < 2.5 * len(rows)


def test_tips(spark):
    # t -> x where x has two in-edges
    branching = symmetric([(A, X, 5, 100, 90), (B, X, 5, 100, 90), (X, C, 5, 100, 90)])
    assert {A, B} <= nids(tp.tip_nodes(graph_of(spark, branching)))
    simple = graph_of(spark, symmetric([(A, X, 5, 100, 90), (X, C, 5, 100, 90), (C, D, 5, 100, 90)]))
    assert A not in nids(tp.tip_nodes(simple))
    assert A in nids(tp.tip_nodes(simple, "documented", 4))
    assert A not in nids(tp.tip_nodes(simple, "documented", 2))
    with pytest.raises(ValueError):
        tp.tip_nodes(simple, "observed", 0)


def test_tip_lengths_and_degrees(spark):
    graph = graph_of(spark, symmetric([(A, B, 5, 100, 90), (B, C, 5, 100, 90), (D, C, 5, 100, 90)]))
    got = {r["nid"]: r["length"] for r in st.tip_lengths(graph).collect()}
    assert got == {A: 2, D: 1, C ^ 1: 0}
    assert {r["length"] for r in st.tip_lengths(graph, 1).collect()} == {0, 1}
    empty = graph_of(spark, [])
    assert st.compressible_fraction(empty).first()["fraction"] == 0.0


@pytest.mark.parametrize("seed", range(2))
def test_unitigs_match_walks(spark, seed):
    rows = random_rows(seed, 40, 42)
    found = ut.compress(graph_of(spark, rows))
    paths = {}
    for r in found.members.collect():
        paths.setdefault(r["unitig_id"], {})[r["pos"]] = r["node"]
    got = {tuple(p[i] for i in range(len(p))) for p in paths.values()}
    assert got == unitigs_by_hand(rows)


@pytest.mark.parametrize("seed,near", [(0, False), (1, True), (2, False)])
def test_chains_over_stretches(spark, seed, near):
    rng, rows, want, at = random.Random(seed), [], [], 0
    for size in [2, 3, 40, 5, 60, 2, 30, 90]:
        ids = list(range(at, at + size)) if near else rng.sample(range(at * 10, at * 10 + 5000), size)
        at += 1000
        ring = size % 3 == 0
        if ring:
            k = ids.index(min(ids))
            ids = ids[k:] + ids[:k]
        offset = 0
        for i, x in enumerate(ids):
            want.append((x, ids[0], i, offset, ring))
            if ring or i + 1 < size:
                rows.append((x, ids[(i + 1) % size], rng.randint(1, 60), 100, 90.0))
                offset += rows[-1][2]
    rng.shuffle(rows)
    graph = graph_of(spark, rows, [10**6])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ch.chain_table(graph, stretch=20).nodes.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(tuple(r) for r in got) == sorted([*want, (10**6, 10**6, 0, 0, False)])


def test_neighbouring_nodes_need_no_rounds(spark, monkeypatch):
    rows = [(i, (i + 1) % 1000, 1, 100, 90.0) for i in range(1000)]
    graph, written = graph_of(spark, rows), []
    plain = ch.settle

    def counted(df, label, **metrics):
        done, seen = plain(df, label, **metrics)
        written.append(seen["rows"])
        return done, seen

    monkeypatch.setattr(ch, "settle", counted)
    nodes = ch.chain_table(graph).nodes
    assert nodes.filter("cyclic and head = 0 and pos = nid and offset = nid").count() == 1000
    assert sum(written) < 1000


def test_cycle_of_four(spark):
    rows = symmetric([(A, B, 1, 9, 90), (B, C, 2, 9, 90), (C, D, 3, 9, 90), (D, A, 4, 9, 90)])
    found = ut.compress(graph_of(spark, rows))
    ring = found.unitigs.orderBy("first").collect()
    assert [(r["first"], r["n_members"], r["topology"]) for r in ring] == [(A, 4, "c"), (A ^ 1, 4, "c")]
    ahead = found.members.filter("unitig_id = 0").orderBy("pos").collect()
    assert [(r["node"], r["edge_len"], r["offset"]) for r in ahead] == [(A, 1, 0), (B, 2, 1), (C, 3, 3), (D, 4, 6)]
    kept = ut.drop_twins(found)
    assert kept.unitigs.count() == 1
    assert ut.topologies(kept.unitigs, kept.members, edges_df(spark, rows)).first()["topology"] == "c"


def test_singletons_option(spark):
    graph = graph_of(spark, symmetric([(A, B, 5, 100, 90)]), extra_nodes=[X, X ^ 1])
    assert ut.compress(graph).unitigs.count() == 2
    assert ut.compress(graph, singletons=True).unitigs.count() == 4


def test_twin_links_can_be_folded(spark):
    # C branches into two chains
    rows = symmetric([(A, B, 5, 9, 90), (B, C, 5, 9, 90), (C, D, 5, 9, 90), (C, E_, 5, 9, 90), (D, X, 5, 9, 90)])
    found = ut.compress(graph_of(spark, rows))
    plain, folded = ut.drop_twins(found), ut.drop_twins(found, fold=True)
    kept = {r["unitig_id"] for r in folded.unitigs.collect()}
    links = {(r["from_id"], r["to_id"]) for r in folded.edges.collect()}
    assert links and all(a in kept and b in kept for a, b in links)
    assert {(r["from_id"], r["to_id"]) for r in plain.edges.collect()} <= links


@pytest.mark.parametrize("light", [3, 256])
def test_two_hops_that_nothing_closes_are_not_shuffled(spark, monkeypatch, light):
    monkeypatch.setattr(red, "_LIGHT", light)
    rng = random.Random(light)
    steps = {(rng.randrange(400), rng.randrange(400)) for _ in range(6000)} | {(0, i) for i in range(1, 400)}
    out = {(a, b): 1 + (a * 31 + b * 17) % 60 for a, b in steps if a != b}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in out.items()], "src bigint, dst bigint, edge_len bigint")
    after = {}
    for a, b in out:
        after.setdefault(a, []).append(b)
    want = {(a, b, c, n, out[b, c], out[a, c]) for (a, b), n in out.items() for c in after.get(b, []) if (a, c) in out}
    got = [tuple(r) for r in red.closed_two_hops(edges).collect()]
    assert len(got) == len(want) and set(got) == want
    directed = red._directed(edges)
    ahead = directed.select(F.col("lo").alias("hi"), F.col("hi").alias("z"))
    hops = directed.select("lo", "hi").join(ahead, "hi")
    closed = hops.join(directed.select("lo", F.col("hi").alias("z")), ["lo", "z"]).count()
    corners = red._corners(directed).count()
    assert closed <= corners < closed + 0.15 * (hops.count() - closed)
