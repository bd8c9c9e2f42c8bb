"""Small graphs for tests and plain restatements of the graph rules to compare with."""

from __future__ import annotations

import random
from collections import defaultdict

from strandweave.operators.graph import EDGE_COLUMNS, Graph, from_edges
from strandweave.plans.settle import table

EDGES = "src bigint, dst bigint, edge_len bigint, overlap_len bigint, identity double"


def edges_df(spark, rows):
    return table(spark.createDataFrame([tuple(r) for r in rows], EDGES).coalesce(1), "test-edges")


def symmetric(rows):
    """Rows and their mirrors, the first row per (src, dst)."""
    out = {}
    for s, d, ln, ov, idy in rows:
        out.setdefault((s, d), (s, d, ln, ov, float(idy)))
        out.setdefault((d ^ 1, s ^ 1), (d ^ 1, s ^ 1, ln, ov, float(idy)))
    return list(out.values())


def graph_of(spark, rows, extra_nodes=()) -> Graph:
    graph = from_edges(edges_df(spark, rows))
    if extra_nodes:
        more = spark.createDataFrame([(n,) for n in extra_nodes], "nid bigint")
        graph = Graph(graph.nodes.union(more).distinct(), graph.edges)
    return graph


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.select("src", "dst").collect()}


def nids(df):
    return {r["nid"] for r in df.select("nid").collect()}


def random_rows(seed, reads, edges):
    rng = random.Random(seed)
    rows = []
    while len(rows) < edges:
        a, b = rng.randrange(2 * reads), rng.randrange(2 * reads)
        if a >> 1 != b >> 1:
            rows.append((a, b, rng.randint(1, 60), rng.randint(100, 900), rng.randint(80, 100)))
    return symmetric(rows)


def transitive_by_hand(rows, fuzz):
    out = defaultdict(list)
    for s, d, ln, *_ in rows:
        out[s].append((ln, d))
    reduced = set()
    for n1, steps in out.items():
        steps = sorted(steps)
        reach = steps[-1][0] + fuzz
        targets, gone = {d for _, d in steps}, set()
        for ln, n2 in steps:
            if n2 in gone:
                continue
            gone |= {d for l2, d in out.get(n2, []) if l2 + ln <= reach and d in targets}
        for _, n2 in steps:
            near = min((l2 for l2, _ in out.get(n2, [])), default=None)
            gone |= {d for l2, d in out.get(n2, []) if (l2 < fuzz or l2 == near) and d in targets}
        reduced |= {(n1, d) for d in gone}
    return reduced


def components_by_hand(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, d, *_ in rows:
        a, b = find(s), find(d)
        if a != b:
            parent[max(a, b)] = min(a, b)
    low = {}
    for x in list(parent):
        low[find(x)] = min(low.get(find(x), x), x)
    return {x: low[find(x)] for x in parent}


def unitigs_by_hand(rows):
    """Maximal non-branching paths and pure cycles as tuples of nodes."""
    out, into = defaultdict(list), defaultdict(list)
    for s, d, *_ in rows:
        out[s].append(d)
        into[d].append(s)
    nodes = set(out) | set(into)

    def simple(x):
        return len(out[x]) == 1 and len(into[x]) == 1

    found, covered = set(), set()
    for u in nodes:
        if simple(u):
            continue
        for v in out[u]:
            if len(into[v]) != 1:
                continue
            path = [u, v]
            while len(out[path[-1]]) == 1 and len(into[out[path[-1]][0]]) == 1 and out[path[-1]][0] != u:
                path.append(out[path[-1]][0])
            found.add(tuple(path))
            covered |= set(path)
    for u in sorted(nodes):
        if simple(u) and u not in covered:
            path = [u]
            while out[path[-1]][0] != u and simple(out[path[-1]][0]) and out[path[-1]][0] not in covered:
                path.append(out[path[-1]][0])
            if out[path[-1]][0] == u:
                found.add(tuple(path))
                covered |= set(path)
    return found


__all__ = [n for n in dir() if not n.startswith("_")] + ["EDGE_COLUMNS"]
