"""Duplicate stages on rows whose ids are null, repeated or shared, and the parts of the Jaccard join."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandweave.llm import exact_dedup, jaccard_regions
from test_operators import jaccard_brute

NAMES = "doc_id bigint, text string, _text_key int, digest string, kept boolean, size int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "x", False, 2) for r in rows], NAMES).repartition(partitions)


def near_groups(seed, groups=40, alphabet=40):
    rng, rows = random.Random(seed), []
    letters = [f"w{i}" for i in range(alphabet)]
    passage = [rng.choice(letters) for _ in range(60)]
    for _ in range(groups):
        base = [rng.choice(letters) for _ in range(rng.choice([1, 4, 5, 8, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(letters)
            rows.append((len(rows), " ".join(words + (passage if rng.random() < 0.3 else []))))
    return rows


def test_the_unlike_text_of_a_shared_id_stays(spark):
    a = " ".join(f"a{i}" for i in range(60))
    near, unlike = a + " end", " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, near), (5, unlike), (None, a), (None, near), (7, None), (7, None), (8, ""), (None, " ")]
    got = jaccard_regions.one_per_component(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (5, unlike), (7, None), (8, ""), (None, " ")])


def test_one_row_of_each_text_stays(spark):
    rows = [(5, "A"), (5, "A"), (3, "A"), (None, "A"), (None, "B"), (None, "B"), (5, "C"), (5, None), (6, "")]
    got = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(5, "A"), (None, "B"), (5, "C"), (6, "")])
    empty = frame(spark, [])
    assert exact_dedup.drop_exact_duplicates(empty).count() == jaccard_regions.one_per_component(empty).count() == 0


def brute_kept(rows):
    """The rows that stay, where ids are unique."""
    return Counter(d for d, _, c in jaccard_brute(rows) if d == c)


def test_one_per_component_is_brute_force(spark):
    rows = near_groups(8)
    got = jaccard_regions.one_per_component(frame(spark, rows, 5))
    assert Counter(r.doc_id for r in got.collect()) == brute_kept(rows)


@pytest.mark.parametrize("most,pivots,first,block", [(6, 3, 2, 3), (4, 8, 32, 4096)])
def test_cells_and_blocks_lose_no_link(spark, monkeypatch, most, pivots, first, block):
    monkeypatch.setattr(jaccard_regions, "_FIRST", first)
    monkeypatch.setattr(jaccard_regions, "_MORE", 2)
    monkeypatch.setattr(jaccard_regions, "_BLOCK", block)
    seen, cut = [], jaccard_regions.cells

    def small(members, percent):
        done, levels = cut(members, percent, most, pivots)
        seen.extend(levels)
        return done, levels

    monkeypatch.setattr(jaccard_regions, "cells", small)
    rows = near_groups(9, 60)
    # distant families that share a passage: their cells part
    rng = random.Random(10)
    passage = [f"p{i}" for i in range(80)]
    for g in range(6):
        body = [f"g{g}x{i}" for i in range(90)]
        for _ in range(9):
            words = body[:]
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(passage + words)))
    got = jaccard_regions.jaccard_components(frame(spark, rows, 5)).collect()
    assert Counter(map(tuple, got)) == jaccard_brute(rows)
    assert seen and sum(level["large"] for level in seen)


def test_cells_part_distant_families(spark):
    bits = [f"s{i}" for i in range(16)]
    rng = random.Random(3)
    centres = [[rng.getrandbits(64) - (1 << 63) for _ in bits] for _ in range(4)]
    rows = []
    for i in range(200):
        s = list(centres[i % 4])
        s[rng.randrange(16)] ^= 1 << rng.randrange(63)
        rows.append((1, 200, i, 0, True, 20, *s))
    schema = "key bigint, size bigint, digest bigint, own int, home boolean, n_shingles bigint, " + ", ".join(f"{b} bigint" for b in bits)
    done, levels = jaccard_regions.cells(spark.createDataFrame(rows, schema), 80, 60, 8)
    assert levels[0]["cut"] and not levels[0]["whole"]
    homes = done.filter("home").groupBy("digest").count().filter("count <> 1")
    assert homes.count() == 0 and done.filter("home").count() == 200
    family = done.groupBy("key").agg(F.countDistinct(F.expr("digest % 4")).alias("n"))
    assert family.filter("n > 1").count() == 0


def test_two_sets_of_one_name(spark, monkeypatch):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{j}" for j in range(30))) for i in range(6)] + [(9, "c d e f g h")]
    real = jaccard_regions.digest

    def clashing(found, seed=0):
        return 7 if not seed and len(found) > 20 else real(found, seed)

    monkeypatch.setattr(jaccard_regions, "digest", clashing)
    got = {r.doc_id: r.component_id for r in jaccard_regions.jaccard_components(frame(spark, rows)).collect()}
    assert got == {0: 0, 2: 0, 4: 0, 1: 1, 3: 1, 5: 1, 9: 9}
