"""Spelling variants, source mixing and the Merkle manifest against brute force, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from strandweave.llm import merkle, mixing, spelling

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, word string, size int"


def frame(spark, rows, partitions=3):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(partitions)


def odd_rows(n, sources, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(["ab ", "c\n", "é ", "ß", "\t", "word "]) for _ in range(rng.randint(0, 40)))
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3]), text()) for i in range(n)]
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, None, None, None, "a\nb"), (n, "s", None, 1, "x " * 3000)]
    return rows + [(n + 1, "", "", 0, ""), (1, rows[1][1], "en", 3, "another text of id 1")]


# ---- Merkle manifest


def brute_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    order = lambda v: (v is not None, v)
    trees = {}
    for r in rows:
        t = r[4]
        if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            t = t.replace("\n", "")
        trees.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], t))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, i):
        steps = []
        for level in tree[:-1]:
            a = i // 3 * 3
            steps.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
            i //= 3
        return steps

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda r: (order(r[0]) if r[0] is not None else (False, 0), r[1]))
        built[s] = levels([r[1] for r in trees[s]])
    top = levels([built[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for i, (doc, own, changed) in enumerate(trees[s]):
            steps = way(built[s], i) + way(top, k)
            fold = changed
            for left, right in steps:
                fold = h(left + fold + right)
            root = top[-1][0]
            found.append((doc, own, built[s][-1][0], root, h("".join(a + b for a, b in steps)), fold, fold == root))
    return found


@pytest.mark.parametrize("n,sources", [(40, ["s", "t"]), (2300, ["hot"] * 30 + ["s", None, "é", "z", "Z", ""])])
def test_manifest_is_brute_force(spark, n, sources):
    rows = odd_rows(n, sources)
    got = sorted(map(repr, map(tuple, merkle.manifest(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, brute_manifest(rows)))


def test_manifest_of_little(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    rows = [(5, "a", "en", 1, "one\ntwo")]
    assert [tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()] == brute_manifest(rows)


def test_versions_share_their_nodes():
    leaves = [merkle.digest(str(i)) for i in range(50)]
    tree = merkle.PersistentTree(leaves)
    before, root = list(tree.digests), tree.digests[tree.root]
    version = tree.replaced(tree.root, 17, "x")
    assert len(tree.digests) == len(before) + tree.height + 1 and tree.digests[: len(before)] == before
    again = merkle.PersistentTree([*leaves[:17], "x", *leaves[18:]])
    assert tree.digests[version] == again.digests[again.root] != root
    assert tree.siblings(version, 17) == tree.siblings(tree.root, 17)


def test_many_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SPAN", 9)
    rows = odd_rows(400, ["hot"] * 8 + [f"s{i}" for i in range(30)])
    got = sorted(map(repr, map(tuple, merkle.manifest(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, brute_manifest(rows)))


# ---- source mixing


def brute_seats(votes, caps, seats, names):
    """Seat by seat to the highest quotient."""
    got = [0] * len(votes)
    offers = [(-Fraction(v), n, i) for i, (v, n) in enumerate(zip(votes, names)) if v and caps[i]]
    heapq.heapify(offers)
    for _ in range(seats):
        if not offers:
            break
        _, n, i = heapq.heappop(offers)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(offers, (-Fraction(votes[i]) / (2 * got[i] + 1), n, i))
    return got


def brute_mix(rows, block, shard, seed=0):
    sizes = {}
    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    for r in rows:
        sizes.setdefault(r[1], []).append((r[0], words(r[4])))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, n in sizes[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        left = sum(weight[s] for s in names if s not in stopped)
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in stopped)) / left if left else 0
        more = {s for s in names if weight[s] * level >= 2 * total[s]} | stopped
        if more == stopped or not left:
            break
        stopped = more
    target = {s: min(2.0 * total[s], weight[s] * level) if s not in stopped else 2.0 * total[s] for s in names}
    blocks = {s: -(-total[s] // block) for s in names}
    votes = [target[s] * blocks[s] / total[s] if total[s] else 0.0 for s in names]
    seats = brute_seats(votes, [2 * blocks[s] for s in names], round(sum(votes)), range(len(names)))
    out = []
    for s, quota in zip(names, seats):
        tree = "," if s is None else "+" + s
        shards = range(-(-blocks[s] // shard))
        n = [min(shard, blocks[s] - shard * i) for i in shards]
        dealt = brute_seats(n, [2 * v for v in n], quota, shards)
        assert dealt == [mixing.shard_quota(quota, blocks[s], shard, i, 2) for i in shards]
        turns = [t for i in shards for t in mixing.block_turns(tree, i, blocks[s], shard, quota, 2, seed)]
        assert sum(turns) == quota and max(turns, default=0) <= 2
        place = 0
        for doc, size in sorted(sizes[s], key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
            taken = sum(int(turns[w // block]) for w in range(place, place + size))
            place += size
            out.append((doc, size, total[s], target[s], taken))
    return out


def near(rows):
    return sorted(map(repr, [(*r[:3], round(r[3], 6), r[4]) for r in map(tuple, rows)]))


@pytest.mark.parametrize("block,shard", [(4, 8), (16, 4096), (1, 3)])
def test_mix_is_brute_force(spark, block, shard):
    rows = odd_rows(150, ["hot"] * 9 + ["s", "t", None, "é", "u"])
    got = mixing.mix(frame(spark, rows), block=block, shard=shard).collect()
    assert near(got) == near(brute_mix(rows, block, shard))
    assert near(mixing.mix(frame(spark, rows, 7), block=block, shard=shard).collect()) == near(got)
    for s in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == s]
        assert all(r.taken <= 2 * r.size for r in mine)


def test_mix_meets_its_targets(spark):
    rows = [(i, f"s{i % 7}", None, None, "w " * (i % 50)) for i in range(700)]
    got = mixing.mix(frame(spark, rows), block=8).toPandas()
    by = got.groupby(got.doc_id % 7).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 16).all() and abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6


def test_mix_of_little(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, "a", None, None, None), (2, None, None, None, " \n")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_equal_quotients_go_to_the_smaller_party(spark):
    rows = [(f"p{i}", v, 9) for i, v in enumerate([2.5, 2.5, 2.5, 2.5, 1.0, 0.0])]
    for seats in range(14):
        got = mixing.apportioned(spark.createDataFrame(rows, "tree string, votes double, cap int"), "votes", "cap", seats, "tree")
        got = {r.tree: r.quota for r in got.collect()}
        assert [got[r[0]] for r in rows] == brute_seats([r[1] for r in rows], [9] * 6, seats, range(6))


# ---- spelling variants


def brute_words(rows):
    words = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[4] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def spelled_rows(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcÉé") for _ in range(rng.randint(5, 8))) for _ in range(25)]
    pool = base + [w[:i] + rng.choice("abÉß") + w[i + rng.randint(0, 1) :] for w in base for i in range(4)]
    pool += ["aaaaa", "aaaaaa", "aaaaaaa", "z" * 3000, "z" * 2999, "ß" * 40]
    texts = [" ".join(rng.choices(pool, [1 / (i + 1) for i in range(len(pool))], k=60)) for _ in range(80)]
    texts = [t.upper() if i % 9 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, "s", None, None, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, None, None, None, texts[5]), (7, None, None, None, None), (8, "s", None, None, "")]


def test_variants_are_brute_force(spark):
    rows = spelled_rows()
    want = sorted(map(repr, brute_variants(rows)))
    assert sorted(map(repr, map(tuple, spelling.variants(frame(spark, rows)).collect()))) == want
    assert any("'z" in w for w in want)


def test_small_broadcasts_change_nothing(spark):
    words = brute_words(spelled_rows())
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = sorted((a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b))
    plan = spelling.filter_plan(Counter(map(len, words)), 16, 64)
    assert len(plan) > 3 and any(parts > 1 for batch in plan for _, _, parts, _ in batch)
    for bits, batch_bytes in ((16, 64), (1, 64), (16, 16 << 20)):
        got = spelling.near_pairs(df, bits, batch_bytes).collect()
        assert sorted(map(tuple, got)) == want


def test_edit_hashes():
    words = ["abcde", "aabbc", "ééßaz"]
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint64)
    seen = set()
    for length, n, at, letter, hashes in spelling.edits(words, alphabet):
        for k in range(len(hashes)):
            w, i = words[n[k]], int(at[k])
            new = w[:i] + (chr(int(letter[k])) if length == 5 else "") + w[i + 1 :]
            assert (w, new) not in seen and len(new) == length
            seen.add((w, new))
            assert spelling._hashes(spelling._points(new)[None])[0] == hashes[k]


def test_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, None, None, "ab ab ab abcde")])).count() == 0
