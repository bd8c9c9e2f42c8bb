"""Every operator against a brute-force version, a library or a round trip, and on odd rows."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandweave.llm import (
    bpe_prefix,
    exact_dedup,
    html_crf,
    jaccard_regions,
    kd_topk,
    language_codes,
    packing,
    records,
    secret_scan,
    toxicity,
)

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: null, empty, white space, copies, repeated rows, long words, special strings, other scripts
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (6, "x" * 3000),
    (7, "a  b\n\n c <|endoftext|> d"), (8, "É ΟΔΟΣ ½ 日本 don't 'S"), (None, "no id"), (9, "one two three " * 900),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string, n_shingles int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t or "" for i, t in ODD if i == r.doc_id)
        group = [i for i, t in ODD if (t or "") == text]
        best = max((i for i in group if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(group), r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 8, 9, None}


def test_prefix_bpe_is_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), bpe_prefix.codec(WORDS)
    rng, vocabulary = random.Random(3), sorted(own.id_of)
    texts = [t or "" for _, t in ODD]
    texts += ["".join(rng.choice("aeithsn") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(3)).replace("</w>", "") for _ in range(3000)]
    texts += ["helpjanemondaymotivation", "a\x1cb\x85c d", "İ ſ K Å é"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.coded(text)[2] == own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert bpe_prefix.encode_documents(odd, WORDS).count() == len(ODD)
    assert bpe_prefix.encode_documents(empty, WORDS).count() == 0


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids


def test_records_round_trip(spark, odd, empty, tmp_path):
    written = records.write_records(odd, BYTES, 2, str(tmp_path / "r"))
    got = sorted(records.record_rows(written).collect(), key=lambda r: r.start)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = np.array([*library_ids(text), 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    mixed = records.read_records(records.shuffled(spark, written, 5), written.folder, ids=True).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in mixed) == Counter(
        (i, (*library_ids(t), 2)) for i, t in ODD
    )
    assert records.record_rows(records.write_records(empty, BYTES, 2, str(tmp_path / "e"))).count() == 0
    framed = records.frame(b"payload")
    assert records.unframe(framed, 0) == (b"payload", len(framed))
    for at in range(len(framed)):
        with pytest.raises(ValueError):
            records.unframe(framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1 :], 0)


def check_plan(counts, capacity, groups):
    runs = packing.plan(dict(counts), capacity, groups).tolist()
    places, numbers = {}, Counter()
    for length, first, n, sequence, offset in runs:
        for i in range(n):
            numbers[length, first + i] += 1
            places.setdefault(sequence + i, []).append((offset, length))
    assert numbers == Counter((length, i) for length, n in counts.items() for i in range(n))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([1, 2, 7, 20, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 200)))
        check_plan(counts, capacity, rng.choice([1, 3, 10, 50]))
    counts = Counter(rng.choice([rng.randint(1, 300), rng.randint(300, 2048)]) for _ in range(4000))
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert check_plan(counts, 2048, 64) <= 1.02 * least + 1
    assert len(packing.plan({}, 10)) == 0


def test_pack(odd, empty):
    rows = packing.pack(odd, BYTES, capacity=64, ids=True).collect()
    whole = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256
        whole.setdefault((r.doc_id, r.start), []).append(bytes(r.ids))
    for doc_id, text in ODD:
        ids = np.array([*library_ids(text), 0], dtype="<u4").tobytes()
        for start, n in packing.cuts(len(ids) // 4, 64):
            assert ids[4 * start : 4 * (start + n)] in whole[doc_id, start]
    for own in {r.sequence_id for r in rows}:
        end = 0
        for r in sorted((r for r in rows if r.sequence_id == own), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert packing.pack(empty, BYTES).count() == 0


def jaccard_brute(rows):
    sets = []
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(5, len(words))
        sets.append((doc_id, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()))
    head = list(range(len(sets)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                head[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets))


def test_jaccard_regions(spark, odd, empty):
    got = jaccard_regions.jaccard_components(odd).collect()
    assert Counter(map(tuple, got)) == jaccard_brute(ODD)
    assert jaccard_regions.jaccard_components(empty).count() == 0
    rng, rows = random.Random(4), []
    letters = [f"w{i}" for i in range(40)]
    passage = [rng.choice(letters) for _ in range(60)]
    for _ in range(40):
        base = [rng.choice(letters) for _ in range(rng.choice([1, 4, 5, 6, 8, 9, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(letters)
            rows.append((len(rows), " ".join(words + (passage if rng.random() < 0.3 else []))))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert Counter(map(tuple, jaccard_regions.jaccard_components(frame).collect())) == jaccard_brute(rows)


def test_jaccard_keeps_the_region_of_a_rare_shingle(spark):
    """b and c link, a links to neither and is the pivot of all regions the three share: those of 15
    rare shingles and of 5 frequent ones."""
    rows = []
    for g in range(12):
        x, q = [f"g{g}x{i}" for i in range(104)], [f"g{g}q{i}" for i in range(20)]
        texts = [x[:80] + q, [*x[:103], "b"], [*x[:103], "c"]]
        others = [x[15:80] + q] * 3 + [x[15:103]] * 3 + [x[20:103]] + [x[76:103]] * 10 + [x[76:80] + q] * 10
        texts += [[f"g{g}o{n}w{i}" for i in range(200)] + o for n, o in enumerate(others)]
        rows += [(len(rows) + n, " ".join(t)) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    want = jaccard_brute(rows)
    assert sum(d != c for d, _, c in want) == 12
    assert Counter(map(tuple, jaccard_regions.jaccard_components(frame).collect())) == want


def der(tag, body):
    return bytes([tag, len(body)]) + body


def test_secret_scan(spark, odd, empty):
    key = base64.b64encode(der(0x30, der(0x02, b"\x00" * 9) + der(0x04, b"k" * 20))).decode()
    token = ".".join(
        base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"a":1}', b"sig-sig-sig")
    )
    ssh = base64.b64encode(b"\x00\x00\x00\x07ssh-rsa\x00\x00\x00\x03\x01\x00\x01").decode()
    text = f"é PassWord: 'hunter22' pw secret=abc AKIA{'A1' * 8} {'0af' * 8} {key} {token} {ssh} {'word' * 9}"
    spans = {(k, text[s:e]) for s, k, e in secret_scan.base_spans(text) + secret_scan.confirmed_spans(text)}
    assert spans == {
        ("assign", "PassWord: 'hunter22"), ("access", "AKIA" + "A1" * 8), ("hex", "0af" * 8), ("der", key),
        ("jwt", token), ("sshkey", ssh),
    }
    assert json.loads(secret_scan.decode64(token.split(".")[0])) == {"alg": "HS256"}
    none = hashlib.sha256(b"").hexdigest()
    got = secret_scan.scan(odd).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {none}
    assert secret_scan.scan(empty).count() == 0
    frame = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id bigint, text string, extra string")
    clean = {r.doc_id: r for r in secret_scan.redact(frame).collect()}
    assert clean[2].text is None and clean[1].extra == "x"
    assert not secret_scan.base_spans(clean[1].text) and clean[1].text.startswith("é [secret]")


def test_kd_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(120)]
    vectors += [(900, None), (950, [1.0, None] * 3), (1000, [float("nan")] * 6), (1050, [1.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in kd_topk.top_k(frame, shard_rows=64).collect()}
    own = {
        i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)
        for i, v in vectors if i is not None and i < 900
    }
    want = {}
    for q in own:
        if q % 50 == 0:
            best = sorted((-int(v @ own[q]), i) for i, v in own.items() if i != q)[:5]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert kd_topk.top_k(frame.limit(0)).count() == 0


def test_kd_topk_repeated_ids_and_empty_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=3)]) for i in [*range(150), 0, 0, 7, 50, 100, 100]]
    rows += [(200, rows[0][1]), (200, rows[0][1])] + [(i, []) for i in range(1000, 1100, 2)] + [(1000, [])]
    found = kd_topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), shard_rows=32)
    want = []
    for x, (q, a) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted(
                (-sum(int(256 * u) * int(256 * v) for u, v in zip(a, b)), i)
                for y, (i, b) in enumerate(rows) if x != y and len(a) == len(b)
            )
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_language_codes(spark, sf, odd, empty):
    code = language_codes.codewords(4)
    assert code.shape == (4, 7) and min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_codes.fit(docs.filter("doc_id % 2 = 0"))
    found = language_codes.identify(docs.filter("doc_id % 2 = 1"), model).join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    got = language_codes.identify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = language_codes.fit(spark.createDataFrame([], "lang string, text string"))
    assert language_codes.identify(odd, nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_codes.identify(empty, model).count() == 0


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_levenshtein_automaton():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(150)})
    lexicon = toxicity.Lexicon.build({t: rng.random() + 1 for t in terms}, 1000)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 10)))
        near = [t for t in terms if one_error(word, t)]
        assert lexicon.misspelled(word) == max(near, key=lambda t: (lexicon.weight[t], t), default=None)


def test_misspelled_short_terms_and_large_lexicon():
    rng = random.Random(5)
    terms = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(1200)}
    weight = {t: rng.choice([1.5, 4.0]) + rng.random() for t in sorted(terms)}
    lexicon = toxicity.Lexicon.build(weight)
    tried = [t for t in weight if len(t) >= 5 or weight[t] > 3]
    assert len(tried) > 800 and min(map(len, tried)) == 3
    words = {t[:i] + c + t[k:] for t in tried[::5] for i in range(len(t)) for c in ("", "x", t[i]) for k in (i, i + 1)}
    for word in sorted(words - terms):
        near = [t for t in tried if one_error(word, t)]
        assert lexicon.misspelled(word) == max(near, key=lambda t: (weight[t], t))
        assert lexicon.look(word) == (weight[lexicon.misspelled(word)], True)
    lexicon = toxicity.Lexicon.build({"scum": 7.3, "idiot": 7.4, "thin": 1.5})
    for word in ("scm", "scumm", "skum", "idot", "diot", "idiott"):
        assert lexicon.look(word)[1], word
    assert lexicon.look("then") == (0.0, False)


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    plain = ["stone", "river", "green", "market", "window", "paper"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = words[rng.randrange(30)] = rng.choice(["grumble", "snarling"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"grumble", "snarling"} <= set(model.lexicon.weight)
    assert model.score("green grumbles paper window stone river") >= 0.3
    assert model.score("stone river green") < 0.3 and model.score(None) == model.score("")
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.scored(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_html_blocks_and_crf(spark):
    page = (
        "<head><title>t</title></head><nav><a href=x>Menu</a></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1>"
        "<p><b>one\n two<br>three.<p>four<script>p('</p>')</script> five</article><footer>&copy; x &middot"
    )
    assert [b.text for b in html_crf.blocks(page)] == ["Menu", "A & B", "one two three.", "four five", "© x ·"]
    assert html_crf.blocks("a < b <3 <p") and html_crf.blocks(None) == html_crf.blocks("") == []
    rng, made = random.Random(3), []
    while len(made) < 120:
        text, labels = html_crf.laid_out([f"Some words, and more. Line {i}." for i in range(5)], ["Menu", "Home x"], rng)
        found = html_crf.blocks(text)
        assert len(found) == len(labels)
        made.append((found, labels))
    crf = html_crf.train(made[:80])
    wrong = sum(a != b for p, y in made[80:] for a, b in zip(crf.decode(p), y, strict=True))
    assert wrong <= 0.03 * sum(len(y) for _, y in made[80:])
    short = [p for p, _ in made if len(p) <= 8][:5]
    for blocks in short:  # Viterbi against all label sequences
        own = [sum(crf.weight.get(f, 0.0) for f in b.features) for b in blocks]

        def value(y, own=own):
            steps = sum(crf.step[a][b] for a, b in zip(y, y[1:]))
            return crf.first[y[0]] + steps + sum(e for e, z in zip(own, y, strict=True) if z)

        every = [[m >> i & 1 for i in range(len(blocks))] for m in range(1 << len(blocks))]
        assert abs(value(crf.decode(blocks)) - max(map(value, every))) < 1e-9
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", "")]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), crf).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and got[2].text == ""


def brute_near(rows):
    """One row of each group of near copies among rows ``(id, text, ...)``."""
    sets = [shingle_set(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                comp[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_is_brute_force(spark, sf):
    import corpus_pipeline
    from strandweave.llm import queries
    from strandweave.plans.settle import table

    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in source.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = " ".join(f"word{i}" for i in range(80))
    odd = [(5, base), (900, base + " x"), (900, "quite another text of id 900"), (None, base), (None, base + " x"),
           (None, None), (901, ""), (901, ""), (902, "token = abcdef1234567890 in a text"), (903, "é " * 3000),
           (904, rows[0][1]), (904, rows[0][1]), (None, "alone without id")]
    rows += [(i, t, None, None, None if t is None else len(t)) for i, t in odd]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    for c in ("kept", "digest", "_text_key", "score", "comp", "tree"):
        docs = docs.withColumn(c, F.lit("clash"))
    model = queries.toxicity_model(spark, sf)
    want = [r for r in rows if model.score(r[1]) < 0.3]
    assert len(want) < len(rows)
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))
    names = docs.columns

    docs = table(stages["toxicity"](spark, docs, sf), "toxicity")
    assert docs.columns == names and plain(docs) == Counter((r[0], r[1]) for r in want)

    texts = {}
    for r in want:
        texts.setdefault(r[1] or "", []).append(r)
    want = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in texts.values()]
    docs = table(stages["exact dedup"](spark, docs, sf), "exact")
    assert docs.columns == names
    empty = lambda c: Counter({(i, t or ""): n for (i, t), n in c.items()})
    assert empty(plain(docs)) == empty(Counter((r[0], r[1]) for r in want))

    want = brute_near([(r.doc_id, r.text) for r in docs.collect()])
    assert (900, "quite another text of id 900") in want and len(want) < docs.count()
    docs = table(stages["n-gram Jaccard join"](spark, docs, sf), "near")
    assert docs.columns == names and plain(docs) == Counter(want)

    want = Counter((i, secret_scan._without(t, "[secret]")) for i, t in want)
    docs = table(stages["secret scans"](spark, docs, sf), "secrets")
    assert docs.columns == names and plain(docs) == want
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    assert any("[secret]" in (t or "") for _, t in want)

    packed = table(stages["best-fit packing"](spark, docs, sf), "packed").collect()
    tokens = Counter()
    for i, text in want.elements():
        tokens[i] += len(library_ids(text or "")) + 1
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in tokens} == dict(tokens)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(tokens.values())


def test_pipeline_of_nothing(spark, sf):
    import corpus_pipeline
    from strandweave.plans.settle import table

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, sf), "nothing")
        assert docs.count() == 0
