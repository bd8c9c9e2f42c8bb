"""Hidden, broken and endless secrets; models that do not depend on partitions; long quotations; deep pages."""

import base64
import json
import os
import random
import time

import numpy as np
import pytest

from strandweave.llm import html_crf, language_codes, secret_scan, toxicity


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def rsa(rng, size=64):
    ints = [der(2, bytes([0, *(rng.randrange(1, 255) for _ in range(size - 1))])) for _ in range(3)]
    return base64.b64encode(der(0x30, der(2, b"\0") + b"".join(ints))).decode()


def ssh(rng):
    field = lambda b: len(b).to_bytes(4, "big") + b
    return base64.b64encode(field(b"ssh-ed25519") + field(bytes(rng.randrange(256) for _ in range(32)))).decode()


def token(header):
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return f"{part(header)}.{part(b'{}')}.c2ln"


def wrapped(text, width, line="\n"):
    return line.join(text[i : i + width] for i in range(0, len(text), width))


KEY, SSH = rsa(random.Random(1)), ssh(random.Random(2))
JWT = json.dumps({"typ": "JWT", "alg": "HS256"}).encode()


@pytest.mark.parametrize(
    "before,secret,after,kind",
    [
        ("key is ", KEY, " end", "der"),
        ("path/", KEY, "\n", "der"),
        ("k-", KEY, "", "der"),
        ("a_b+", KEY, ".", "der"),
        ("lines:\n", wrapped(KEY, 16), "\n\nmore", "der"),
        ("x = '", wrapped(KEY, 64, "\\n"), "'", "der"),
        ("x = '", wrapped(KEY, 64, "\r\n    "), "'", "der"),
        ("host ", SSH, " me@host", "sshkey"),
        ("dir/", SSH, "", "sshkey"),
        ("hex ", base64.b64decode(KEY).hex(), " end", "der"),
        ("", "-----BEGIN RSA PRIVATE KEY-----\\n" + wrapped(KEY, 64, "\\n") + "\\n-----END RSA PRIVATE KEY-----", "", "pem"),
        (
            "",
            "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123456789ABCDEF\n\n"
            + wrapped(base64.b64encode(bytes(range(64))).decode(), 32)
            + "\n-----END RSA PRIVATE KEY-----",
            "",
            "pem",
        ),
        ("Bearer ", token(JWT), " end", "jwt"),
        ("Bearer_", token(JWT), "", "jwt"),
        ("x ", token(b' {"alg":"none"}'), "", "jwt"),
        ("x ", token(b'\n{ "alg": "RS256", "kid": "' + b"k" * 900 + b'"}'), "", "jwt"),
    ],
)
def test_structures_are_found(before, secret, after, kind):
    spans = secret_scan.confirmed_spans(before + secret + after)
    assert (len(before), kind, len(before) + len(secret)) in spans, spans


@pytest.mark.parametrize(
    "text",
    [
        "a.b.c www.example.org version 1.2.3 eyJ.eyJ.eyJ",
        token(b'{"typ":"JWT"}') + " " + token(b'{"alg":5}') + " " + token(b'["alg"]'),
        KEY[:-8] + " " + "M" + KEY[2:],
        "-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----",
        base64.b64encode(os.urandom(0) + bytes(range(48))).decode() + " " + "A" * 60,
    ],
)
def test_what_only_looks_like_one_is_not(text):
    assert [s for s in secret_scan.confirmed_spans(text)] == []


def test_a_deep_header_is_no_token(spark):
    deep = base64.urlsafe_b64encode(b'{"a":' * 60_000).decode() + ".abc.def"
    rows = [(1, deep), (2, token(JWT))]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == "" and got[2].startswith("jwt:0:")


@pytest.mark.parametrize(
    "unit", ["eyJ", "eyJ-", "eyJhIjo", "eyJhIjo-", "a.", "eyJ.", "M", "MIIB/", "MIIB\n", "AAAA/", "AAAAB3Nz\\n", "30", "-----BEGIN PRIVATE KEY-----", "password ", "x"]
)
def test_a_megabyte_takes_seconds(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.process_time()
    secret_scan.base_spans(text), secret_scan.confirmed_spans(text)
    assert time.process_time() - start < 6


def brute_trigrams(texts):
    n = np.zeros(language_codes.BUCKETS, np.int64)
    for t in texts:
        b = t.lower().encode()
        for i in range(len(b) - 2):
            n[(b[i] * 31_337 + b[i + 1] * 257 + b[i + 2]) % language_codes.BUCKETS] += 1
    return n


def test_trigrams_belong_to_one_text(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab", "abc", "ÄÖ"] + ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = [("x", t) for t in texts]
    want = brute_trigrams(texts)
    for partitions in (1, 7):
        frame = spark.createDataFrame(rows, "lang string, text string").repartition(partitions)
        got = np.zeros(language_codes.BUCKETS, np.int64)
        for r in language_codes.count_trigrams(frame).collect():
            got[r.bucket] += r.n
        assert (got == want).all()


def test_a_long_quotation_is_a_quotation():
    lexicon = toxicity.Lexicon.build({"scoundrel": 5.0})
    filler = " ".join(["word"] * 300)
    long = toxicity.features(lexicon, f'they printed "{filler} scoundrel {filler}" and left')
    short = toxicity.features(lexicon, 'they printed "you scoundrel you" and left')
    assert long[3] == short[3] > 0 and long[2] == short[2] == 0
    assert toxicity.features(lexicon, f"{filler} scoundrel {filler}")[2] > 0


@pytest.mark.parametrize("unit", ["<div>x", "<p>x", "<b>x", "<span><p>x", "<a>x", "</section>x", "<div><li>x"])
def test_a_deep_page_takes_seconds(unit):
    start = time.process_time()
    found = html_crf.blocks(unit * 8000)
    assert time.process_time() - start < 4 and found


def test_an_end_is_found_however_deep():
    page = "<ul><li>one" + "<b>" * 30 + "two<li>three</ul>"
    assert [b.text for b in html_crf.blocks(page)] == ["onetwo", "three"]
    assert "li" in html_crf.blocks(page)[1].tags and "b" not in html_crf.blocks(page)[1].tags
