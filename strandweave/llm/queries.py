"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import (
    bpe_prefix,
    exact_dedup,
    html_crf,
    jaccard_regions,
    kd_topk,
    language_codes,
    merkle,
    mixing,
    packing,
    records,
    secret_scan,
    spelling,
    toxicity,
)
from strandweave.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.fit(pages))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = language_codes.fit(docs.filter(~held_out))
    return language_codes.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = read(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    return toxicity.fit(read(spark, sf_dir, "documents"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.jaccard_components(read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode_documents(
        read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = records.write_records(
        read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2
    )
    return records.record_rows(written)


def op10_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_topk.top_k(read(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_crf,
        op2_exact_dedup,
        op3_language_codes,
        op4_toxicity,
        op5_jaccard_regions,
        op6_secret_scan,
        op7_prefix_bpe,
        op8_best_fit_packing,
        op9_token_records,
        op10_kd_topk,
        op11_spelling_variants,
        op12_source_mix,
        op13_merkle_manifest,
    )
}

#: crc32 of a list of bytes, by the table ``t`` of its polynomial
_CRC_TABLE = """
        crc AS MATERIALIZED (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i] || range(8), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) r(i)
            )
        )"""


def _crc(bytes_: str) -> str:
    return (
        f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {bytes_}, lambda c, b: "
        "xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
    )


def _utf8(text: str) -> str:
    """Bytes of a text whose code points are below 128 or from 192 to 255."""
    return (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 "
        "THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))"
    )


def _leaf(text: str) -> str:
    parts = [
        f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)
    ]
    return "sha256(" + " || ".join(parts) + ")"


SQL: dict[str, str] = {
    "op10_kd_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS n,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.n, a.vec_id AS query_id, b.vec_id,
                   CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.n <> b.n
            WHERE a.vec_id % 50 = 0
        ),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text
    """,
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (
            SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) u(r)
        ),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
        hashed AS (
            SELECT run, n, {_crc(_utf8("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM counted, crc
        ),
        changed AS (
            SELECT n, CASE WHEN h % 97 = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
            FROM hashed
        ),
        words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ),
        cuts AS MATERIALIZED (
            SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
            FROM words, unnest(range(1, length(word) + 1)) u(i)
        ),
        less AS (SELECT DISTINCT word, n, a || b AS shorter FROM cuts),
        pairs AS (
            SELECT x.word, x.n, y.word AS near, y.n AS near_n
            FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
            UNION ALL
            SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.shorter = w.word
            UNION ALL
            SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.shorter = w.word
        ),
        best AS (
            SELECT word, n, count(*) AS n_near, max(near_n) AS m, min(struct_pack(m := -near_n, w := near)).w AS w
            FROM pairs GROUP BY word, n
        ),
        forms AS MATERIALIZED (
            SELECT w.word, CASE WHEN b.m >= 2 * w.n THEN b.w END AS form, w.n,
                   coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word
        ),
        walk AS (
            SELECT word, word AS at FROM forms
            UNION ALL
            SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL
        ),
        ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NULL)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS MATERIALIZED (
            SELECT doc_id, source, {_leaf("text")} AS leaf,
                   CASE WHEN {_crc(_utf8("CAST(doc_id AS VARCHAR)"))} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
                   ELSE {_leaf("text")} END AS changed
            FROM documents, crc
        ),
        leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS place FROM d
        ),
        low AS (
            SELECT source, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
            UNION ALL
            SELECT source, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 2) // 3
            FROM low WHERE n > 1 GROUP BY source, level, place // 3
        ),
        subroots AS MATERIALIZED (
            SELECT source, level AS height, h AS subroot,
                   row_number() OVER (ORDER BY source COLLATE "binary" NULLS FIRST) - 1 AS place
            FROM low WHERE n = 1
        ),
        high AS (
            SELECT 0 AS level, place, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 2) // 3
            FROM high WHERE n > 1 GROUP BY level, place // 3
        ),
        root AS (SELECT h AS root FROM high WHERE n = 1),
        nodes AS MATERIALIZED (
            SELECT source, level, place, h, false AS top FROM low WHERE n > 1
            UNION ALL SELECT NULL, level, place, h, true FROM high WHERE n > 1
        ),
        steps AS (
            SELECT doc_id, leaf, l.source, l.place, s.height, s.place AS s_place, changed, s.subroot
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
        ),
        sides AS MATERIALIZED (
            SELECT s.doc_id, s.leaf, n.top, n.level, n.place AS node_place, n.h,
                   CASE WHEN n.top THEN s.s_place ELSE s.place END // CAST(pow(3, n.level) AS BIGINT) AS own
            FROM steps s JOIN nodes n
              ON (n.top OR n.source IS NOT DISTINCT FROM s.source)
             AND CASE WHEN n.top THEN s.s_place ELSE s.place END // CAST(pow(3, n.level + 1) AS BIGINT) = n.place // 3
        ),
        joined AS MATERIALIZED (
            SELECT doc_id, leaf, top, level,
                   coalesce(string_agg(h, '' ORDER BY node_place) FILTER (node_place < own), '') AS l,
                   coalesce(string_agg(h, '' ORDER BY node_place) FILTER (node_place > own), '') AS r
            FROM sides GROUP BY ALL
        ),
        numbered AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY top, level) AS k FROM joined
        ),
        proofs AS (SELECT doc_id, leaf, string_agg(l || r, '' ORDER BY k) AS proof FROM numbered GROUP BY ALL),
        fold AS (
            SELECT doc_id, leaf, CAST(0 AS BIGINT) AS k, changed AS h FROM steps
            UNION ALL
            SELECT f.doc_id, f.leaf, n.k, sha256(n.l || f.h || n.r)
            FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.leaf = f.leaf AND n.k = f.k + 1
        ),
        folded AS (SELECT doc_id, leaf, arg_max(h, k) AS h FROM fold GROUP BY ALL)
        SELECT s.doc_id, s.leaf, s.subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
               f.h AS folded_root, f.h = root.root AS verified
        FROM steps s JOIN folded f ON f.doc_id = s.doc_id AND f.leaf = s.leaf
        LEFT JOIN proofs p ON p.doc_id = s.doc_id AND p.leaf = s.leaf CROSS JOIN root
    """,
}
