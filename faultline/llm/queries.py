"""The registered queries of the corpus operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    exact_dedup,
    hard_negatives,
    html_extract,
    jaccard_join,
    language_id,
    license_scan,
    license_texts,
    mixing,
    pii,
    sentencepiece_codec,
    simhash,
    spelling,
    topk_search,
    toxicity,
)
from faultline.plans.registry import Query
from faultline.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def model_path() -> str:
    """The vocabulary file; installed with the workers, never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query(
    "op2_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op2_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    rows = docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    groups = exact_dedup.radix_groups(rows, carry=["digest"])
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@_query("op3_source_mix")
def op3_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"))


@_query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, root, "documents"), model_path())


@_query("op7_language_id")
def op7_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    learnt = language_id.training_rows(docs)
    model = language_id.train(docs.filter(learnt))
    found = language_id.language_columns(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learnt).alias("held_out"), "language.lang_pred", "language.score")


@_query(
    "op9_jaccard_join",
    r"""
    WITH RECURSIVE w AS MATERIALIZED (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
    ), sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS s FROM w
    ), rows AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
    edges AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
    SELECT sets.doc_id, any_value(len(s)) AS n_shingles, min(b) AS component_id FROM sets JOIN reach ON sets.doc_id = reach.a GROUP BY sets.doc_id
    """,
)
def op9_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, root, "documents"))


@_query(
    "op10_topk_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
)
def op10_topk_search(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    return topk_search.top_k(vectors, F.col("vec_id") % 100 == 0)


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    learnt = toxicity.training_rows()
    model = toxicity.train(docs.filter(learnt), table(spark, root, "labels").filter(learnt))
    return toxicity.score_documents(docs, model).select("doc_id", (~learnt).alias("held_out"), "score", "predicted")


@_query("op8_html_extract")
def op8_html_extract(spark: SparkSession, root: str) -> DataFrame:
    return html_extract.extract(table(spark, root, "pages"))


@_query("op1_pii")
def op1_pii(spark: SparkSession, root: str) -> DataFrame:
    found = pii.detect(table(spark, root, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


_KNOWN_SQL = " UNION ALL ".join(f"SELECT '{name}' AS name, '{body.replace(chr(39), chr(39) * 2)}' AS body" for name, body in license_texts.KNOWN)


@_query(
    "op5_license_scan",
    f"""
    WITH known AS (
        SELECT sha256({license_scan.canonical_sql("body")}) AS known_digest, min(name) AS license FROM ({_KNOWN_SQL}) GROUP BY 1
    ), rows AS (SELECT doc_id, {license_scan.canonical_sql("coalesce(text, '')")} AS t FROM documents)
    SELECT doc_id, sha256(t) AS canonical_sha256, length(t) AS canonical_chars, license
    FROM rows LEFT JOIN known ON sha256(t) = known_digest AND t <> ''
    """,
)
def op5_license_scan(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return license_scan.scan(docs, license_scan.known_digests(spark))


@_query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, d.vec_id AS other_id, a.label = d.label AS same,
               CAST(list_sum(list_transform(list_zip(a.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v d ON a.vec_id % 50 = 0 AND a.vec_id <> d.vec_id
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored
        WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    ), met AS (
        SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS place
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
             AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    )
    SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE place <= 3
    """,
)
def op11_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of bytes, half a byte at a time."""
    steps = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(f"{c}::BIGINT")
    half = f"xor([{', '.join(steps)}][(xor(c, b) & 15) + 1], c >> 4)"
    halves = f"flatten(list_transform({codes}, lambda x: [x & 15, x >> 4]))"
    return f"xor(4294967295::BIGINT, list_reduce({halves}, lambda c, b: {half}, 4294967295::BIGINT))"


# one run in so many is misspelt before words are counted
NOISE = 199


@_query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
        FROM documents
    ), per_doc AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL
    ), coded AS (
        SELECT run, k, list_transform(string_split(id || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS points FROM per_doc
    ), hashed AS (
        SELECT run, k, {_crc32_sql("flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))")} AS h FROM coded
    ), spelt AS (
        SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k
        FROM hashed
    ), words AS (
        SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
    ), gaps AS (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
        SELECT DISTINCT a.word AS a, b.word AS b, b.n AS bn FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT DISTINCT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
        UNION SELECT DISTINCT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
    ), best AS (
        SELECT a, b, bn, count(*) OVER (PARTITION BY a) AS k FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) = 1
    ), forms AS (
        SELECT word, CASE WHEN bn >= 5 * n THEN b END AS form, n, coalesce(k, 0) AS n_near, CASE WHEN bn >= 5 * n THEN bn END AS form_n
        FROM words LEFT JOIN best ON word = a
    ), ways(word, reached) AS (
        SELECT word, word FROM words
        UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON ways.reached = forms.word WHERE forms.form IS NOT NULL
    )
    SELECT f.word, f.form, w.reached AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN ways w ON f.word = w.word JOIN forms last ON w.reached = last.word AND last.form IS NULL
    """,
)
def op12_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, root, "documents"), noise=NOISE)


@_query("op13_simhash")
def op13_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_components(table(spark, root, "documents"))
