"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import bpe, collocation, divergence, embedding, html_text, mixing, pii, quality, simhash, token_count, topk, toxicity, warc
from textguard.llm.common import table
from textguard.session import written


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("text")


#: The key of the registered queries. A deployment keeps its own.
KEY = b"registered queries"


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, KEY)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.scored(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_embedding(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return embedding.near_duplicates(vectors, threshold=0.93)


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages, html_text.train())
    return html_text.with_length(found).select("page_id", "url", "text", "n_chars")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    prints = written(simhash.fingerprinted(docs, shingle=3).drop("text"), "fingerprints")
    groups = simhash.clustered(prints, F.col("doc_id"), distance=3)
    return groups.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    return quality.judged(docs, quality.fit(docs, labels)).drop("text")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    limited = token_count.with_limit(counted, 512)
    return limited.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mix = mixing.mixed(docs, ["doc_id"])
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top(vectors, F.col("id") % 50 == 0, k=5, scale=256.0)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text", "lang")
    return collocation.collocations(docs, least=100, longest=5, covered=100, top=2000)


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text", "lang", "source")
    return divergence.audit(docs, least=30, top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_embedding": op4_embedding,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_topk": op11_topk,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op4_embedding": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL
        ), u AS (
            SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
            WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.norm > 0 AND b.norm > 0
              AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
        ), reach AS (
            SELECT a AS vec_id, b AS other FROM l
            UNION
            SELECT reach.vec_id, l.b FROM reach JOIN l ON reach.other = l.a
        ), c AS (
            SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
        )
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links,
               least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
        FROM embeddings e
        LEFT JOIN n ON n.vec_id = e.vec_id
        LEFT JOIN c ON c.vec_id = e.vec_id
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), m AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM m
    """,
    "op11_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (
                       PARTITION BY query_id ORDER BY score DESC, vec_id
                   ) AS n, vec_id, score
            FROM p
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
        ), g AS (
            SELECT lang, size, unnest(list_transform(
                range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
            FROM w, (SELECT unnest(range(1, 6)) AS size)
        ), f AS (
            SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL
        ), t AS (
            SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
        ), c AS (
            SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 100
        ), k AS (
            SELECT *, unnest(range(1, size)) AS k FROM c
        ), s AS (
            SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, t.n,
                   CAST((1000::HUGEINT * k.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM k JOIN t ON t.lang = k.lang
            JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
            JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')
        ), m AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), i AS (
            SELECT lang, a, ws, size, unnest(range(2, size)) AS part FROM c
        ), h AS (
            SELECT lang, a, unnest(list_transform(
                range(1, size - part + 2), lambda j: array_to_string(ws[j:j + part - 1], ' '))) AS phrase
            FROM i
        ), z AS (
            SELECT m.* FROM m
            WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = m.lang AND h.phrase = m.phrase AND 100 * h.a >= 100 * m.a)
        ), o AS (
            SELECT lang, row_number() OVER (
                       PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)
                   ) AS rank, phrase, a, l, r, n, score
            FROM z
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
    """,
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ), e AS (
            SELECT id, lang, source, unnest(ts) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM e) GROUP BY ALL HAVING count(*) >= 30
        ), v AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), c AS (
            SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY ALL
        ), t AS (
            SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
        ), g AS (
            SELECT o.lang, o.source, coalesce(t.total, 0) AS total, coalesce(v.v, 0) AS v
            FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)
        ), p AS (
            SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v) AS p
            FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
        ), w AS (
            SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang
        ), q AS (
            SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)::HUGEINT) // (any_value(w.total) + 5 * any_value(w.v)) AS q
            FROM c JOIN w USING (lang) GROUP BY lang, term
        ), x AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   CAST(coalesce(sum(abs(m.p - n.p)), 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN p m ON m.lang = a.lang AND m.source = a.source
            LEFT JOIN p n ON n.lang = b.lang AND n.source = b.source AND n.term = m.term
            GROUP BY ALL
            UNION ALL
            SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT)
            FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
        ), r AS (
            SELECT *, row_number() OVER (
                       PARTITION BY lang, source, part ORDER BY value DESC, encode(item)
                   ) AS n
            FROM x
        )
        SELECT lang, source, part, item, value, CAST(n AS INTEGER) AS rank
        FROM r WHERE part = 'pair' OR n <= 50
    """,
}
