"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, exact_dedup, line_dedup, mixing, ngram_join, pii, repair, toxicity, warc
from .store import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key="query key, to be replaced by a secret")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), whole=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op9_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_ids(repair.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), with_ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_near_vectors, op4_line_dedup, op5_byte_bpe, op6_mixing, op7_ngram_join, op8_exact_dedup, op9_grammar_ids, op10_toxicity, pipeline)}

ORACLES = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g""",
    "op3_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        ), fine AS (
            SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
        ), reach AS (
            SELECT a AS node, a AS low FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.low
        ), comp AS (
            SELECT node, min(low) AS component FROM reach GROUP BY node
        ), cnt AS (
            SELECT a, count(*) AS c FROM link GROUP BY a
        )
        SELECT v.vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, coalesce(component, v.vec_id) AS component_id, v.vec_id = coalesce(component, v.vec_id) AS kept
        FROM v LEFT JOIN cnt ON v.vec_id = cnt.a LEFT JOIN comp ON v.vec_id = comp.node""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                                ELSE [array_to_string(w[i + 1:i + 4], ' ') FOR i IN range(len(w) - 3)] END) AS shingle FROM d
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), link AS (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), reach AS (
            SELECT a AS node, a AS low FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.low
        ), low AS (
            SELECT node, min(low) AS component FROM reach GROUP BY 1
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON node = d.doc_id""",
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT)
                    + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), r AS (
            SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w, 3 * source_size AS cap FROM s
        ), t AS (
            SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(w) OVER (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
                   row_number() OVER (ORDER BY source_size / w, w, source NULLS LAST) AS n
            FROM r
        ), f AS (
            SELECT arg_min(rest, n) AS rest, arg_min(w_rest, n) AS w_rest, min(n) AS n FROM t WHERE rest * w <= cap * w_rest
        ), plan AS (
            SELECT t.source, source_size, CASE WHEN t.n >= f.n THEN CAST(w * f.rest AS DOUBLE) / CAST(f.w_rest AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
            FROM t LEFT JOIN f ON true
        ), g AS (
            SELECT source, length(bin(greatest(size, 1))) AS v, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2
        ), h AS (
            SELECT g.source, v, words, source_size, target,
                   target - CAST(3 * coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
                   CAST(sum(v * words) OVER (PARTITION BY g.source ORDER BY v DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS need
            FROM g JOIN plan ON g.source IS NOT DISTINCT FROM plan.source
        ), i AS (
            SELECT source, max(v) AS v0, arg_max(rest, v) AS rest, arg_max(need, v) AS need FROM h WHERE rest * v <= 3 * need GROUP BY source
        ), j AS (
            SELECT h.source, v, words, source_size, target,
                   CASE WHEN v > v0 THEN 3 WHEN i.need > 0 THEN i.rest * v / i.need ELSE 0 END AS lam
            FROM h JOIN i ON h.source IS NOT DISTINCT FROM i.source
        ), q AS (
            SELECT *, CAST(least(floor(lam), 3) AS BIGINT) AS whole, lam - least(floor(lam), 3) AS pi,
                   target - CAST(sum(CAST(least(floor(lam), 3) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS words_left FROM j
        ), k AS (
            SELECT doc_id, d.source, size, source_size, target, whole, pi, words_left,
                   CASE WHEN pi > 0 AND pi < 1 THEN least(CAST(floor((u / (1 - u)) / (pi / (1 - pi)) / (1 + (u / (1 - u)) / (pi / (1 - pi))) * CAST(281474976710656 AS DOUBLE)) AS BIGINT), 281474976710655) END AS key
            FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND length(bin(greatest(d.size, 1))) = q.v
        ), c AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                   sum(size) OVER (PARTITION BY source, key) AS words FROM k
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               size * (whole + CASE WHEN key IS NULL THEN 0
                                    WHEN upto < words_left THEN 1
                                    WHEN upto - words >= words_left THEN 0
                                    WHEN abs(upto - words_left) <= abs(words_left - (upto - words)) THEN 1 ELSE 0 END) AS taken
        FROM c""",
}
