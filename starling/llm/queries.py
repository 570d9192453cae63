"""The registered queries of this package: thin wrappers that give each operator its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starling.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.toxicity import learn, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.warc import archive

    return archive(spark, table(spark, sf_dir, "pages"))[0]


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.quality import learn, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).drop("live")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from starling.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starling.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 16)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_near_dedup": op2_near_dedup, "op3_warc": op3_warc, "op4_decontaminate": op4_decontaminate, "op5_quality": op5_quality, "op6_html": op6_html, "op7_secrets": op7_secrets, "op8_topk": op8_topk, "op9_bpe": op9_bpe, "op10_shards": op10_shards}
ORACLES = {
    "op2_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
        ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        link AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        )
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
        FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON s.doc_id = r.a
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (d)
    """,
}
