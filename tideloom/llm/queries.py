"""Queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, licenses, line_dedup, mixing, ngram_join, secrets, sql, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), size_col="n_chars", counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", "n_chars", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), 4, 85)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_exact_dedup, op4_ngram_join, op5_license_scan, op6_token_counts, op7_decontamination, op8_toxicity, op9_secret_scan, op10_mix_sources)}

ORACLE_SQL = {
    "op1_line_dedup": sql.line_dedup_sql(),
    "op4_ngram_join": sql.ngram_join_sql(4, 85),
    "op5_license_scan": sql.license_sql(),
    "op9_secret_scan": sql.secret_sql(),
    "op2_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, url, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url AS target_uri
        FROM f""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS n FROM t)
        SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(x) AS text_sha256 FROM g""",
    "op10_mix_sources": """
        WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, 1.0::DOUBLE / count(*) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM c),
        k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS k FROM r),
        s AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
        u AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS at FROM documents),
        n AS (SELECT u.*, (SELECT count(*) FROM s WHERE s.source IS NOT DISTINCT FROM u.source AND s.cdf < u.at) AS copies FROM u)
        SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(0, copies - 1)) AS INTEGER) AS copy FROM n WHERE copies > 0""",
}
