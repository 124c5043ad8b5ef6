"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, digest, html_blocks, licences, mixing, quality, resampling, setjoin, templates, toxicity, urlfilter, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    records = warc.find(captures, warc.build_index(captures))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to, by a published vocabulary."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    size = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_html_extraction, op2_warc_index, op3_document_fingerprints, op4_url_filter, op5_toxicity, op6_benchmark_decontamination,
        op7_licence_scan, op8_ngram_jaccard_join, op9_source_mixing, op10_quality_classifier,
        op11_importance_resampling, op12_embedding_whitening, op13_byte_bpe,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op7_licence_scan": licences.oracle_sql(), "op9_source_mixing": mixing.ORACLE_SQL, "op2_warc_index": WARC_SQL}


#: Sizes and revisits of op2 in DuckDB's SQL; the digest is base 32 of SHA-1, built from groups of five bits.
WARC_SQL = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, hex,
         list_aggregate(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::INT), 4, '0')), 'string_agg', '') AS b
  FROM rows
), named AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (list_sum(list_transform(range(5), lambda j: (substr(b, 5 * i + j + 1, 1))::INT << (4 - j)))::INT) + 1, 1)), 'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named
"""
