"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, katz, mixing, packing, quality, rans, simhash, suffixes, tokens, topk, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def token_digests(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(rans.stored_tokens(spark, table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), 2))


def passage_digests(found: DataFrame) -> DataFrame:
    digests = found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans", "kept")
    # the spans themselves, and what remains as text (a character that lost a byte is a replacement character)
    return digests.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return passage_digests(suffixes.deduplicated(spark, docs))


def simhash_digests(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digests(simhash.grouped_documents(spark, table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(spark, table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings")).drop("read")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parsed_conversations(spark, table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_ids, op2_suffix_dedup, op3_simhash, op4_quality_rules, op5_lm_score, op6_top_k, op7_packing, op8_warc, op9_chat_format, op10_mixing, pipeline)}

SQL: dict[str, str] = {
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        ) SELECT * FROM ranked WHERE rank <= 5""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
        ), d AS (
            SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first_id,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (5 * (3 - i % 4))::INTEGER) & 31), 1)), '') AS payload_digest
            FROM p
        ) SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d""",
}
