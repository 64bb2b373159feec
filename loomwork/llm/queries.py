"""The queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.byte_bpe import round_trip_digest
from loomwork.llm.common import table
from loomwork.llm.embedding_dedup import near_duplicate_vectors
from loomwork.llm.lm_scoring import score_texts
from loomwork.llm.minhash import near_duplicates
from loomwork.llm.packing import pack_documents
from loomwork.llm.pii import pii_digest
from loomwork.llm.quality_rules import quality_rules
from loomwork.llm.suffix_dedup import repeat_digest
from loomwork.llm.token_counts import token_counts
from loomwork.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash": op5_minhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    # bytes of a text are counted by strlen(), characters by length()
    "op8_warc": """
WITH r AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM r WHERE strlen(h) >= 100 GROUP BY d
)
SELECT page_id, strlen(h) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM r LEFT JOIN f USING (d)
""",
}
