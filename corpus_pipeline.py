"""The corpus pipeline: five stages over the documents table.

    quality     documents that the quality rules reject go
    near_dups   one document of each group of near duplicates (NEAR per cent of the 5-word shingles
                or more in common) stays, the one of the smallest id
    repeats     passages that an earlier document holds are cut out of the texts
    private     personal data in the texts is replaced by its kind
    packed      the texts' tokens are packed into sequences; one row per piece

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents, the last one the places of the pieces. A null or empty text counts as empty
and the quality rules reject it; rows with a null doc_id pass near_dups and repeats unchanged; rows
that share a doc_id leave near_dups together, if any of them is a near duplicate of a smaller id.
An empty table gives no rows at any stage. Results are written as Parquet and read again between
stages; run() deletes a stage's table once the next one is stored.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import discard, materialize, table
from loomwork.llm.minhash import near_duplicates
from loomwork.llm.packing import pack_documents
from loomwork.llm.pii import redact
from loomwork.llm.quality_rules import kept_documents
from loomwork.llm.suffix_dedup import remove_repeats


#: The stage's own threshold in per cent; that of op5 is higher.
NEAR = 80


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = near_duplicates(docs, NEAR)
    gone = verdict.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(remove_repeats(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dups", near_dups),
    ("repeats", repeats),
    ("private", private),
    ("packed", packed),
]

#: The stages train, sample and pack, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
