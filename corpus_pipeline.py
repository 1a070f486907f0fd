"""A corpus pipeline over the operators of ``docquarry.llm``; each stage is written and read again.

Language ID drops documents without a language; exact deduplication keeps the row with the largest
doc_id of equal texts; the n-gram join keeps the smallest doc_id of each group of near copies (five words,
similarity 0.8); the secret scan masks secrets in the text; packing cuts what is left into sequences.

Defined results: null and empty texts have no language and go with the first stage; of repeated rows
(same doc_id and text) one stays; of ties in doc_id with different texts each is judged on its own; an
empty table gives no pieces; very long texts are worked on whole; all columns of ``docs``, whatever
their names, pass every stage but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import exact_dedup, language_id, ngram_join, packing, secret_scan
from docquarry.llm.shared import shared_dir, stored

#: The first stage, cross-parsing with suffix automata, has no equivalent in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n_words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("secret_scan", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), name, f"{work}/{k}-{name}")
    return docs
