"""The corpus pipeline: documents in, clean tokenized documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next one's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm import bpe, near_dup, quality, secret_scan, tiling
from recordflow.llm.common import ready, stored, table

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ready(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar to 0.8 or more, found
    by SimHash and Golay keys first, and by min-hash keys what these leave."""
    ready(spark)
    return near_dup.keep_one(docs, near_dup.similar(0.8, shingle=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return tiling.remove(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars brought up to date."""
    ready(spark)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding these gives the text again."""
    ready(spark)
    file = public_tokenizers.path(VOCABULARY)
    coded = bpe.round_trip(docs, file)
    return coded.select(
        "doc_id", "lang", "source", "text", "n_chars", "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: SQL has neither fingerprints, tilings, checksums nor merges; the tests hold the stages against
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages give for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
