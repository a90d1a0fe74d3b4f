"""A corpus pipeline of five stages: quality rules, near-dedup, benchmark decontamination, redaction of personal data, BPE ids.

Each stage is (spark, docs, sf_dir) -> DataFrame; run() writes each result as Parquet in the shared folder and reads it back as
the next stage's docs. All but the last return the columns of documents. SQL cannot express the fingerprint links, the trained
redaction and the merges, so ORACLE_SQL is None and tests hold the result against plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, pii, quality_rules, simhash
from lodestone.llm.common import passing, stage, table, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go; null and empty texts have no words and go too."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays (a null one last); null and empty texts are one group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the names of its kinds; null and empty texts stay as they are."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts that are left; a null text counts as an empty one."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("personal data", redaction), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself, and its input, are deleted when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        with passing(spark) as keep:
            docs = keep(stage(f(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
