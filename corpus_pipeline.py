"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all that its predecessor kept.  All but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, near_dup, packing, secrets, sparkkit

#: Languages that the sequences may hold.
LANGUAGES = ("de", "en", "es", "fr")
#: Least similarity of near copies, in percent.
SIMILARITY = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES; those in others, in no recognised one, or without evidence go."""
    return langid.keep_identified(docs, languages=LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dup.drop_near_duplicates(docs, percent=SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's question and answer."""
    return decontaminate.drop_contaminated(docs, sparkkit.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

#: Tokenizing and hashing have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sparkkit.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = sparkkit.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
