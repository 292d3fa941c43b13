"""The corpus pipeline: language ID, near duplicates, decontamination, secret scans, packing.

Each stage takes all documents its predecessor kept, written as Parquet and read again, and returns the columns of ``documents``;
the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm.common import shared_dir, staged, table
from rollcall.llm.decontaminate import clean_documents
from rollcall.llm.jaccard_join import keep_one
from rollcall.llm.language import keep_identified
from rollcall.llm.packing import pack
from rollcall.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: null texts, texts without a letter and texts that no learned language claims with a score of 0.55 go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles one stays."""
    return keep_one(docs, width=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark window go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are replaced by a mark; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL can't express the stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, at, name)
    return docs
