"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .collocations import collocations
from .common import shared_dir, table
from .decontaminate import decontamination_report
from .jaccard_join import jaccard_components
from .language import language_report
from .licenses import license_report
from .packing import pack
from .quality import quality_report
from .quotes import reply_order
from .secrets import report, scan_versions
from .toxicity import toxicity_report
from .trie import prefix_trie
from .url_filter import judge_urls
from .warc import warc_report


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one kept ledger: an eighth of the versions first, then all of them, of which the second run scans what the first has not."""
    docs, ledger = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger"
    scan_versions(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 8 == 0), ledger=ledger)
    return report(scan_versions(docs, ledger=ledger)[0])


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_benchmark_decontamination,
        op3_chat_formatting,
        op4_warc,
        op5_language_id,
        op6_ngram_jaccard_join,
        op7_packing,
        op8_url_filters,
        op9_quality_rules,
        op10_toxicity,
        op11_phrase_collocation_mining,
        op12_conversation_prefix_trie,
        op13_license_scans,
    )
}
#: DuckDB SQL of the queries that SQL can express; the tests hold the others against brute-force versions or held-out labels.
ORACLE: dict[str, str] = oracle.SQL
