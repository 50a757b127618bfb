"""The registered queries: each applies one operator to its whole table, by ``(session, data folder)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .html_extract import extract_text, learn_weights
from .lexical_search import rank_documents
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import judge_quality
from .secret_scan import secret_digest
from .substring_dedup import dedup_substrings
from .token_counts import document_token_counts
from .toxicity import fit_toxicity
from .url_filter import judge_urls
from .whitening import whiten


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_substrings(_read(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return fit_toxicity(docs, _read(spark, folder, "labels")).score(docs)


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"), shingle=2)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(_read(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return document_token_counts(_read(spark, folder, "documents"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_read(spark, folder, "pages"), _read(spark, folder, "labels"))


def op8_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages")
    return extract_text(pages, learn_weights(pages, _read(spark, folder, "documents")))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_quality(_read(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "distance")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_read(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digest(_read(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(_read(spark, folder, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_url_filter": op7_url_filter,
    "op8_html_extract": op8_html_extract,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_whitening": op13_whitening,
}
