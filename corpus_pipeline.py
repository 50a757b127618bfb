"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``. Rows are matched by id and text hash (near
duplicates by id alone), and other columns pass unchanged whatever their names.

Defined results: a null text fails the base rules and goes. A null id alone is no reason to go, and such rows are near
duplicates of nothing. An empty input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import Scratch, id_or_last, row_key
from corpusgraph.llm.decontaminate import contaminated
from corpusgraph.llm.line_dedup import dedup_lines
from corpusgraph.llm.near_dedup import near_duplicates
from corpusgraph.llm.packing import pack
from corpusgraph.llm.quality_rules import judge_quality

#: Words of a shingle and percent of similarity of near duplicates.
SHINGLE, SIMILARITY = 5, 80


def _packed_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, beside the keys the stages match on."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__whole"), id_or_last().alias("__id"), row_key().alias("__row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = judge_quality(docs, keep_key=True)
    kept = judged.filter("kept").select("__id", "__row").distinct()
    return _packed_rows(docs).join(kept, ["__id", "__row"], "left_semi").select("__whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds; ``n_chars`` follows the text."""
    carried = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("__whole"))
    kept = dedup_lines(carried, keep="__whole")
    return kept.select(*[
        F.col("kept_text").alias(c) if c == "text"
        else F.char_length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("__whole").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    gone = near_duplicates(docs, SHINGLE, SIMILARITY).filter("not kept").select(id_or_last().alias("__id")).distinct()
    return _packed_rows(docs).join(gone, "__id", "left_anti").select("__whole.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_key=True)
    gone = hits.select(id_or_last().alias("__id"), F.col("row").alias("__row")).distinct()
    return _packed_rows(docs).join(gone, ["__id", "__row"], "left_anti").select("__whole.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("packing", packing),
]

#: SQL cannot express the determinant search of the first stage nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
