"""Inputs of the registered queries, derived by Spark from the supplied tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, run_table, spread
from ..sources.units import line_units
from ..operators import entities, graph
from ..operators.vectors import vector_rows
from . import pipeline

_KEPT: dict[tuple, object] = {}


def kept(name: str, spark: SparkSession, sf: str, make):
    """A shared intermediate of several queries, written once to the checkpoint folder of the session."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop the shared intermediates, so that the next query makes its own."""
    _KEPT.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def doc_units(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents, 20 to the page."""
    return line_units(table(spark, sf, "documents"), "doc_id", "text")


def doc_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as one block."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(0).cast("bigint").alias("block_seq"),
        F.lit(1).alias("page"), F.lit("page_1").alias("source"), F.lit("text").alias("type"), "text",
    )


def fact_text(key: Column, date: Column) -> Column:
    """Short statements on money, models and years, one for each order."""
    low, high = (key % 90 + 10).cast("string"), (key % 70 + 110).cast("string")
    year, after = F.year(date).cast("string"), (F.year(date) + 1).cast("string")
    kind = key % 6
    return (
        F.when(kind == 0, F.concat(F.lit("Revenue increased from "), low, F.lit(" million to "), high, F.lit(" million. Margin reached "), year, F.lit(".")))
        .when(kind == 1, F.concat(F.lit("Cost fell from "), high, F.lit(" million to "), low, F.lit(" million. Budget was set in "), year, F.lit(".")))
        .when(kind == 2, F.lit("LSTM is used for forecast. BERT improves revenue."))
        .when(kind == 3, F.concat(F.lit("Sales rose from "), year, F.lit(" to "), after, F.lit(". Transformer supports profit.")))
        .when(kind == 4, F.concat(F.lit("GPT and CNN met. Ebitda was flat in "), year, F.lit(" and "), after, F.lit(".")))
        .otherwise(F.lit("Nothing here."))
    )


def fact_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk for each order; the customer is the document."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("document_id"),
        F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"),
        F.col("o_orderkey").alias("chunk_seq"),
        fact_text(F.col("o_orderkey"), F.col("o_orderdate")).alias("text"),
        F.lit("page_1").alias("source"), F.lit(1).alias("page"), F.lit("text").alias("type"),
    )


def fact_units(spark: SparkSession, sf: str) -> DataFrame:
    return fact_chunks(spark, sf).select(
        "document_id", F.col("chunk_seq").alias("unit_seq"), "page", "source", "type", "text"
    )


def fact_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return kept("extraction", spark, sf, lambda: run_table(entities.extract_chunks(fact_chunks(spark, sf)), "extraction"))


def fact_graph(spark: SparkSession, sf: str) -> graph.GraphTables:
    """Graph tables of the facts, without communities."""
    return graph.build_graph(fact_extraction(spark, sf), with_communities=False)


def linked_facts(spark: SparkSession, sf: str) -> graph.GraphTables:
    """The same with mentions and relations written: links, entities and degrees are made from them."""
    found = fact_extraction(spark, sf)
    edges = run_table(graph.relation_edges(entities.relation_rows(found)), "relationships")
    g = graph.build_graph(found, with_communities=False, edges=edges)
    return replace(g, mentions=run_table(g.mentions, "mentions"))


def fact_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vector_rows(fact_chunks(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question for each customer; those in debt search everything, the others their own document."""
    key = F.col("c_custkey")
    year = (key % 7 + 1992).cast("string")
    kind = key % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("What was revenue and cost in "), year, F.lit("?")))
        .when(kind == 1, F.concat(F.lit(" How did margin develop in "), year, F.lit("? ")))
        .when(kind == 2, F.lit("Which model supports teh profit forecast"))
        .when(kind == 3, F.lit("Sales trends with AI usage"))
        .otherwise(F.concat(F.lit("Budget of "), year))
    )
    return table(spark, sf, "customer").select(
        key.alias("query_id"), text.alias("query"),
        F.when(F.col("c_acctbal") >= 0, key.cast("string")).alias("document_id"),
    )


def stored_facts(spark: SparkSession, sf: str) -> graph.GraphTables:
    """The graph tables of the facts as a store holds them: written."""
    def write() -> graph.GraphTables:
        g = linked_facts(spark, sf)
        return replace(g, chunks=run_table(g.chunks, "chunks"), entities=run_table(g.entities, "entities"))

    return kept("stored-facts", spark, sf, write)


def retrieved(spark: SparkSession, sf: str) -> pipeline.Retrieved:
    return kept(
        "retrieved", spark, sf,
        lambda: pipeline.retrieve(questions(spark, sf), run_table(fact_vectors(spark, sf), "vectors"), stored_facts(spark, sf)),
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a progress feed: the user is the session."""
    return feed_columns(table(spark, sf, "events"))


def feed_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"),
        "ts", F.get_json_object("props", "$.k").alias("k"),
    )
