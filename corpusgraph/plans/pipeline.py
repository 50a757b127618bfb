"""End-to-end jobs: documents to stored tables, and questions to answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import AdjacentSimilarity, Embedder
from ..operators import chunking, context, dedup, entities, graph, retrieval, vectors
from ..operators.graph import GraphTables
from ..options import DEFAULTS, Options
from ..session import run_table
from ..sources.tables import GraphStore


def chunk_documents(units: DataFrame, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> DataFrame:
    """Gathered units to chunks."""
    return chunking.chunk_units(dedup.deduplicate(units, opts), opts, similarity)


def ingest_documents(
    units: DataFrame, store: GraphStore, opts: Options = DEFAULTS,
    embedder: Embedder | None = None, similarity: AdjacentSimilarity | None = None,
) -> None:
    """Chunk, extract and store documents; repeating it for the same documents changes nothing.

    Chunks are materialised once, so that the graph and the vectors are made from the same rows.
    """
    documents = units.select("document_id").distinct()
    chunks = run_table(chunk_documents(units, opts, similarity), "chunks")
    store.upsert("chunks", chunks, documents)
    extracted = run_table(entities.extract_once(chunks, opts), "extracted")
    g = graph.build_graph(extracted, opts)
    for table in ("entities", "mentions", "relationships"):
        store.upsert(table, getattr(g, table), documents)
    store.upsert("vectors", vectors.vector_rows(chunks, embedder, opts), documents)


def stored_graph(store: GraphStore) -> GraphTables:
    return GraphTables(store.load("chunks"), store.load("entities"), store.load("mentions"), store.load("relationships"))


@dataclass
class Retrieved:
    """Tables of one retrieval run, all keyed by query_id."""

    questions: DataFrame
    hits: DataFrame
    entities: DataFrame
    nodes: DataFrame
    edges: DataFrame
    edges_by_chunk: DataFrame
    context: DataFrame


def retrieve(
    queries: DataFrame, vector_table: DataFrame, g: GraphTables,
    opts: Options = DEFAULTS, embedder: Embedder | None = None,
) -> Retrieved:
    """``queries``: query_id, query, document_id (null searches everything).

    Questions, hits, their entities, nodes, edges and context are written: all that follows reads them, and their sizes are
    bounded by the questions and the hits.
    """
    questions = run_table(retrieval.prepare_questions(queries, opts), "questions")
    hits = run_table(retrieval.hybrid_hits(questions, vector_table, embedder, opts), "hits")
    found = run_table(retrieval.hit_entities(questions, hits, g), "hit-entities")
    nodes = run_table(retrieval.expansion_nodes(found), "hit-nodes")
    edges = run_table(retrieval.induced_edges(nodes, g, opts), "hit-edges")
    return Retrieved(
        questions, hits, found, nodes, edges, retrieval.chunk_edges(found, edges),
        run_table(retrieval.context_chunks(hits, vector_table, g, opts), "hit-context"),
    )


def answer_questions(
    queries: DataFrame, vector_table: DataFrame, g: GraphTables,
    opts: Options = DEFAULTS, embedder: Embedder | None = None,
) -> DataFrame:
    """One row for each question: prompt, fallback answer, steps, citations, confidence, and the nodes, edges and
    chunks that were used."""
    r = retrieve(queries, vector_table, g, opts, embedder)
    passages = context.passages(r.context, opts)
    facts = context.triples(r.edges, r.nodes)
    cited = context.citations(r.context, r.entities, r.edges_by_chunk, r.nodes, opts)
    listed = cited.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("position", "chunk_id", "page", "source", "text", "graph_entities", "graph_relationships")
            )
        ).alias("citations")
    )
    scored = context.confidence(r.questions, r.hits, r.nodes, r.edges, cited)
    used = [
        r.nodes.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("graph_key", "name"))).alias("nodes")),
        r.edges.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("source", "target", "type"))).alias("edges")),
        r.context.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "source", "page"))).alias("chunks")),
    ]
    answers = context.answer_context(r.questions, facts, passages)
    for part in used:
        answers = answers.join(part, "query_id", "left")
    return (
        answers.join(listed, "query_id", "left").join(scored, "query_id", "left")
        .withColumn("confidence", F.round("confidence", 2))
    )
