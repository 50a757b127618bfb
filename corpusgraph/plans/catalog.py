"""The registered queries: name -> (session, data folder) -> result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import extraction, text
from ..functions.similarity import BatchedModel, HashedCounts, StoredVectors
from ..functions.labels import canonical_label, relation_type_or_null
from ..operators import chunking, context, dedup, entities, graph, keyword_index, ordering, retrieval, selection, vector_index, vectors
from ..options import Options
from ..session import run_table
from ..sources import responses
from ..sources import units as sources
from ..sources.log_tables import LogStore
from ..sources.tables import GraphStore
from ..streaming import feed as feeds
from ..streaming import ordered
from ..streaming.incremental import IncrementalGraph, graph_stream
from ..streaming.runs import parquet_stream, run_available, run_folder
from . import corpora as c
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column)


# --- flagship -------------------------------------------------------------------------------------

@query
def phrase_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Best capitalised phrases of the corpus: units, entities, mentions, statistics, ranking."""
    lines = c.doc_units(spark, sf)
    found = lines.select(
        F.lit("corpus").alias("document_id"),
        F.concat_ws("#", "document_id", F.col("unit_seq").cast("string")).alias("chunk_id"),
        F.col("unit_seq").alias("chunk_seq"), extraction.entities_of("text").alias("entities"),
    )
    mentions = entities.mention_rows(found)
    none = spark.createDataFrame([], "document_id string, from_key string, to_key string, from_name string, to_name string, rel_type string")
    scores = selection.entity_scores(mentions, none)
    return selection.top_entities(scores, Options(max_entities=20)).select("name", "score", "rank")


# --- sources, filters -----------------------------------------------------------------------------

@query
def units_from_lines(spark: SparkSession, sf: str) -> DataFrame:
    return c.doc_units(spark, sf)


@query
def units_from_html(spark: SparkSession, sf: str) -> DataFrame:
    return sources.html_units(c.table(spark, sf, "pages"), "page_id", "html").select("document_id", "text")


@query
def rows_to_table_text(spark: SparkSession, sf: str) -> DataFrame:
    part = c.table(spark, sf, "part")
    size = F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))
    grid = F.array(
        F.array(F.lit(" name "), F.lit("brand"), F.lit("size")),
        F.array(F.col("p_name"), F.col("p_brand"), size),
    )
    units = sources.table_units(
        part.select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("page"), F.lit(0).alias("table_index"), grid.alias("raw_table"))
    )
    line = sources.row_text(F.col("p_partkey"), F.col("p_type"), size)
    return units.join(part.select(F.col("p_partkey").cast("string").alias("document_id"), line.alias("row")), "document_id").select(
        "document_id", "source", "text", "row"
    )


def _image_text(spark: SparkSession, sf: str) -> DataFrame:
    talk = c.table(spark, sf, "conversations")
    return talk.select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page"),
        F.lit(0).alias("image_index"), F.when(F.col("role") == "assistant", F.col("text")).otherwise(" ").alias("recognised"),
        F.lit("").alias("translated"),
    )


@query
def image_text_units(spark: SparkSession, sf: str) -> DataFrame:
    return sources.image_units(_image_text(spark, sf)).select("document_id", "page", "source", "type", "text")


@query
def chart_fallback(spark: SparkSession, sf: str) -> DataFrame:
    pages = c.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page"), "text"
    )
    return sources.chart_units(pages, _image_text(spark, sf)).select("document_id", "page", "source", "text")


@query
def gather_units(spark: SparkSession, sf: str) -> DataFrame:
    talk = c.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("unit_seq"),
        F.col("turn").cast("int").alias("page"), F.concat(F.lit("page_"), "turn").alias("source"), "role", "text",
    )
    tables = talk.filter("role = 'user'").withColumn("context_ready", F.when(F.col("page") > 1, F.col("text")).otherwise("")).withColumn(
        "translated", F.lower("text")
    )
    images = talk.filter("role = 'assistant'").withColumn("merged_context", F.col("text"))
    return sources.gather(c.doc_units(spark, sf), tables, images).select(
        "document_id", "unit_seq", "page", "source", "type", "text"
    )


@query
def ascii_routing(spark: SparkSession, sf: str) -> DataFrame:
    routed = sources.route_for_translation(c.doc_units(spark, sf))
    return routed.select("document_id", "unit_seq", "needs_translation", "translation_input")


@query
def event_previews(spark: SparkSession, sf: str) -> DataFrame:
    seen = sources.event_previews(c.doc_units(spark, sf))
    return seen.select(
        "document_id", "unit_seq", *[x for x in seen.columns if x.endswith("preview")]
    )


# --- chunking -------------------------------------------------------------------------------------

@query
def sentence_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = c.doc_blocks(spark, sf).select("document_id", F.explode(text.sentences("text")).alias("s"))
    return found.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(text.token_estimate("s")).alias("tokens"), F.max(F.length("s")).alias("longest")
    )


@query
def section_headers(spark: SparkSession, sf: str) -> DataFrame:
    heads = c.doc_units(spark, sf).withColumn("text", F.concat(F.col("page"), F.lit(" "), "text"))
    return heads.filter(text.is_section_header("text")).select("document_id", "unit_seq", "text")


@query
def salient_terms(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_chunks(spark, sf).select("chunk_id", F.size(text.salient_terms("text")).alias("terms"))


@query
def structural_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.structural_blocks(c.doc_units(spark, sf)).select(
        "document_id", "block_seq", "page", "source", "type", "n_units", "text"
    )


@query
def structural_blocks_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The same where documents reach over many ranges of units."""
    small = Options(chunk_max_tokens=60)
    return chunking.structural_blocks(c.fact_units(spark, sf), small).select("document_id", "block_seq", "n_units", "text")


@query
def adjacent_similarity(spark: SparkSession, sf: str) -> DataFrame:
    pairs = chunking.adjacent_similarity(c.doc_blocks(spark, sf))
    return pairs.select("document_id", "position", F.round("similarity", 6).alias("similarity"))


@query
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_split(c.doc_blocks(spark, sf), Options(similarity_threshold=0.15)).select(
        "document_id", "piece", "text"
    )


@query
def weakest_boundary(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.similarity import LexicalSimilarity

    sim = LexicalSimilarity()
    found = c.doc_blocks(spark, sf).select("document_id", text.sentences("text").alias("s")).filter(F.size("s") > 1)
    return found.select("document_id", F.inline(F.array(chunking.weakest_boundary(sim.adjacent(F.col("s")))))).select(
        "document_id", "position", F.round("similarity", 6).alias("similarity")
    )


@query
def entity_refine(spark: SparkSession, sf: str) -> DataFrame:
    opts = Options(refine_min_terms=0, refine_max_similarity=0.1)
    return chunking.entity_refine(c.doc_blocks(spark, sf), opts).select("document_id", "half", "text")


@query
def size_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.size_control(c.doc_blocks(spark, sf)).select("document_id", "segment", "text")


@query
def coherence(spark: SparkSession, sf: str) -> DataFrame:
    scored = c.doc_blocks(spark, sf).select("document_id", chunking.coherence(F.col("text")).alias("score"))
    floor = Options(coherence_min=0.1).coherence_min
    rounded = F.round("score", 6)
    return scored.select("document_id", rounded.alias("score"), (rounded >= floor).alias("kept"))


CHUNKING = Options(similarity_threshold=0.1, coherence_min=0.05, refine_min_terms=0)


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.chunk_units(c.doc_units(spark, sf), CHUNKING)
    return chunks.withColumn("coherence_score", F.round("coherence_score", 6))


@query
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_stats(chunking.split_blocks(chunking.structural_blocks(c.doc_units(spark, sf)), CHUNKING))


@query
def chunk_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbering and ids of one-block documents."""
    split = chunking.split_blocks(c.doc_blocks(spark, sf), Options(similarity_threshold=0.0, coherence_min=0.0, refine_max_similarity=-1.0))
    return chunking.number_chunks(split).select("document_id", "chunk_seq", "chunk_id", "text")


# --- deduplication --------------------------------------------------------------------------------

@query
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_chunks(spark, sf).select("chunk_id", text.normal_form("text").alias("form"))


@query
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Copies over the whole corpus: one document holds all lines."""
    whole = c.table(spark, sf, "documents").select(
        F.lit("corpus").alias("document_id"), F.col("doc_id").alias("unit_seq"), F.lit(1).alias("page"),
        "source", F.lit("text").alias("type"), "text",
    )
    return dedup.exact_dedup(whole).select("unit_seq", "content_hash")


@query
def exact_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_dedup_stats(c.doc_units(spark, sf))


def _mixed_units(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents as text, table and image units, some of the images seen; every text between two copies
    that differ by a number or a word, so that merges, appended numbers and priorities all occur."""
    lines = c.doc_units(spark, sf)
    place = F.col("unit_seq") * 3
    numbered = F.concat("text", F.lit(" "), (F.col("unit_seq") % 7).cast("string"))
    reworded = F.concat(F.col("text"), F.lit(" item"))
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.length("text") % 3 + 1).cast("int"))
    parts = [
        (place, "text", F.col("text"), F.lit(None).cast("string")), (place + 1, kind, numbered, F.lit(None).cast("string")),
        (place + 2, F.lit("image"), reworded, F.when(F.length("text") % 2 == 0, F.lit("seen"))),
    ]
    every = F.array(*[F.struct(
        seq.alias("unit_seq"), (F.lit(k) if isinstance(k, str) else k).alias("type"), t.alias("text"), v.alias("vision_context"))
        for seq, k, t, v in parts])
    return lines.select("document_id", "page", "source", F.explode(every).alias("u")).select("document_id", "page", "source", "u.*")


@query
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Units of a document whose cosine of word counts is 0.85 or more."""
    found = dedup.similar_pairs(dedup.exact_dedup(c.doc_units(spark, sf)))
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def greedy_merge(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicate(c.doc_units(spark, sf))


@query
def merge_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Which kept unit each near copy joins, over units of all types."""
    found = dedup.merge_targets(dedup.exact_dedup(_mixed_units(spark, sf)))
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def mixed_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Merged units of all types: priorities (seen images first), appended numbers, later units that meet merged forms."""
    return dedup.deduplicate(_mixed_units(spark, sf))


@query
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Units of each document, and how many went as copies and as near copies."""
    units = _mixed_units(spark, sf)
    return dedup.dedup_stats(units, dedup.deduplicate(units))


@query
def near_copy_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Size of each group that is merged in order."""
    return dedup.near_copy_groups(dedup.exact_dedup(_mixed_units(spark, sf)))


@query
def merge_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact merged with the one before it in its document, as text over image text and the reverse."""
    pairs = ordering.with_neighbour(c.fact_units(spark, sf), ["document_id"], "unit_seq", F.col("text"), "before").filter(
        "before is not null"
    )
    return pairs.select(
        "document_id", "unit_seq",
        dedup.merge_pair(F.col("text"), F.lit(2), F.col("before"), F.lit(2)).alias("newer_wins"),
        dedup.merge_pair(F.col("text"), F.lit(1), F.col("before"), F.lit(2)).alias("kept_wins"),
    )


@query
def prefix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.table(spark, sf, "documents").select("lang", "doc_id", "text")
    return dedup.prefix_dedup(docs, ["lang"], "doc_id").select("lang", "doc_id")


# --- extraction -----------------------------------------------------------------------------------

@query
def entities_by_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_extraction(spark, sf).select("chunk_id", F.posexplode("entities").alias("position", "e")).select(
        "chunk_id", "position", "e.label", "e.type"
    )


@query
def phrases_by_line(spark: SparkSession, sf: str) -> DataFrame:
    found = c.doc_units(spark, sf).select("document_id", "unit_seq", extraction.entities_of("text").alias("entities"))
    return found.select("document_id", "unit_seq", F.posexplode("entities").alias("position", "e")).select(
        "document_id", "unit_seq", "position", "e.label", "e.type"
    )


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_extraction(spark, sf).select("chunk_id", F.posexplode("relationships").alias("position", "r")).select(
        "chunk_id", "position", F.col("r.from").alias("source"), F.col("r.to").alias("target"), F.col("r.type").alias("type")
    )


@query
def relations_by_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf)


@query
def rules_change(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).filter("type in ('INCREASED_FROM', 'DECREASED_FROM')").drop("position")


@query
def rules_used_for(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).filter("type = 'USED_FOR'").drop("position")


@query
def rules_has_value(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).filter("type = 'HAS_VALUE'").drop("position")


@query
def rules_related(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).filter("type = 'RELATED_TO'").drop("position")


@query
def extraction_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_extraction(spark, sf).select("chunk_id", F.round("confidence", 6).alias("confidence"), "needs_augmentation")


def _listed(array: str, *fields: str) -> Column:
    return F.array_join(F.transform(array, lambda e: F.concat_ws(":", *[e[f] for f in fields])), ";")


@query
def label_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Label and relation type normalisation over names of every kind."""
    part = c.table(spark, sf, "part")
    odd = F.concat(F.lit("  The "), "p_name", F.lit(", "), "p_type", F.lit("..."))
    kind = F.concat("p_type", F.lit(" used-for "), "p_brand")
    return part.select(
        "p_partkey", canonical_label("p_name").alias("name_label"), canonical_label("p_type").alias("type_label"),
        canonical_label(odd).alias("odd_label"), relation_type_or_null(kind).alias("rel_type"),
    )


@query
def tag_merge(spark: SparkSession, sf: str) -> DataFrame:
    orders = c.table(spark, sf, "orders")
    tag = F.struct
    tags = orders.select(
        F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"),
        F.inline(
            F.array(
                tag(F.lit(1).alias("tag_seq"), F.col("o_orderpriority").alias("text"), F.lit("ORG").alias("tag")),
                tag(F.lit(2).alias("tag_seq"), F.year("o_orderdate").cast("string").alias("text"), F.lit("DATE").alias("tag")),
                tag(F.lit(3).alias("tag_seq"), F.concat(F.lit("Clerk "), "o_custkey").alias("text"), F.lit("MONEY").alias("tag")),
            )
        ),
    )
    merged = entities.extract_tagged(c.fact_chunks(spark, sf), tags)
    return merged.select("chunk_id", F.round("confidence", 6).alias("confidence"), F.posexplode("entities").alias("position", "e")).select(
        "chunk_id", "confidence", "position", "e.label", "e.type"
    )


@query
def tag_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations whose ends only the tagger finds, present where both ends are tagged."""
    orders = c.table(spark, sf, "orders")
    planner = F.concat(F.lit("route planner "), "o_custkey")
    tracking = F.concat(F.lit("order tracking "), F.year("o_orderdate").cast("string"))
    chunk = F.concat(F.lit("c"), "o_orderkey").alias("chunk_id")
    added = orders.select(chunk, F.concat(F.lit(" "), planner, F.lit(" is used for "), tracking, F.lit(".")).alias("added"))
    chunks = c.fact_chunks(spark, sf).join(added, "chunk_id").withColumn("text", F.concat("text", "added"))
    ends = F.array(
        F.struct(F.lit(1).alias("tag_seq"), planner.alias("text"), F.lit("ORG").alias("tag")),
        F.struct(F.lit(2).alias("tag_seq"), tracking.alias("text"), F.lit("WORK_OF_ART").alias("tag")),
    )
    tags = orders.select(chunk, F.inline(F.when(F.col("o_orderkey") % 4 > 0, ends).otherwise(F.slice(ends, 1, 1))))
    merged = entities.extract_tagged(chunks, tags)
    return merged.select("chunk_id", F.round("confidence", 6).alias("confidence"), F.posexplode("relationships").alias("position", "r")).select(
        "chunk_id", "confidence", "position", F.col("r.from").alias("from_label"), F.col("r.to").alias("to_label"), "r.type"
    )


@query
def response_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of an outside extractor in every form: fenced, amid words, plain names, broken, blank and missing."""
    orders = c.table(spark, sf, "orders")
    name, year = F.col("o_orderpriority"), F.year("o_orderdate").cast("string")
    as_objects = F.concat(
        F.lit('{"entities":[{"label":"'), name, F.lit('","type":"Metric"},{"text":" Year '), year, F.lit('","type":"odd"},{"label":""}],'
              '"relationships":[{"subject":"'), name, F.lit('","object":"Year '), year, F.lit('","predicate":"uses"}]}'))
    as_names = F.concat(F.lit('{"entities":["'), name, F.lit('","Customer '), "o_custkey", F.lit('"]}'))
    kind = F.col("o_orderkey") % 6
    response = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), as_objects, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Found: "), as_objects, F.lit(" and no more")))
        .when(kind == 2, as_names).when(kind == 3, F.concat(F.lit('{"entities":[{"label":"'), name)).when(kind == 4, F.lit("  "))
    )
    read = responses.parse_responses(orders.select("o_orderkey", response.alias("response")))
    return read.select("o_orderkey", _listed("entities", "label", "type").alias("entities"),
                       _listed("relationships", "from", "to", "type").alias("relationships"))


@query
def numbered_units(spark: SparkSession, sf: str) -> DataFrame:
    """Places of tables and images in their document by page and index, whatever the indexes."""
    part = c.table(spark, sf, "part")
    tables = sources.table_units(part.select(
        F.col("p_brand").alias("document_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("table_index"),
        F.array(F.array(F.col("p_name"), F.col("p_type"))).alias("raw_table")))
    images = sources.image_units(part.select(
        F.col("p_brand").alias("document_id"), F.col("p_size").alias("page"), (-F.col("p_partkey")).alias("image_index"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("recognised"), F.col("p_type").alias("translated")))
    columns = ["document_id", "unit_seq", "page", "source", "type", "text"]
    return tables.select(*columns).unionByName(images.select(*columns))


@query
def scoped_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees of one document's entities: the first document by id."""
    tables = c.fact_graph(spark, sf)
    document = tables.chunks.agg(F.min("document_id")).first()[0]
    return graph.entity_degree(graph.GraphTables(*[
        graph.scope(t, document) for t in (tables.chunks, tables.entities, tables.mentions, tables.relationships)]))


@query
def response_merge(spark: SparkSession, sf: str) -> DataFrame:
    found = c.fact_extraction(spark, sf)
    body = (
        '{"entities":[{"label":"Net Income","type":"Metric"},{"text":"Outlook","type":"mood"}],'
        '"relationships":[{"subject":"Nothing","object":"outlook","predicate":"uses"},'
        '{"from":"outlook","to":"sales","type":"part of"},{"from":"outlook","to":"sales","type":"??"}]}'
    )
    responses = found.select(entities.text_hash(F.col("text")).alias("chunk_hash")).distinct().withColumn(
        "response", F.concat(F.lit("```json\n" + body + "\n```"))
    )
    merged = entities.merge_responses(found, responses)
    return merged.select(
        "chunk_id", "used_response", F.round("confidence", 6).alias("confidence"),
        _listed("entities", "label", "type").alias("entities"),
        _listed("relationships", "from", "to", "type").alias("relationships"),
    )


@query
def reuse_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_once(c.fact_chunks(spark, sf)).select(
        "chunk_id", "reused", _listed("entities", "label", "type").alias("entities"),
        _listed("relationships", "from", "to", "type").alias("relationships"),
    )


# --- graph ----------------------------------------------------------------------------------------

@query
def chunk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_graph(spark, sf).chunks.select("document_id", "chunk_id", "text", "source", "page")


@query
def entity_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_graph(spark, sf).entities.select("document_id", "graph_key", "name", "entity_type")


@query
def mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_graph(spark, sf).mentions


@query
def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    return c.fact_graph(spark, sf).relationships.select("from_key", "to_key", "rel_type")


@query
def communities(spark: SparkSession, sf: str) -> DataFrame:
    # Both are read several times, and the nodes are made from the edges too.
    found = c.fact_extraction(spark, sf)
    edges = run_table(graph.relation_edges(entities.relation_rows(found)), "edges")
    g = graph.build_graph(found, with_communities=False, edges=edges)
    return graph.communities(run_table(g.entities.select("document_id", "graph_key"), "nodes"), edges)


def _mentions_and_relations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = c.fact_extraction(spark, sf)
    return entities.mention_rows(found), entities.relation_rows(found)


@query
def entity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return selection.entity_scores(*_mentions_and_relations(spark, sf)).select(
        "document_id", "graph_key", "frequency", "chunks", "degree", "score"
    )


@query
def top_entities(spark: SparkSession, sf: str) -> DataFrame:
    scores = selection.entity_scores(*_mentions_and_relations(spark, sf))
    return selection.top_entities(scores, Options(max_entities=5)).select("document_id", "graph_key", "score", "rank")


LABEL_PLACES = 32


@query
def kmeans_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of each document by clusters of their labels, as what must hold: how many are kept, whether each is the best of
    its cluster, and whether every entity lies in the cluster nearest to it."""
    scores = selection.entity_scores(*_mentions_and_relations(spark, sf))
    kept, points, centres = selection.clustered_with_points(scores, Options(max_entities=12), HashedCounts(LABEL_PLACES))
    best = kept.filter("cluster IS NOT NULL").select("document_id", "cluster", F.col("score").alias("best"))
    # A plain sum: every entity meets all centroids of its document, and functions over arrays are not compiled.
    far = F.lit(0.0)
    for place in range(LABEL_PLACES):
        apart = F.get("embedding", F.lit(place)) - F.get("centre", F.lit(place))
        far += apart * apart
    nearest = points.join(centres.select("document_id", "centre"), "document_id").groupBy("document_id", "graph_key").agg(F.min(far).alias("least"))
    judged = points.join(nearest, ["document_id", "graph_key"]).join(best, ["document_id", "cluster"]).groupBy("document_id").agg(
        F.bool_and(F.col("score") <= F.col("best")).alias("best_of_cluster"),
        F.bool_and(F.col("distance") <= F.col("least") + 1e-6).alias("nearest"))
    return kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("kept")).join(judged, "document_id", "left").select(
        "document_id", "kept", F.coalesce("best_of_cluster", F.lit(True)).alias("best_of_cluster"), F.coalesce("nearest", F.lit(True)).alias("nearest"))


@query
def top_relations(spark: SparkSession, sf: str) -> DataFrame:
    mentions, relations = _mentions_and_relations(spark, sf)
    keys = selection.top_entities(selection.entity_scores(mentions, relations), Options(max_entities=6))
    best = selection.top_relations(relations, mentions, keys, Options(max_relationships=4))
    return best.select("document_id", "from_key", "to_key", "rel_type", "frequency", "score", "rank")


@query
def selected_mentions(spark: SparkSession, sf: str) -> DataFrame:
    mentions, relations = _mentions_and_relations(spark, sf)
    keys = selection.top_entities(selection.entity_scores(mentions, relations), Options(max_entities=6))
    return selection.selected_mentions(mentions, keys).select("chunk_id", "graph_key")


@query
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entity_degree(c.fact_graph(spark, sf))


@query
def snapshot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.snapshot_nodes(c.fact_graph(spark, sf))


@query
def snapshot_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.snapshot_links(c.fact_graph(spark, sf))


@query
def complete_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Placeholders where only chunks of the snapshot are known."""
    g = c.fact_graph(spark, sf)
    return graph.complete_nodes(graph.snapshot_nodes(g).filter("`group` = 1"), graph.snapshot_links(g))


@query
def links_with_known_end(spark: SparkSession, sf: str) -> DataFrame:
    """Links that touch a metric."""
    g = c.linked_facts(spark, sf)
    return graph.links_with_known_end(graph.snapshot_nodes(g).filter("entity_type = 'metric'"), graph.snapshot_links(g))


@query
def first_entity_names(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_entity_names(graph.snapshot_nodes(c.fact_graph(spark, sf)))


@query
def relation_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_histogram(c.fact_graph(spark, sf).relationships)


@query
def document_relation_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return graph.document_relation_histogram(c.fact_graph(spark, sf).relationships)


@query
def graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_totals(c.fact_graph(spark, sf))


@query
def document_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.document_counts(c.fact_graph(spark, sf))


@query
def chunks_per_document(spark: SparkSession, sf: str) -> DataFrame:
    return graph.chunks_per_document(c.fact_chunks(spark, sf))


@query
def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extraction_stats(c.fact_extraction(spark, sf))


@query
def stored_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Tables after writing all documents, writing the chunks again, and deleting one document."""
    folder = run_folder(spark)
    database = "corpusgraph_" + folder.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    store = GraphStore(spark, database, buckets=8).create()
    # Written tables: an upsert reads its rows more than once.
    g = c.stored_facts(spark, sf)
    stored = g.chunks.withColumn("type", F.lit("text")).withColumn("coherence_score", F.lit(1.0))
    for name, rows in (("chunks", stored), ("entities", g.entities), ("mentions", g.mentions), ("relationships", g.relationships)):
        store.upsert(name, rows)
    store.upsert("chunks", stored)
    last = g.chunks.agg(F.max("document_id")).first()[0]
    store.delete_document(last)
    tables = graph.GraphTables(*[store.load(t) for t in ("chunks", "entities", "mentions", "relationships")])
    return graph.document_counts(tables)


def _graph_parts(g: graph.GraphTables) -> dict[str, DataFrame]:
    chunks = g.chunks.withColumn("type", F.lit("text")).withColumn("coherence_score", F.lit(1.0))
    return {"chunks": chunks, "entities": g.entities, "mentions": g.mentions, "relationships": g.relationships}


@query
def store_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log-structured tables after three appended batches, a replayed one, deletions, documents written again, a
    compaction, and a deletion after it."""
    store = LogStore(spark, run_folder(spark), buckets=8)
    parts = {t: run_table(rows, t) for t, rows in _graph_parts(c.fact_graph(spark, sf)).items()}
    number = F.col("document_id").cast("bigint")
    for name, part in (("load-0", 0), ("load-1", 1), ("load-1", 1), ("load-2", 2)):
        with store.commit(name) as commit:
            for table, rows in parts.items() if commit is not None else ():
                commit.append(table, rows.filter(number % 3 == part))
    documents = parts["chunks"].select("document_id").distinct()
    store.delete_documents(documents.filter(number % 10 == 0))
    with store.commit("again") as commit:
        for table, rows in parts.items():
            commit.upsert(table, rows.filter(number % 15 == 0), documents.filter(number % 15 == 0))
    store.compact("chunks", "mentions")
    store.delete_document(documents.agg(F.max("document_id")).first()[0])
    return graph.document_counts(graph.GraphTables(*[store.load(t) for t in ("chunks", "entities", "mentions", "relationships")]))


@query
def store_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The stored vectors after being appended in two commits, replaced by one half, and appended to once more."""
    store = LogStore(spark, run_folder(spark), buckets=8)
    rows = run_table(c.fact_vectors(spark, sf), "vectors")
    even, odd = rows.filter("chunk_seq % 2 = 0"), rows.filter("chunk_seq % 2 = 1")
    store.append("vectors", even)
    store.append("vectors", odd, "odd")
    store.append("vectors", odd, "odd")
    store.replace_all("vectors", odd)
    store.append("vectors", even.filter("chunk_seq % 4 = 0"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x).cast("bigint")
    return store.load("vectors").select("document_id", "chunk_id", "chunk_seq", "text", total.alias("n_tokens"))


@query
def incremental_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and communities of a graph that a stream of three files of chunks built, after a batch came again."""
    folder = run_folder(spark)
    chunks = c.fact_chunks(spark, sf)
    for part in range(3):
        chunks.filter(F.col("chunk_seq") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/chunks")
    kept_up = IncrementalGraph(spark, f"{folder}/graph", buckets=8)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/chunks")
    graph_stream(stream, kept_up, f"{folder}/state", "facts").awaitTermination()
    kept_up.apply("facts-1", run_table(entities.extract_chunks(chunks.filter("chunk_seq % 3 = 1")), "extracted"))
    return kept_up.tables().entities.select("document_id", "graph_key", "name", "entity_type", "community_id")


# --- retrieval ------------------------------------------------------------------------------------

@query
def question_terms(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.prepare_questions(c.questions(spark, sf)).select("query_id", "query", _joined("terms"), "multi_topic", "k")


@query
def default_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs; customers ask, some without a document."""
    jobs = c.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"),
        F.col("o_orderdate").alias("completed_at"),
    )
    asked = c.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey").cast("string")).alias("document_id"),
        (F.col("c_acctbal") < 0).alias("search_all"),
    )
    return retrieval.default_scope(asked, jobs).select("query_id", "document_id")


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every embedding is a vector and a question; the label is the document."""
    rows = c.table(spark, sf, "embeddings")
    points = rows.select(
        F.col("label").cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("vec_id").alias("chunk_seq"), "embedding",
    )
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("document_id"), F.lit(5).alias("k"), "embedding")
    return asked, points


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked, points = _points(spark, sf)
    return vectors.corpus_topk(asked, points, cosine=False)


@query
def scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked, points = _points(spark, sf)
    return vectors.scoped_topk(asked, points, cosine=False)


@query
def post_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked, points = _points(spark, sf)
    return vectors.post_filtered_topk(asked, points, cosine=False)


@query
def indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Search through the inverted file, by every twentieth vector: hits of each question, whether they are in order and rightly
    scored, and whether at least 0.9 of the exact hits of all questions were found."""
    asked, points = _points(spark, sf)
    asked, k = asked.filter("query_id % 20 = 0").withColumn("k", F.lit(10)), 10
    found = run_table(vector_index.build_index(points, k).search(asked, cosine=False), "found")
    exact = run_table(vectors.corpus_topk(asked, points, cosine=False), "exact")
    wide = vectors.corpus_topk(asked.withColumn("k", F.lit(200)), points, cosine=False)
    true = wide.select("query_id", "chunk_id", F.col("score").alias("true_score"), F.col("rank").alias("true_rank"))
    order = W.partitionBy("query_id").orderBy("true_rank")
    judged = found.join(true, ["query_id", "chunk_id"], "left").withColumn("place", F.row_number().over(order))
    by_query = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.bool_and((F.col("true_score").isNull() | (F.col("score") == F.col("true_score"))) & (
            F.col("true_rank").isNull() | (F.col("place") == F.col("rank")))).alias("right"))
    share = vector_index.recall(found, exact).agg((F.sum("n_found") / F.sum("n_exact") >= 0.9).alias("enough"))
    return by_query.withColumn("enough", share.select("enough").scalar())


def _word_counter():
    """Stands for a model: counts of words hashed into 64 places."""
    import hashlib
    import re

    import numpy as np

    words, places = re.compile(r"[^\W_]+"), {}

    def predict(texts: np.ndarray) -> np.ndarray:
        found = np.zeros((len(texts), 64), np.float32)
        for row, t in enumerate(texts):
            for word in words.findall(t.lower()):
                if word not in places:
                    places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64
                found[row, places[word]] += 1
        return found

    return predict


@query
def model_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a model called on batches; the orders of one status have no text."""
    facts = c.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("chunk_seq"),
        F.when(F.col("o_orderstatus") != "P", c.fact_text(F.col("o_orderkey"), F.col("o_orderdate"))).alias("text"))
    found = BatchedModel(_word_counter).encode(facts)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x).cast("bigint")
    places = F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x).cast("bigint")
    return found.select("chunk_seq", total.alias("n_words"), places.alias("places"))


@query
def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the vectors stored for them; some have no key and some no vector."""
    docs = c.table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("doc_id")).alias("vec_id"))
    found = StoredVectors(c.table(spark, sf, "embeddings"), "vec_id").encode(docs)
    return found.select("doc_id", F.round(F.get("embedding", F.lit(3)).cast("double"), 6).alias("fourth"))


def _filtered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as questions over documents; the first word must occur in the text."""
    embedder = HashedCounts()
    asked = c.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(8).alias("k"),
        F.get(text.word_tokens("text"), F.lit(0)).alias("keyword"),
    )
    docs = c.doc_blocks(spark, sf).select(
        "document_id", F.col("document_id").alias("chunk_id"), F.lit(0).cast("bigint").alias("chunk_seq"), "text", "source", "page"
    )
    return embedder.encode(asked), vectors.vector_rows(docs, embedder)


@query
def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.filtered_topk(*_filtered(spark, sf))


@query
def overscan_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.overscan_topk(*_filtered(spark, sf))


@query
def answers_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """From documents to answers: dedup, chunks, graph, vectors, then the benchmark items as questions."""
    chunks = run_table(pipeline.chunk_documents(c.doc_units(spark, sf)), "chunks")
    g = graph.build_graph(run_table(entities.extract_once(chunks), "extracted"))
    stored = graph.GraphTables(*(run_table(getattr(g, t), t) for t in ("chunks", "entities", "mentions", "relationships")))
    asked = c.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("document_id"))
    return pipeline.answer_questions(asked, run_table(vectors.vector_rows(chunks), "vectors"), stored)


def _asked_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    words = text.word_tokens("text")
    asked = c.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.slice(words, 1, 2).alias("terms"), F.lit(20).alias("k"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (F.col("item_id") % 4 + 1).cast("int")).alias("document_id"),
    )
    docs = c.table(spark, sf, "documents").select(
        F.col("lang").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_seq"), "text")
    return asked, docs


@query
def keyword_any(spark: SparkSession, sf: str) -> DataFrame:
    """The first two words of each benchmark item as keywords, in the documents of one language each."""
    return retrieval.keyword_hits(*_asked_words(spark, sf)).select("query_id", "chunk_id", "rank")


@query
def indexed_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an index of gram postings over all texts."""
    asked, docs = _asked_words(spark, sf)
    found = keyword_index.build_keyword_index(docs).keyword_hits(asked)
    return found.select("query_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "rank")


@query
def keyword_and(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.keyword_hits(retrieval.prepare_questions(c.questions(spark, sf)), c.fact_vectors(spark, sf)).select(
        "query_id", "chunk_id", "rank"
    )


@query
def hybrid_hits(spark: SparkSession, sf: str) -> DataFrame:
    return c.retrieved(spark, sf).hits


@query
def hit_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.chunk_ids(c.retrieved(spark, sf).hits)


@query
def expand(spark: SparkSession, sf: str) -> DataFrame:
    return c.retrieved(spark, sf).nodes.select("query_id", "graph_key", "name")


@query
def induced_edges(spark: SparkSession, sf: str) -> DataFrame:
    return c.retrieved(spark, sf).edges


@query
def chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return c.retrieved(spark, sf).edges_by_chunk


@query
def context_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return c.retrieved(spark, sf).context.select("query_id", "position", "chunk_id", "text", "in_graph")


@query
def triples(spark: SparkSession, sf: str) -> DataFrame:
    r = c.retrieved(spark, sf)
    return context.triples(r.edges, r.nodes)


@query
def passages(spark: SparkSession, sf: str) -> DataFrame:
    return context.passages(c.retrieved(spark, sf).context, Options(context_chars=40)).select("query_id", "position", "chunk_id", "text")


@query
def answer_context(spark: SparkSession, sf: str) -> DataFrame:
    r = c.retrieved(spark, sf)
    made = context.answer_context(r.questions, context.triples(r.edges, r.nodes), context.passages(r.context))
    return made.select("query_id", "prompt", "fallback_answer", _joined("reasoning_steps"))


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    r = c.retrieved(spark, sf)
    return context.citations(r.context, r.entities, r.edges_by_chunk, r.nodes)


@query
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return _citations(spark, sf).select(
        "query_id", "position", "chunk_id", "page", "source", "text", _joined("graph_entities"), _joined("graph_relationships")
    )


@query
def citation_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return context.citation_dedup(c.retrieved(spark, sf).context)


@query
def query_confidence(spark: SparkSession, sf: str) -> DataFrame:
    r = c.retrieved(spark, sf)
    scored = context.confidence(r.questions, r.hits, r.nodes, r.edges, _citations(spark, sf))
    return scored.select("query_id", F.round("confidence", 6).alias("confidence"))


@query
def graph_trace(spark: SparkSession, sf: str) -> DataFrame:
    r = c.retrieved(spark, sf)
    return context.graph_trace(r.nodes, r.edges).select(
        "query_id", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), _joined("used_node_ids")
    )


@query
def fallback_context(spark: SparkSession, sf: str) -> DataFrame:
    """Graph chunks of questions are the hits with a metric; thin ones are completed by their hits."""
    r = c.retrieved(spark, sf)
    rows = r.context.select("query_id", F.col("position").alias("rank"), "chunk_id", "text", "source", "page")
    metric = F.col("text").startswith("Revenue") | F.col("text").startswith("Cost")
    completed = context.with_fallback(rows.filter(metric), rows, r.questions)
    return context.plain_context(completed, r.questions).select("query_id", "context", _joined("citations"), "confidence")


@query
def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as points of a chart, the order's fact as its recognised text."""
    items = c.table(spark, sf, "lineitem")
    points = items.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("point_seq"),
        F.year("l_shipdate").cast("string").alias("label"), (F.col("l_partkey") % 100).cast("string").alias("value"),
    )
    facts = c.fact_chunks(spark, sf).select(F.col("chunk_seq").cast("string").alias("document_id"), F.lit(1).alias("page"), "text")
    return context.chart_point_text(points, facts).select("document_id", "text")


@query
def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with citation marks, cleaned and cut into sections."""
    raw = F.concat(
        "text", F.lit(" [Source: page_1] [page_1 p1]\n\n\n\n"),
        F.when(F.col("chunk_seq") % 2 == 0, F.lit("Details: see above. ")).otherwise(F.lit("")),
    )
    cleaned = c.fact_chunks(spark, sf).select("chunk_id", context.clean_answer(raw).alias("answer"))
    parts = context.answer_sections(F.col("answer"))
    return cleaned.select("chunk_id", "answer", parts["summary"].alias("summary"), parts["details"].alias("details"))


# --- event feed -----------------------------------------------------------------------------------

FEED = Options(feed_max=60, feed_keep=40, feed_view=61)


@query
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.session_counts(c.feed(spark, sf))


@query
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.retained(c.feed(spark, sf), FEED).select("session_id", "seq")


@query
def read_from(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.read_from(c.feed(spark, sf), 500).select("session_id", "seq", "total")


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return c.feed(spark, sf).select(F.col("session_id").alias("job_id"), "seq", F.col("type").alias("field"), F.col("k").alias("value"))


@query
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.latest_state(_updates(spark, sf))


@query
def progress_state(spark: SparkSession, sf: str) -> DataFrame:
    patches = _updates(spark, sf).withColumn("section", F.when(F.col("field").isin("view", "click"), "graph").otherwise("chunking"))
    merged = feeds.progress_state(patches.withColumnRenamed("field", "key"))
    pairs = F.transform(F.array_sort(F.map_keys("progress")), lambda k: F.concat(k, F.lit("="), F.element_at("progress", k)))
    return merged.select("job_id", "section", F.array_join(pairs, ",").alias("progress"))


@query
def ordered_logs(spark: SparkSession, sf: str) -> DataFrame:
    logs = c.feed(spark, sf).select(F.col("session_id").alias("job_id"), "seq", F.col("type").alias("phase"), F.col("k").alias("message"))
    return feeds.ordered_logs(logs)


@query
def percent_done(spark: SparkSession, sf: str) -> DataFrame:
    done, total = F.col("seq") % 201, (F.col("seq") % 4) * 50
    return c.feed(spark, sf).select("seq", feeds.percent(done, total).alias("percent"))


@query
def change_only(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.changes_only(c.feed(spark, sf).select("session_id", "seq", F.col("type").alias("state")))


@query
def latest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.latest_per_source(c.feed(spark, sf).select("session_id", "seq", F.col("type").alias("source"), "k"))


@query
def first_chunk_per_id(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.first_per_chunk(c.feed(spark, sf).select("session_id", "seq", F.col("k").alias("chunk_id"), "type"))


@query
def newest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.newest(c.feed(spark, sf), FEED).select("session_id", "seq", "age")


@query
def terminal_status(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and errors as ends of a session."""
    ends = F.when(F.col("type") == "purchase", "completed").when(F.col("type") == "error", "failed")
    events = c.feed(spark, sf).select("session_id", "seq", ends.alias("status"))
    return feeds.terminal_status(events.withColumn("type", F.when(F.col("status").isNotNull(), "done").otherwise("step")))


@query
def step_durations(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.step_durations(c.feed(spark, sf).select("session_id", "seq", "type", "ts")).select(
        "session_id", "seq", "type", "duration_ms"
    )


def _feed_stream(spark: SparkSession, sf: str) -> DataFrame:
    return c.feed_columns(parquet_stream(spark, sf, "events.parquet"))


@query
def stream_session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return run_available(feeds.session_counts(_feed_stream(spark, sf)), "complete")


@query
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    updates = _feed_stream(spark, sf).select(
        F.col("session_id").alias("job_id"), "seq", F.col("type").alias("field"), F.col("k").alias("value")
    )
    return run_available(feeds.latest_state(updates), "complete")


@query
def stream_distinct_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feed_stream(spark, sf).select("session_id", F.col("k").alias("chunk_id"), "ts")
    return run_available(feeds.distinct_chunks(rows), "append").select("session_id", "chunk_id")


DAY_MS = 24 * 3600 * 1000


def _late_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream of files of five days each; every tenth row comes with the next file."""
    feed, folder = c.feed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), run_folder(spark)
    due = F.floor(F.unix_millis("ts") / (5 * DAY_MS)) + (F.col("seq") % 10 == 3).cast("int")
    placed = run_table(feed.withColumn("file", due), "feed")
    low, high = placed.agg(F.min("file"), F.max("file")).first()
    for number in range(low or 0, (high or 0) + 1):
        placed.filter(F.col("file") == number).drop("file").repartition(2).write.mode("append").parquet(f"{folder}/feed")
    return spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/feed")


@query
def ordered_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of state by sequence from late rows, up to the watermark; sessions idle for two days start anew."""
    states = _late_feed(spark, sf).select("session_id", "seq", "ts", F.col("type").alias("state"))
    found = run_available(ordered.ordered_changes(states, ["session_id"], "state", "6 days", 2 * DAY_MS), "append")
    return found.select("session_id", "seq", "state")


@query
def first_chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each chunk of a session from late rows, up to the watermark; a chunk unseen for four days is new."""
    seen = _late_feed(spark, sf).select("session_id", F.col("k").alias("chunk_id"), "seq", "ts", F.lit("").alias("mark"))
    found = run_available(ordered.ordered_changes(seen, ["session_id", "chunk_id"], "mark", "6 days", 4 * DAY_MS), "append")
    return found.select("session_id", "chunk_id", "seq")


@query
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    states = _feed_stream(spark, sf).select("session_id", "seq", F.col("type").alias("state"))
    return run_available(feeds.changes_only_stream(states), "append")
