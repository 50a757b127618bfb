"""Retrieval for a table of questions: terms, keyword and vector hits, their merge, graph expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import Embedder, HashedCounts
from ..functions.text import clip, strip, text_or_empty
from ..options import DEFAULTS, Options
from ..session import run_table
from .dedup import prefix_dedup
from .graph import GraphTables
from .skew import salted_join
from .vectors import corpus_topk, scoped_topk

# The words that make a question a keyword question, and those that join topics.
METRIC_QUESTION = r"\b(revenue|cost|profit|earnings|margin|sales|income|expense)\b"
YEAR_QUESTION = r"\b(19\d{2}|20\d{2})\b"
JOINING_WORDS = r"\b(and|together|both|combined|also|additionally)\b"


# --- questions ------------------------------------------------------------------------------------

def clean_question(c: Column) -> Column:
    return F.regexp_replace(strip(text_or_empty(c)), r"(?iU)\bteh\b", "the")


def question_terms(c: Column) -> Column:
    """Years, then metric words in lower case, each once."""
    years = F.regexp_extract_all(c, F.lit("(?U)" + YEAR_QUESTION), F.lit(1))
    metrics = F.regexp_extract_all(c, F.lit("(?iU)" + METRIC_QUESTION), F.lit(1))
    return F.array_distinct(F.concat(years, F.transform(metrics, F.lower)))


def is_multi_topic(c: Column) -> Column:
    low = F.lower(c)
    trends = low.contains("trends") & (low.contains("ai") | low.contains("usage"))
    return low.rlike("(?U)" + JOINING_WORDS) | trends


def prepare_questions(queries: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Clean ``query`` and add ``terms``, ``multi_topic`` and the number of hits wanted, ``k``."""
    wide = min(opts.retrieval_k + opts.multi_topic_extra, opts.retrieval_k_cap)
    cleaned = queries.withColumn("query", clean_question(F.col("query")))
    return (
        cleaned.withColumn("terms", question_terms(F.col("query")))
        .withColumn("multi_topic", is_multi_topic(F.col("query")))
        .withColumn("k", F.when(F.col("multi_topic"), wide).otherwise(opts.retrieval_k))
    )


def default_scope(queries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Document of each question: none when all are searched, else its own, else the last completed job's."""
    last = jobs.filter("status = 'completed'").agg(F.max_by("job_id", F.struct("completed_at", "job_id")).alias("j"))
    return queries.withColumn(
        "document_id",
        F.when(F.col("search_all"), F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.nullif("document_id", F.lit("")), last.select("j").scalar())),
    )


# --- hits -----------------------------------------------------------------------------------------

def holds_all(text: Column, keywords: Column) -> Column:
    """Whether a text holds every keyword of two or more characters; false where there is none."""
    usable = F.filter(F.transform(keywords, lambda w: F.lower(strip(w))), lambda w: F.length(w) >= 2)
    low = F.lower(text_or_empty(text))
    return (F.size(usable) > 0) & F.forall(usable, lambda w: F.contains(low, w))


def keyword_hits(queries: DataFrame, vectors: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """First k chunks of each question's document that hold all its keywords as substrings, in document order.

    Any keywords will do; those of fewer than two characters do not count. Each chunk is searched for the keywords
    asked of its document, which gives an inverted list for every asked keyword; questions with the same document and
    keywords are searched once, on their keyword with the shortest list.
    """
    usable = F.array_sort(F.array_distinct(F.filter(F.transform("terms", lambda w: F.lower(strip(w))), lambda w: F.length(w) >= 2)))
    asked = queries.filter("document_id is not null").withColumn("terms", usable).filter("size(terms) > 0")
    # This and the lists are read several times.
    wanted = run_table(asked.groupBy("document_id", "terms").agg(F.max("k").alias("most")), "asked-terms")
    words = wanted.select("document_id", F.explode("terms").alias("term")).groupBy("document_id").agg(
        F.collect_set("term").alias("words"))
    low = F.lower(text_or_empty("text"))
    held = salted_join(vectors.select("document_id", "chunk_id", "chunk_seq", low.alias("low")), words, ["document_id"], ["chunk_id"]).select(
        "document_id", "chunk_id", "chunk_seq", F.filter("words", lambda w: F.contains(F.col("low"), w)).alias("held"))
    lists = run_table(held.filter("size(held) > 0").withColumn("term", F.explode("held")), "keyword-lists")
    sizes = lists.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.withColumn("term", F.explode("terms")).join(sizes, ["document_id", "term"])
        .groupBy("document_id", "terms", "most").agg(F.min_by("term", F.struct("n", "term")).alias("term"))
    )
    found = rarest.join(lists, ["document_id", "term"]).filter(F.size(F.array_except("terms", "held")) == 0)
    order = W.partitionBy("document_id", "terms").orderBy("chunk_seq", "chunk_id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("most"))
    return (
        asked.select("query_id", "document_id", "terms", "k")
        .join(first.select("document_id", "terms", "chunk_id", "rank"), ["document_id", "terms"])
        .filter(F.col("rank") <= F.col("k"))
        .select("query_id", "chunk_id", F.lit(1.0).alias("score"), "rank")
    )


def vector_hits(queries: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, cosine: bool = True) -> DataFrame:
    """Best k chunks of each question by vector, inside its document where it has one."""
    # Read by both searches, and several times in each.
    embedded = run_table((embedder or HashedCounts()).encode(queries, "query", "embedding"), "embedded-questions")
    unscoped = corpus_topk(embedded.filter("document_id is null"), vectors, cosine)
    return unscoped.unionByName(scoped_topk(embedded, vectors, cosine))


def merge_hits(queries: DataFrame, keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Keyword hits, then vector hits, each chunk once, first k: query_id, chunk_id, score, rank."""
    both = keyword.withColumn("source_order", F.lit(0)).unionByName(vector.withColumn("source_order", F.lit(1)))
    best = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("source_order", "rank", "score")).alias("b"))
    order = W.partitionBy("query_id").orderBy("b.source_order", "b.rank", "chunk_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .join(queries.select("query_id", "k"), "query_id")
        .filter(F.col("rank") <= F.col("k"))
        .select("query_id", "chunk_id", F.col("b.score").alias("score"), "rank")
    )


def hybrid_hits(queries: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, opts: Options = DEFAULTS) -> DataFrame:
    return merge_hits(queries, keyword_hits(queries, vectors, opts), vector_hits(queries, vectors, embedder))


# --- graph expansion ------------------------------------------------------------------------------

def hit_entities(queries: DataFrame, hits: DataFrame, g: GraphTables) -> DataFrame:
    """Entities mentioned by each hit: query_id, chunk_id, graph_key, name (inside the scope, if any)."""
    scoped = hits.join(queries.select("query_id", F.col("document_id").alias("scope")), "query_id")
    mentioned = scoped.join(g.mentions, "chunk_id").filter(
        F.col("scope").isNull() | (F.col("scope") == F.col("document_id"))
    )
    return mentioned.join(
        g.entities.select("document_id", "graph_key", "name"), ["document_id", "graph_key"]
    ).select("query_id", "chunk_id", "rank", "document_id", "graph_key", "name", "scope")


def expansion_nodes(entities: DataFrame) -> DataFrame:
    return entities.select("query_id", "document_id", "graph_key", "name", "scope").distinct()


def induced_edges(nodes: DataFrame, g: GraphTables, opts: Options = DEFAULTS) -> DataFrame:
    """Relations with both ends among a question's nodes; without a scope the first 100 only.

    Relations are cut down to the asked nodes at both ends before anything is counted. Each relation is looked up at its end with fewer relations, so an entity that is linked to a great
    part of a document does not multiply every question that meets it.
    """
    keys = run_table(nodes.select("graph_key").distinct(), "asked-keys")
    plain = g.relationships.select("from_key", "to_key", "rel_type").join(
        keys.withColumnRenamed("graph_key", "from_key"), "from_key", "left_semi").join(
        keys.withColumnRenamed("graph_key", "to_key"), "to_key", "left_semi")
    degree = plain.select(F.explode(F.array("from_key", "to_key")).alias("graph_key")).groupBy(
        "graph_key"
    ).agg(F.count(F.lit(1)).alias("degree"))
    def with_degree(rows: DataFrame, key: str, name: str, other: str) -> DataFrame:
        named = degree.withColumnRenamed("graph_key", key)
        return salted_join(rows, named.withColumn(name, F.col("degree")), [key], [other, "rel_type"], rows="degree")

    edges = (
        with_degree(with_degree(plain, "from_key", "d_from", "to_key"), "to_key", "d_to", "from_key")
        .withColumn("near", F.when(F.col("d_from") <= F.col("d_to"), F.col("from_key")).otherwise(F.col("to_key")))
        .withColumn("far", F.when(F.col("d_from") <= F.col("d_to"), F.col("to_key")).otherwise(F.col("from_key")))
        .select("near", "far", "from_key", "to_key", "rel_type")
    )
    own = nodes.select("query_id", "scope", F.col("graph_key").alias("near"))
    other = nodes.select("query_id", F.col("graph_key").alias("far"))
    found = own.join(edges, "near").join(other, ["query_id", "far"], "left_semi")
    order = W.partitionBy("query_id").orderBy("from_key", "to_key", "rel_type")
    return (
        found.withColumn("edge_rank", F.row_number().over(order))
        .filter(F.col("scope").isNotNull() | (F.col("edge_rank") <= opts.unscoped_edges))
        .select("query_id", F.col("from_key").alias("source"), F.col("to_key").alias("target"), F.col("rel_type").alias("type"))
    )


def chunk_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each hit both of whose ends the chunk mentions."""
    mentioned = entities.select("query_id", "chunk_id", "graph_key")
    sources = mentioned.withColumnRenamed("graph_key", "source")
    targets = mentioned.withColumnRenamed("graph_key", "target")
    return edges.join(sources, ["query_id", "source"]).join(targets, ["query_id", "chunk_id", "target"]).select(
        "query_id", "chunk_id", "source", "target", "type"
    )


def context_chunks(hits: DataFrame, vectors: DataFrame, g: GraphTables, opts: Options = DEFAULTS) -> DataFrame:
    """Texts of the hits by rank: the graph's text for chunks in the graph, else the vector row's.

    A chunk is in the graph when it mentions an entity. Repeats by the start of the text are dropped,
    and ``position`` counts what is left.
    """
    # The hits cut the other tables down before anything else is done with them.
    asked = run_table(hits.select("chunk_id").distinct(), "asked-chunks")
    mentioned = g.mentions.select("chunk_id").join(asked, "chunk_id", "left_semi")
    in_graph = g.chunks.join(asked, "chunk_id", "left_semi").join(mentioned, "chunk_id", "left_semi")
    graph_side = in_graph.select(
        "chunk_id", F.col("text").alias("g_text"), F.col("source").alias("g_source"), F.col("page").alias("g_page"),
        F.lit(True).alias("in_graph"),
    )
    vector_side = vectors.join(asked, "chunk_id", "left_semi").select(
        "chunk_id", clip("text", opts.vector_text_chars).alias("v_text"), F.col("source").alias("v_source"),
        F.col("page").alias("v_page"),
    )
    # Both sides are met by chunk first, so that the hits are spread and joined once: a chunk may be among those of a great part of
    # the questions.
    sides = asked.join(graph_side, "chunk_id", "left").join(vector_side, "chunk_id", "left")
    found = salted_join(hits, sides, ["chunk_id"], ["query_id"], "left").select(
        "query_id", "rank", "chunk_id",
        F.coalesce("g_text", "v_text").alias("text"), F.coalesce("g_source", "v_source").alias("source"),
        F.coalesce("g_page", "v_page").alias("page"), F.coalesce("in_graph", F.lit(False)).alias("in_graph"),
    )
    order = W.partitionBy("query_id").orderBy("rank")
    return prefix_dedup(found, ["query_id"], "rank").withColumn("position", F.row_number().over(order))
