"""Answer context for each question: triples, passages, prompt, citations, confidence, trace.

Everything collected here belongs to one question and is bounded by its hits, so lists stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import cosine, squared_norm, token_dot
from ..functions.text import clip, ellipsis, is_blank, last_key_part, strip, text_or_empty, word_tokens
from ..options import DEFAULTS, Options

# Sizes and wording of results.
MAX_TRIPLES = 30
SAME_PREFIX_CHARS = 150
PASSAGE_CHARS = 800
CITED_ENTITIES = 20
CITED_RELATIONS = 15
FALLBACK_CHARS = 350
FALLBACK_TOTAL = 600
NOTHING_FOUND = "No relevant context was retrieved. Try refining your query or uploading a document."
FALLBACK_INTRO = "Based on the retrieved passages:\n\n"
STEP_GRAPH = "Retrieved graph relationships"
STEP_PASSAGES = "Retrieved %d relevant passages"
STEP_COMBINED = "Combined graph + passages into unified explanation"
NO_CONTEXT = "No context."
CONTEXT_SEPARATOR = "\n\n---\n\n"

# The engine's own wording of the request to a language model.
PROMPT_HEAD = "Answer the question from the facts and passages below, and from nothing else."
PROMPT_RULES = (
    "Combine facts and passages into one answer of at most 150 words. Cover every topic of the question. "
    "Start with the direct answer; put more after \"Details:\". Do not cite inline."
)


def triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """First triples of each question as text, ordered: query_id, position, triple."""
    names = nodes.select("query_id", "graph_key", last_key_part("name").alias("label"))
    source = names.select("query_id", F.col("graph_key").alias("source"), F.col("label").alias("source_name"))
    target = names.select("query_id", F.col("graph_key").alias("target"), F.col("label").alias("target_name"))
    order = W.partitionBy("query_id").orderBy("source", "target", "type")
    first = edges.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= MAX_TRIPLES)
    return (
        first.join(source, ["query_id", "source"], "left").join(target, ["query_id", "target"], "left")
        .select(
            "query_id", "position",
            triple_text(F.coalesce("source_name", "source"), F.col("type"), F.coalesce("target_name", "target")).alias("triple"),
        )
    )


def triple_text(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("("), source, F.lit(")-["), kind, F.lit("]->("), target, F.lit(")"))


def passages(context: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Excerpts of the top chunks; blanks and repeats of the same start drop out afterwards."""
    text = strip(text_or_empty("text"))
    top = context.filter(F.col("position") <= opts.context_chunks).withColumn("text", text).filter(~is_blank("text"))
    start = F.regexp_replace(F.lower(clip("text", SAME_PREFIX_CHARS)), r"(?U)\s+", " ")
    first = W.partitionBy("query_id", "start").orderBy("position")
    return (
        top.withColumn("start", start).withColumn("__n", F.row_number().over(first)).filter("__n = 1")
        .select("query_id", "position", "chunk_id", "page", "source", ellipsis("text", opts.context_chars).alias("text"))
    )


def _ordered(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Array of a value for each question, by an order column."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy("query_id").agg(F.transform(listed, lambda x: x["v"]).alias(name))


def answer_context(queries: DataFrame, triple_rows: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Per question: triples, passages, prompt, answer from the passages alone, and reasoning steps."""
    facts = _ordered(triple_rows, "position", F.col("triple"), "triples")
    body = F.concat(
        F.lit("["), F.coalesce("source", F.lit("source")), F.lit(" p"), F.col("page").cast("string"), F.lit("]\n"),
        F.col("text"), F.lit("\n"),
    )
    shown = _ordered(passage_rows, "position", F.struct(body.alias("body"), F.col("text").alias("text")), "shown")
    joined = queries.select("query_id", "query").join(facts, "query_id", "left").join(shown, "query_id", "left")
    none = F.array().cast("array<string>")
    filled = joined.select(
        "query_id", "query", F.coalesce("triples", none).alias("triples"),
        F.coalesce(F.transform("shown", lambda s: s["body"]), none).alias("bodies"),
        F.coalesce(F.transform("shown", lambda s: s["text"]), none).alias("texts"),
    )
    return filled.select(
        "query_id", "triples", F.col("texts").alias("passages"),
        prompt_text(F.col("query"), F.col("triples"), F.col("bodies")).alias("prompt"),
        fallback_answer(F.col("texts")).alias("fallback_answer"),
        reasoning_steps(F.size("triples"), F.size("texts")).alias("reasoning_steps"),
    )


def prompt_text(query: Column, facts: Column, bodies: Column) -> Column:
    listed = F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda t: F.concat(F.lit("- "), t)), "\n")).otherwise(
        F.lit("- (none)")
    )
    return F.concat_ws(
        "\n",
        F.lit(PROMPT_HEAD), F.lit(""), F.lit("## Facts"), listed, F.lit(""), F.lit("## Passages"),
        F.array_join(bodies, "\n"), F.lit("## Question"), query, F.lit(""), F.lit("## Rules"), F.lit(PROMPT_RULES),
    )


def fallback_answer(texts: Column) -> Column:
    """Answer made of passages alone, for when no model answers."""
    joined = F.array_join(F.transform(F.slice(texts, 1, 3), lambda t: clip(t, FALLBACK_CHARS)), "\n\n")
    cut = F.when(F.length(joined) > FALLBACK_TOTAL, F.concat(clip(joined, FALLBACK_TOTAL), F.lit("…"))).otherwise(joined)
    return F.when(F.size(texts) == 0, F.lit(NOTHING_FOUND)).otherwise(F.concat(F.lit(FALLBACK_INTRO), cut))


def reasoning_steps(n_triples: Column, n_passages: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(n_triples > 0, F.lit(STEP_GRAPH)),
            F.when(n_passages > 0, F.format_string(STEP_PASSAGES, n_passages)),
            F.when((n_passages >= 2) | (n_triples > 0), F.lit(STEP_COMBINED)),
        )
    )


def clean_answer(c: Column) -> Column:
    """Answer without citation markup and runs of blank lines."""
    t = F.regexp_replace(c, r"(?iU)\[Source:\s*[^\]]+\]", "")
    t = F.regexp_replace(t, r"(?i)\[.*?p\d+.*?\]", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def answer_sections(c: Column) -> Column:
    """``struct<summary, details>``: the text before and after ``Details:``."""
    pattern = r"(?i)\bDetails?:\s*"
    has = c.rlike(pattern)
    before = F.regexp_extract(c, r"(?is)^(.*?)\bDetails?:", 1)
    after = F.regexp_extract(c, r"(?is)\bDetails?:\s*(.*)$", 1)
    return F.struct(
        F.when(has, strip(before)).otherwise(c).alias("summary"),
        F.when(has, strip(after)).otherwise(F.lit("")).alias("details"),
    )


def citations(context: DataFrame, entities: DataFrame, edges_by_chunk: DataFrame, nodes: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """First chunks of each question with passage, entity names and relation texts."""
    cited = context.filter(F.col("position") <= opts.citations)
    keys = cited.select("query_id", "chunk_id")
    names = entities.join(keys, ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("graph_key", last_key_part("name").alias("label")))).alias("e")
    )
    label = nodes.select("query_id", "graph_key", last_key_part("name").alias("label"))
    source = label.select("query_id", F.col("graph_key").alias("source"), F.col("label").alias("source_name"))
    target = label.select("query_id", F.col("graph_key").alias("target"), F.col("label").alias("target_name"))
    related = (
        edges_by_chunk.join(keys, ["query_id", "chunk_id"], "left_semi")
        .join(source, ["query_id", "source"], "left").join(target, ["query_id", "target"], "left")
        .groupBy("query_id", "chunk_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "source", "target", "type",
                        triple_text(F.coalesce("source_name", "source"), F.col("type"), F.coalesce("target_name", "target")).alias("t"),
                    )
                )
            ).alias("r")
        )
    )
    none = F.array().cast("array<string>")
    return (
        cited.join(names, ["query_id", "chunk_id"], "left").join(related, ["query_id", "chunk_id"], "left")
        .select(
            "query_id", "position", "chunk_id", "page", "source",
            ellipsis(strip(text_or_empty("text")), PASSAGE_CHARS).alias("text"),
            F.coalesce(F.slice(F.transform("e", lambda x: x["label"]), 1, CITED_ENTITIES), none).alias("graph_entities"),
            F.coalesce(F.slice(F.transform("r", lambda x: x["t"]), 1, CITED_RELATIONS), none).alias("graph_relationships"),
        )
    )


def citation_dedup(context: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """First chunks of each question that are not near copies of one before them: query_id, position, chunk_id.

    A fold over the question's few context chunks; word-count cosine.
    """
    row = F.struct("position", "chunk_id", word_tokens("text").alias("tokens"))
    lists = context.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    normed = F.transform(
        "rows",
        lambda r: F.struct(
            r["position"].alias("position"), r["chunk_id"].alias("chunk_id"), r["tokens"].alias("tokens"),
            squared_norm(r["tokens"]).alias("norm"),
        ),
    )
    kind = "array<struct<position:int,chunk_id:string,tokens:array<string>,norm:double>>"

    def step(kept: Column, r: Column) -> Column:
        repeats = F.exists(
            kept,
            lambda u: (u["chunk_id"] == r["chunk_id"])
            | (cosine(token_dot(u["tokens"], r["tokens"]), u["norm"], r["norm"]) >= opts.citation_similarity),
        )
        return F.when((F.size(kept) < opts.citations) & ~repeats, F.array_append(kept, r)).otherwise(kept)

    kept = lists.select("query_id", F.aggregate(normed, F.array().cast(kind), step).alias("kept"))
    return kept.select("query_id", F.inline("kept")).select("query_id", "position", "chunk_id")


def confidence(queries: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, cited: DataFrame) -> DataFrame:
    """Weighted evidence of each question: graph matches, best score, citations; between 0.2 and 1."""
    parts = (
        hits.groupBy("query_id").agg(F.max("score").alias("best")).select("query_id", F.lit("best").alias("part"), F.col("best").alias("n"))
        .unionByName(_counted(nodes, "nodes")).unionByName(_counted(edges, "edges")).unionByName(_counted(cited, "cited"))
    )
    wide = parts.groupBy("query_id").agg(
        *[F.max(F.when(F.col("part") == p, F.col("n"))).alias(p) for p in ("best", "nodes", "edges", "cited")]
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    graph = F.greatest(F.least(F.lit(1.0), zero("edges") / 10.0), F.least(F.lit(1.0), zero("nodes") / 15.0))
    similarity = F.least(F.lit(1.0), zero("best"))
    strength = F.least(F.lit(1.0), zero("cited") / 5.0)
    base = graph * 0.4 + similarity * 0.3 + strength * 0.3
    return queries.select("query_id").join(wide, "query_id", "left").select(
        "query_id", F.least(F.lit(1.0), F.greatest(F.lit(0.2), base)).alias("confidence")
    )


def _counted(rows: DataFrame, part: str) -> DataFrame:
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        "query_id", F.lit(part).alias("part"), "n"
    )


def graph_trace(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and used node ids of each question, as sorted arrays."""
    n = nodes.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("graph_key").alias("id"), "name"))).alias("nodes")
    )
    e = edges.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", "type"))).alias("edges"))
    ids = F.array_union(
        F.transform("nodes", lambda x: x["id"]),
        F.flatten(F.transform("edges", lambda x: F.array(x["source"], x["target"]))),
    )
    none = F.array().cast("array<struct<source:string,target:string,type:string>>")
    return (
        n.join(e, "query_id", "left").withColumn("edges", F.coalesce("edges", none))
        .select("query_id", "nodes", "edges", F.array_sort(ids).alias("used_node_ids"))
    )


# --- the plain agent path -------------------------------------------------------------------------

def with_fallback(graph_chunks: DataFrame, vector_chunks: DataFrame, queries: DataFrame, needed: int = 2, fetched: int = 5) -> DataFrame:
    """Graph chunks of each question, completed by its best vector chunks where fewer than two were found.

    Both inputs: query_id, rank, chunk_id, text, source, page. A chunk found by both keeps its place and
    takes the vector row's values.
    """
    counts = graph_chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    thin = queries.select("query_id").join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < needed)
    extra = vector_chunks.filter(F.col("rank") <= fetched).join(thin.select("query_id"), "query_id", "left_semi")
    both = graph_chunks.withColumn("later", F.lit(0)).unionByName(extra.withColumn("later", F.lit(1)))
    place, values = F.struct("later", "rank"), F.struct("text", "source", "page")
    merged = both.groupBy("query_id", "chunk_id").agg(
        F.min(place).alias("place"), F.max_by(values, place).alias("v")
    )
    order = W.partitionBy("query_id").orderBy("place", "chunk_id")
    return merged.withColumn("position", F.row_number().over(order)).select(
        "query_id", "position", "chunk_id", "v.text", "v.source", "v.page"
    )


def plain_context(chunks: DataFrame, queries: DataFrame, limit: int = 10, cited: int = 5) -> DataFrame:
    """Context of the first ten chunks as text, the first five as citations, and a fixed confidence."""
    body = F.concat(F.lit("["), text_or_empty("source"), F.lit("]\n"), F.col("text"))
    rows = chunks.filter(F.col("position") <= limit)
    shown = rows.filter("text is not null and text <> ''")
    parts = _ordered(shown, "position", body, "parts")
    refs = _ordered(chunks.filter(F.col("position") <= cited), "position", F.col("chunk_id"), "citations")
    none = F.array().cast("array<string>")
    return (
        queries.select("query_id").join(parts, "query_id", "left").join(refs, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(F.array_join("parts", CONTEXT_SEPARATOR), F.lit(NO_CONTEXT)).alias("context"),
            F.coalesce("citations", none).alias("citations"),
            F.when(F.col("parts").isNull(), 0.3).otherwise(0.85).alias("confidence"),
        )
    )


# --- chart points ---------------------------------------------------------------------------------

def chart_point_text(points: DataFrame, recognised: DataFrame, limit: int = 10) -> DataFrame:
    """Chart points that the recognised text confirms, as sentences; else the recognised text itself.

    ``points``: document_id, page, point_seq, label, value. ``recognised``: document_id, page, text. A
    point counts when its value or label is a number of the text, or when the text has no numbers.
    """
    numbers = F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\b(\d+(?:\.\d+)?)\b"), F.lit(1))
    keys = ["document_id", "page"]
    seen = recognised.select(*keys, strip(text_or_empty("text")).alias("text")).withColumn("numbers", numbers)
    confirmed = (
        (F.size("numbers") == 0) | F.array_contains("numbers", F.col("value")) | F.array_contains("numbers", F.col("label"))
    )
    order = W.partitionBy(*keys).orderBy("point_seq", "value", "label")
    kept = (
        points.join(seen, keys).filter(confirmed)
        .withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit)
    )
    sentence = F.concat("value", F.lit(" in "), "label", F.lit("."))
    told = kept.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("point_seq", "value", "label", sentence.alias("s")))), lambda x: x["s"]
            ),
            " ",
        ).alias("sentences")
    )
    return seen.join(told, keys, "left").select(*keys, F.coalesce("sentences", "text").alias("text"))
