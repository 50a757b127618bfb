"""Graph tables (chunks, entities, mentions, relationships) and the reports over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import RELATION_TYPES
from ..functions.text import clip, last_key_part
from ..options import DEFAULTS, Options
from ..session import run_table
from .components import connected_components
from .entities import mention_rows, relation_rows
from .ordering import with_text_rank
from .skew import salted_join


@dataclass
class GraphTables:
    chunks: DataFrame
    entities: DataFrame
    mentions: DataFrame
    relationships: DataFrame


def scope(df: DataFrame, document_id: str | None) -> DataFrame:
    """Rows of one document, or all rows; tables may name the column ``document_id`` or ``doc_id``."""
    if document_id is None:
        return df
    column = "document_id" if "document_id" in df.columns else "doc_id"
    return df.filter(F.col(column) == document_id)


def allowed_relations(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("rel_type").isin(RELATION_TYPES))


def chunk_nodes(chunks: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """One row for each chunk id, the last written; chunks without a mention are nodes too."""
    last = W.partitionBy("chunk_id").orderBy(F.col("chunk_seq").desc())
    return (
        chunks.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
        .select("document_id", "chunk_id", "chunk_seq", clip("text", opts.graph_text_chars).alias("text"), "source", "page")
    )


def mention_edges(mentions: DataFrame) -> DataFrame:
    return mentions.select("document_id", "chunk_id", "graph_key").distinct()


def relation_edges(relations: DataFrame) -> DataFrame:
    """Distinct relations of a corpus, allowed types only."""
    return allowed_relations(relations).select(
        "document_id", "from_key", "to_key", "from_name", "to_name", "rel_type"
    ).distinct()


def entity_nodes(mentions: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """One row for each graph key; the chunk with the highest sequence sets name and type.

    Relation ends that no chunk mentions are entities too, of type ``concept``.
    """
    mentioned = mentions.groupBy("document_id", "graph_key").agg(
        F.max_by("name", "chunk_seq").alias("name"), F.max_by("entity_type", "chunk_seq").alias("entity_type")
    )
    if relations is None:
        return mentioned
    ends = relation_ends(relations).distinct().join(mentioned, ["document_id", "graph_key"], "left_anti")
    return mentioned.unionByName(ends.withColumn("entity_type", F.lit("concept")))


def relation_ends(relations: DataFrame) -> DataFrame:
    """Both ends of each relation, one row each."""
    ends = F.array(
        F.struct(F.col("from_key").alias("graph_key"), F.col("from_name").alias("name")),
        F.struct(F.col("to_key").alias("graph_key"), F.col("to_name").alias("name")),
    )
    return relations.select("document_id", F.inline(ends))


def communities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Connected components of each document's entities, numbered from 0 in order of their least key."""
    keys = entities.select("document_id", "graph_key")
    node = lambda key: F.struct("document_id", F.col(key).alias("graph_key"))
    edges = allowed_relations(relations).select(node("from_key").alias("a"), node("to_key").alias("b"))
    found = connected_components(edges, "a", "b").select(
        F.col("node.document_id").alias("document_id"), F.col("node.graph_key").alias("graph_key"),
        F.col("component.graph_key").alias("root"),
    )
    return number_communities(
        keys.join(found, ["document_id", "graph_key"], "left").withColumn("root", F.coalesce("root", "graph_key")))


def number_communities(placed: DataFrame) -> DataFrame:
    """``document_id, graph_key, root`` (the component's least key) to numbers from 0 in the order of roots."""
    ranked = with_text_rank(placed.select("document_id", "root").distinct(), ["document_id"], "root", "community_id")
    numbered = ranked.select("document_id", "root", F.col("community_id").cast("int").alias("community_id"))
    return salted_join(placed, numbered, ["document_id", "root"], ["graph_key"]).select("document_id", "graph_key", "community_id")


def build_graph(
    extracted: DataFrame, opts: Options = DEFAULTS, with_communities: bool = True, edges: DataFrame | None = None,
) -> GraphTables:
    """All four tables from extracted chunks. Cache or write ``extracted`` first: each table reads it.

    ``edges``: its relations, where they are written already.
    """
    mentions = mention_rows(extracted)
    edges = relation_edges(relation_rows(extracted)) if edges is None else edges
    if with_communities:
        # Both are read several times.
        edges = run_table(edges, "edges")
        entities = run_table(entity_nodes(mentions, edges), "nodes")
        entities = entities.join(communities(entities, edges), ["document_id", "graph_key"], "left")
    else:
        entities = entity_nodes(mentions, edges).withColumn("community_id", F.lit(None).cast("int"))
    return GraphTables(chunk_nodes(extracted, opts), entities, mention_edges(mentions), edges)


# --- reports --------------------------------------------------------------------------------------

def relation_histogram(relations: DataFrame) -> DataFrame:
    return allowed_relations(relations).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def document_relation_histogram(relations: DataFrame) -> DataFrame:
    """Relations of each type in each document."""
    return allowed_relations(relations).groupBy("document_id", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def entity_degree(g: GraphTables) -> DataFrame:
    """Edges of each entity, mentions included, in both directions; a relation to itself counts once."""
    ends = g.relationships.select(
        "document_id", F.explode(F.array_distinct(F.array("from_key", "to_key"))).alias("graph_key")
    ).unionByName(g.mentions.select("document_id", "graph_key"))
    counted = ends.groupBy("document_id", "graph_key").agg(F.count(F.lit(1)).alias("degree"))
    return g.entities.select("document_id", "graph_key").join(
        counted, ["document_id", "graph_key"], "left"
    ).select("document_id", "graph_key", F.coalesce("degree", F.lit(0)).alias("degree"))


def snapshot_nodes(g: GraphTables) -> DataFrame:
    chunks = g.chunks.select(
        "document_id", F.concat(F.lit("chunk:"), "chunk_id").alias("id"),
        clip(F.coalesce(F.nullif("source", F.lit("")), F.lit("chunk")), 40).alias("name"),
        F.lit(1).alias("group"), F.lit("chunk").alias("entity_type"),
        F.lit(-1).alias("community_id"), F.lit(1).cast("bigint").alias("val"),
    )
    name = F.coalesce(F.nullif("name", F.lit("")), last_key_part("graph_key"))
    entities = g.entities.join(entity_degree(g), ["document_id", "graph_key"], "left").select(
        "document_id", F.col("graph_key").alias("id"), clip(name, 60).alias("name"),
        F.lit(2).alias("group"), F.coalesce("entity_type", F.lit("concept")).alias("entity_type"),
        F.coalesce("community_id", F.lit(-1)).alias("community_id"),
        F.greatest(F.lit(1), "degree").cast("bigint").alias("val"),
    )
    return chunks.unionByName(entities)


def snapshot_links(g: GraphTables) -> DataFrame:
    mentions = g.mentions.select(
        "document_id", F.concat(F.lit("chunk:"), "chunk_id").alias("source"),
        F.col("graph_key").alias("target"), F.lit("MENTIONS").alias("type"),
    )
    relations = g.relationships.select(
        "document_id", F.col("from_key").alias("source"), F.col("to_key").alias("target"),
        F.col("rel_type").alias("type"),
    )
    return mentions.unionByName(relations)


def complete_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with defaults filled in, and a placeholder for each link end that is no node."""
    is_chunk = F.col("id").startswith("chunk:")
    known = nodes.filter(F.col("id").isNotNull()).select(
        "document_id", "id", "name", "group",
        F.coalesce(F.nullif("entity_type", F.lit("")), F.when(is_chunk, "chunk").otherwise("concept")).alias("entity_type"),
        F.coalesce("community_id", F.lit(-1)).alias("community_id"),
        F.when(F.col("val") > 0, F.col("val")).otherwise(1).cast("bigint").alias("val"),
    )
    ends = links.filter("source is not null and target is not null").select(
        "document_id", F.explode(F.array("source", "target")).alias("id")
    ).distinct()
    missing = ends.join(known.select("document_id", "id"), ["document_id", "id"], "left_anti").select(
        "document_id", "id",
        F.when(is_chunk, F.lit("chunk")).otherwise(clip(last_key_part("id"), 60)).alias("name"),
        F.when(is_chunk, 1).otherwise(2).alias("group"),
        F.when(is_chunk, F.lit("chunk")).otherwise(F.lit("concept")).alias("entity_type"),
        F.lit(-1).alias("community_id"), F.lit(1).cast("bigint").alias("val"),
    )
    return known.unionByName(missing)


def links_with_known_end(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links of which at least one end is a node."""
    ids = nodes.select("document_id", "id").distinct()
    as_source = ids.select("document_id", F.col("id").alias("source"), F.lit(True).alias("__s"))
    as_target = ids.select("document_id", F.col("id").alias("target"), F.lit(True).alias("__t"))
    return (
        salted_join(
            salted_join(links, as_source, ["document_id", "source"], ["target", "type"], "left"),
            as_target, ["document_id", "target"], ["source", "type"], "left",
        )
        .filter(F.col("__s").isNotNull() | F.col("__t").isNotNull())
        .select(*links.columns)
    )


def first_entity_names(nodes: DataFrame, limit: int = 40) -> DataFrame:
    """First entity nodes of each document by id."""
    order = W.partitionBy("document_id").orderBy("id")
    return (
        nodes.filter(~F.col("id").startswith("chunk:"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        .select("document_id", "rank", "id", "name")
    )


def document_counts(g: GraphTables) -> DataFrame:
    """Stored chunks, entities and relations of each document."""
    parts = [("chunks", g.chunks), ("entities", g.entities), ("relationships", g.relationships)]
    counts = None
    for name, table in parts:
        part = table.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    return counts.groupBy("document_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k, _ in parts]
    )


def graph_totals(g: GraphTables) -> DataFrame:
    return document_counts(g).agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("chunks", "entities", "relationships")]
    )


def chunks_per_document(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """Documents with the most chunks."""
    counted = chunks.filter("document_id is not null and document_id <> ''").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks")
    )
    return counted.orderBy(F.col("chunks").desc(), "document_id").limit(limit)
