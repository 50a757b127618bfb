"""Entity and relation ranking: the most telling part of each document's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import Embedder, HashedCounts
from ..options import DEFAULTS, Options
from ..session import run_table
from .clustering import cluster_by_document
from .graph import allowed_relations, relation_ends
from .skew import salted_join

# Weight of each relation type, and the entity types that score a bonus.
RELATION_WEIGHTS = {
    "HAS_VALUE": 3.0,
    "INCREASED_FROM": 2.5,
    "DECREASED_FROM": 2.5,
    "USED_FOR": 2.0,
    "RELATED_TO": 1.0,
}
BONUS_TYPES = ["number", "metric", "date"]


def entity_statistics(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Mention frequency, distinct chunks and relation degree of each entity.

    Mentions are counted by chunk before they are counted by entity, which gives the distinct chunks
    without a distinct aggregate.
    """
    per_chunk = mentions.groupBy("document_id", "graph_key", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("chunk_seq", "name", "entity_type")).alias("first")
    )
    counted = per_chunk.groupBy("document_id", "graph_key").agg(
        F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("chunks"), F.min("first").alias("first")
    )
    degree = relation_ends(allowed_relations(relations)).groupBy("document_id", "graph_key").agg(
        F.count(F.lit(1)).alias("degree")
    )
    return counted.join(degree, ["document_id", "graph_key"], "left").select(
        "document_id", "graph_key", F.col("first.name").alias("name"),
        F.col("first.entity_type").alias("entity_type"),
        "frequency", "chunks", F.coalesce("degree", F.lit(0)).alias("degree"),
    )


def entity_scores(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    score = (
        F.col("frequency") * 2.0 + F.col("degree") * 3.0
        + F.when(F.col("chunks") > 1, 4.0).otherwise(0.0)
        + F.when(F.col("entity_type").isin(BONUS_TYPES), 2.0).otherwise(0.0)
    )
    return entity_statistics(mentions, relations).withColumn("score", score)


def top_entities(scores: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Best entities of each document, earlier key first on ties."""
    order = W.partitionBy("document_id").orderBy(F.col("score").desc(), "graph_key")
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= opts.max_entities)
        .select("document_id", "graph_key", "name", "score", "rank")
    )


def clustered_entities(
    scores: DataFrame, opts: Options = DEFAULTS, embedder: Embedder | None = None, iterations: int = 20
) -> DataFrame:
    """Best entity of each cluster of label vectors, by document; all entities of a document with no more than the limit.

    Each document has as many clusters as entities are wanted of it.
    """
    return clustered_with_points(scores, opts, embedder, iterations)[0]


def clustered_with_points(
    scores: DataFrame, opts: Options = DEFAULTS, embedder: Embedder | None = None, iterations: int = 20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same, with all clustered entities (``cluster``, ``distance``, ``embedding``) and the centroids."""
    scores = run_table(scores.select("document_id", "graph_key", "name", "score"), "scores")
    large = scores.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > opts.max_entities).select("document_id")
    many = scores.join(large, "document_id", "left_semi")
    embedded = run_table((embedder or HashedCounts(32)).encode(many, "name", "embedding"), "label-vectors")
    assigned, centres = cluster_by_document(embedded.select("document_id", "graph_key", "embedding"), opts.max_entities, iterations)
    points = embedded.join(assigned, ["document_id", "graph_key"])
    best = F.max_by(F.struct("graph_key", "name", "score"), F.struct("score", "graph_key"))
    winners = points.groupBy("document_id", "cluster").agg(best.alias("best")).select("document_id", "best.*", "cluster")
    rest = scores.join(large, "document_id", "left_anti").withColumn("cluster", F.lit(None).cast("int"))
    return winners.unionByName(rest), points, centres


def top_relations(
    relations: DataFrame, mentions: DataFrame, keys: DataFrame, opts: Options = DEFAULTS
) -> DataFrame:
    """Best relations between selected entities: mentions of both ends, frequency and type weight."""
    selected = keys.select("document_id", "graph_key")
    counted = allowed_relations(relations).groupBy(
        "document_id", "from_key", "to_key", "from_name", "to_name", "rel_type"
    ).agg(F.count(F.lit(1)).alias("frequency"))
    importance = mentions.groupBy("document_id", "graph_key").agg(F.count(F.lit(1)).alias("mentions"))
    # The mention count of a selected key rides along with the key it is selected by.
    known = selected.join(importance, ["document_id", "graph_key"], "left").select(
        "document_id", "graph_key", F.coalesce("mentions", F.lit(0)).alias("mentions")
    )
    sources = known.select("document_id", F.col("graph_key").alias("from_key"), F.col("mentions").alias("m_from"))
    targets = known.select("document_id", F.col("graph_key").alias("to_key"), F.col("mentions").alias("m_to"))
    weight = F.coalesce(F.try_element_at(_weights(), F.col("rel_type")), F.lit(1.0))
    score = (F.col("m_from") + F.col("m_to")) * 2.0 + F.col("frequency") * 2.0 + weight
    order = W.partitionBy("document_id").orderBy(F.col("score").desc(), "from_key", "to_key", "rel_type")
    return (
        salted_join(
            salted_join(counted, sources, ["document_id", "from_key"], ["to_key", "rel_type"]),
            targets, ["document_id", "to_key"], ["from_key", "rel_type"],
        )
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= opts.max_relationships)
        .select("document_id", "from_key", "to_key", "from_name", "to_name", "rel_type", "frequency", "score", "rank")
    )


def _weights():
    return F.create_map(*[F.lit(x) for kv in RELATION_WEIGHTS.items() for x in kv])


def selected_mentions(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    return mentions.join(keys.select("document_id", "graph_key").distinct(), ["document_id", "graph_key"], "left_semi")
