"""The graph kept up batch by batch: what a batch adds is merged with what is stored, in place of a new build.

A batch holds chunks, of new documents or of documents that are stored in part. Its rows are appended; stored rows are
read only where they decide something, and only in the buckets of the batch's documents:

- mentions and relations that are stored already are not appended again;
- names and types of entities are kept with the sequence of their chunk, and the highest wins when they are read;
- components: the ends of new relations are replaced by the roots of their stored components, components of that small
  graph tell which roots meet, and rows are appended for new entities and for entities whose root moved. The last written
  root of an entity stands.

All of a batch is one commit under the batch's name, so a replayed batch changes nothing, and a reader sees a batch whole
or not at all. Deleting documents is one commit of markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import entities, graph
from ..operators.components import connected_components
from ..options import DEFAULTS, Options
from ..session import run_table, spread
from ..sources.log_tables import LogStore

SCHEMAS = {
    "chunks": "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int, written bigint",
    "names": "document_id string, graph_key string, name string, entity_type string, chunk_seq bigint",
    "mentions": "document_id string, chunk_id string, graph_key string",
    "relationships": "document_id string, from_key string, to_key string, from_name string, to_name string, rel_type string",
    "components": "document_id string, graph_key string, root string, written bigint",
}
_KEY = ["document_id", "graph_key"]


class IncrementalGraph:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.store = LogStore(spark, folder, SCHEMAS, buckets)

    def apply(self, batch: str, extracted: DataFrame, opts: Options = DEFAULTS) -> bool:
        """Merge extracted chunks under the batch's name; False where that batch is in already.

        ``extracted`` should come from a written table, since it is read several times.
        """
        with self.store.commit(batch) as commit:
            if commit is None:
                return False
            documents = run_table(extracted.select("document_id").distinct(), "documents")
            mentions = entities.mention_rows(extracted)
            relations = graph.relation_edges(entities.relation_rows(extracted))

            def stored(table: str) -> DataFrame:
                return self.store.load(table, documents)

            commit.append("chunks", graph.chunk_nodes(extracted, opts).withColumn("written", F.lit(commit.number)))
            commit.append("mentions", graph.mention_edges(mentions).join(stored("mentions"), [*_KEY, "chunk_id"], "left_anti"))
            new = run_table(relations.join(
                stored("relationships"), ["document_id", "from_key", "to_key", "rel_type"], "left_anti"), "relations")
            commit.append("relationships", new)
            last = F.max_by(F.struct("name", "entity_type", "chunk_seq"), "chunk_seq").alias("v")
            named = mentions.groupBy(*_KEY).agg(last).select(*_KEY, "v.*")
            commit.append("names", named)
            keys = named.select(*_KEY).unionByName(graph.relation_ends(new).select(*_KEY)).distinct()
            commit.append("components", self._moved(keys, new, last_roots(stored("components"))).withColumn("written", F.lit(commit.number)))
        return True

    @staticmethod
    def _moved(keys: DataFrame, relations: DataFrame, stored: DataFrame) -> DataFrame:
        """``document_id, graph_key, root`` of new entities, and of stored ones whose root is another now."""
        placed = run_table(
            stored.withColumn("known", F.lit(True)).unionByName(
                keys.join(stored, _KEY, "left_anti").select(*_KEY, F.col("graph_key").alias("root"), F.lit(False).alias("known"))), "placed")

        def end(side: str) -> DataFrame:
            return placed.select("document_id", F.col("graph_key").alias(f"{side}_key"), F.struct("document_id", "root").alias(side))

        edges = relations.select("document_id", "from_key", "to_key").join(end("from"), ["document_id", "from_key"]).join(
            end("to"), ["document_id", "to_key"])
        met = connected_components(edges, "from", "to").select(
            F.col("node.document_id").alias("document_id"), F.col("node.root").alias("root"), F.col("component.root").alias("now"))
        return placed.join(met, ["document_id", "root"], "left").filter("NOT known OR now <> root").select(
            *_KEY, F.coalesce("now", "root").alias("root"))

    def tables(self, documents: DataFrame | None = None) -> graph.GraphTables:
        """The graph as it stands, of all documents or some."""
        chunks, names, mentions, relations, placed = (self.store.load(t, documents) for t in SCHEMAS)
        last = F.max_by(F.struct("chunk_seq", "text", "source", "page"), "written").alias("v")
        ends = graph.relation_ends(relations).distinct().withColumns(
            {"entity_type": F.lit("concept"), "chunk_seq": F.lit(-1).cast("bigint")})
        nodes = names.unionByName(ends.select(*names.columns)).groupBy(*_KEY).agg(
            F.max_by(F.struct("name", "entity_type"), F.struct("chunk_seq", "name")).alias("v")).select(*_KEY, "v.*")
        numbered = graph.number_communities(last_roots(placed))
        return graph.GraphTables(
            chunks.groupBy("document_id", "chunk_id").agg(last).select(
                "document_id", "chunk_id", "v.chunk_seq", "v.text", "v.source", "v.page"),
            nodes.join(numbered, _KEY, "left"), mentions, relations)


def last_roots(components: DataFrame) -> DataFrame:
    return components.groupBy(*_KEY).agg(F.max_by("root", "written").alias("root"))


def graph_stream(
    chunks: DataFrame, into: IncrementalGraph, checkpoint: str, name: str, opts: Options = DEFAULTS,
) -> StreamingQuery:
    """Keep the graph up with a stream of chunks until no more are available.

    A batch is named by the stream and its number, so that a batch run again after a failure is known.
    """
    def ingest(batch: DataFrame, number: int) -> None:
        if not into.store.has_batch(f"{name}-{number}"):
            into.apply(f"{name}-{number}", run_table(entities.extract_chunks(spread(batch), opts), "extracted"), opts)

    return (
        chunks.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(ingest).start()
    )
