"""Stored graph and vector tables, rewritten document by document.

Tables are partitioned by a hash bucket of the document: one partition for each document would be far
too many for a large corpus. An upsert rewrites only the buckets it touches (dynamic partition
overwrite), so repeating it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "chunks": "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int, "
              "type string, coherence_score double",
    "entities": "document_id string, graph_key string, name string, entity_type string, community_id int",
    "mentions": "document_id string, chunk_id string, graph_key string",
    "relationships": "document_id string, from_key string, to_key string, from_name string, to_name string, rel_type string",
    "vectors": "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int, "
               "embedding array<float>",
}
BUCKET = "doc_bucket"
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


class GraphStore:
    def __init__(self, spark: SparkSession, database: str = "default", prefix: str = "corpus", buckets: int = 64):
        self.spark, self.database, self.prefix, self.buckets = spark, database, prefix, buckets

    def name(self, table: str) -> str:
        return f"{self.database}.{self.prefix}_{table}"

    def _bucket(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def create(self) -> "GraphStore":
        for table, columns in SCHEMAS.items():
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}, {BUCKET} int) "
                f"USING parquet PARTITIONED BY ({BUCKET})"
            )
        return self

    def load(self, table: str, document_id: str | None = None) -> DataFrame:
        """A stored table, or one document of it; a missing table reads as an empty one."""
        if not self.spark.catalog.tableExists(self.name(table)):
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self.spark.table(self.name(table))
        if document_id is not None:
            rows = rows.filter((F.col(BUCKET) == self._bucket(F.lit(document_id))) & (F.col("document_id") == document_id))
        return rows.drop(BUCKET)

    def _write(self, table: str, rows: DataFrame) -> None:
        columns = self.spark.table(self.name(table)).columns
        # Rebalancing splits the bucket of a very large document over several files and tasks.
        ready = rows.select(*columns).hint("rebalance", BUCKET)
        before = self.spark.conf.get(_OVERWRITE_MODE)
        self.spark.conf.set(_OVERWRITE_MODE, "dynamic")
        try:
            ready.write.insertInto(self.name(table), overwrite=True)
        finally:
            self.spark.conf.set(_OVERWRITE_MODE, before)

    def upsert(self, table: str, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Replace the stored rows of all documents in ``rows`` (or in ``documents``) by ``rows``.

        ``rows`` should come from a written or checkpointed table, since it is read twice.
        """
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        incoming = rows.select(*columns).withColumn(BUCKET, self._bucket(F.col("document_id")))
        replaced = (documents if documents is not None else incoming).select("document_id").distinct()
        # At most one number for each bucket comes to the driver.
        touched = [r[0] for r in replaced.select(self._bucket(F.col("document_id"))).distinct().collect()]
        stored = self.spark.table(self.name(table)).filter(F.col(BUCKET).isin(touched))
        kept = stored.join(replaced, "document_id", "left_anti")
        merged = kept.unionByName(incoming)
        left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
        self._write(table, merged)
        self._drop_buckets(table, set(touched) - left)

    def _drop_buckets(self, table: str, buckets: set[int]) -> None:
        """Dynamic overwrite leaves a partition alone when nothing is written to it."""
        for bucket in sorted(buckets):
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({BUCKET} = {bucket})")

    def replace_all(self, table: str, rows: DataFrame) -> None:
        self.spark.sql(f"TRUNCATE TABLE {self.name(table)}")
        self.upsert(table, rows)

    def delete_document(self, document_id: str) -> None:
        """Remove one document's rows from every table, with the edges attached to them."""
        gone = self.spark.createDataFrame([(document_id,)], "document_id string")
        for table, schema in SCHEMAS.items():
            self.upsert(table, self.spark.createDataFrame([], schema), documents=gone)

    def delete_all(self) -> None:
        for table in SCHEMAS:
            self.spark.sql(f"TRUNCATE TABLE {self.name(table)}")
