"""Incremental ingest: each new file of documents goes through the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.similarity import AdjacentSimilarity, Embedder
from ..options import DEFAULTS, Options
from ..plans.pipeline import ingest_documents
from ..sources.tables import GraphStore
from ..sources.units import line_units


def ingest_stream(
    documents: DataFrame, store: GraphStore, checkpoint: str, opts: Options = DEFAULTS,
    embedder: Embedder | None = None, similarity: AdjacentSimilarity | None = None,
    document_id: str = "doc_id", text: str = "text",
) -> StreamingQuery:
    """Ingest a stream of documents until no more are available.

    Documents are stored whole and by key, so a batch that runs again after a failure replaces itself.
    """

    def ingest(batch: DataFrame, _: int) -> None:
        ingest_documents(line_units(batch, document_id, text), store, opts, embedder, similarity)

    return (
        documents.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(ingest).start()
    )
