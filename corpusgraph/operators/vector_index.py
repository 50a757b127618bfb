"""An inverted file over vectors: coarse centroids, every vector in the list of its nearest one, probed lists ranked exactly.

Centroids are fitted on a bounded sample (``SAMPLE_ROWS`` vectors, those with the least hash of their id, so the same ones
each time) with at most ``MAX_LISTS`` of them. All vectors are listed, by one scan, and stored by list. A question is
compared with the centroids, and with all vectors of its nearest lists: the search inside lists is that of
``vectors.scoped_topk`` with lists as scopes, which cuts large lists into shards and many questions into blocks. How many
lists to probe is read off the sample: as many as hold the wanted share of the true nearest neighbours there.

Scores and ties are those of the exact search (``vectors.corpus_topk``), which remains the way to results without a miss;
``recall`` compares the two. Rows without a vector are in no list. Vectors are listed by direction, which suits unit vectors
and cosine; inner products of vectors of very different lengths need more probes, as the calibration does not see lengths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, run_table
from .vectors import _matrix, scoped_topk

SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
#: Vectors compared with all centroids at a time.
_SLICE = 1024
#: Rows that a batch of probes has at most (or one question's): each holds a vector.
_PROBED = 16_384
_STEPS = 12


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd steps on directions; the first distinct vectors are the start, and a centroid without vectors stays."""
    points = _unit(sample)
    points = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
    centres = points[:lists].copy()
    for _ in range(_STEPS):
        nearest = nearest_lists(points, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved = _unit(sums)
        held = np.bincount(nearest, minlength=len(centres)) > 0
        centres[held] = moved[held]
    return centres


def nearest_lists(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first; the lower number on ties."""
    found = []
    for low in range(0, len(points), _SLICE):
        scores = points[low: low + _SLICE] @ centres.T
        if n == 1:
            found.append(scores.argmax(axis=1)[:, None])
        else:
            found.append(np.argsort(-scores, axis=1, kind="stable")[:, :n])
    return np.concatenate(found) if found else np.zeros((0, n), np.int64)


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, share: float) -> int:
    """Lists to probe so that ``share`` of the ``k`` nearest neighbours of sampled vectors lie in them."""
    points = _unit(sample)
    asked = points[:: max(1, len(points) // 512)]
    neighbours = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :k]
    order = nearest_lists(asked, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    lists = nearest_lists(points, centres, 1)[:, 0]
    needed = np.sort(np.take_along_axis(place, lists[neighbours], axis=1).ravel())
    return int(needed[min(len(needed) - 1, ceil(share * len(needed)) - 1)]) + 1


def _probes(batch: pa.RecordBatch, centres: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Each question once for each of its ``n`` nearest lists. Lists grow with the vectors, so batches are cut by the rows they give."""
    step = max(1, _PROBED // n)
    for low in range(0, batch.num_rows, step):
        part = batch.slice(low, step)
        near = nearest_lists(_unit(_matrix(part["embedding"])), centres, n)
        each = pa.array(np.repeat(np.arange(part.num_rows), n))
        yield pa.record_batch({
            "query_id": part["query_id"].take(each), "k": part["k"].take(each),
            "embedding": part["embedding"].take(each), "document_id": pa.array(near.ravel().astype(str))})


@dataclass(frozen=True)
class VectorIndex:
    """``lists``: ``document_id`` (the list), chunk_id, chunk_seq (a place in the list), embedding."""

    centres: np.ndarray
    probes: int
    lists: DataFrame

    def search(self, queries: DataFrame, cosine: bool = True, probes: int | None = None) -> DataFrame:
        """Best k vectors of the probed lists for each question: query_id, chunk_id, score, rank."""
        centres, n = self.centres, min(probes or self.probes, len(self.centres))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _probes(batch, centres, n)

        asked = queries.filter("embedding IS NOT NULL").select(
            F.col("query_id").cast("bigint"), F.col("k").cast("int"), F.col("embedding").cast("array<double>"))
        if not n:
            return asked.sparkSession.createDataFrame([], "query_id bigint, chunk_id string, score double, rank int")
        probed = run_table(asked.mapInArrow(
            probe, "query_id bigint, k int, embedding array<double>, document_id string"), "probed")
        return scoped_topk(probed, self.lists, cosine)


def build_index(vectors: DataFrame, k: int = 10, share: float = 0.97) -> VectorIndex:
    """Index of ``vectors`` (chunk_id, embedding); ``k`` and ``share`` set how many lists a search probes."""
    points = run_table(vectors.filter("embedding IS NOT NULL").select(
        F.col("chunk_id").cast("string"), F.col("embedding").cast("array<double>")), "points")
    sample = _sample(points)
    lists = min(MAX_LISTS, max(1, ceil(sqrt(points.count()))))
    centres = fit_centroids(sample, lists) if len(sample) else np.zeros((0, 0))
    probes = probes_for(sample, centres, k, share) if len(sample) else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_lists(_unit(_matrix(batch["embedding"])), centres, 1)[:, 0]
                yield pa.record_batch({
                    "list": pa.array(near.astype(np.int32)), "chunk_id": batch["chunk_id"], "embedding": batch["embedding"]})

    listed = run_table(points.mapInArrow(assign, "list int, chunk_id string, embedding array<double>"), "listed")
    # One row for each list: at most MAX_LISTS.
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    placed = listed.join(F.broadcast(sizes), "list").select(
        F.col("list").cast("string").alias("document_id"), "chunk_id", F.pmod(F.xxhash64("chunk_id"), F.col("n")).alias("chunk_seq"),
        "embedding", F.pmod("list", F.lit(64)).alias("part"))
    place = f"{ensure_checkpoint_dir(points.sparkSession)}/index-{uuid.uuid4().hex}"
    placed.hint("rebalance", "part").write.partitionBy("part").mode("overwrite").parquet(place)
    stored = points.sparkSession.read.schema(placed.schema).parquet(place)
    return VectorIndex(centres, probes, stored.select("document_id", "chunk_id", "chunk_seq", "embedding"))


def _sample(points: DataFrame) -> np.ndarray:
    rows = points.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    return _matrix(rows["embedding"]) if rows.num_rows else np.zeros((0, 0))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, n_exact, n_found``: how many of the exact hits of a question were found."""
    both = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
