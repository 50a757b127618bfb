"""k-means of many documents at once: each document's points are clustered by themselves, all documents in the same steps.

A document of at most ``SHARD_POINTS`` points takes all its steps in one task, where its points are shuffled to once, together with
other documents. Only larger ones take theirs as jobs of their own, as follows.

A step has two grouped parts. Points meet the centroids of their document in groups of at most about ``SHARD_POINTS`` points,
so a document of any size is spread over tasks; each group gives its points' nearest centroids, or sums by cluster. The sums of
all groups make the new centroids, ``k`` rows a document. Nothing of a document as a whole is in one task but its centroids.

Seeds are fixed: the document's first ``k`` distinct vectors in the order of a hash. A document with fewer distinct vectors has
as many clusters. A cluster that loses its points takes over the point that lies farthest from its centroid (the first by key
on ties). Steps end when no point changes its cluster, or after ``iterations``; then points are assigned once more, so
that each lies in the cluster nearest to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import run_table
from .skew import salted_join
from .vectors import _matrix, _rows_by_part

SHARD_POINTS = 8192
_ASSIGNED = "document_id string, graph_key string, cluster int, distance double"
_SUMS = "document_id string, cluster int, place int, total double, n bigint"
_SETTLED = f"{_ASSIGNED}, centre array<double>"


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the lower number on ties at nine digits) and the squared distance."""
    own = (centres * centres).sum(axis=1)
    found, distances = [], []
    for low in range(0, len(points), 1024):
        part = points[low: low + 1024]
        squared = np.round((part * part).sum(axis=1)[:, None] + own[None, :] - 2 * (part @ centres.T), 9)
        best = squared.argmin(axis=1)
        found.append(best)
        distances.append(np.maximum(squared[np.arange(len(part)), best], 0.0))
    return np.concatenate(found), np.concatenate(distances)


def _step(sums: bool):
    """Work of one group: parts of many documents, each with the centroids of its own."""
    def work(key, points: pa.Table, centres: pa.Table) -> pa.Table:
        if not points.num_rows or not centres.num_rows:
            return _arrow(sums).empty_table()
        names = pa.chunked_array([*points["part"].chunks, *centres["c_part"].chunks]).combine_chunks()
        codes = names.dictionary_encode().indices.to_numpy()
        of_points, of_centres = _rows_by_part(codes[: points.num_rows]), _rows_by_part(codes[points.num_rows:])
        matrix, centre, cluster = _matrix(points["embedding"]), _matrix(centres["centre"]), centres["cluster"].to_numpy()
        nearest, distance = np.zeros(len(matrix), np.int32), np.zeros(len(matrix))
        found = []
        for part, rows in of_points.items():
            own = of_centres[part][np.argsort(cluster[of_centres[part]], kind="stable")]
            at, distance[rows] = _nearest(matrix[rows], centre[own])
            nearest[rows] = cluster[own][at]
            if sums:
                held, code = np.unique(at, return_inverse=True)
                total = np.zeros((len(held), matrix.shape[1]))
                np.add.at(total, code, matrix[rows])
                found.append((rows[0], cluster[own][held], total, np.bincount(code)))
        if not sums:
            return pa.table([points["document_id"], points["graph_key"], pa.array(nearest), pa.array(distance)], schema=_arrow(False))
        d = matrix.shape[1]
        first = np.concatenate([np.repeat(f[0], f[2].size) for f in found])
        return pa.table([
            points["document_id"].take(pa.array(first)), pa.array(np.concatenate([np.repeat(f[1], d) for f in found]), pa.int32()),
            pa.array(np.concatenate([np.tile(np.arange(d), len(f[1])) for f in found]), pa.int32()),
            pa.array(np.concatenate([f[2].ravel() for f in found])), pa.array(np.concatenate([np.repeat(f[3], d) for f in found]), pa.int64())],
            schema=_arrow(True))

    return work


def _arrow(sums: bool) -> pa.Schema:
    if sums:
        return pa.schema([("document_id", pa.string()), ("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])
    return pa.schema([("document_id", pa.string()), ("graph_key", pa.string()), ("cluster", pa.int32()), ("distance", pa.float64())])


def _settle(points: np.ndarray, hashes: np.ndarray, k: int, iterations: int):
    """All steps of one document, its points in the order of their keys: cluster and distance of each point, and the centroids."""
    order = np.lexsort((*points.T[::-1], hashes))
    new = np.ones(len(order), bool)
    new[1:] = (points[order[1:]] != points[order[:-1]]).any(axis=1)
    centres = points[order[new][:k]]
    numbers, before = np.arange(len(centres)), None
    for _ in range(iterations):
        at, distance = _nearest(points, centres)
        sizes = np.bincount(at, minlength=len(centres))
        lost, now = np.flatnonzero(sizes == 0), numbers[at]
        if before is not None and not len(lost) and (now == before).all():
            return now, distance, numbers, centres
        before = now
        totals = np.zeros_like(centres)
        np.add.at(totals, at, points)
        held = sizes > 0
        moved = totals / np.maximum(sizes, 1)[:, None]
        if len(lost):
            far = np.argsort(-distance, kind="stable")[: len(lost)]
            far = far[distance[far] > 0]
            moved[lost[: len(far)]] = points[far]
            held[lost[: len(far)]] = True
        numbers, centres = numbers[held], moved[held]
    at, distance = _nearest(points, centres)
    return numbers[at], distance, numbers, centres


def _settle_group(k: int, iterations: int):
    """All documents of one group, each by itself; centroids are rows without a key."""
    schema = pa.schema([*_arrow(False), ("centre", pa.list_(pa.float64()))])

    def work(points: pa.Table) -> pa.Table:
        points = points.sort_by([("document_id", "ascending"), ("graph_key", "ascending")])
        names = points["document_id"].combine_chunks().dictionary_encode()
        matrix, hashes = _matrix(points["embedding"]), points["hash"].to_numpy()
        cluster, distance = np.zeros(len(matrix), np.int32), np.zeros(len(matrix))
        of, numbers, centres = [], [], []
        for code, rows in _rows_by_part(names.indices.to_numpy()).items():
            cluster[rows], distance[rows], own, found = _settle(matrix[rows], hashes[rows], k, iterations)
            of.append(np.full(len(own), code))
            numbers.append(own)
            centres.append(found)
        assigned = pa.table([
            points["document_id"], points["graph_key"], pa.array(cluster), pa.array(distance), pa.nulls(len(matrix), pa.list_(pa.float64()))],
            schema=schema)
        made = np.concatenate(centres)
        ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.int32())
        return pa.concat_tables([assigned, pa.table([
            names.dictionary.take(pa.array(np.concatenate(of))), pa.nulls(len(made), pa.string()),
            pa.array(np.concatenate(numbers).astype(np.int32)), pa.nulls(len(made), pa.float64()),
            pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], schema=schema)])

    return work


def _settled(points: DataFrame, n_points: int, k: int, iterations: int) -> DataFrame:
    """Documents that fit into a task: each goes to one group whole, and a group has about ``SHARD_POINTS`` points."""
    groups = max(points.sparkSession.sparkContext.defaultParallelism, -(-n_points // SHARD_POINTS))
    ready = points.select(
        F.pmod(F.xxhash64("document_id"), F.lit(groups)).alias("group"), "document_id", "graph_key", "embedding",
        F.xxhash64("embedding").alias("hash"))
    return run_table(ready.groupBy("group").applyInArrow(_settle_group(k, iterations), _SETTLED), "settled")


def _meet(points: DataFrame, centres: DataFrame, groups: int, sums: bool) -> DataFrame:
    """Parts of documents against the centroids of their document. Small parts share a task's group."""
    part = F.concat_ws("#", F.col("shard").cast("string"), "document_id")
    group = F.pmod(F.xxhash64("document_id", "shard"), F.lit(groups))
    left = points.select(group.alias("group"), part.alias("part"), "document_id", "graph_key", "embedding")
    # Both sides come from one table, so their columns get different names.
    right = points.select("document_id", "shard").distinct().join(centres, "document_id").select(
        group.alias("c_group"), part.alias("c_part"), "cluster", "centre")
    return left.groupBy("group").cogroup(right.groupBy("c_group")).applyInArrow(_step(sums), _SUMS if sums else _ASSIGNED)


def cluster_by_document(points: DataFrame, k: int, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """``points``: document_id, graph_key (unique in its document), embedding. Gives ``document_id, graph_key, cluster, distance``
    (squared) of each point, and ``document_id, cluster, centre``."""
    sizes = points.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    shards = F.ceil(F.col("n") / SHARD_POINTS)
    placed = run_table(salted_join(points, sizes.withColumn("rows", F.col("n")), ["document_id"], ["graph_key"], rows="rows").select(
        "document_id", "graph_key", vector.alias("embedding"), F.pmod(F.xxhash64("graph_key"), shards).alias("shard"),
        (shards > 1).alias("large")), "points")
    counts = {r["large"]: r["count"] for r in placed.groupBy("large").count().collect()}
    settled = _settled(placed.filter("NOT large"), counts.get(False, 0), k, iterations)
    assigned = settled.filter("graph_key IS NOT NULL").select("document_id", "graph_key", "cluster", "distance")
    centres = settled.filter("graph_key IS NULL").select("document_id", "cluster", "centre")
    if counts.get(True):
        others = _cluster_large(placed.filter("large").drop("large"), counts[True], k, iterations)
        assigned, centres = assigned.unionByName(others[0]), centres.unionByName(others[1])
    return assigned, centres


def _cluster_large(placed: DataFrame, n_points: int, k: int, iterations: int) -> tuple[DataFrame, DataFrame]:
    """The same for documents of many shards, a step of all of them after the other."""
    groups = max(placed.sparkSession.sparkContext.defaultParallelism, -(-n_points // SHARD_POINTS))
    order = W.partitionBy("document_id").orderBy(F.xxhash64("embedding"), "embedding")
    seeds = placed.select("document_id", "embedding").distinct().withColumn("cluster", F.row_number().over(order) - 1).filter(F.col("cluster") < k)
    centres = run_table(seeds.select("document_id", "cluster", F.col("embedding").alias("centre")), "centres")
    before = None
    for _ in range(iterations):
        assigned = run_table(_meet(placed, centres, groups, sums=False), "assigned")
        lost = centres.join(assigned, ["document_id", "cluster"], "left_anti")
        some_lost = not lost.isEmpty()
        if before is not None and not some_lost:
            moved = assigned.join(before, ["document_id", "graph_key"]).filter(F.col("cluster") != F.col("was"))
            if moved.isEmpty():
                break
        before = assigned.select("document_id", "graph_key", F.col("cluster").alias("was"))
        sums = _meet(placed, centres, groups, sums=True).groupBy("document_id", "cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        held = sums.groupBy("document_id", "cluster").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("place", (F.col("total") / F.col("n")).alias("mean")))), lambda x: x["mean"]).alias("centre"))
        if some_lost:
            by_distance = W.partitionBy("document_id").orderBy(F.desc("distance"), "graph_key")
            vacant = lost.select("document_id", "cluster").withColumn("at", F.row_number().over(W.partitionBy("document_id").orderBy("cluster")))
            most = lost.groupBy("document_id").agg(F.count(F.lit(1)).alias("wanted"))
            far = assigned.filter("distance > 0").join(most, "document_id").withColumn("at", F.row_number().over(by_distance)).filter(F.col("at") <= k).filter("at <= wanted")
            taken = vacant.join(far.select("document_id", "at", "graph_key"), ["document_id", "at"]).join(placed, ["document_id", "graph_key"])
            held = held.unionByName(taken.select("document_id", "cluster", F.col("embedding").alias("centre")))
        centres = run_table(held, "centres")
    assigned = run_table(_meet(placed, centres, groups, sums=False), "assigned")
    return assigned, centres
