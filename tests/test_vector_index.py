"""The inverted file over vectors against exact search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.operators import vector_index, vectors

SCHEMA = "chunk_id string, embedding array<float>"


def _points(rng, n, d, clusters):
    centres = rng.normal(size=(clusters, d))
    rows = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * 0.4
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("clusters", [12, 400])
def test_recall_and_exact_scores(spark, clusters):
    rng = np.random.default_rng(clusters)
    matrix = _points(rng, 1500, 24, clusters)
    # A third of all vectors are copies of one, so one list is hot.
    rows = [(f"c{i:05d}", [float(x) for x in v]) for i, v in enumerate(np.concatenate([matrix, np.repeat(matrix[:1], 700, axis=0)]))]
    table = spark.createDataFrame([*rows, ("none", None)], SCHEMA).repartition(4)
    asked = spark.createDataFrame([(i, 10, rows[i * 7][1]) for i in range(1, 120)] + [(999, 10, None)], "query_id bigint, k int, embedding array<float>")
    index = vector_index.build_index(table)
    assert index.lists.count() == len(rows) and 1 <= index.probes <= len(index.centres) == 47
    exact = vectors.corpus_topk(asked, table)
    found = index.search(asked)
    totals = vector_index.recall(found, exact).agg({"n_exact": "sum", "n_found": "sum"}).first()
    assert totals["sum(n_exact)"] == 1190 and totals["sum(n_found)"] >= 0.9 * 1190
    scores = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    got = found.collect()
    assert all(scores.get((r.query_id, r.chunk_id), r.score) == r.score for r in got)
    everything = index.search(asked, probes=len(index.centres))
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))


def test_index_of_few_vectors(spark):
    asked = spark.createDataFrame([(1, 3, [1.0, 0.0])], "query_id bigint, k int, embedding array<float>")
    assert vector_index.build_index(spark.createDataFrame([("a", None)], SCHEMA)).search(asked).count() == 0
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [0.0, 1.0])], SCHEMA)
    index = vector_index.build_index(few)
    assert [r.chunk_id for r in index.search(asked, probes=9).collect()] == ["a", "b", "c"]


def test_vectors_that_are_missing_are_passed_over(spark):
    points = spark.createDataFrame([("d", f"c{i}", i, [float(i), 1.0] if i % 3 else None) for i in range(9)],
                                   "document_id string, chunk_id string, chunk_seq bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, "d", 9, [1.0, 0.0]), (2, "d", 9, None)], "query_id bigint, document_id string, k int, embedding array<float>")
    want = [(1, f"c{i}", float(i)) for i in (8, 7, 5, 4, 2, 1)]
    for found in (vectors.corpus_topk(asked, points, cosine=False), vectors.scoped_topk(asked, points, cosine=False)):
        assert [(r.query_id, r.chunk_id, r.score) for r in found.orderBy("rank").collect()] == want


def test_probes_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(vector_index, "_PROBED", 200)
    rng = np.random.default_rng(1)
    centres, asked = rng.normal(size=(60, 4)), rng.normal(size=(500, 4))
    batch = pa.record_batch({"query_id": pa.array(range(500)), "k": pa.array([3] * 500, pa.int32()), "embedding": pa.array(asked.tolist())})
    parts = list(vector_index._probes(batch, centres, 45))
    assert max(p.num_rows for p in parts) <= 200
    whole = pa.Table.from_batches(parts)
    near = vector_index.nearest_lists(asked / np.linalg.norm(asked, axis=1, keepdims=True), centres, 45)
    assert whole["document_id"].to_pylist() == [str(x) for x in near.ravel()]
    assert whole["query_id"].to_pylist() == np.repeat(np.arange(500), 45).tolist()
    assert whole["embedding"].to_pylist() == np.repeat(asked, 45, axis=0).tolist()
