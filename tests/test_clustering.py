"""Clusters of many documents at once, against plain steps on each document."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import clustering, selection
from corpusgraph.options import Options

POINTS = "document_id string, graph_key string, embedding array<float>"


def _rows(rng):
    rows = []
    for doc, n in (("a", 3), ("b", 40), ("c", 300)):
        centres = rng.normal(size=(6, 5)) * 4
        for i in range(n):
            v = centres[rng.integers(6)] + rng.normal(size=5) * 0.3 if doc != "b" or i % 4 else np.ones(5)
            rows.append((doc, f"{doc}{i:03d}", [float(x) for x in v]))
    return rows


@pytest.mark.parametrize("shard", [8192, 50])
def test_every_document_is_clustered_by_itself(spark, monkeypatch, shard):
    monkeypatch.setattr(clustering, "SHARD_POINTS", shard)
    rows = _rows(np.random.default_rng(3))
    assigned, centres = clustering.cluster_by_document(spark.createDataFrame(rows, POINTS).repartition(4), 7)
    held = {}
    for r in centres.collect():
        held.setdefault(r.document_id, {})[r.cluster] = np.array(r.centre)
    found = {(r.document_id, r.graph_key): (r.cluster, r.distance) for r in assigned.collect()}
    assert len(found) == len(rows)
    sums = {}
    for doc, key, v in rows:
        far = {c: float(((np.array(v, np.float32).astype(float) - m) ** 2).sum()) for c, m in held[doc].items()}
        cluster, distance = found[doc, key]
        assert distance == pytest.approx(min(far.values()), abs=1e-6) and far[cluster] == pytest.approx(min(far.values()), abs=1e-6)
        sums.setdefault((doc, cluster), []).append(v)
    assert {d: len(c) for d, c in held.items()} == {"a": 3, "b": 7, "c": 7}
    assert {d: len({c for e, c in sums if e == d}) for d in held} == {"a": 3, "b": 7, "c": 7}  # none is empty
    for (doc, cluster), own in sums.items():  # settled: each centroid is the mean of its points
        assert np.allclose(np.mean(np.array(own, np.float32).astype(float), axis=0), held[doc][cluster], atol=1e-5)


def test_small_documents_take_all_steps_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [*_rows(rng), *[("d", f"d{i}", [float(i % 3)] * 5) for i in range(30)]]
    # Repeated words of few places: equal points, equal distances, and clusters that lose their points.
    rows += [("e", f"e{i:02d}", [float(x) for x in rng.integers(0, 2, 5) * rng.integers(1, 3)]) for i in range(60)]
    points = spark.createDataFrame(rows, POINTS).repartition(4)

    def clusters():
        assigned, centres = clustering.cluster_by_document(points, 7)
        return (sorted((r.document_id, r.graph_key, r.cluster, round(r.distance, 6)) for r in assigned.collect()),
                sorted((r.document_id, r.cluster, [round(x, 6) + 0.0 for x in r.centre]) for r in centres.collect()))

    with monkeypatch.context() as m:
        m.setattr(clustering, "SHARD_POINTS", 2)
        by_steps = clusters()
    monkeypatch.setattr(clustering, "_meet", None)
    assert clusters() == by_steps


def test_best_of_each_cluster(spark):
    words = ["net income", "gross income", "income net", "margin", "margin rate", "cash", "cash flow", "flow", "debt", "debt", "loan"]
    rows = [(d, f"{d}::{i}", w, float((i * 7) % 5)) for d, n in (("d1", 11), ("d2", 4), ("d3", 6)) for i, w in enumerate(words[:n])]
    scores = spark.createDataFrame(rows, "document_id string, graph_key string, name string, score double")
    kept = {}
    for r in selection.clustered_entities(scores, Options(max_entities=4)).collect():
        kept.setdefault(r.document_id, []).append(r)
    assert {d: len(v) for d, v in kept.items()} == {"d1": 4, "d2": 4, "d3": 4}
    assert all(r.cluster is None for r in kept["d2"]) and sorted(r.cluster for r in kept["d1"]) == [0, 1, 2, 3]
    same = selection.clustered_entities(scores.repartition(7), Options(max_entities=4))
    assert sorted(map(tuple, same.collect()), key=repr) == sorted((tuple(r) for v in kept.values() for r in v), key=repr)
    assert selection.clustered_entities(scores.filter(F.lit(False)), Options(max_entities=4)).count() == 0
