"""Inputs dealt out evenly, and searches of the whole corpus in few blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusgraph import session
from corpusgraph.operators import entities, graph, retrieval, vectors
from corpusgraph.plans import pipeline

from .conftest import SMALL


def test_one_row_group_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    path = str(tmp_path / "one")
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        got = session.spread(read)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2_000
        assert got.select(F.sum("id")).first()[0] == 20_000 * 19_999 // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _brute(queries, ks, points, cosine):
    hits = []
    for i, q in enumerate(queries):
        dots = points @ q
        if cosine:
            dots = dots / np.sqrt((q * q).sum() * (points * points).sum(axis=1))
        scores = np.floor(dots * 1e6 + 0.5) / 1e6
        hits += [(i, j, scores[j]) for j in np.lexsort((np.arange(len(points)), -scores))[: ks[i]]]
    return hits


def test_best_over_many_blocks_with_equal_vectors():
    rng = np.random.default_rng(3)
    distinct = rng.integers(0, 4, (40, 6)).astype(float) + 0.5
    for points in (rng.normal(size=(5000, 6)), distinct[rng.integers(0, 40, 5000)]):
        queries, ks = rng.normal(size=(300, 6)), rng.integers(1, 9, 300).astype(np.int32)
        for cosine in (True, False):
            rows, cols, scores = vectors._best(queries, ks, points, cosine)
            assert list(zip(rows.tolist(), cols.tolist(), scores.tolist())) == _brute(queries, ks, points, cosine)


def test_places_without_a_value_are_not_compared(monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.poisson(0.4, (5000, 64)).astype(float)
    queries = np.zeros((300, 64))
    for i in range(300):
        queries[i, (i % 4) * 16 + rng.integers(0, 16, 4)] = rng.integers(1, 3, 4)
    widths, products = [], vectors._products
    monkeypatch.setattr(vectors, "_products", lambda q, *rest: widths.append(q.shape[1]) or products(q, *rest))
    ks = rng.integers(1, 9, 300).astype(np.int32)
    for cosine in (True, False):
        rows, cols, scores = vectors._best(queries, ks, points, cosine)
        assert list(zip(rows.tolist(), cols.tolist(), scores.tolist())) == _brute(queries, ks, points, cosine)
    assert widths and max(widths) <= 64 and sum(widths) < 0.9 * 64 * len(widths)


def test_stored_tables_are_read_in_small_parts(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    before, path = spark.conf.get(key), str(tmp_path / "parts")
    spark.range(4000).repartition(60).write.parquet(path)
    try:
        spark.conf.unset(key)
        session.configure(spark)
        # A file counts as 4 MB at least.
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 15
        spark.conf.set(key, "64k")
        session.configure(spark)
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.set(key, before)


def test_a_vector_travels_once_for_many_questions(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 10)
    sent, search = [], vectors._search_groups
    monkeypatch.setattr(vectors, "_search_groups", lambda left, right, *rest: sent.append(right.count()) or search(left, right, *rest))
    vector = F.array(*[F.sin(F.col("id") * i) for i in range(1, 5)]).alias("embedding")
    asked = spark.range(5000).select(F.col("id").alias("query_id"), F.lit(3).alias("k"), vector)
    points = spark.range(300).select(F.col("id").cast("string").alias("chunk_id"), vector)
    assert vectors.corpus_topk(asked, points).count() == 15_000
    assert sent == [300]


def _is_stored(df) -> bool:
    """Rows are read from files as they are, with nothing to be grouped or joined first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(step in plan for step in ("Aggregate", "Join", "Window"))


def test_graph_tables_read_several_times_are_written(spark, monkeypatch):
    from corpusgraph.operators import graph
    from corpusgraph.plans.catalog import QUERIES
    from corpusgraph.sources.tables import GraphStore

    seen, communities, upsert = [], graph.communities, GraphStore.upsert
    monkeypatch.setattr(graph, "communities", lambda *tables: seen.extend(tables) or communities(*tables))
    monkeypatch.setattr(GraphStore, "upsert", lambda self, table, rows, documents=None: seen.append(rows) or upsert(self, table, rows, documents))
    QUERIES["communities"](spark, SMALL)
    assert len(seen) == 2
    QUERIES["stored_graph"](spark, SMALL)
    assert len(seen) > 7 and all(map(_is_stored, seen))


def test_small_parts_are_searched_together(monkeypatch):
    """A document of a few chunks costs no call of its own, and the hits are those of a comparison one by one."""
    rng = np.random.default_rng(4)
    asked, held = rng.integers(0, 3, (400, 16)).astype(np.float32), rng.integers(0, 3, (900, 16)).astype(np.float32)
    q_parts, v_parts, ks = rng.integers(0, 70, 400), rng.integers(0, 80, 900), rng.integers(1, 13, 400).astype(np.int32)
    ids = [f"c{i}" for i in rng.permutation(900)]
    queries = pa.table({"part": [f"p{p}" for p in q_parts], "query_id": np.arange(400), "k": ks, "embedding": list(asked)})
    found = pa.table({"v_part": [f"p{p}" for p in v_parts], "v_chunk_id": ids, "v_embedding": list(held)})

    def refuse(*_):
        raise AssertionError("a small part was searched alone")

    monkeypatch.setattr(vectors, "_best", refuse)
    got = vectors._search_group(True)(None, queries, found).to_pylist()
    want = []
    for i, part in enumerate(q_parts):
        mine = np.flatnonzero(v_parts == part)
        scores = vectors._scores(asked[i:i + 1].astype(float), held[mine].astype(float), True)[0]
        best = sorted(zip(-scores, (ids[m] for m in mine)))[:ks[i]]
        want += [(i, name, -score, int(ks[i])) for score, name in best]
    assert sorted(tuple(r.values()) for r in got) == sorted(want)


def test_few_long_rows_in_one_task_are_spread(spark):
    wanted = spark.sparkContext.defaultParallelism
    read = spark.range(0, 2000, 1, 1)
    for _ in range(wanted):
        read = read.unionByName(spark.range(0, 0, 1, 1))
    got = session.spread(read)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 2 * 2000 / wanted


def test_retrieval_writes_what_it_reads_again(spark):
    chunks = spark.createDataFrame(
        [(d, f"{d}{i}", i, f"Revenue was {i}0 in 200{i}.", "page_1", 1) for d in "ab" for i in range(5)],
        "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int")
    asked = spark.createDataFrame(
        [(1, "What was revenue in 2003?", "a"), (2, "Revenue", None)], "query_id bigint, query string, document_id string")
    r = pipeline.retrieve(asked, vectors.vector_rows(chunks), graph.build_graph(entities.extract_chunks(chunks)))
    for table in (r.questions, r.hits, r.nodes, r.edges):
        assert len(table.inputFiles()) and "Scan ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert {x.query_id for x in r.nodes.collect()} == {1, 2} and r.hits.filter("query_id = 1").count() == 5


def test_texts_of_a_chunk_written_twice_stay_twice(spark):
    rows = [("d", "c1", 1, "One text.", "s", 1), ("d", "c1", 1, "Other text.", "s", 1), ("d", "c2", 2, "Third.", "s", 2)]
    held = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int")
    hits = spark.createDataFrame([(1, 1, "c1"), (1, 2, None), (2, 1, "c2"), (2, 2, "c1")], "query_id bigint, rank int, chunk_id string")
    g = graph.GraphTables(held.filter("chunk_id = 'c2'"), None, spark.createDataFrame([("d", "c2", "d::x")], "document_id string, chunk_id string, graph_key string"), None)
    got = retrieval.context_chunks(hits, held, g)
    assert sorted((r.query_id, r.chunk_id or "", r.text or "", r.in_graph) for r in got.collect()) == [
        (1, "", "", False), (1, "c1", "One text.", False), (1, "c1", "Other text.", False),
        (2, "c1", "One text.", False), (2, "c1", "Other text.", False), (2, "c2", "Third.", True)]
