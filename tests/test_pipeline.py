"""Stored tables, ingest by batch and by stream, and answers end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions.similarity import HashedCounts
from corpusgraph.operators import entities, graph, retrieval, vectors
from corpusgraph.options import Options
from corpusgraph.plans import corpora, pipeline
from corpusgraph.sources.tables import GraphStore
from corpusgraph.sources.units import line_units
from corpusgraph.streaming import feed
from corpusgraph.streaming.ingest import ingest_stream
from corpusgraph.streaming.runs import run_available

from .conftest import SMALL

DOCS = [
    (1, "Revenue rose from 1996 to 1997.\nLSTM is used for forecast."),
    (2, "Cost fell from 5 million to 4 million in 2020.\nBudget was set."),
    (3, "Nothing to see."),
]
OPTS = Options(similarity_threshold=0.0, coherence_min=0.0)


def rows(store, table):
    return sorted(map(tuple, store.load(table).collect()), key=repr)


def test_ingest_is_repeatable_and_deletes_whole_documents(spark):
    store = GraphStore(spark, prefix="batch", buckets=4).create()
    units = line_units(spark.createDataFrame(DOCS, "doc_id bigint, text string"), "doc_id", "text")
    pipeline.ingest_documents(units, store, OPTS)
    before = {t: rows(store, t) for t in ("chunks", "entities", "mentions", "relationships", "vectors")}
    assert len(before["chunks"]) == 3 and len(before["vectors"]) == 3 and before["relationships"]
    pipeline.ingest_documents(units.filter("document_id = '2'"), store, OPTS)
    assert {t: rows(store, t) for t in before} == before
    store.delete_document("2")
    assert {r[0] for t in before for r in rows(store, t)} == {"1", "3"}
    assert store.load("chunks", "1").count() == 1
    answers = pipeline.answer_questions(
        spark.createDataFrame([(1, "What is LSTM used for?", None)], "query_id bigint, query string, document_id string"),
        store.load("vectors"), pipeline.stored_graph(store), OPTS,
    ).first()
    assert "LSTM" in answers.prompt and answers.citations[0].graph_entities and 0.2 <= answers.confidence <= 1
    store.delete_all()
    assert all(not rows(store, t) for t in before)


def test_stream_ingest_equals_batch(spark, tmp_path):
    frame = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    for i in range(3):
        frame.filter(F.col("doc_id") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    streamed, batch = (GraphStore(spark, prefix=p, buckets=4).create() for p in ("streamed", "whole"))
    ingest_stream(stream, streamed, str(tmp_path / "state"), OPTS).awaitTermination()
    pipeline.ingest_documents(line_units(frame, "doc_id", "text"), batch, OPTS)
    for table in ("chunks", "entities", "mentions", "relationships", "vectors"):
        assert rows(streamed, table) == rows(batch, table)


def test_streamed_changes_over_many_batches(spark, tmp_path):
    events = corpora.feed(spark, SMALL).select("session_id", "seq", F.col("type").alias("state"))
    for lower in range(0, 1000, 250):
        events.filter(F.col("seq").between(lower, lower + 249)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: spark.read.parquet(str(p)).agg(F.min("seq")).first()[0])
    for age, path in enumerate(files):
        import os

        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_available(feed.changes_only_stream(stream), "append")
    want = feed.changes_only(events)
    assert sorted(map(tuple, got.collect())) == sorted((r.session_id, r.seq, r.state) for r in want.collect())


def test_vector_search_paths_agree(spark, monkeypatch):
    """Searching in place, in blocks, and by document shards give the same hits."""
    asked = corpora.table(spark, SMALL, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.lit("d").alias("document_id"), F.lit(4).alias("k"), "embedding"
    )
    points = asked.select("document_id", F.col("query_id").cast("string").alias("chunk_id"), F.col("query_id").alias("chunk_seq"), "embedding")
    want = sorted(map(tuple, vectors.corpus_topk(asked, points, cosine=False).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 64)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 64)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 100)
    assert sorted(map(tuple, vectors.corpus_topk(asked, points, cosine=False).collect())) == want
    assert sorted(map(tuple, vectors.scoped_topk(asked, points, cosine=False).collect())) == want


def test_keyword_hits_equal_plain_substring_test(spark):
    questions = retrieval.prepare_questions(corpora.questions(spark, SMALL))
    table = corpora.fact_vectors(spark, SMALL)
    got = {(r.query_id, r.chunk_id) for r in retrieval.keyword_hits(questions, table).collect()}
    plain = questions.filter("document_id is not null").join(table, "document_id").filter(
        retrieval.holds_all(F.col("text"), F.col("terms"))
    )
    assert got == {(r.query_id, r.chunk_id) for r in plain.collect()}


def test_scans_read_only_what_they_need(spark):
    plan = graph.chunks_per_document(corpora.fact_chunks(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_hashed_vectors_are_counts(spark):
    row = spark.createDataFrame([("a b a",)], "text string").select(HashedCounts(16).vector("text").alias("v")).first()
    assert sum(row.v) == 3 and max(row.v) == 2


def test_any_keywords_and_more_than_the_usual_number_of_hits(spark):
    rows = [("d", f"c{i:02d}", i, f"Some Widgets and gadgets number {i}") for i in range(30)] + [("d", "x", 99, "gadgets alone")]
    vectors = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_seq bigint, text string")
    asked = spark.createDataFrame(
        [(1, "d", ["widgets", " GADGETS "], 20), (2, "d", ["widgets", "absent"], 20), (3, "d", ["a", ""], 20), (4, "d", ["gadgets", "widgets"], 3)],
        "query_id bigint, document_id string, terms array<string>, k int")
    got = {}
    for r in retrieval.keyword_hits(asked, vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [f"c{i:02d}" for i in range(20)], 4: ["c00", "c01", "c02"]}


def test_rules_run_on_tagged_labels(spark):
    chunks = spark.createDataFrame(
        [("d", "c1", 1, "Traffic rose from north gate to south gate."), ("d", "c2", 2, "nothing")],
        "document_id string, chunk_id string, chunk_seq bigint, text string")
    tags = spark.createDataFrame(
        [("c1", 1, "north gate", "FAC"), ("c1", 2, "south gate", "FAC")], "chunk_id string, tag_seq int, text string, tag string")
    found = {r.chunk_id: r for r in entities.extract_tagged(chunks, tags).collect()}
    assert [(r["from"], r["to"], r["type"]) for r in found["c1"].relationships] == [("north gate", "south gate", "INCREASED_FROM")]
    plain = {r.chunk_id: r for r in entities.extract_chunks(chunks).collect()}
    assert plain["c1"].relationships == [] and plain["c1"].confidence < found["c1"].confidence


def test_relations_are_cut_down_before_they_are_counted(spark):
    nodes = spark.createDataFrame([(1, "d", "a", "a", None), (1, "d", "b", "b", None)], "query_id bigint, document_id string, graph_key string, name string, scope string")
    relations = spark.createDataFrame([("d", "a", "b", "X"), ("d", "a", "z", "X")], "document_id string, from_key string, to_key string, rel_type string")
    edges = retrieval.induced_edges(nodes, graph.GraphTables(None, None, None, relations))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Aggregate [graph_key"):].count("LeftSemi") >= 2
    assert [(r.source, r.target) for r in edges.collect()] == [("a", "b")]
