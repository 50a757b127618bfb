from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusgraph.operators import entities, graph, ordering, selection
from corpusgraph.operators.components import connected_components
from corpusgraph.options import Options
from corpusgraph.plans import corpora

from .conftest import SMALL

CHUNKS = "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int"
SAMPLE = [
    ("A", "a1", 0, "Revenue was 80 in 2021 and increased to 100 in 2022. Costs were 50 in 2021.", "page_1", 1),
    ("A", "a2", 1, "CNN is used for image recognition. Transformers are used in NLP.", "page_2", 2),
    ("B", "b1", 0, "Revenue increased from 80 in 2021 to 100 in 2022. Costs were 50.", "page_1", 1),
    ("B", "b2", 1, "Nothing.", "page_2", 2),
]


def built(spark):
    extracted = entities.extract_chunks(spark.createDataFrame(SAMPLE, CHUNKS))
    return graph.build_graph(extracted)


def test_graph_tables(spark):
    g = built(spark)
    assert g.chunks.count() == 4
    keys = {r.graph_key for r in g.entities.collect()}
    assert {"A::revenue", "A::cnn", "A::cost", "B::2022", "B::nothing"} <= keys
    assert {(r.from_key, r.to_key, r.rel_type) for r in g.relationships.collect()} == {
        (f"{d}::revenue", f"{d}::{y}", "HAS_VALUE") for d in "AB" for y in (2021, 2022)
    }
    ids = {r.graph_key: r.community_id for r in g.entities.collect()}
    assert ids["A::2021"] == ids["A::2022"] == ids["A::revenue"] == 0
    assert sorted(v for k, v in ids.items() if k.startswith("A")) == [0, 0, 0, 1, 2, 3]
    totals = graph.graph_totals(g).first()
    assert totals.chunks == 4 and totals.relationships == 4


def test_ends_from_responses_become_entities(spark):
    found = entities.extract_chunks(spark.createDataFrame(SAMPLE[3:], CHUNKS))
    answer = '{"entities": [], "relationships": [{"from": "Nothing", "to": "Outer Space", "type": "relates"}]}'
    responses = spark.createDataFrame([("x", answer)], "chunk_hash string, response string").withColumn(
        "chunk_hash", entities.text_hash(F.lit("Nothing."))
    )
    merged = entities.merge_responses(found, responses)
    assert merged.first().used_response
    g = graph.build_graph(merged, with_communities=False)
    assert {r.graph_key: r.entity_type for r in g.entities.collect()} == {"B::nothing": "concept", "B::outer space": "concept"}


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[i] for i in range(301)} == {0}
    assert {got[1000 + i] for i in range(400)} == {1000}
    assert {got[i] for i in (2000, 2001, 2002)} == {2000}


def test_positions_and_neighbours_over_ranges(spark):
    rng = random.Random(2)
    rows = [(g, s) for g in "ab" for s in rng.sample(range(1000), 100)]
    df = spark.createDataFrame(rows, "g string, s bigint")
    want = {}
    for g in "ab":
        ordered = sorted(s for x, s in rows if x == g)
        for i, s in enumerate(ordered):
            want[g, s] = (i + 1, 100 - i, ordered[i - 1] if i else None, ordered[i + 1] if i < 99 else None, sum(ordered[:i]))
    out = ordering.with_position(df, ["g"], "s", "up", width=16)
    out = ordering.with_position(out, ["g"], "s", "down", descending=True, width=16)
    out = ordering.with_neighbour(out, ["g"], "s", F.col("s"), "before", width=16)
    out = ordering.with_neighbour(out, ["g"], "s", F.col("s"), "after", following=True, width=16)
    out = ordering.with_offset(out, ["g"], "s", "s", "total", width=16)
    assert {(r.g, r.s): (r.up, r.down, r.before, r.after, r.total) for r in out.collect()} == want


def test_clustered_entities_keep_all_when_few(spark):
    found = entities.extract_chunks(spark.createDataFrame(SAMPLE, CHUNKS))
    scores = selection.entity_scores(entities.mention_rows(found), entities.relation_rows(found))
    assert selection.clustered_entities(scores, Options(max_entities=100)).count() == scores.count()
    few = selection.clustered_entities(scores, Options(max_entities=3))
    by_document = {r.document_id: r.n for r in few.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(by_document) == {r[0] for r in scores.select("document_id").distinct().collect()}
    assert all(1 <= n <= 3 for n in by_document.values())


def test_links_and_nodes_are_made_from_written_tables(spark):
    extracted = entities.extract_chunks(spark.createDataFrame(SAMPLE, CHUNKS))
    edges = graph.relation_edges(entities.relation_rows(extracted)).limit(0)
    g = graph.build_graph(extracted, with_communities=False, edges=edges)
    assert g.relationships.count() == 0 and g.entities.count() == entities.mention_rows(extracted).select("document_id", "graph_key").distinct().count()
    read = {f.rsplit("/", 2)[1].split("-")[0] for f in corpora.linked_facts(spark, SMALL).mentions.inputFiles()}
    assert read == {"mentions"}
