"""Heavy keys: the salted join gives the same rows, and hot groups do not change results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import entities, skew
from corpusgraph.operators.components import connected_components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 50)
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 30).alias("key"))
    small = spark.range(20).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    got = skew.salted_join(big, small, ["key"], ["id"], how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, big.join(small, ["key"], how).select(*got.columns).collect()))


def test_heavy_text_and_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    rows = [(f"d{i % 7}", f"c{i}", i, "Nothing here." if i % 3 else f"Revenue grew in 20{i % 90 + 10}.", "p", 1) for i in range(300)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int")
    columns = ["chunk_id", "entities", "relationships", "confidence"]
    once, plain = entities.extract_once(chunks), entities.extract_chunks(chunks)
    assert sorted(map(repr, once.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))
    assert once.filter("not reused").count() == len({r[3] for r in rows})
    hub = [(0, i) for i in range(1, 300)] + [(500, 501)]
    found = connected_components(spark.createDataFrame(hub, "a bigint, b bigint"), "a", "b")
    assert {r.component: r["count"] for r in found.groupBy("component").count().collect()} == {0: 300, 500: 2}
