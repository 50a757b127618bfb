"""Ranks of text keys in groups of any size."""

from __future__ import annotations

import random

from corpusgraph.operators.ordering import with_text_rank


def test_ranks_of_one_large_group_are_spread(spark):
    rng = random.Random(1)
    rows = [("big", f"the same long start {i:05d}") for i in range(3000)] + [(f"g{i % 7}", f"{rng.random()}") for i in range(200)] + [("é", "z"), ("é", "Z"), (None, "n")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "name string, label string").repartition(5)
    ranked = with_text_rank(table, ["name"], "label", "rank")
    want = {}
    for name, label in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1].encode())):
        want.setdefault(name, []).append(label)
    got = {(r.name, r.label): r.rank for r in ranked.collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == {(n, l): i for n, ls in want.items() for i, l in enumerate(ls)}


def test_the_large_group_lies_in_several_parts(spark):
    rows = [("big", f"the same long start {i:05d}") for i in range(20_000)]
    spread = spark.createDataFrame(rows, "name string, label string").repartitionByRange(8, "name", "label")
    sizes = [r[0] for r in spread.selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
