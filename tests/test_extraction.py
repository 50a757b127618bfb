from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import extraction
from corpusgraph.functions.extraction import extraction_of
from corpusgraph.functions.labels import canonical_label, relation_type_or_null
from corpusgraph.functions.text import is_section_header, normal_form, sentences, token_estimate
from corpusgraph.sources.responses import parse_responses

CASES = [
    ("Revenue was 80 in 2021 and increased to 100 in 2022. Costs were 50 in 2021.",
     ["2021:date", "2022:date", "revenue:metric", "cost:concept"],
     ["revenue>2021:HAS_VALUE", "revenue>2022:HAS_VALUE"]),
    ("CNN is used for image recognition. Transformers are used in NLP.", ["cnn:concept", "transformers:concept"], []),
    ("Revenue increased from 80 in 2021 to 100 in 2022. Costs were 50.",
     ["2021:date", "2022:date", "revenue:metric", "cost:concept"],
     ["revenue>2021:HAS_VALUE", "revenue>2022:HAS_VALUE"]),
    ("Machine learning is used for NLP. Transformers are popular.",
     ["machine learning:concept", "machine:concept", "transformers:concept"], []),
    ("Sales grew 20% in Q3.", ["revenue:metric"], []),
    ("AI drives innovation.", [], []),
    ("Cost fell from 2.5 million to 2 million.", ["2.5 million:number", "2 million:number", "cost:metric"],
     ["2.5 million>2 million:DECREASED_FROM"]),
    ("Die Straße ist lang. Été Paris.", ["die:concept", "paris:concept"], []),
]


@pytest.mark.parametrize("text,entities,relations", CASES)
def test_rules(spark, text, entities, relations):
    row = spark.createDataFrame([(text,)], "text string").select(F.inline(F.array(extraction_of("text")))).first()
    assert [f"{e.label}:{e.type}" for e in row.entities] == entities
    assert [f"{r['from']}>{r['to']}:{r['type']}" for r in row.relationships] == relations


def test_labels(spark):
    raw = ["  Net   Income ", "growth", "x", "a" * 65, "the long and winding road home", "Revenue...", "a, b" + "c" * 30, "Fy…"]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(canonical_label("raw").alias("l")).collect()
    assert [r.l for r in rows] == ["earnings", "", "", "", "", "revenue", "", "fiscal year"]


def test_relation_types(spark):
    raw = ["has value", "uses", "strongly related to it", "increase", "nonsense", "", None, "used-for"]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(relation_type_or_null("raw").alias("t")).collect()
    assert [r.t for r in rows] == ["HAS_VALUE", "USED_FOR", "RELATED_TO", "INCREASED_FROM", None, None, None, "USED_FOR"]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("A b. C!  d? e",), ("REVENUE 2020",), ("# title",), ("x" * 130,), ("3.1 Results",), ("plain words",)], "t string"
    )
    rows = df.select(sentences("t").alias("s"), is_section_header("t").alias("h"), token_estimate("t").alias("n")).collect()
    assert rows[0].s == ["A b.", "C!", "d?", "e"]
    assert [r.h for r in rows] == [False, True, True, False, True, False]
    assert rows[3].n == 32 and rows[2].n == 1
    form = spark.createDataFrame([("  Up 5 Million, or 3 bn (20%)!",)], "t string").select(normal_form("t").alias("f")).first().f
    assert form == "up 5m or 3b 20"


def test_responses(spark):
    raw = [
        '```json\n{"entities":[{"label":"Net Income","type":"metric"},{"text":"AI"}],"relationships":[{"from":"a","to":"b","type":"uses"}]}\n```',
        'so: {"entities":["Foo bar","zed"]} end', "no json", "{broken", None,
    ]
    rows = parse_responses(spark.createDataFrame([(r,) for r in raw], "response string")).collect()
    assert [[(e.label, e.type) for e in r.entities] for r in rows] == [
        [("earnings", "metric"), ("ai", "concept")], [("foo bar", "concept"), ("zed", "concept")], [], [], [],
    ]
    assert [len(r.relationships) for r in rows] == [1, 0, 0, 0, 0]


def test_both_sentence_rules_look_for_finance_terms_once(spark, monkeypatch):
    asked, find = [], extraction.find_words
    monkeypatch.setattr(extraction, "find_words", lambda low, pattern, group: asked.append(pattern) or find(low, pattern, group))
    extraction.relations_of(F.lit("x"), F.lit(None).cast("array<struct<label:string,type:string>>"))
    assert asked.count(extraction.FINANCE_TERM) == 1
