from __future__ import annotations

import corpus_pipeline
from corpusgraph.llm import decontaminate

from ..conftest import SMALL
from . import brute
from .test_operators import _rows, _sorted

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _docs(spark, rows, more=""):
    return spark.createDataFrame([(d, t, "en", None, len(t or ""), *([1] if more else [])) for d, t in rows], COLUMNS + more).repartition(3)


def test_stages_against_brute_force(spark):
    rows = _rows()
    docs = _docs(spark, rows, ", __row int")
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert kept.columns == docs.columns
    passed = {(d, t) for d, t in rows if (s := brute.statistics(t))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} <= passed

    lines = corpus_pipeline.line_dedup(spark, docs, SMALL)
    assert lines.columns == docs.columns
    assert _sorted((r["doc_id"], brute.sha(r["text"])) for r in lines.collect()) == _sorted((x[0], x[3]) for x in brute.lines(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = corpus_pipeline.near_dedup(spark, docs, SMALL)
    stays = {d for d, _, c in brute.components(rows, 5) if d == c}
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == stays

    clean = corpus_pipeline.decontamination(spark, docs, SMALL)
    hit = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - hit

    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    some = _docs(spark, [(None, "clean words of no item"), (None, item), (5, item), (5, "clean row of the same id")])
    assert {r["text"] for r in corpus_pipeline.decontamination(spark, some, SMALL).collect()} == {"clean words of no item", "clean row of the same id"}

    packed = corpus_pipeline.packing(spark, docs, SMALL)
    assert packed.count() >= len(rows)


def test_empty_input(spark):
    docs = _docs(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_the_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and len(corpus_pipeline.STAGES) == 5
