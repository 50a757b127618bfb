"""Block packing against a plain walk, and the effects of the splitting rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import chunking
from corpusgraph.options import Options

UNITS = "document_id string, unit_seq bigint, page int, source string, type string, text string"


def walk(items, limit):
    blocks, current, total, page_before = [], [], 0, None
    for seq, page, header, tokens in items:
        if current and (page != page_before or header or total + tokens > limit):
            blocks.append(current)
            current, total = [], 0
        current.append(seq)
        total += tokens
        page_before = page
    return {b[0]: len(b) for b in [*blocks, current] if b}


@pytest.mark.parametrize("pages,sparse", [(0.0, False), (0.05, False), (0.001, True)])
def test_blocks_over_many_ranges(spark, pages, sparse):
    rng = random.Random(7)
    rows, want = [], {}
    for doc, n in enumerate([3, 700, 2600]):
        seq, page, items = 0, 1, []
        for _ in range(n):
            seq += rng.choice([1, 2, 300]) if sparse else 1
            page += rng.random() < pages
            header = rng.random() < 0.005
            text = "1 head" if header else "x" * rng.choice([3, 20, 80, 400, 1700])
            rows.append((str(doc), seq, page, "s", "text", text))
            items.append((seq, page, header, max(1, len(text) // 4)))
        want[str(doc)] = walk(items, 400)
    units = spark.createDataFrame(rows, UNITS).repartition(5)
    got = {}
    for r in chunking.structural_blocks(units).collect():
        got.setdefault(r.document_id, {})[r.block_seq] = r.n_units
    assert got == want


def test_block_order_and_first_values(spark):
    rows = [("d", i, 1 + i // 2, f"p{i}", "text", f"unit {i}") for i in range(4)]
    blocks = chunking.structural_blocks(spark.createDataFrame(rows, UNITS)).orderBy("block_seq").collect()
    assert [(b.text, b.source, b.page) for b in blocks] == [("unit 0\n\nunit 1", "p0", 1), ("unit 2\n\nunit 3", "p2", 2)]


def pieces(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("p")).first().p


def test_semantic_cut(spark):
    text = "red fox runs. red fox sleeps. blue sky above."
    got = pieces(spark, text, lambda c: chunking.semantic_pieces(c, Options(similarity_threshold=0.3)))
    assert got == ["red fox runs. red fox sleeps.", "blue sky above."]
    assert pieces(spark, "only  one", chunking.semantic_pieces) == ["only  one"]


def test_refine_splits_once_at_the_weakest_boundary(spark):
    left = "revenue cost profit margin in 2020 and 2021 " * 8 + "end. "
    right = "LSTM CNN BERT GPT models learn much " * 10 + "end. "
    text = (left + left + right).strip()
    got = pieces(spark, text, chunking.refined_pieces)
    assert len(got) == 2 and got[1] == right.strip()
    assert len(pieces(spark, text, lambda c: chunking.refined_pieces(c, Options(refine_min_terms=50)))) == 1


def test_size_windows(spark):
    words = [f"w{i}" for i in range(1000)]
    got = pieces(spark, " ".join(words), chunking.sized_pieces)
    assert got == [" ".join(words[0:400]), " ".join(words[399:799]), " ".join(words[798:1000])]
    tail = [f"w{i}" for i in range(500)]
    assert len(pieces(spark, " ".join(tail), chunking.sized_pieces)) == 1
    assert pieces(spark, "short", chunking.sized_pieces) == ["short"]


def test_chunks_are_numbered_densely_and_the_same_on_rerun(spark):
    rows = [("d", i, 1 + i // 3, "p", "text", f"alpha beta {i}. gamma delta {i}. zeta eta {i}.") for i in range(900)]
    opts = Options(similarity_threshold=0.2, coherence_min=0.0)
    units = spark.createDataFrame(rows, UNITS)
    first = {r.chunk_id: (r.chunk_seq, r.text) for r in chunking.chunk_units(units.repartition(3), opts).collect()}
    again = {r.chunk_id: (r.chunk_seq, r.text) for r in chunking.chunk_units(units.repartition(7), opts).collect()}
    assert first == again and sorted(s for s, _ in first.values()) == list(range(len(first)))


def test_coherence_floor_drops(spark):
    rows = [("d", 0, 1, "p", "text", "red fox. blue sky. green sea.")]
    opts = Options(similarity_threshold=0.0, coherence_min=0.22)
    stats = chunking.chunk_stats(chunking.split_blocks(chunking.structural_blocks(spark.createDataFrame(rows, UNITS)), opts)).first()
    assert (stats.sized, stats.kept, stats.dropped) == (1, 0, 1)


@pytest.mark.parametrize("stride, width", [(1, 512), (1_000_003, 512), (1, 3), (7, 2)])
def test_blocks_do_not_depend_on_unit_numbers(spark, monkeypatch, stride, width):
    """Sparse numbers and many levels give the blocks of a plain pass; no row is longer than a range."""
    import random

    rng = random.Random(2)
    rows = []
    for doc in range(3):
        for i in range(90):
            words = " ".join(["word"] * rng.choice([3, 40, 90, 200]))
            rows.append((str(doc), i, i // 30 + 1, "s", "text", words if rng.random() > 0.05 else "# Header here"))
    want = {}
    for doc, seq, page, _, _, body in rows:
        blocks = want.setdefault(doc, [])
        tokens, header = max(1, len(body) // 4), body.startswith("#")
        if not blocks or page != blocks[-1][1] or header or blocks[-1][2] + tokens > 400:
            blocks.append([seq, page, 0, 0])
        blocks[-1][2] += tokens
        blocks[-1][3] += 1
    monkeypatch.setattr(chunking, "RANGE", width)
    units = spark.createDataFrame([(d, s * stride, *rest) for d, s, *rest in rows], "document_id string, unit_seq bigint, page int, source string, type string, text string")
    got = {}
    for r in chunking.structural_blocks(units).orderBy("block_seq").collect():
        got.setdefault(r.document_id, []).append([r.block_seq // stride, r.page, r.n_units])
    assert got == {d: [[b[0], b[1], b[3]] for b in blocks] for d, blocks in want.items()}
