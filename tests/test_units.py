from __future__ import annotations

from corpusgraph.operators import entities
from corpusgraph.sources import units


def test_units_of_a_page_with_very_many_tables_have_numbers_of_their_own(spark):
    rows = [("a", 1, i) for i in (0, 99_999, 100_000, 100_001, 3_000_000_000)] + [("a", 2, 0), ("a", 2, 1), ("b", None, None), (None, 1, 7)]
    tables = spark.createDataFrame([(*r, [["x", None]]) for r in rows] + [("a", 3, 0, [])],
                                   "document_id string, page int, table_index bigint, raw_table array<array<string>>")
    got = [(r["document_id"], r["page"], r["unit_seq"]) for r in units.table_units(tables).collect()]
    assert sorted(got, key=repr) == sorted(
        [("a", 1, n) for n in range(5)] + [("a", 2, 5), ("a", 2, 6), ("b", None, 0), (None, 1, 0)], key=repr)
    images = spark.createDataFrame([("a", 1, 100_000, "t", ""), ("a", 2, 0, "u", "v"), ("a", 1, 1, " ", "w"), ("", 1, 0, "z", None)],
                                   "document_id string, page int, image_index bigint, recognised string, translated string")
    got = [(r["document_id"], r["unit_seq"], r["text"]) for r in units.image_units(images).collect()]
    assert sorted(got) == [("", 0, "z"), ("a", 0, "t"), ("a", 1, "v")]
    gathered = units.gather(units.page_units(spark.createDataFrame([("a", "p\nq")], "document_id string, text string"), "document_id", "text"),
                            units.table_units(tables.filter("document_id is not null")), units.image_units(images))
    keys = gathered.select("document_id", "unit_seq").collect()
    assert len(keys) == len(set(keys)) == 2 + 8 + 3


def test_equal_texts_are_extracted_once(spark):
    rows = [("b", "c1", 1, "Revenue was 5 million in 2020."), ("a", "c2", 2, " Revenue was 5 million in 2020. "), ("a", "c3", 1, None), ("a", "c4", 3, "")]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_seq bigint, text string")
    once = {r["chunk_id"]: r for r in entities.extract_once(chunks).collect()}
    each = {r["chunk_id"]: r for r in entities.extract_chunks(chunks).collect()}
    assert {k: r["reused"] for k, r in once.items()} == {"c1": True, "c2": False, "c3": False, "c4": True}
    for k, r in each.items():
        assert (once[k]["entities"], once[k]["relationships"], once[k]["confidence"]) == (r["entities"], r["relationships"], r["confidence"])
