"""Log-structured tables, the graph kept up by batches, and ordered changes on streams."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import entities, graph
from corpusgraph.plans import pipeline
from corpusgraph.sources.log_tables import LogStore
from corpusgraph.sources.units import line_units
from corpusgraph.streaming import ordered
from corpusgraph.streaming.incremental import IncrementalGraph
from corpusgraph.streaming.runs import run_available

from .test_pipeline import DOCS, OPTS

ROWS = {"notes": "document_id string, note_id bigint, text string", "marks": "document_id string, mark bigint"}


def files(folder):
    return {os.path.join(place, name): os.stat(os.path.join(place, name)).st_mtime_ns
            for place, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS["notes"])


def stored(store, table="notes", **which):
    return sorted((tuple(r) for r in store.load(table, **which).collect()), key=repr)


def test_commits_change_no_earlier_file(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), ROWS, buckets=4)
    assert stored(store) == []
    store.append("notes", notes(spark, *[(str(i), i, "first") for i in range(40)], (None, 99, "no document")))
    before = files(tmp_path)
    store.append("notes", notes(spark, ("7", 70, "added")))
    after = files(tmp_path)
    assert {p: after[p] for p in before} == before and len(after) == len(before) + 1
    store.delete_document("7")
    gone = set(files(tmp_path)) - set(after)
    assert gone and all("/markers/" in p for p in gone)
    assert stored(store) == sorted([(str(i), i, "first") for i in range(40) if i != 7] + [(None, 99, "no document")], key=repr)
    store.append("notes", notes(spark, ("7", 71, "back")))
    assert stored(store, documents="7") == [("7", 71, "back")] and stored(store, documents=["7", "8"])[1] == ("8", 8, "first")
    store.upsert("notes", notes(spark, ("8", 80, "other"), ("8", 81, "two")))
    store.upsert("notes", notes(spark), notes(spark, ("9", 0, "")))
    assert stored(store, documents=["8", "9"]) == [("8", 80, "other"), ("8", 81, "two")]
    assert {p: m for p, m in files(tmp_path).items() if p in before} == before


def test_compaction_and_replacement_keep_what_stands(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), ROWS, buckets=4)
    for i in range(3):
        store.append("notes", notes(spark, ("a", i, "x"), (f"d{i}", i, "y")))
    store.delete_document("d1")
    want = stored(store)
    reader = store.load("notes")  # a reader from before sees what it saw
    store.compact()
    assert stored(store) == want == sorted(map(tuple, reader.collect()))
    assert store._commits(store.log(), "notes") == ([5], [])
    removed = store.vacuum()
    assert removed >= 4 and stored(store) == want and all("commit=5" in p for p in files(tmp_path / "data"))
    store.append("notes", notes(spark, ("d1", 5, "again")))
    assert ("d1", 5, "again") in stored(store)
    store.replace_all("notes", notes(spark, ("z", 1, "all new")))
    assert stored(store) == [("z", 1, "all new")] == stored(LogStore(spark, str(tmp_path), ROWS, buckets=4))
    store.delete_all()
    assert stored(store) == [] and stored(store, "marks") == []


def test_failed_and_replayed_commits(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), ROWS, buckets=4)
    store.append("notes", notes(spark, ("a", 1, "x")), batch="b1")
    store.append("notes", notes(spark, ("a", 1, "x")), batch="b1")
    assert stored(store) == [("a", 1, "x")] and store.has_batch("b1") and not store.has_batch("b2")
    with pytest.raises(RuntimeError, match="on purpose"), store.commit("b2") as commit:
        commit.append("notes", notes(spark, ("b", 2, "half written")))
        raise RuntimeError("on purpose")
    assert stored(store) == [("a", 1, "x")] and not store.has_batch("b2")
    with store.commit("b2") as commit:
        commit.append("notes", notes(spark, ("b", 3, "whole")))
        commit.append("marks", spark.createDataFrame([("b", 1)], ROWS["marks"]))
        with pytest.raises(ValueError):
            commit.append("notes", notes(spark))
        assert stored(store) == [("a", 1, "x")]  # nothing is seen before the end
    assert stored(store) == [("a", 1, "x"), ("b", 3, "whole")] and stored(store, "marks") == [("b", 1)]
    slow, fast = LogStore(spark, str(tmp_path), ROWS, buckets=4), LogStore(spark, str(tmp_path), ROWS, buckets=4)
    with pytest.raises(RuntimeError, match="another writer"), slow.commit() as mine:
        with fast.commit() as theirs:
            theirs.append("marks", spark.createDataFrame([("c", 1)], ROWS["marks"]))
        mine.delete(notes(spark, ("a", 0, "")))
    assert ("a", 1, "x") in stored(store)


def test_one_document_reads_its_bucket_alone(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), ROWS, buckets=16)
    store.append("notes", notes(spark, *[(str(i), i, "x") for i in range(200)]))
    one = store.load("notes", "17")
    assert [r.note_id for r in one.collect()] == [17]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "doc_bucket" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    read = [p for p in one.inputFiles()]
    assert read and len({p.split("doc_bucket=")[1].split("/")[0] for p in read}) <= 16


def test_documents_ingest_into_one_commit(spark, tmp_path):
    """The ingest job writes through a commit: all tables of a batch appear together, a replay changes nothing."""
    store = LogStore(spark, str(tmp_path), buckets=4)
    units = line_units(spark.createDataFrame(DOCS, "doc_id bigint, text string"), "doc_id", "text")
    for _ in range(2):
        with store.commit("batch-0") as commit:
            if commit is not None:
                pipeline.ingest_documents(units, commit, OPTS)
    assert store.load("chunks").count() == 3 and store.load("vectors").count() == 3
    before = {t: stored(store, t) for t in ("chunks", "entities", "mentions", "relationships", "vectors")}
    with store.commit("batch-1") as commit:
        pipeline.ingest_documents(units.filter("document_id = '2'"), commit, OPTS)
    assert {t: stored(store, t) for t in before} == before
    store.delete_document("2")
    assert {r[0] for t in before for r in stored(store, t)} == {"1", "3"}


def test_batches_with_a_replay_equal_one_build(spark, tmp_path):
    """Relations of later batches join components of earlier ones, in any order of batches."""
    rng = random.Random(6)
    schema = ("document_id string, chunk_id string, chunk_seq bigint, text string, source string, page int, "
              "entities array<struct<label:string,type:string>>, relationships array<struct<from:string,to:string,type:string>>")
    rows = []
    for doc in ("d1", "d2", "d3"):
        for i in range(24):
            a, b, extra = (f"n{rng.randrange(30):02d}" for _ in range(3))
            rows.append((doc, f"{doc}-{i}", i, f"text {i}", "s", 1, [(a, rng.choice(["concept", "metric"])), (extra, "date")],
                         [(a, b, "RELATED_TO")] if rng.random() < 0.5 else []))
    whole = graph.build_graph(spark.createDataFrame(rows, schema))
    want = {t: sorted(map(tuple, getattr(whole, t).collect()), key=repr) for t in ("entities", "mentions", "relationships", "chunks")}
    rng.shuffle(rows)
    kept_up = IncrementalGraph(spark, str(tmp_path), buckets=4)
    batches = [rows[i::4] for i in range(4)]
    done = [kept_up.apply(name, spark.createDataFrame(batches[n], schema)) for name, n in (("0", 0), ("1", 1), ("1", 1), ("2", 2), ("3", 3), ("0", 0))]
    assert done == [True, True, False, True, True, False]
    got = kept_up.tables()
    for table in want:
        columns = getattr(whole, table).columns
        assert sorted(map(tuple, getattr(got, table).select(*columns).collect()), key=repr) == want[table], table
    one = kept_up.tables(spark.createDataFrame([("d2",)], "document_id string")).entities
    assert sorted(map(tuple, one.select(*whole.entities.columns).collect()), key=repr) == [r for r in want["entities"] if r[0] == "d2"]
    moved = kept_up.store.load("components")
    assert moved.count() < 4 * whole.entities.count()
    kept_up.store.delete_document("d2")
    assert {r[0] for r in kept_up.tables().entities.select("document_id").collect()} == {"d1", "d3"}


def _event_files(spark, tmp_path, rows, schema, batches):
    for number, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for path in (tmp_path / "in").glob("*.parquet"):
            if path.stat().st_mtime > 1_800_000_000 - 1:
                os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_rows_are_judged_in_order(spark, tmp_path):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows, clock = [], {}
    for seq in range(600):
        key = rng.randrange(5)
        clock[key] = clock.get(key, 0) + rng.choice([1, 1, 5, 9, 60, 200])
        rows.append((key, seq, start + datetime.timedelta(minutes=clock[key]), rng.choice("ab")))
    rows.sort(key=lambda r: r[2])
    hour = lambda r: int((r[2] - start).total_seconds() // 3600)
    batches: dict[int, list] = {}
    for r in rows:
        batches.setdefault(hour(r) // 24 + rng.choice([0, 0, 0, 1]), []).append(r)
    schema = "session_id bigint, seq bigint, ts timestamp, state string"
    stream = _event_files(spark, tmp_path, rows, schema, [batches[b] for b in sorted(batches)])
    idle = 150 * 60 * 1000
    got = run_available(ordered.ordered_changes(stream, ["session_id"], "state", "25 hours", idle), "append")
    table = spark.createDataFrame(rows, schema)
    cut = max(r[2] for r in rows) - datetime.timedelta(hours=25)
    want = ordered.changes_with_expiry(table, ["session_id"], "state", idle).filter(F.col("ts") <= F.lit(cut))
    assert len(batches) > 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class _State:
    """One value of a key's state; asking whether there is one is an error."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_a_state_is_asked_once_for_its_value():
    processor = ordered.ChangeProcessor(1000, ["key", "seq", "at", "value"])
    waiting, timers = {}, []
    processor.waiting = type("Map", (), {
        "updateValue": staticmethod(waiting.__setitem__), "iterator": staticmethod(lambda: iter(waiting.items())),
        "removeKey": staticmethod(waiting.pop)})
    processor.last, processor.alarm = _State(), _State()
    processor.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append), "deleteTimer": staticmethod(timers.remove)})
    row, clock = type("In", (), {}), type("Clock", (), {"getCurrentWatermarkInMs": staticmethod(lambda: 50)})
    for seq, at, value in ((2, 20, "b"), (1, 10, "a"), (3, 90, "b")):
        row.seq, row.at, row.value = seq, at, value
        assert list(processor.handleInputRows(("k",), iter([row]), clock)) == []
    assert timers == [10]
    assert [(r.seq, r.value) for r in processor.handleExpiredTimer(("k",), clock, None)] == [(1, "a"), (2, "b")]
    assert processor.last.value == (20, "b") and processor.alarm.value == (90,)
