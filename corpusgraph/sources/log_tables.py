"""Log-structured graph and vector tables: commits add files, markers take documents away, reads merge.

A commit is a number. Its rows lie in files of their own (``<table>/commit=<n>``, partitioned by a hash bucket of the
document), its markers name the documents whose earlier rows are gone, and its entry in the log, written last, makes all
of it visible at once. Nothing written is ever changed:

- *append* adds files; *upsert* adds files and markers for the documents it replaces; *delete* adds markers alone;
- *replace_all* and *compact* write a new base: earlier commits of the table are no longer read, from the moment the log
  entry is there. ``vacuum`` removes their files.

A reader sees the commits that the log held when ``load`` was called. A failed commit leaves files that no reader looks at and
the next commit overwrites. A commit may carry a batch name; a name that is in the log is not committed again, so a replayed
batch changes nothing. There is one writer at a time; a second one fails when it writes the same log entry.

The log has a few lines for each commit and is read by the driver; ``compact`` bounds the files a read must open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import run_table
from .tables import BUCKET, SCHEMAS

_WITH_DATA = ("append", "upsert", "replace", "compact")
_WITH_MARKERS = ("upsert", "delete")
_BASES = ("replace", "compact")


@dataclass(frozen=True)
class Entry:
    commit: int
    batch: str | None
    table: str
    operation: str


class LogStore:
    """Tables of one folder, which every executor can reach. ``schemas``: table name -> columns; each has a document_id."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str] | None = None, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schemas = SCHEMAS if schemas is None else schemas
        self._known: dict[int, list[Entry]] = {}

    # --- the log ---

    def _exists(self, path: str) -> bool:
        return self._files(path).exists(self._path(path))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> list[Entry]:
        """Entries in order. Entries never change, so each is read once."""
        folder = f"{self.folder}/_log"
        files = self._files(folder)
        if files.exists(self._path(folder)):
            for status in files.listStatus(self._path(folder)):
                name = status.getPath().getName()
                if name.isdigit() and int(name) not in self._known:
                    stream = files.open(status.getPath())
                    try:
                        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                    finally:
                        stream.close()
                    self._known[int(name)] = [Entry(int(name), *json.loads(line)) for line in text.splitlines()]
        return [entry for number in sorted(self._known) for entry in self._known[number]]

    def _write_entry(self, number: int, rows: list[tuple]) -> None:
        """Appears whole under its number, or fails where another writer's entry is there already."""
        final, hidden = self._path(f"{self.folder}/_log/{number}"), self._path(f"{self.folder}/_log/.{number}-{uuid.uuid4().hex}")
        files = self._files(f"{self.folder}/_log")
        out = files.create(hidden, False)
        out.write(bytearray("\n".join(json.dumps(r) for r in rows).encode()))
        out.close()
        if files.exists(final) or not files.rename(hidden, final):
            files.delete(hidden, False)
            raise RuntimeError(f"commit {number} of {self.folder} was written by another writer")

    def has_batch(self, batch: str) -> bool:
        return any(e.batch == batch for e in self.log())

    @contextmanager
    def commit(self, batch: str | None = None) -> Iterator["Commit | None"]:
        """Collect writes and make them visible together at the end; None where the batch is in the log already."""
        log = self.log()
        if batch is not None and any(e.batch == batch for e in log):
            yield None
            return
        made = Commit(self, 1 + max((e.commit for e in log), default=0))
        yield made
        self._write_entry(made.number, [(batch, table, operation) for table, operation in made.operations] or [(batch, "", "none")])

    # --- reading ---

    def bucket(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def _commits(self, log: list[Entry], table: str) -> tuple[list[int], list[int]]:
        """Commits whose rows are read, and those whose markers are."""
        own = [e for e in log if e.table == table]
        base = max((e.commit for e in own if e.operation in _BASES), default=0)
        return ([e.commit for e in own if e.operation in _WITH_DATA and e.commit >= base],
                [e.commit for e in own if e.operation in _WITH_MARKERS and e.commit > base])

    def _stored(self, kind: str, table: str, commits: list[int], columns: str) -> DataFrame:
        schema = f"{columns}, commit bigint" + (f", {BUCKET} int" if kind == "data" else "")
        root = f"{self.folder}/{kind}/{table}"
        paths = [f"{root}/commit={n}" for n in commits if self._exists(f"{root}/commit={n}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def load(self, table: str, documents: list[str] | str | DataFrame | None = None) -> DataFrame:
        """The rows that stand, or those of some documents: their buckets alone are read then."""
        data, marked = self._commits(self.log(), table)
        rows = self._stored("data", table, data, self.schemas[table])
        gone = self._stored("markers", table, marked, "document_id string")
        if documents is not None:
            if not isinstance(documents, DataFrame):
                few = [documents] if isinstance(documents, str) else list(documents)
                documents = self.spark.createDataFrame([(d,) for d in few], "document_id string")
            documents = documents.select("document_id").distinct()
            # At most one number for each bucket comes to the driver.
            buckets = [r[0] for r in documents.select(self.bucket(F.col("document_id"))).distinct().collect()]
            rows = rows.filter(F.col(BUCKET).isin(buckets)).join(documents, "document_id", "left_semi")
            gone = gone.join(documents, "document_id", "left_semi")
        keys = [c.split()[0] for c in self.schemas[table].split(", ")]
        if not marked:
            return rows.select(*keys)
        last = gone.groupBy("document_id").agg(F.max("commit").alias("gone_at"))
        return salted_join(rows, last, ["document_id"], keys, "left").filter(
            F.col("gone_at").isNull() | (F.col("commit") >= F.col("gone_at"))).select(*keys)

    # --- writing: one commit each ---

    def append(self, table: str, rows: DataFrame, batch: str | None = None) -> None:
        with self.commit(batch) as c:
            if c is not None:
                c.append(table, rows)

    def upsert(self, table: str, rows: DataFrame, documents: DataFrame | None = None) -> None:
        with self.commit() as c:
            c.upsert(table, rows, documents)

    def replace_all(self, table: str, rows: DataFrame) -> None:
        with self.commit() as c:
            c.replace_all(table, rows)

    def delete_documents(self, documents: DataFrame) -> None:
        """Take documents out of every table, with the edges attached to them, by one commit of markers."""
        with self.commit() as c:
            c.delete(documents)

    def delete_document(self, document_id: str) -> None:
        self.delete_documents(self.spark.createDataFrame([(document_id,)], "document_id string"))

    def delete_all(self) -> None:
        with self.commit() as c:
            for table, columns in self.schemas.items():
                c.replace_all(table, self.spark.createDataFrame([], columns))

    def compact(self, *tables: str) -> None:
        """Write what stands as the new base of the tables (of all by default), without markers."""
        with self.commit() as c:
            for table in tables or self.schemas:
                c.base(table, self.load(table), "compact")

    def vacuum(self) -> int:
        """Remove the files of commits that no load would read any more; gives the number of folders removed."""
        log, removed = self.log(), 0
        for table in self.schemas:
            data, marked = self._commits(log, table)
            for kind, live in (("data", data), ("markers", marked)):
                root = f"{self.folder}/{kind}/{table}"
                if not self._exists(root):
                    continue
                for status in self._files(root).listStatus(self._path(root)):
                    if int(status.getPath().getName().split("=")[1]) not in live:
                        self._files(root).delete(status.getPath(), True)
                        removed += 1
        return removed


class Commit:
    """Writes of one commit; tables take each at most one operation that writes rows."""

    def __init__(self, store: LogStore, number: int):
        self.store, self.number = store, number
        self.operations: list[tuple[str, str]] = []

    def _place(self, kind: str, table: str) -> str:
        return f"{self.store.folder}/{kind}/{table}/commit={self.number}"

    def _rows(self, table: str, rows: DataFrame) -> None:
        if any(t == table and o in _WITH_DATA for t, o in self.operations):
            raise ValueError(f"{table} is written already in this commit")
        columns = [c.split()[0] for c in self.store.schemas[table].split(", ")]
        ready = rows.select(*columns).withColumn(BUCKET, self.store.bucket(F.col("document_id")))
        # Rebalancing splits the bucket of a very large document over several files and tasks.
        ready.hint("rebalance", BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(self._place("data", table))

    def _markers(self, table: str, documents: DataFrame) -> None:
        documents.select("document_id").distinct().write.mode("overwrite").parquet(self._place("markers", table))

    def append(self, table: str, rows: DataFrame) -> None:
        self._rows(table, rows)
        self.operations.append((table, "append"))

    def upsert(self, table: str, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Replace the rows of all documents in ``rows`` (or in ``documents``). ``rows`` is read twice without ``documents``."""
        self._rows(table, rows)
        self._markers(table, rows if documents is None else documents)
        self.operations.append((table, "upsert"))

    def base(self, table: str, rows: DataFrame, operation: str) -> None:
        self._rows(table, rows)
        self.operations.append((table, operation))

    def replace_all(self, table: str, rows: DataFrame) -> None:
        self.base(table, rows, "replace")

    def delete(self, documents: DataFrame) -> None:
        gone = run_table(documents.select("document_id").distinct(), "deleted")
        for table in self.store.schemas:
            self._markers(table, gone)
            self.operations.append((table, "delete"))
