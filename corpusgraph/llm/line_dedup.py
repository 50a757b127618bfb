"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. The store keeps, for
every key seen, the smallest document that holds it, as *runs*: tables sorted and bucketed by key. Documents
arrive in batches of ascending ids. A batch merge-anti-joins its keys with all runs; what is left are its new
keys, which become a run of level 0. Once a level has ``fanout`` runs, they are merged into one run of the next
level, so a batch meets about ``fanout * log(batches)`` runs.

A line stays where (key, document) is in the batch's own new run; since that join includes the document, a line
that a third of all documents hold is spread over all tasks.

Defined results: a null id comes after all others, and all rows without an id are one document. Rows with one id
are one document. Null or empty text is one empty line, which stays. Keys of fewer than ``min_chars`` code points
and keys of one document stay. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_or_last, row_key, strings

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_STRIP = b" \t\n\x0b\x0c\r"


def _key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def _hashed_lines(min_chars: int):
    """Position and 128-bit key hash of every line that may be a repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, high, low = [], [], [], []
            for row, text in enumerate(strings(batch.column("text")).to_pylist()):
                for n, line in enumerate(text.encode().split(b"\n")):
                    key = _key(line)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        h = xxhash.xxh3_128_intdigest(key)
                        rows.append(row)
                        at.append(n)
                        high.append((h >> 64) - 2**63)
                        low.append((h & (2**64 - 1)) - 2**63)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("row").take(take),
                 pa.array(at, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                names=["id", "row", "at", "k1", "k2"])
    return run


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, row, at, k1, k2`` of the lines of ``docs`` with keys of ``min_chars`` code points or more."""
    return docs.select(id_or_last().alias("id"), row_key().alias("row"), "text").mapInArrow(
        _hashed_lines(min_chars), "id bigint, row bigint, at int, k1 bigint, k2 bigint")


class LineRuns:
    """The levelled store of first documents of keys."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.scratch = Scratch(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []

    def _write(self, keys: DataFrame) -> DataFrame:
        """A run: one sorted file for each bucket."""
        path = self.scratch.path()
        name = "line_run_" + path.rsplit("-", 1)[1].replace("/", "_")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (keys.repartition(buckets, "k1", "k2").write.format("parquet").option("path", path)
         .bucketBy(buckets, "k1", "k2").sortBy("k1", "k2").saveAsTable(name))
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in the lines of documents that come after all earlier ones; give the lines to drop."""
        new = lines.groupBy("k1", "k2").agg(F.min("id").alias("id"))
        for runs in self.levels:
            for run in runs:
                new = new.join(run, ["k1", "k2"], "left_anti")
        own = self._write(new)
        self._push(own, 0)
        return self.scratch.table(
            lines.join(own, ["k1", "k2", "id"], "left_anti").select("id", "row", "at"))

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self._push(self._write(merged), level + 1)


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``id, row, drops``: positions of the dropped lines of the documents that lose any."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout)
    lines = runs.scratch.table(line_hashes(docs, min_chars))
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    low, dropped = None, None
    for high in [*sorted({int(c) for c in cuts}), None]:
        part = lines
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        drops = runs.add(part)
        dropped = drops if dropped is None else dropped.unionByName(drops)
        low = high
    return dropped.groupBy("id", "row").agg(F.collect_set("at").alias("drops"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, lost, kept = [], [], []
        for text, drops in zip(strings(batch.column("text")).to_pylist(), batch.column("drops").to_pylist()):
            lines = text.split("\n")
            gone = set(drops or ())
            total.append(len(lines))
            lost.append(len(gone))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        keep = [n for n in batch.schema.names if n not in ("text", "drops")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
             pa.array(kept, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())],
            names=[*keep, "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT,
                keep: str | None = None) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text, kept_sha256`` of every row of ``docs``.

    ``keep``: a column of ``docs`` to carry along.
    """
    carried = [keep] if keep else []
    drops = lines_to_drop(docs, min_chars, batches, fanout)
    rows = docs.select("doc_id", "text", *carried, id_or_last().alias("__id"), row_key().alias("__row"))
    marked = rows.join(drops, (F.col("__id") == F.col("id")) & (F.col("__row") == F.col("row")), "left")
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carried, "text", "drops").mapInArrow(
        _rebuild, f"doc_id bigint{kinds}, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string")
