"""Packing of documents into token sequences by non-negative least squares over tail lengths.

A document's ids (with the closing id) are cut into full sequences and a tail. Combinations of two or three tail
lengths that fill a sequence exactly are enumerated, and their repeat counts are fitted to the histogram of
tail lengths by non-negative least squares, rounded down, and cut to what the histogram holds. The tails that no
combination takes are packed greedily one after the other, cut where a sequence is full.

Only the histogram (one row for each length below the sequence size) reaches the driver. Tails get their places
by rank within their length; ranks are counted within hash shards and offset by the shards before, so one length
that a third of all documents have is no hot group. Left-over tails are packed in shards of bounded size.

Neither texts nor ids are stored or shuffled: tails are cut on a grid of ``GRID`` ids only, and a tail carries the
running CRC-32 at each grid point, from which the CRC-32 of any piece follows. A sequence of left-overs is
therefore padded by fewer than ``GRID`` ids, but for the last of each shard.

Defined results: a null or empty text is the closing id alone. Rows that share an id are packed alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_key, strings
from .tokens import default_path, encoder

SEQUENCE = 2048
CLOSING_ID = 1
GRID = 16
# Lengths that three-part combinations are made of, and rows of a shard.
FREQUENT = 64
SHARD_ROWS = 20_000
_POLY = 0xEDB88320


def _pieces(path: str, size: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            total, full, tails, crcs, running = [], [], [], [], []
            for text in strings(batch.column("text")).to_pylist():
                ids = encode.ids(text)
                n = len(ids) + 1
                raw = memoryview(np.append(ids, np.uint32(closing)).astype("<u4").tobytes())
                cut = n // size * size
                full.append([zlib.crc32(raw[4 * i: 4 * (i + size)]) for i in range(0, cut, size)])
                crc, marks = 0, []
                for i in range(cut, n, GRID):
                    crc = zlib.crc32(raw[4 * i: 4 * (i + GRID)], crc)
                    marks.append(crc)
                total.append(n)
                tails.append(n - cut)
                crcs.append(crc)
                running.append(np.array(marks, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(total, pa.int64()),
                 pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.int32()),
                 pa.array(crcs, pa.int64()), pa.array(running, pa.binary())],
                names=["doc_id", "row", "doc_tokens", "full", "tail", "tail_crc", "running"])
    return run


def _powers() -> list[np.ndarray]:
    """Operators that advance a CRC-32 over 2^k zero bytes, as the images of the 32 bits."""
    step = np.empty(32, np.uint64)
    for bit in range(32):
        crc = 1 << bit
        for _ in range(8):
            crc = (crc >> 1) ^ (_POLY if crc & 1 else 0)
        step[bit] = crc
    out = [step]
    while len(out) < 14:
        out.append(np.array([_apply(out[-1], int(x)) for x in out[-1]], np.uint64))
    return out


def _apply(images: np.ndarray, crc: int) -> int:
    value = 0
    for bit in range(32):
        if crc >> bit & 1:
            value ^= int(images[bit])
    return value


def crc_of_part(before: int, until: int, n_bytes: int, powers: list[np.ndarray]) -> int:
    """CRC-32 of the last ``n_bytes`` of a run whose CRC-32 is ``until``, and was ``before`` ahead of them."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            before = _apply(powers[k], before)
        n_bytes >>= 1
        k += 1
    return before ^ until


def combinations(histogram: dict[int, int], size: int = SEQUENCE, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Pairs of any lengths, and triples with two of the most frequent lengths, that fill a sequence."""
    have = {n for n, c in histogram.items() if c > 0}
    pairs = [(n, size - n) for n in sorted(have) if n >= size - n and size - n in have]
    top = sorted(have, key=lambda n: (-histogram[n], n))[:frequent]
    triples = {
        tuple(sorted((a, b, size - a - b), reverse=True))
        for i, a in enumerate(top) for b in top[i:] if size - a - b in have}
    return pairs + sorted(triples)


def non_negative_fit(combos: list[tuple[int, ...]], histogram: dict[int, int], rounds: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared distance of the lengths they use to the histogram, by cyclic
    coordinate descent (each column holds at most three lengths)."""
    left = {n: float(c) for n, c in histogram.items()}
    uses = [[(n, combo.count(n)) for n in set(combo)] for combo in combos]
    norms = [sum(m * m for _, m in use) for use in uses]
    x = np.zeros(len(combos))
    for _ in range(rounds):
        moved = 0.0
        for k, use in enumerate(uses):
            value = max(0.0, x[k] + sum(m * left[n] for n, m in use) / norms[k])
            change = value - x[k]
            if change:
                for n, m in use:
                    left[n] -= m * change
                x[k] = value
                moved = max(moved, abs(change))
        if moved < 0.25:
            break
    return x


def places(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``(length, first rank, end rank, first sequence, offset)`` of every slot, and the number of sequences."""
    combos = combinations(histogram, size)
    left, used = dict(histogram), dict.fromkeys(histogram, 0)
    slots, sequences = [], 0
    for combo, want in zip(combos, non_negative_fit(combos, histogram)):
        n = min(int(want), *(left[length] // combo.count(length) for length in combo))
        if n <= 0:
            continue
        offset = 0
        for length in combo:
            slots.append((length, used[length], used[length] + n, sequences, offset))
            used[length] += n
            left[length] -= n
            offset += length
        sequences += n
    return slots, sequences


def _greedy(size: int):
    powers = _powers()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out, sequence, filled = [], 0, 0
        for row in frame.sort_values(["doc_id", "row", "rank"]).itertuples(index=False):
            marks = np.frombuffer(row.running, "<u4")
            at, tail, begin = 0, int(row.tail), int(row.doc_tokens) - int(row.tail)
            while at < tail:
                room = size - filled
                take = tail - at if tail - at <= room else room // GRID * GRID
                if take == 0:
                    sequence, filled = sequence + 1, 0
                    continue
                before = int(marks[at // GRID - 1]) if at else 0
                crc = crc_of_part(before, int(marks[-(-(at + take) // GRID) - 1]), 4 * take, powers)
                out.append((row.doc_id, begin + at, take, crc, int(row.doc_tokens), int(row.shard), sequence, filled))
                at += take
                filled += take
                if filled == size:
                    sequence, filled = sequence + 1, 0
        made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "sequence_id", "offset"])
        return made.astype({"doc_id": "Int64"})
    return run


def _offsets(counts: DataFrame, n: str, by: list[str]) -> DataFrame:
    """The sum of ``n`` over the shards before each shard (a row for each shard and ``by``)."""
    before = Window.partitionBy(*by).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "shard", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")
    cut = scratch.table(rows.mapInArrow(
        _pieces(path or default_path(), size, closing),
        "doc_id bigint, row bigint, doc_tokens bigint, full array<bigint>, tail int, tail_crc bigint, running binary"))
    found = {r["tail"]: r["n"] for r in cut.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(found.values())
    found.pop(0, None)
    slots, n_combined = places(found, size)
    n_shards = max(1, -(-n_rows // SHARD_ROWS))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_shards)))

    # Ranks of tails within their length.
    tails = sharded.filter("tail > 0")
    bases = _offsets(tails.groupBy("tail", "shard").agg(F.count(F.lit(1)).alias("n")), "n", ["tail"])
    within = Window.partitionBy("tail", "shard").orderBy("doc_id", "row")
    ranked = tails.select("doc_id", "row", "doc_tokens", "tail", "tail_crc", "shard", "running",
                          (F.row_number().over(within) - 1).cast("bigint").alias("r")).join(bases, ["tail", "shard"])
    ranked = ranked.select("doc_id", "row", "doc_tokens", "tail", "tail_crc", "running", (F.col("r") + F.col("base")).alias("rank"))
    table = spark.createDataFrame(slots, "tail int, low bigint, high bigint, first bigint, offset bigint").withColumnRenamed("tail", "__tail")
    placed = scratch.table(ranked.join(
        table, (F.col("tail") == F.col("__tail")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left",
    ).drop("__tail"))
    combined = placed.filter("low is not null").select(
        "doc_id", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").cast("bigint").alias("length"),
        F.col("tail_crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")

    # Left-over tails.
    rest = placed.filter("low is null")
    n_rest = rest.count()
    rest_shards = max(1, -(-n_rest // SHARD_ROWS))
    packed = scratch.table(
        rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "rank"), F.lit(rest_shards)))
        .groupBy("shard").applyInPandas(_greedy(size), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
                                        "doc_tokens bigint, shard bigint, sequence_id bigint, offset bigint"))
    per_shard = packed.groupBy("shard").agg((F.max("sequence_id") + 1).alias("n"))
    one = per_shard.withColumn("all", F.lit(0))
    rest_bases = _offsets(one, "n", ["all"]).drop("all")
    left_over = packed.join(rest_bases, "shard").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence_id") + F.col("base") + n_combined).alias("sequence_id"), "offset")
    n_rest_sequences = per_shard.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # Full sequences.
    whole = sharded.filter(F.size("full") > 0).select("doc_id", "row", "doc_tokens", "shard", "full")
    whole_bases = _offsets(whole.groupBy("shard").agg(F.sum(F.size("full")).alias("n")).withColumn("all", F.lit(0)), "n", ["all"]).drop("all")
    running = Window.partitionBy("shard").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = whole.withColumn("end", F.sum(F.size("full")).over(running)).join(whole_bases, "shard")
    full = numbered.select(
        "doc_id", "doc_tokens", (F.col("end") - F.size("full") + F.col("base")).alias("first"), F.posexplode("full").alias("i", "ids_crc32"),
    ).select(
        "doc_id", (F.col("i") * F.lit(size)).cast("bigint").alias("start"), F.lit(size).cast("bigint").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("first") + F.col("i") + n_combined + n_rest_sequences).cast("bigint").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    return combined.unionByName(left_over).unionByName(full)
