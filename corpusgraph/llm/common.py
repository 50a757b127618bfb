"""Helpers of the training-data operators: the shared folder, row keys and word spans over Arrow buffers.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Those bytes are never part of a longer
UTF-8 character, so words are found on the raw bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes of text that a worker turns into word arrays at a time; one longer text is taken alone.
SLICE_BYTES = 4 << 20

LAST_ID = 2**63 - 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Scratch:
    """Tables of one run, in a folder of their own below the cluster's shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self) -> str:
        self._n += 1
        return f"{self.folder}/{self._n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again: later steps prune columns and survive lost executors."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def row_key(text: str = "text") -> Column:
    """Tells rows with the same doc_id apart by their text; equal rows share it and get equal results."""
    return F.xxhash64(F.col(text))


def id_or_last(column: str = "doc_id") -> Column:
    """The id, with null ordered after all others."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST_ID))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``bytes, offsets`` of a string or binary array without nulls."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, width)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], (offs - offs[0]).astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; each holds one row at least."""
    _, offs = buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offs, offs[low] + limit, "right")) - 1)
        yield low, high
        low = high


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, row`` of every word; a word ends with its row."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    return _LOWER[raw]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time for all spans together."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * _C1 + _C3)
    at, live = starts, None
    left = length
    while True:
        chunk = eights[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ chunk) * _C1)
        else:
            h[live] = mix((h[live] ^ chunk) * _C1)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
