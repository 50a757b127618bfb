"""Token counts by scanning flat, unindexed token files for end-of-document ids.

A file is a plain run of big-endian unsigned integers of ``width`` bytes; a document ends with the separator id.
A shard is read as fixed blocks. Each block is searched for separators by one vectorised comparison; documents
that begin and end in it are complete. A document that is still open at the end of its block gets its end from
the next block of the file that holds a separator, by a running scan over block rows in reverse order. Only those
block rows and the finished counts are shuffled, never tokens.

``header``: number of values before a document's tokens that carry its id (``write_token_files`` writes them);
they hold 15 bits each and so never equal a separator. With ``header=0`` a document is known by file and ordinal.

Defined results: an empty or null text has no token; a document without a closing separator ends with its file; an
empty file has no document; rows that share an id are counted alone; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, strings
from .tokens import default_path, encoder

SEPARATOR = 50256
WIDTH = 2
HEADER = 5
BLOCK_TOKENS = 1 << 19
_DIGIT = 15


def _header(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Five values of 15 bits for each id; the last also tells that there is none."""
    u = ids.astype(np.int64).view(np.uint64)
    out = np.empty((len(u), HEADER), np.uint32)
    for k in range(HEADER):
        out[:, k] = (u >> np.uint64(_DIGIT * k)) & np.uint64((1 << _DIGIT) - 1)
    out[:, HEADER - 1] |= null.astype(np.uint32) << 8
    return out


def _ids(header: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = header[:, HEADER - 1].astype(np.uint64)
    u = (last & np.uint64(15)) << np.uint64(_DIGIT * (HEADER - 1))
    for k in range(HEADER - 1):
        u |= header[:, k].astype(np.uint64) << np.uint64(_DIGIT * k)
    return u.view(np.int64), (last >> np.uint64(8)).astype(bool)


def _check(separator: int, width: int) -> None:
    if width not in (2, 4):
        raise ValueError(f"ids have 2 or 4 bytes, not {width}")
    if not 1 << _DIGIT <= separator < 1 << 8 * width:
        raise ValueError(f"the separator {separator} must lie from {1 << _DIGIT} (values below are ids of documents) and fit {width} bytes")


def _flat(path: str, separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ordinary=True)
        end, limit = np.array([separator], np.uint32), 1 << 8 * width
        for batch in batches:
            texts = strings(batch.column("text"))
            ids = batch.column("doc_id")
            heads = _header(ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()))
            for low, high in slices(texts):
                parts = [x for n, text in enumerate(texts[low:high].to_pylist(), low) for x in (heads[n], encode.ids(text), end)]
                values = np.concatenate(parts)
                if values.max() >= limit or np.count_nonzero(values == separator) != high - low:
                    raise ValueError(f"the vocabulary of {path} has ids of more than {width} bytes or the separator {separator} itself")
                flat = values.astype(f">u{width}").tobytes()
                # The text writer ends the row with the separator's last byte.
                yield pa.RecordBatch.from_arrays([pa.array([flat[:-1]], pa.binary())], names=["flat"])
    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, separator: int = SEPARATOR,
                      width: int = WIDTH) -> None:
    """Write every text's ids to flat files in ``folder``, each document as header, ids, separator.

    The scan's partitions become the files, with no shuffle.
    """
    _check(separator, width)
    closing = chr(separator & 0xFF)
    if ord(closing) >= 128:
        raise ValueError("the separator's last byte must be below 128")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    flat = rows.mapInArrow(_flat(path or default_path(), separator, width), "flat binary")
    flat.select(F.col("flat").cast("string")).write.option("lineSep", closing).text(folder)


def _scan(separator: int, width: int, header: int, block_tokens: int):
    """Rows of a block: its documents with (id, start, end or null), and its own row with its first separator."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, block = batch.column("file")[i], batch.column("block")[i].as_py()
                values = np.frombuffer(batch.column("bytes")[i].as_buffer(), f">u{width}")
                base = block * block_tokens
                size = batch.column("tokens")[i].as_py()
                own = values[:block_tokens]
                ends = np.flatnonzero(own == separator) + base
                starts = ends + 1
                if block == 0:
                    starts = np.concatenate([[0], starts])
                starts = starts[starts < size]
                at = np.searchsorted(ends, starts)
                stop = np.where(at < len(ends), ends[np.minimum(at, len(ends) - 1)] if len(ends) else 0, -1)
                n = len(starts)
                if header:
                    local = (starts - base)[:, None] + np.arange(header)
                    ids, null = _ids(values[np.minimum(local, len(values) - 1)].astype(np.uint32)) if n else (np.zeros(0, np.int64), np.zeros(0, bool))
                else:
                    ids, null = np.zeros(n, np.int64), np.ones(n, bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file.as_py()] * (n + 1), pa.string()),
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array(np.append(starts, base), pa.int64()),
                    pa.array(np.append(ids, 0), pa.int64(), mask=np.append(null, True)),
                    pa.array(np.append(stop, -1), pa.int64(), mask=np.append(stop < 0, True)),
                    pa.array([size] * (n + 1), pa.int64()),
                    pa.array([False] * n + [True]),
                    pa.array([None] * n + [int(ends[0]) if len(ends) else None], pa.int64()),
                ], names=["file", "block", "start", "doc_id", "stop", "tokens", "is_block", "first_end"])
    return run


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = WIDTH,
                 header: int = HEADER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, start, doc_id, n_tokens`` of every document in the files of ``folder``."""
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(folder)
    sized = files.select(F.col("path").alias("file"), "content", (F.col("length") / width).cast("bigint").alias("tokens"))
    last = F.floor((F.col("tokens") - 1) / block_tokens)
    blocks = sized.filter("tokens > 0").select("file", "content", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    cut = F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step + (header + 1) * width))
    rows = blocks.select("file", "tokens", "block", cut.alias("bytes")).mapInArrow(
        _scan(separator, width, header, block_tokens),
        "file string, block bigint, start bigint, doc_id bigint, stop bigint, tokens bigint, is_block boolean, first_end bigint")
    # From the end of the file: the nearest separator in a later block. A document belongs to the block of the
    # separator before it, and a block's own row comes after its documents.
    later = Window.partitionBy("file").orderBy(F.col("block").desc(), F.col("is_block").asc()).rowsBetween(
        Window.unboundedPreceding, -1)
    known = rows.withColumn("next", F.last("first_end", ignorenulls=True).over(later))
    stop = F.coalesce("stop", "next", "tokens")
    return known.filter("not is_block").select(
        "file", "start", "doc_id", (stop - F.col("start") - header).alias("n_tokens"))


def document_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row, by way of flat files in the shared folder."""
    spark = docs.sparkSession
    folder = Scratch(spark, "tokens").path()
    write_token_files(docs, folder, path)
    return count_tokens(spark, folder).select("doc_id", "n_tokens")
