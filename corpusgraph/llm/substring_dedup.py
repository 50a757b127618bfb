"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the least hash of the ``part``-word
runs in it. Consecutive windows that share their minimiser travel as one packed string (a super-k-mer: its words
joined by blanks) to the bucket of the minimiser, so equal windows meet in one bucket; there the windows are
sorted by hash, counted, and equal ones are confirmed on their bytes.

Hot text: a first pass finds the ``part``-word runs that are frequent in some slice of the input; they rank behind
all others, so only windows that lie wholly inside text repeated that often have such a minimiser. Super-k-mers
that a slice holds twice or more are covered where they stand and travel once, without a return address. A passage
that a third of all documents share so costs its bucket one string for each slice of the input, not one for each
document. Long runs of one minimiser are cut into ``MAX_RUN`` windows.

What comes back are covered word ranges, joined to the documents by id and text hash.

Defined results: null or empty text has no words, and its kept text is empty. Texts with fewer words than a window
keep all. Null ids are a key like others. Rows that share id and text get the same result; each counts as a place.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buffers, id_or_last, mix, row_key, signed, slices, span_hashes, strings, word_spans

WINDOW = 35
PART = 6
MAX_RUN = 256
# Words of packed text in a bucket, and the share of a slice from which a run of PART words is frequent.
BUCKET_WORDS = 1_000_000
FREQUENT = 1 / 5000
MAX_FREQUENT = 100_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(1 << 63)
_COMPARE_BYTES = 8 << 20


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of every ``size`` consecutive values, from prefix sums modulo 2^64."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n, np.uint64(_inverse(int(_BASE))), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(n + 1, np.uint64)
    np.add.accumulate(h * power, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * back[: n - size + 1])


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    have, now = 1, values
    while 2 * have <= size:
        now = np.minimum(now[:-have], now[have:])
        have *= 2
    return now if have == size else np.minimum(now[: len(now) - (size - have)], now[size - have:])


def _frequent(window: int, part: int):
    """Words of the slice (a row without hash), and runs of ``part`` words that are frequent in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            for low, high in slices(texts):
                raw, offs = buffers(texts[low:high])
                starts, ends, row = word_spans(raw, offs)
                found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(row) >= window:
                    parts = rolling(span_hashes(raw, starts, ends), part)[row[: 1 - part] == row[part - 1:]]
                    found, counts = np.unique(parts, return_counts=True)
                    many = counts >= max(64, FREQUENT * len(parts))
                    found, counts = found[many], counts[many]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(signed(found), 0), pa.int64(), mask=np.append(np.zeros(len(found), bool), True)),
                    pa.array(np.append(counts, len(row)), pa.int64())], names=["part", "n"])
    return run


def _compact(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words joined by one blank, and where each begins."""
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    source = np.repeat(starts - begin, sizes) + np.arange(sizes.sum())
    joined = np.append(raw, np.uint8(32))[source]
    joined[begin + sizes - 1] = 32
    return joined.tobytes(), begin


def _packed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _unpacked(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


_ADDRESS = ["i8", "i8", "i4", "u1"]
_COVERED = ["i8", "i8", "i4", "i4"]


def _super_kmers(window: int, part: int, buckets: int, frequent: np.ndarray):
    """Of every slice: for each bucket its packed super-k-mers with return addresses, and what is covered already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            ids, keys = (np.asarray(batch.column(n)) for n in ("id", "row"))
            for low, high in slices(texts):
                raw, offs = buffers(texts[low:high])
                starts, ends, row = word_spans(raw, offs)
                if len(row) < window:
                    continue
                valid = np.flatnonzero(row[: 1 - window] == row[window - 1:])
                if not len(valid):
                    continue
                parts = rolling(span_hashes(raw, starts, ends), part)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, parts), len(frequent) - 1)
                    rank = np.where(frequent[at] == parts, parts | _TOP, parts & ~_TOP)
                else:
                    rank = parts & ~_TOP
                least = sliding_min(rank, window - part + 1)[valid]
                new = np.ones(len(valid), bool)
                new[1:] = (valid[1:] != valid[:-1] + 1) | (least[1:] != least[:-1])
                begin = np.flatnonzero(new)
                place = np.arange(len(valid)) - np.repeat(begin, np.diff(np.append(begin, len(valid))))
                begin = np.flatnonzero(place % MAX_RUN == 0)
                last = np.append(begin[1:], len(valid)) - 1
                bucket = (mix(least[begin]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                begin, last, bucket = begin[order], last[order], bucket[order]
                joined, at = _compact(raw, starts, ends)
                first_word, last_word = valid[begin], valid[last] + window - 1
                a = at[first_word].tolist()
                b = (at[last_word] + ends[last_word] - starts[last_word]).tolist()
                seen: dict[bytes, int] = {}
                many = np.zeros(len(begin), np.uint8)
                again = np.zeros(len(begin), bool)
                packed = []
                for k in range(len(a)):
                    text = joined[a[k]: b[k]]
                    first = seen.setdefault(text, k)
                    if first != k:
                        many[first] = 1
                        again[k] = True
                    packed.append(text)
                base = np.searchsorted(row, np.arange(high - low))
                local = row[first_word]
                where = first_word - base[local]
                until = last_word + 1 - base[local]
                covered = np.flatnonzero(again | (many > 0))
                sent = np.flatnonzero(~again)
                edges = np.flatnonzero(np.diff(bucket[sent], prepend=-1))
                rows_bucket, rows_text, rows_address = [], [], []
                for lo, hi in zip(edges, np.append(edges[1:], len(sent))):
                    own = sent[lo:hi]
                    rows_bucket.append(int(bucket[own[0]]))
                    rows_text.append(zstandard.ZstdCompressor(level=3).compress(b"\n".join([packed[k] for k in own])))
                    rows_address.append(_packed([ids[low + local[own]], keys[low + local[own]], where[own].astype(np.int32), many[own]]))
                rows_covered = [None] * len(rows_bucket)
                if len(covered):
                    rows_bucket.append(int(keys[low]) % buckets)
                    rows_text.append(None)
                    rows_address.append(None)
                    rows_covered.append(_packed([
                        ids[low + local[covered]], keys[low + local[covered]], where[covered].astype(np.int32), until[covered].astype(np.int32)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows_bucket, pa.int64()), pa.array(rows_text, pa.binary()), pa.array(rows_address, pa.binary()),
                    pa.array(rows_covered, pa.binary())], names=["bucket", "texts", "addresses", "covered"])
    return run


def _equal_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``a`` and ``b`` agree over ``sizes``, some megabytes at a time."""
    equal = np.ones(len(a), bool)
    low = 0
    total = np.cumsum(sizes)
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _COMPARE_BYTES)))
        n = sizes[low:high]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum())
        same = raw[np.repeat(a[low:high] - begin, n) + step] == raw[np.repeat(b[low:high] - begin, n) + step]
        equal[low:high] = np.logical_and.reduceat(same, begin)
        low = high
    return equal


def repeated_windows(raw: np.ndarray, offs: np.ndarray, many: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, place`` of every window of the packed strings in ``raw``, and whether its words start elsewhere too.

    ``many``: rows whose windows are known to.
    """
    starts, ends, row = word_spans(raw, offs)
    h = rolling(span_hashes(raw, starts, ends), window)
    at = np.flatnonzero(row[: len(h)] == row[window - 1:]) if len(h) else np.zeros(0, np.int64)
    h = h[at]
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    group = np.cumsum(new) - 1
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][group] if len(order) else 0
    # Confirm on the bytes: runs of windows that follow each other, against the same run at their firsts.
    other = np.flatnonzero(first != np.arange(len(first)))
    if len(other):
        follows = np.zeros(len(other), bool)
        follows[1:] = (
            (other[1:] == other[:-1] + 1) & (first[other[1:]] == first[other[:-1]] + 1)
            & (at[other[1:]] == at[other[:-1]] + 1) & (at[first[other[1:]]] == at[first[other[:-1]]] + 1))
        begin = np.flatnonzero(~follows)
        last = np.append(begin[1:], len(other)) - 1
        a, b = starts[at[other[begin]]], starts[at[first[other[begin]]]]
        size_a = ends[at[other[last]] + window - 1] - a
        size_b = ends[at[first[other[last]]] + window - 1] - b
        equal = size_a == size_b
        equal[equal] = _equal_spans(raw, a[equal], b[equal], size_a[equal])
        if not equal.all():
            bad = np.repeat(~equal, np.diff(np.append(begin, len(other))))
            _regroup(raw, starts, ends, at, first, np.unique(first[other[bad]]), window)
    size = np.bincount(first, minlength=len(first))
    known = np.bincount(first, weights=many[row[at]], minlength=len(first)) > 0
    repeated = (size[first] > 1) | known[first]
    return row[at], at - np.searchsorted(row, row[at]), repeated


def _regroup(raw, starts, ends, at, first, groups, window) -> None:
    """Different windows share a hash: group them by their bytes."""
    for group in groups:
        firsts: dict[bytes, int] = {}
        for k in np.flatnonzero(first == group):
            text = raw[starts[at[k]]: ends[at[k] + window - 1]].tobytes()
            first[k] = firsts.setdefault(text, k)


def _count_bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        texts, address = [], [[], [], [], []]
        for blob, where, covered in zip(*(table.column(n).to_pylist() for n in ("texts", "addresses", "covered"))):
            if covered is not None:
                for out, a in zip(found, _unpacked(covered, _COVERED)):
                    out.append(a)
            else:
                texts.append(zstandard.ZstdDecompressor().decompress(blob))
                for out, a in zip(address, _unpacked(where, _ADDRESS)):
                    out.append(a)
        if texts:
            raw = np.frombuffer(b"\n".join(texts), np.uint8)
            ids, keys, where, many = (np.concatenate(a) for a in address)
            offs = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]])
            row, place, repeated = repeated_windows(raw, offs, many, window)
            hit = np.flatnonzero(repeated & (many[row] == 0))
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
                begin = hit[new]
                last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                for out, a in zip(found, (ids[row[begin]], keys[row[begin]], where[row[begin]] + place[begin],
                                          where[row[begin]] + place[last] + window)):
                    out.append(a)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table([pa.array(np.concatenate(a) if a else [], k) for a, k in zip(found, kinds)], names=["id", "row", "low", "high"])
    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """``id, row, low, high``: word ranges covered by windows that start elsewhere too; ranges may overlap."""
    part = min(part, window)
    rows = docs.select(id_or_last().alias("id"), row_key().alias("row"), "text")
    scratch = Scratch(docs.sparkSession, "substrings")
    counts = scratch.table(rows.select("text").mapInArrow(_frequent(window, part), "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")))
    words = counts.filter("part is null").agg(F.sum("n")).first()[0] or 0
    # At most MAX_FREQUENT hashes, the most frequent ones.
    top = counts.filter("part is not null").orderBy(F.desc("n"), "part").limit(MAX_FREQUENT).collect()
    frequent = np.sort(np.array([r["part"] for r in top], np.int64).view(np.uint64))
    buckets = max(1, -(-3 * words // BUCKET_WORDS))
    packed = rows.mapInArrow(
        _super_kmers(window, part, buckets, frequent), "bucket bigint, texts binary, addresses binary, covered binary")
    return packed.groupBy("bucket").applyInArrow(_count_bucket(window), "id bigint, row bigint, low int, high int")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, lost, kept = [], [], []
        for text, ranges in zip(strings(batch.column("text")).to_pylist(), batch.column("ranges").to_pylist()):
            words = text.encode().split()
            total.append(len(words))
            if ranges:
                keep = np.ones(len(words), bool)
                for r in ranges:
                    keep[r["low"]: r["high"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            lost.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
            pa.array([k.decode() for k in kept], pa.string()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` of every row of ``docs``."""
    ranges = repeated_ranges(docs, window, part).groupBy("id", "row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", id_or_last().alias("__id"), row_key().alias("__row"))
    marked = rows.join(ranges, (F.col("__id") == F.col("id")) & (F.col("__row") == F.col("row")), "left")
    return marked.select("doc_id", "text", "ranges").mapInArrow(
        _remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
