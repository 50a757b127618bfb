"""Ranked lexical search by presence masks: the best documents of each item under an integer term-weight score.

1. *Postings.* Each text is cut into terms once, in the worker. A document keeps the terms that a fixed-size filter of
   the items' terms lets pass (2^20 bits of a term hash, whatever the number of items; what passes wrongly falls out of
   the exact joins below) with their occurrences. This narrow table is written, and all later steps read it alone.
2. *Weights* come from all documents: their number, their length, and the documents of each asked term.
3. *Blocks.* Documents and items are dealt evenly over blocks of bounded size; a block of documents meets each block of
   items in one task. There each term is a bitmap over the block's documents. An item stacks the bitmaps of its terms;
   turned by ninety degrees they are the documents' presence masks, and documents with one mask form a group.
4. *Ranking.* The bound of a mask is the sum over its terms of the largest contribution that any document of the block
   has for the term. Groups are scored exactly by falling bound, until the bound of the next is below the k-th score
   found. Documents of equal bound are still scored, since a smaller id wins a tie. The best k of each block meet in
   one ranking for each item, whose first cut Spark makes before the shuffle.

Defined results: a null or empty text, or one without terms, is no document (it does not count) and no item. Documents
are rows: equal rows are ranked each by itself. Equal rows of items are one item; one id with two texts is two items.
A null document id comes last among equal scores. Other columns are ignored, whatever their names. Scores are 64-bit.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, Scratch

#: Bits of the filter of asked terms; a power of two.
FILTER_BITS = 1 << 20
#: About how many postings a block of documents holds, and how many items a block of items.
BLOCK_POSTINGS, BLOCK_ITEMS = 1 << 20, 256
#: Bytes of text that are cut into terms at a time.
PIECE_BYTES = 1 << 20

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a term as they are, A-Z small, all others a blank. Bytes from 128 up are always part of a term.
_FOLD = bytes(
    b + 32 if 65 <= b < 91 else b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _SMALL), F.lit(_TERM), 0)


def count_terms(text: str) -> Counter:
    """Occurrences of each term (UTF-8 bytes); long texts go piece by piece."""
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    counts: Counter = Counter()
    low = 0
    while low < len(raw):
        high = raw.find(b" ", low + PIECE_BYTES)
        high = len(raw) if high < 0 else high
        counts.update(raw[low:high].split())
        low = high
    return counts


def _filter_of(asked: DataFrame) -> np.ndarray:
    """The filter as bits; at most ``FILTER_BITS / 64`` rows reach the driver."""
    place = F.crc32(F.encode("term", "UTF-8")).bitwiseAND(FILTER_BITS - 1)
    rows = (asked.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).collect())
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for row in rows:
        words[row.word] = row.bits
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _postings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows with a term: id, terms in all, asked terms with occurrences, and a number no other row has."""
    packed = np.packbits(bits).tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool).tolist()
        mask, crc = FILTER_BITS - 1, zlib.crc32
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, totals, spots, sizes, terms, times = [], [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                counts = count_terms(text) if text else None
                if not counts:
                    continue
                for term, n in counts.items():
                    if passes[crc(term) & mask]:
                        terms.append(term)
                        times.append(n)
                ids.append(doc)
                totals.append(counts.total())
                spots.append(row)
                sizes.append(len(terms))
                row += 1
            offsets = pa.array(sizes, pa.int32())
            yield pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(totals, pa.int64()), "spot": pa.array(spots, pa.int64()),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            })

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        read, "doc_id bigint, n bigint, spot bigint, terms array<string>, times array<bigint>")


def mask_groups(rows: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group documents by the terms they hold, from one packed bitmap a term.

    Returns the documents with any term, the group of each, and the masks as terms x groups.
    """
    some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), count=documents))
    bits = np.unpackbits(rows, axis=1, count=documents)[:, some]
    packed = np.packbits(bits, axis=0)
    wide = np.zeros((-(-len(packed) // 8) * 8, len(some)), np.uint8)
    wide[: len(packed)] = packed
    group = np.zeros(len(some), np.int64)
    first = np.zeros(min(1, len(some)), np.int64)
    for word in np.ascontiguousarray(wide.T).view(np.uint64).T:
        values, code = np.unique(word, return_inverse=True)
        _, first, group = np.unique(group * len(values) + code, return_index=True, return_inverse=True)
    return some, group, bits[:, first]


def _best_of_item(codes: np.ndarray, block: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the block) and scores of an item's best ``k``."""
    starts, docs, value = block["starts"], block["docs"], block["value"]
    found, group, masks = mask_groups(block["bitmaps"][codes], block["n"])
    bound = block["largest"][codes] @ masks.astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    sizes = np.bincount(group, minlength=len(bound))[order]
    members = np.argsort(_ranks(order)[group], kind="stable")
    ends = np.cumsum(sizes)
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, wanted = 0, max(64, k)
    while done < len(order):
        if len(scores) == k and bound[order[done]] < scores[-1]:
            break
        stop = min(len(order), int(np.searchsorted(ends, wanted)) + 1)
        stop = max(stop, done + 1)
        new = np.sort(found[members[ends[done] - sizes[done]: ends[stop - 1]]])
        fresh = np.zeros(len(new), np.int64)
        for code in codes:
            low, high = starts[code], starts[code + 1]
            at = np.minimum(np.searchsorted(docs[low:high], new), high - low - 1)
            hit = docs[low:high][at] == new
            fresh[hit] += value[low:high][at[hit]]
        places, scores = np.concatenate([places, new]), np.concatenate([scores, fresh])
        best = np.lexsort((block["ids"][places], -scores))[:k]
        places, scores = places[best], scores[best]
        done, wanted = stop, 2 * wanted
    return places[scores > 0], scores[scores > 0]


def _ranks(order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _rank_block(documents: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """One block of documents against one block of items."""
    out: dict[str, list] = {"item": [], "doc_id": [], "nobody": [], "score": []}
    if len(documents) and len(items):
        asked, weights = items["terms"].combine_chunks(), items["weights"].combine_chunks()
        vocabulary = pc.unique(asked.flatten())
        item_codes = pc.index_in(asked.flatten(), vocabulary).to_numpy()
        weight = np.zeros(len(vocabulary), np.int64)
        weight[item_codes] = weights.flatten().to_numpy()

        held = documents["terms"].combine_chunks()
        owner = np.repeat(np.arange(len(documents)), pc.list_value_length(held).to_numpy())
        code = pc.index_in(held.flatten(), vocabulary).fill_null(-1).to_numpy()
        times = documents["times"].combine_chunks().flatten().to_numpy()
        asked_for = np.flatnonzero(code >= 0)
        asked_for = asked_for[np.argsort(code[asked_for], kind="stable")]
        code, owner, times = code[asked_for].astype(np.int64), owner[asked_for], times[asked_for]
        value = weight[code] * (1_000_000_000 * times // (1000 * times + 8 * documents["m"].to_numpy()[owner]))
        starts = np.searchsorted(code, np.arange(len(vocabulary) + 1))
        present = np.zeros(len(vocabulary), bool)
        present[code] = True
        largest = np.zeros(len(vocabulary), np.int64)
        if len(code):
            largest[present] = np.maximum.reduceat(value, starts[:-1][present])
        bitmaps = np.zeros((len(vocabulary), -(-len(documents) // 8)), np.uint8)
        line = np.zeros(len(documents), bool)
        for term in np.flatnonzero(present):
            line[:] = False
            line[owner[starts[term]: starts[term + 1]]] = True
            bitmaps[term] = np.packbits(line)
        names = documents["doc_id"].combine_chunks()
        block = {"starts": starts, "docs": owner, "value": value, "largest": largest, "bitmaps": bitmaps, "n": len(documents),
                 "ids": names.fill_null(LAST_ID).to_numpy()}
        nobody = names.is_null().to_numpy(zero_copy_only=False)
        offsets = asked.offsets.to_numpy() - asked.offsets[0].as_py()
        for row, item in enumerate(items["item"].to_pylist()):
            codes = item_codes[offsets[row]: offsets[row + 1]]
            codes = codes[present[codes]]
            if len(codes):
                places, scores = _best_of_item(codes, block, k)
                out["item"] += [item] * len(places)
                out["doc_id"] += block["ids"][places].tolist()
                out["nobody"] += nobody[places].tolist()
                out["score"] += scores.tolist()
    types = {"item": pa.int64(), "doc_id": pa.int64(), "nobody": pa.bool_(), "score": pa.int64()}
    return pa.table({name: pa.array(out[name], kind) for name, kind in types.items()})


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = scratch.table(
        items.select("item_id", "text").filter("text IS NOT NULL").distinct()
        .select(F.monotonically_increasing_id().alias("item"), "item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
        .filter("size(terms) > 0"))
    terms = asked.select("item", F.explode("terms").alias("term"))
    held = scratch.table(_postings(docs, _filter_of(terms)))
    totals = held.agg(
        F.count(F.lit(1)).alias("all_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_terms"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    n_docs, n_terms = totals.all_docs, totals.all_terms
    doc_blocks = totals.postings // BLOCK_POSTINGS + 1
    item_blocks = asked.count() // BLOCK_ITEMS + 1

    frequency = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = scratch.table(
        terms.join(frequency, "term").groupBy("item")
        .agg(F.collect_list(F.struct("term", weight.cast("bigint").alias("weight"))).alias("pairs"))
        .select("item", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights")))

    left = (
        held.filter("size(terms) > 0")
        .select("doc_id", "terms", "times", F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {max(1, n_terms)}L)").alias("m"),
                F.pmod(F.xxhash64("spot"), F.lit(doc_blocks)).alias("doc_block"),
                F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("item_block")))
    right = weighted.select(
        "item", "terms", "weights", F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int").alias("item_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(doc_blocks - 1).cast("bigint"))).alias("doc_block"))
    keys = ["doc_block", "item_block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda documents, items: _rank_block(documents, items, k), "item bigint, doc_id bigint, nobody boolean, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .join(asked.select("item", "item_id"), "item")
        .select("item_id", "rank", F.when(~F.col("nobody"), F.col("doc_id")).alias("doc_id"), "score"))
