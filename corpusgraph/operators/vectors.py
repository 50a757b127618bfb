"""Vector rows and exact top-k search for whole tables of questions.

Vectors are scored block by block with a matrix product inside tasks; each task gives only its best k
for each question, so no question-vector pairs are ever made as rows. Scores are compared at six
digits, which makes ranks independent of summation order; ties go to the lesser chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import Embedder, HashedCounts
from ..functions.text import clip
from ..options import DEFAULTS, Options
from ..session import run_table
from .skew import salted_join

# Vectors in a shard and in a task's group, questions in a block, and questions that may be sent to
# every task.
SHARD_ROWS = 16384
GROUP_ROWS = 8192
BLOCK_QUERIES = 2048
BLOCK_KEYWORDS = 1_000
# Hits that a task gives and vectors that it looks at in a search of the whole corpus.
CORPUS_HITS = 2 ** 19
CORPUS_VECTORS = 65536
BROADCAST_QUERIES = 2048
_SLICE = 256
# Vectors that a slice of questions is compared with at a time.
_COLUMNS = 1024
# The first block is this many times as wide as the hits wanted, so that later vectors meet a high bar.
_FIRST = 64
# Share of the places up to which a slice's own places are copied from the vectors.
_FEW = 0.75

# Question-vector pairs up to which a part is searched together with others, and pairs looked at together.
_SMALL_PART = 4096
_PAIRS = 16384

_HITS = "query_id bigint, chunk_id string, score double, k int"


def vector_rows(chunks: DataFrame, embedder: Embedder | None = None, opts: Options = DEFAULTS) -> DataFrame:
    """One vector for each chunk, with the start of its text."""
    embedded = (embedder or HashedCounts()).encode(chunks, "text", "embedding")
    return embedded.select(
        "document_id", "chunk_id", "chunk_seq", clip("text", opts.vector_text_chars).alias("text"),
        "source", "page", "embedding",
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, -1)


def _scores(queries: np.ndarray, vectors: np.ndarray, cosine: bool) -> np.ndarray:
    """Scores at six digits of every question with every vector."""
    scores = queries @ vectors.T
    if cosine:
        product = np.einsum("ij,ij->i", queries, queries)[:, None] * np.einsum("ij,ij->i", vectors, vectors)[None, :]
        scores = np.divide(scores, np.sqrt(product), out=np.zeros_like(scores), where=product > 0)
    return np.floor(scores * 1e6 + 0.5) / 1e6


def _pair_scores(queries: np.ndarray, vectors: np.ndarray, cosine: bool) -> np.ndarray:
    """The same for pairs of rows."""
    scores = np.einsum("ij,ij->i", queries, vectors)
    if cosine:
        product = np.einsum("ij,ij->i", queries, queries) * np.einsum("ij,ij->i", vectors, vectors)
        scores = np.divide(scores, np.sqrt(product), out=np.zeros_like(scores), where=product > 0)
    return np.floor(scores * 1e6 + 0.5) / 1e6


def _highest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row; of equal ones at the end, the first columns where they are many."""
    k = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    kept = scores >= floor
    if np.count_nonzero(kept) > 2 * k * len(scores):
        above = scores > floor
        equal = kept & ~above
        kept = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - np.count_nonzero(above, axis=1)[:, None]))
    return np.nonzero(kept)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(queries: np.ndarray, ks: np.ndarray, vectors: np.ndarray, cosine: bool):
    """Row numbers of questions and vectors, and scores, of the best k vectors of each question.

    ``vectors`` are in the order of their ids, and are looked at a block of columns after the other: a later vector needs a
    higher score than the k-th one held, so equal scores, however many, are passed over by one comparison. Places where no question
    of a slice has a value add nothing to its scores and are left out of that comparison; questions with values in the same
    places share a slice.
    """
    found = []
    alike = np.lexsort(np.packbits(queries != 0, axis=1).T)
    queries, ks = queries[alike], ks[alike]
    several = len(vectors) > _COLUMNS
    directions = _unit(vectors) if several and cosine else vectors
    room = np.empty(_SLICE * _COLUMNS) if several else None
    longest = 1.0 if cosine or not several else float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))
    for start in range(0, len(queries), _SLICE):
        q, k = queries[start:start + _SLICE], ks[start:start + _SLICE]
        most = int(k.max())
        width = max(_COLUMNS, _FIRST * most)
        scores = _scores(q, vectors[:width], cosine)
        rows, cols, value, bar = _cut(*_with_value(scores, most), k)
        turned, held = _unit(q) if several and cosine else q, directions
        if several:
            used = np.flatnonzero(q.any(axis=0))
            if len(used) <= _FEW * q.shape[1]:
                turned, held = np.ascontiguousarray(turned[:, used]), np.ascontiguousarray(directions[:, used])
        # A score at six digits is above the bar only from half a digit on; less what sums may differ by.
        slack = 1e-9 + 1e-12 * (1.0 if cosine else np.sqrt(np.einsum("ij,ij->i", q, q)) * longest)
        later, waiting = [], 0
        for low in range(width, len(vectors), _COLUMNS):
            part = held[low:low + _COLUMNS]
            likely = _products(turned, part, room)
            hot = np.flatnonzero(likely >= (bar + 0.5e-6 - slack)[:, None])
            if not len(hot):
                continue
            r, c = np.divmod(hot, len(part))
            part = vectors[low:low + _COLUMNS]
            if len(r) > 4 * most * len(q):
                r, c, v = _with_value(_scores(q, part, cosine), most)
            else:
                v = _pair_scores(q[r], part[c], cosine)
            above = v > bar[r]
            later.append((r[above], c[above] + low, v[above]))
            waiting += np.count_nonzero(above)
            if waiting > most * len(q):
                rows, cols, value, bar = _cut(*[np.concatenate(x) for x in zip((rows, cols, value), *later)], k)
                later, waiting = [], 0
        if later:
            rows, cols, value, bar = _cut(*[np.concatenate(x) for x in zip((rows, cols, value), *later)], k)
        found.append((rows + start, cols, value))
    rows, cols, value = (np.concatenate(part) for part in zip(*found))
    rows = alike[rows]
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], value[order]


def _products(queries: np.ndarray, vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """All products of two blocks of rows, in memory that is used again."""
    shape = (len(queries), len(vectors))
    return np.matmul(queries, vectors.T, out=room[:shape[0] * shape[1]].reshape(shape))


def _with_value(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols = _highest(scores, k)
    return rows, cols, scores[rows, cols]


def _cut(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, ks: np.ndarray):
    """The best k of each row in order, and the score that the next one must pass."""
    order = np.lexsort((cols, -value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = place < ks[rows]
    rows, cols, value, place = rows[keep], cols[keep], value[keep], place[keep]
    bar = np.full(len(ks), -np.inf)
    last = place == ks[rows] - 1
    bar[rows[last]] = value[last]
    return rows, cols, value, bar


def _hits_table(query_ids, ks, ids, rows, cols, scores) -> pa.Table:
    return pa.table({
        "query_id": pa.array(query_ids[rows], pa.int64()),
        "chunk_id": pa.array(ids[cols], pa.string()),
        "score": pa.array(scores, pa.float64()),
        "k": pa.array(ks[rows], pa.int32()),
    })


def _rows_by_part(parts: np.ndarray) -> dict[int, np.ndarray]:
    """Row numbers of each part number."""
    order = np.argsort(parts, kind="stable")
    values, starts = np.unique(parts[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, starts[1:])))


def _best_of_small(queries: np.ndarray, ks: np.ndarray, vectors: np.ndarray, starts: np.ndarray, counts: np.ndarray, cosine: bool):
    """The same as :func:`_best` for many small parts at once: question i meets ``counts[i]`` vectors from ``starts[i]`` on."""
    found = []
    ends = np.cumsum(counts)
    low = 0
    while low < len(queries):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - counts[low] + _PAIRS, side="right")))
        n = counts[low:high]
        rows = np.repeat(np.arange(high - low), n)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[low:high], n)
        value = _pair_scores(queries[low:high][rows], vectors[cols], cosine)
        rows, cols, value, _ = _cut(rows, cols, value, ks[low:high])
        found.append((rows + low, cols, value))
        low = high
    return tuple(np.concatenate(part) for part in zip(*found))


def _search_group(cosine: bool):
    """Search of one task's group: many parts, each with its own questions and vectors.

    Questions and vectors are sorted by part, and vectors of a part by id. Small parts, of which a group has thousands, are
    searched together.
    """
    def search(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and vectors.num_rows:
            names = pa.chunked_array([*queries["part"].chunks, *vectors["v_part"].chunks]).combine_chunks()
            codes = names.dictionary_encode().indices.to_numpy()
            q_codes, v_codes = codes[:queries.num_rows], codes[queries.num_rows:]
            by_part = np.argsort(q_codes, kind="stable")
            by_id = pc.sort_indices(vectors["v_chunk_id"]).to_numpy()
            by_id = by_id[np.argsort(v_codes[by_id], kind="stable")]
            q_codes, v_codes = q_codes[by_part], v_codes[by_id]
            query_ids, ks = queries["query_id"].to_numpy()[by_part], queries["k"].to_numpy()[by_part]
            ids = np.asarray(vectors["v_chunk_id"].to_pylist(), dtype=object)[by_id]
            asked, held = _matrix(queries["embedding"])[by_part], _matrix(vectors["v_embedding"])[by_id]
            starts = np.searchsorted(v_codes, q_codes, side="left")
            counts = np.searchsorted(v_codes, q_codes, side="right") - starts
            alike = np.bincount(q_codes)[q_codes]
            few = np.flatnonzero((counts > 0) & (counts * alike <= _SMALL_PART))
            if len(few):
                rows, cols, scores = _best_of_small(asked[few], ks[few], held, starts[few], counts[few], cosine)
                found.append((few[rows], cols, scores))
            many = np.flatnonzero(counts * alike > _SMALL_PART)
            for first in many[np.unique(q_codes[many], return_index=True)[1]]:
                q, v = slice(first, first + alike[first]), slice(starts[first], starts[first] + counts[first])
                rows, cols, scores = _best(asked[q], ks[q], held[v], cosine)
                found.append((rows + first, cols + starts[first], scores))
        if not found:
            return _hits_table(np.array([], np.int64), np.array([], np.int32), np.array([], object), *[np.array([], np.int64)] * 3)
        return _hits_table(query_ids, ks, ids, *[np.concatenate(x) for x in zip(*found)])

    return search


def _ranked(hits: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return (
        hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("k"))
        .select("query_id", "chunk_id", "score", "rank")
    )


def _blocked(queries: DataFrame, keys: list[str]) -> DataFrame:
    """Number blocks of questions of a bounded size inside each group."""
    sizes = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_QUERIES))
    return salted_join(queries, blocks, keys, ["query_id"], rows="n").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))


def scoped_topk(queries: DataFrame, vectors: DataFrame, cosine: bool = True) -> DataFrame:
    """Best k vectors of each question's own document: filter first, so the result is exact.

    ``queries``: query_id, document_id, k, embedding. A document is searched in shards of its chunk
    sequence, so one very large document is spread over many tasks.
    """
    wanted = queries.filter("document_id IS NOT NULL AND embedding IS NOT NULL").select(
        "query_id", "document_id", F.col("k").cast("int"), "embedding")
    vectors = vectors.filter("embedding IS NOT NULL")
    # Both are read several times.
    blocked = run_table(_blocked(wanted, ["document_id"]), "asked-blocks")
    sharded = vectors.select(
        "document_id", "chunk_id", F.floor(F.col("chunk_seq") / SHARD_ROWS).alias("shard"), "embedding"
    )
    shards = run_table(sharded.groupBy("document_id", "shard").agg(F.count(F.lit(1)).alias("rows")), "shards")
    left = blocked.join(shards, "document_id").select("document_id", "shard", "block", "query_id", "k", "embedding")
    blocks = blocked.select("document_id", "block").distinct()
    right = sharded.join(blocks, "document_id").select("document_id", "shard", "block", "chunk_id", "embedding")
    # Vectors as often as they are repeated for blocks of questions.
    repeats = shards.join(blocked.select("document_id", "blocks").distinct(), "document_id").agg(
        F.sum(F.col("rows") * F.col("blocks"))).first()[0]
    return _search_groups(left, right, ["document_id", "shard", "block"], int(repeats or 0), cosine)


def _search_groups(
    left: DataFrame, right: DataFrame, keys: list[str], n_vectors: int, cosine: bool, own: Column | None = None,
) -> DataFrame:
    """Match parts of questions with parts of vectors that have the same keys.

    Small parts share a task's group, so that a document of a few chunks costs no call of its own; ``own`` numbers the groups
    where each part has one to itself. The sides may come from one table, so their columns get different names.
    """
    groups = max(left.sparkSession.sparkContext.defaultParallelism, -(-n_vectors // GROUP_ROWS))
    part = F.concat_ws("#", *[F.col(k).cast("string") for k in keys])
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)) if own is None else own
    asked = left.select(group.alias("group"), part.alias("part"), "query_id", "k", "embedding")
    held = right.select(
        group.alias("v_group"), part.alias("v_part"), F.col("chunk_id").alias("v_chunk_id"), F.col("embedding").alias("v_embedding")
    )
    return _ranked(asked.groupBy("group").cogroup(held.groupBy("v_group")).applyInArrow(_search_group(cosine), _HITS))


def corpus_topk(queries: DataFrame, vectors: DataFrame, cosine: bool = True) -> DataFrame:
    """Best k vectors of the whole corpus for each question: query_id, chunk_id, score, rank.

    Up to ``BROADCAST_QUERIES`` questions go to every task, and vectors are searched where they are
    read. More questions are matched in blocks against hashed shards of vectors.
    """
    wanted = queries.filter("embedding IS NOT NULL").select("query_id", F.col("k").cast("int").alias("k"), "embedding")
    points = vectors.filter("embedding IS NOT NULL").select("chunk_id", "embedding")
    if wanted.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        return _ranked(_search_in_place(wanted, points, cosine))
    asked = wanted.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).first()
    n_points, blocks = points.count(), max(1, -(-asked["n"] * max(1, asked["k"] or 0) // CORPUS_HITS))
    # Every vector travels once for each block of questions, every question and its hits once for each shard of vectors: both
    # are as large as a task can hold, and smaller only where there would be too few tasks.
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n_points // CORPUS_VECTORS), min(-(-tasks // blocks), -(-n_points // (8 * _COLUMNS))))
    left = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    right = points.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    )
    whole = (F.col("block") * shards + F.col("shard")).cast("bigint")
    return _search_groups(left, right, ["shard", "block"], 0, cosine, whole)


def _search_in_place(wanted: DataFrame, points: DataFrame, cosine: bool) -> DataFrame:
    table = wanted.toArrow()
    if not table.num_rows:
        return wanted.sparkSession.createDataFrame([], _HITS)
    shared = wanted.sparkSession.sparkContext.broadcast(
        (table["query_id"].to_numpy(), table["k"].to_numpy(), _matrix(table["embedding"]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, ks, matrix = shared.value
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch["chunk_id"].to_pylist(), dtype=object)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            rows, cols, scores = _best(matrix, ks, _matrix(batch["embedding"])[order], cosine)
            found = (rows, ids[cols], scores)
            if held is not None:
                rows, names, scores = (np.concatenate(p) for p in zip(held, found))
                order = np.lexsort((np.argsort(np.argsort(names, kind="stable")), -scores, rows))
                rows, names, scores = rows[order], names[order], scores[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
                keep = place < ks[rows]
                found = (rows[keep], names[keep], scores[keep])
            held = found
        if held is not None:
            rows, names, scores = held
            yield from _hits_table(query_ids, ks, names, rows, np.arange(len(names)), scores).to_batches()

    return points.mapInArrow(run, _HITS)


def filtered_topk(queries: DataFrame, vectors: DataFrame, cosine: bool = True) -> DataFrame:
    """Best k vectors whose text holds the question's ``keyword`` (any case): filter first, so the result is exact.

    The asked keywords meet every text in blocks of ``BLOCK_KEYWORDS``, without embeddings; the texts that hold a keyword
    are the scope in which its questions are searched, and get their embeddings then, once.
    """
    asked = run_table(
        queries.select("query_id", F.lower("keyword").alias("document_id"), "k", "embedding").filter("document_id is not null"), "asked")
    words = asked.select(F.col("document_id").alias("word")).distinct()
    blocks = max(1, -(-words.count() // BLOCK_KEYWORDS))
    lists = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("list")).agg(F.collect_list("word").alias("words"))
    texts = vectors.select("chunk_id", F.lower("text").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = run_table(texts.join(lists, F.col("block") == F.col("list")).select(
        "chunk_id", F.explode(F.filter("words", lambda w: F.contains(F.col("low"), w))).alias("document_id")), "keyword-pairs")
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, pairs.count())))
    held = run_table(pairs.join(vectors.select("chunk_id", "embedding"), "chunk_id"), "keyword-vectors")
    return scoped_topk(asked, held.withColumn("chunk_seq", spread), cosine)


def overscan_topk(queries: DataFrame, vectors: DataFrame, cosine: bool = True) -> DataFrame:
    """Filtered search as an index without a text filter does it: the best 2k, then the keyword; may find fewer than k."""
    wide = corpus_topk(queries.withColumn("k", F.col("k") * 2), vectors, cosine)
    texts = vectors.select("chunk_id", F.lower("text").alias("low"))
    kept = wide.join(queries.select("query_id", F.col("k").alias("k"), F.lower("keyword").alias("keyword")), "query_id").join(
        texts, "chunk_id"
    ).filter(F.col("low").contains(F.col("keyword")))
    return _ranked(kept.select("query_id", "chunk_id", "score", "k"))


def post_filtered_topk(queries: DataFrame, vectors: DataFrame, cosine: bool = True) -> DataFrame:
    """Scoped search as an index without a document filter does it: best 15k of the corpus, then the scope."""
    scoped = queries.filter("document_id is not null")
    wide = corpus_topk(scoped.withColumn("k", F.col("k") * 15), vectors, cosine)
    kept = wide.join(scoped.select("query_id", "document_id", "k"), "query_id").join(
        vectors.select("chunk_id", "document_id"), ["chunk_id", "document_id"], "left_semi"
    )
    return _ranked(kept.select("query_id", "chunk_id", "score", "k"))


def chunk_ids(hits: DataFrame) -> DataFrame:
    return hits.filter("chunk_id is not null").select("query_id", "rank", "chunk_id")
