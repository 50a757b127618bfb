"""Near-duplicate documents from bottom-k sketches of one hash function, confirmed by exact Jaccard similarity.

A document's set holds the distinct ``shingle``-word shingles of its lower-cased text (A-Z only). Documents with
equal sets form a class, and the smallest id stands for it. Of every class the ``RETAINED`` least hash values are
retained in order. Inverted lists hold the classes that share ``RUN`` neighbouring retained values: two sets with a
similarity of 0.8 or more differ in a fifth of their union at most, so the union in hash order, and with it both
sets, has a run of four shared values (by the pigeonhole principle where the sets are retained whole and the union
has more than 15 values; two values for smaller ones, which use runs of two). Of larger sets the first 64 values of the
union are a random sample; that none of their runs of four is shared has a probability of about 0.8^64, or 1e-6, at a
similarity of exactly 0.8, and quickly less above. Random texts share no such run, common as their single values are.

Lists of up to ``LIGHT`` classes give all their pairs. A longer list gives pairs with its least class only. All
pairs are estimated from the union sketch and confirmed on the full sets, in blocks of bounded size; links become
components. What then remains of the long lists are their members outside the main component: each is compared with
all members of other components, again in blocks and by estimate first, so that no link is lost. Copies cost a class,
not pairs, and a large group of near copies costs one comparison for each member, plus the stragglers'.

Defined results: null or empty texts have an empty set and link with nothing. Rows without an id link with nothing,
have no component and stay. Rows that share an id are one node, linked by any of their sets. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch, buffers, lowered, mix, signed, slices, span_hashes, strings, word_spans

SHINGLE = 5
SIMILARITY = 80
RETAINED = 64
RUN, SMALL_RUN = 4, 2
# Sets up to SMALL_UP values use runs of two, sets from LARGE_FROM on runs of four; their ranges overlap so that any
# two sets of a similar size share a kind.
SMALL_UP, LARGE_FROM = 18, 16
LIGHT = 32
BLOCK = 256
ESTIMATE = 256
_SEED = {SMALL_RUN: np.uint64(0x5851F42D4C957F2D), RUN: np.uint64(0x14057B7EF767814F)}
_LIST_ROWS = 200_000


def _chained(h: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    """Order-dependent hash of every ``size`` consecutive values."""
    n = len(h) - size + 1
    out = np.full(n, seed, np.uint64)
    for k in range(size):
        out = mix(out + h[k: k + n])
    return out


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for low, high in slices(texts):
        raw, offs = buffers(texts[low:high])
        raw = lowered(raw)
        starts, ends, row = word_spans(raw, offs)
        h = span_hashes(raw, starts, ends)
        begin = np.searchsorted(row, np.arange(high - low + 1))
        whole = _chained(h, shingle, np.uint64(shingle)) if len(h) >= shingle else np.zeros(0, np.uint64)
        for a, b in zip(begin[:-1], begin[1:]):
            if b - a >= shingle:
                yield np.unique(whole[a: b - shingle + 1])
            elif b > a:
                yield _chained(h[a:b], b - a, np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _run_keys(values: np.ndarray) -> np.ndarray:
    kept = values[:RETAINED]
    keys = []
    if SMALL_RUN * 2 <= len(values) <= SMALL_UP:
        keys.append(_chained(kept, SMALL_RUN, _SEED[SMALL_RUN]))
    if len(values) >= LARGE_FROM:
        keys.append(_chained(kept, RUN, _SEED[RUN]))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for values in shingle_sets(strings(batch.column("text")), shingle):
                digest = xxhash.xxh3_128_intdigest(values.tobytes())
                n.append(len(values))
                high.append((digest >> 64) - 2**63)
                low.append((digest & (2**64 - 1)) - 2**63)
                keys.append(signed(_run_keys(values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "d1", "d2", "keys"])
    return run


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, id): pairs of each short list; of a long one (least, member), marked ``hot``."""
    def emit(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), hot))], names=["a", "b", "hot"])

    def lists(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, len(keys)))
        a, b = [], []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= LIGHT)]):
            members = ids[begin[sizes == size][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            a.append(members[:, i].ravel())
            b.append(members[:, j].ravel())
        if a:
            yield emit(np.concatenate(a), np.concatenate(b), False)
        long = sizes > LIGHT
        if long.any():
            member = np.repeat(long, sizes)
            yield emit(np.repeat(ids[begin[long]], sizes[long]), ids[member], True)

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, rows = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column("key")), np.asarray(batch.column("id"))))
            rows += batch.num_rows
            if rows >= _LIST_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, rows = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    keys, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_key = long_least = None  # of a long list that goes on
    for more_keys, more_ids in chunks():
        keys, ids = np.concatenate([keys, more_keys]), np.concatenate([ids, more_ids])
        if long_key is not None:
            n = int(np.searchsorted(keys, long_key, "right"))
            yield emit(np.full(n, long_least), ids[:n], True)
            keys, ids = keys[n:], ids[n:]
            if not len(keys):
                continue
            long_key = None
        last = int(np.searchsorted(keys, keys[-1], "left"))
        yield from lists(keys[:last], ids[:last])
        keys, ids = keys[last:], ids[last:]
        if len(keys) > LIGHT:
            long_key, long_least = keys[0], ids[0]
            yield emit(np.full(len(ids), long_least), ids, True)
            keys, ids = keys[:0], ids[:0]
    yield from lists(keys, ids)


def similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether 100 * intersection >= similarity * union: sizes first, then the union sketch, then the full sets."""
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if len(a) > ESTIMATE and len(b) > ESTIMATE:
        both = np.concatenate([a[:ESTIMATE], b[:ESTIMATE]])
        both.sort()
        shared = both[:-1][both[1:] == both[:-1]]
        distinct = both[np.concatenate([[True], both[1:] != both[:-1]])]
        inside = np.searchsorted(shared, distinct[ESTIMATE - 1], "right")
        p = similarity / 100
        if inside / ESTIMATE < p - 6 * (p * (1 - p) / ESTIMATE) ** 0.5:
            return False
    both = np.concatenate([a, b])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= similarity * (len(a) + len(b) - n)


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _sets_of(table: pa.Table) -> dict[int, list[np.ndarray]]:
    out: dict[int, list[np.ndarray]] = {}
    for i, values in zip(table.column("id").to_pylist(), table.column("values")):
        out.setdefault(i, []).append(np.frombuffer(values.as_buffer(), np.uint64))
    return out


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _confirm(similarity: int):
    """Links among candidate pairs; a pair that earlier links of the block already connect needs no look."""
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        forest, of = _Forest(), _sets_of(sets)
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            if forest.root(a) != forest.root(b) and any(similar(x, y, similarity) for x in of.get(a, ()) for y in of.get(b, ())):
                forest.join(a, b)
        # Each member beside the least of its tree: stars take fewer rounds to connect than paths.
        return _links([(forest.root(x), x) for x in list(forest.up) if forest.root(x) != x])
    return run


def _confirm_stragglers(similarity: int):
    """Links between stragglers and members of other components."""
    def run(members: pa.Table, sets: pa.Table) -> pa.Table:
        found, forest, of = [], _Forest(), _sets_of(sets)
        rows = list(zip(*(members.column(n).to_pylist() for n in ("member", "component", "left", "right"))))
        for i, c, _, _ in rows:
            forest.join(i, c)
        for x, _, left, _ in rows:
            if left:
                for y, _, _, right in rows:
                    if right and forest.root(x) != forest.root(y) and any(similar(p, q, similarity) for p in of.get(x, ()) for q in of.get(y, ())):
                        forest.join(x, y)
                        found.append((x, y))
        return _links(found)
    return run


def _ship(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, groups = strings(batch.column("text")), batch.column("groups")
            ids = batch.column("id")
            for k, values in enumerate(shingle_sets(texts, shingle)):
                to = groups[k].values
                raw = values.tobytes()
                for low in range(0, len(to), 64):
                    part = to[low: low + 64]
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array([ids[k].as_py()] * len(part), pa.int64()), pa.array([raw] * len(part), pa.binary())],
                        names=["group", "id", "values"])
    return run


def _blocks(column: str, n: str) -> Column:
    return F.pmod(F.xxhash64(column), F.greatest(F.ceil(F.col(n) / BLOCK).cast("bigint"), F.lit(1)))


def _shipped(rows: DataFrame, needs: DataFrame, shingle: int) -> DataFrame:
    """``group, id, values``: the full sets of ``needs`` (``id, group``)."""
    # One plan at every size: texts are shuffled by id once, and never sorted.
    lists = needs.groupBy("id").agg(F.collect_set("group").alias("groups")).hint("shuffle_hash")
    return rows.join(lists, "id").select("id", "text", "groups").mapInArrow(
        _ship(shingle), "group bigint, id bigint, values binary")


def _grouped(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b, group``: the group in which a pair is confirmed.

    A pair belongs to the least class that its ``a`` is paired with; the documents of such a home are split in
    blocks, and a block pair with candidates is one group.
    """
    ends = pairs.select(F.col("b").alias("id"), F.col("a").alias("home")).unionByName(
        pairs.select(F.col("a").alias("id"), F.col("a").alias("home")))
    homes = ends.groupBy("id").agg(F.min("home").alias("home"))
    homed = scratch.table(pairs.join(homes.withColumnRenamed("id", "a"), "a"))
    # Written, so that the plan knows its size and splits the pairs of a large home.
    sizes = scratch.table(homed.groupBy("home").agg(F.approx_count_distinct("b").alias("size")))
    return homed.join(sizes, "home").select(
        "a", "b", F.xxhash64("home", _blocks("a", "size"), _blocks("b", "size")).alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``; ``similarity`` in percent, 80 or more."""
    if similarity < 80:
        raise ValueError("runs of retained values are proven for a similarity of 80 percent or more")
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    sketches = scratch.table(rows.mapInArrow(_sketches(shingle), "id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"))
    known = sketches.filter("id is not null and n > 0")
    classes = scratch.table(known.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))

    lists = classes.select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    found = scratch.table(
        lists.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_list_pairs, "a bigint, b bigint, hot boolean")
        .groupBy("a", "b").agg(F.max("hot").alias("hot")))
    pairs = found.filter("a <> b").select("a", "b")
    grouped = _grouped(pairs, scratch)
    needs = grouped.select(F.col("a").alias("id"), "group").unionByName(grouped.select(F.col("b").alias("id"), "group"))
    links = scratch.table(
        grouped.groupBy("group").cogroup(_shipped(rows, needs, shingle).groupBy("group")).applyInArrow(
            _confirm(similarity), "u bigint, v bigint"))

    # Rows that share an id connect their classes.
    of = known.join(classes.drop("keys"), ["d1", "d2", "n"])
    shared = of.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"), F.collect_set("rep").alias("reps")).filter("u <> v")
    links = links.unionByName(shared.select("u", F.explode("reps").alias("v")).filter("u <> v"))
    components = connected_components(links, "u", "v")

    hot = found.filter("hot")
    if not hot.isEmpty():
        late = scratch.table(_straggler_links(rows, hot, components, shingle, similarity, scratch))
        if not late.isEmpty():
            components = _merged(components, late)

    class_component = classes.drop("keys").join(components, F.col("rep") == F.col("node"), "left").select(
        "d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    table = scratch.table(class_component)
    out = sketches.drop("keys").join(table, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _merged(components: DataFrame, late: DataFrame) -> DataFrame:
    """``components`` after further links: the links run between components, of which few are left."""
    named = components.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    ends = late.join(named, "u", "left").join(named.toDF("v", "cv"), "v", "left").select(
        F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    moved = connected_components(ends, "u", "v").toDF("component", "to")
    # Classes that had no link before are nodes of their own here.
    nodes = components.unionByName(moved.join(components.select("component").distinct(), "component", "left_anti").select(
        F.col("component").alias("node"), "component"))
    return nodes.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _straggler_links(rows: DataFrame, hot: DataFrame, components: DataFrame, shingle: int, similarity: int,
                     scratch: Scratch) -> DataFrame:
    """Links of the long lists that comparing with the least member did not find."""
    members = hot.select(F.col("a").alias("least"), F.col("b").alias("member")).distinct()
    named = members.join(components, F.col("member") == F.col("node"), "left").select(
        "least", "member", F.coalesce("component", "member").alias("component"))
    named = scratch.table(named)
    counts = named.groupBy("least", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("least").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"),
                                       (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    main = scratch.table(main)
    joined = named.join(main, "least")
    left_blocks = F.greatest(F.ceil(F.col("outside") / BLOCK).cast("bigint"), F.lit(1))
    right_blocks = F.greatest(F.ceil(F.col("size") / BLOCK).cast("bigint"), F.lit(1))
    own_left, own_right = F.pmod(F.xxhash64("member"), left_blocks), F.pmod(F.xxhash64("member"), right_blocks)
    group = F.xxhash64("least", "l", "r")
    left = joined.filter("component <> main").withColumn("l", own_left).withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("bigint"), right_blocks - 1)))
    right = joined.withColumn("r", own_right).withColumn("l", F.explode(F.sequence(F.lit(0).cast("bigint"), left_blocks - 1)))
    both = left.select(group.alias("group"), "member", "component", F.lit(True).alias("left"), F.lit(False).alias("right")).unionByName(
        right.select(group.alias("group"), "member", "component", F.lit(False).alias("left"), F.lit(True).alias("right")))
    both = scratch.table(both.groupBy("group", "member").agg(
        F.first("component").alias("component"), F.max("left").alias("left"), F.max("right").alias("right")))
    sets = _shipped(rows, both.select(F.col("member").alias("id"), "group"), shingle)
    return both.groupBy("group").cogroup(sets.groupBy("group")).applyInArrow(_confirm_stragglers(similarity), "u bigint, v bigint")
