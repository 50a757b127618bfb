"""Chunking: structural blocks over ordered units, then in-row splitting, sizing and scoring.

Only the structural step looks across rows. Its token rule (a block ends where the next unit would
exceed the limit) depends on everything before it in the document, so it is computed as a scan:
ranges of units become small functions from "tokens carried in" to "tokens carried out", ranges are
composed in a tree with as many levels as the unit numbers need, and the carried value is then handed back down. No row
ever holds more than one range of a document, however large the document and however sparse its numbers are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import AdjacentSimilarity, LexicalSimilarity
from ..functions.text import is_blank, is_section_header, let, salient_terms, sentences, strip, token_estimate
from ..options import DEFAULTS, Options
from ..session import run_table
from .ordering import with_offset

# Units in a range, and ranges in a group of ranges. A range is longer than any block of small units.
RANGE = 512


# --- structural blocks ----------------------------------------------------------------------------

def _next_state(state: Column, item: Column, limit: int) -> Column:
    """Tokens in the open block after one unit, capped at the limit (0: no block is open)."""
    starts = item["cut"] | (state + item["tokens"] > limit)
    return F.least(F.when(starts, item["tokens"]).otherwise(state + item["tokens"]), F.lit(limit))


def _through(items: Column, state: Column, limit: int) -> Column:
    return F.aggregate(items, state, lambda s, it: _next_state(s, it, limit))


def _apply(fn: Column, state: Column) -> Column:
    """Value of a carried-state function; a one-element array is a constant function."""
    return F.get(fn, F.least(state, F.size(fn) - 1))


def _entering(state: Column, page_before: Column, first_page: Column, limit: int) -> Column:
    """A page change at a range border closes the block, which a full block expresses."""
    return F.when(page_before.isNotNull() & (page_before != first_page), F.lit(limit)).otherwise(state)


def _function(ordinal: Column, constant: Column, through, limit: int) -> Column:
    """State function of a range; constant for a document's first range and after an inner cut."""
    states = F.sequence(F.lit(0), F.lit(limit))
    return F.when((ordinal == 0) | constant, F.array(through(F.lit(0)))).otherwise(F.transform(states, through))


def _compose(members: Column, state: Column, limit: int) -> Column:
    start = F.struct(state.alias("s"), F.lit(None).cast("int").alias("p"))

    def step(acc: Column, m: Column) -> Column:
        entered = _entering(acc["s"], acc["p"], m["first_page"], limit)
        return F.struct(_apply(m["fn"], entered).alias("s"), m["last_page"].alias("p"))

    return F.aggregate(members, start, step, lambda acc: acc["s"])


def _entries(members: Column, state: Column, page_before: Column, limit: int) -> Column:
    """For each member in order, the state with which it is entered."""
    start = F.struct(
        state.alias("s"), page_before.alias("p"),
        F.array().cast("array<struct<ordinal:bigint,entry:int,page:int>>").alias("out"),
    )

    def step(acc: Column, m: Column) -> Column:
        entered = _entering(acc["s"], acc["p"], m["first_page"], limit)
        entry = F.struct(
            m["ordinal"].alias("ordinal"), entered.alias("entry"), acc["p"].alias("page")
        )
        return F.struct(
            _apply(m["fn"], entered).alias("s"), m["last_page"].alias("p"),
            F.array_append(acc["out"], entry).alias("out"),
        )

    return F.aggregate(members, start, step, lambda acc: acc["out"])


def _starts(items: Column, entry: Column, limit: int) -> Column:
    """Sequence numbers of the units of a range that start a block."""
    start = F.struct(entry.alias("s"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, it: Column) -> Column:
        opens = (acc["s"] == 0) | it["cut"] | (acc["s"] + it["tokens"] > limit)
        return F.struct(
            _next_state(acc["s"], it, limit).alias("s"),
            F.when(opens, F.array_append(acc["out"], it["unit_seq"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def block_starts(units: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """``document_id, range, starts, open_block``: where blocks start in each range of units.

    ``open_block`` is the block that reaches into the range from before, if any.
    """
    limit = opts.chunk_max_tokens
    ranged = units.filter(~is_blank("text")).select(
        "document_id",
        F.floor(F.col("unit_seq") / RANGE).alias("range"),
        F.struct(
            "unit_seq", "page", is_section_header("text").alias("header"),
            token_estimate("text").alias("tokens"),
        ).alias("item"),
    )
    # At most RANGE narrow structs in a group, since unit_seq is unique in its document.
    items = ranged.groupBy("document_id", "range").agg(F.sort_array(F.collect_list("item")).alias("raw"))
    items = items.select(
        "document_id", "range",
        F.get("raw", F.lit(0))["page"].alias("first_page"),
        F.element_at("raw", -1)["page"].alias("last_page"),
        F.transform(
            "raw",
            lambda it, i: F.struct(
                it["unit_seq"].alias("unit_seq"), it["tokens"].alias("tokens"),
                (it["header"] | ((i > 0) & (it["page"] != F.get(F.col("raw"), i - 1)["page"]))).alias("cut"),
            ),
        ).alias("items"),
    )
    # Narrow rows, read at both ends of the scan.
    items = run_table(items, "block-items")
    members = items.select(
        "document_id",
        F.struct(
            F.col("range").alias("ordinal"), "first_page", "last_page",
            _function(
                F.col("range"), F.exists("items", lambda it: it["cut"]),
                lambda s: _through(F.col("items"), s, limit), limit,
            ).alias("fn"),
        ).alias("member"),
    )
    # As many levels as the largest unit number asks for: then all of a document is in one group, at most RANGE members long.
    left, levels = items.agg(F.max("range")).first()[0] or 0, []
    while left or not levels:
        groups = run_table(members.groupBy("document_id", F.floor(F.col("member.ordinal") / RANGE).alias("group")).agg(
            F.sort_array(F.collect_list("member")).alias("members")), "block-groups")
        levels.append(groups)
        members = groups.select(
            "document_id",
            F.struct(
                F.col("group").alias("ordinal"),
                F.get("members", F.lit(0))["first_page"].alias("first_page"),
                F.element_at("members", -1)["last_page"].alias("last_page"),
                _function(
                    F.col("group"), F.lit(False), lambda s: _compose(F.col("members"), s, limit), limit
                ).alias("fn"),
            ).alias("member"),
        )
        left //= RANGE
    entry = levels[-1].select(
        "document_id", F.col("group").alias("range"), F.lit(0).alias("entry"), F.lit(None).cast("int").alias("page"))
    for groups in reversed(levels):
        entry = groups.join(entry.withColumnRenamed("range", "group"), ["document_id", "group"]).select(
            "document_id",
            F.inline(_entries(F.col("members"), F.col("entry"), F.col("page"), limit)).alias("range", "entry", "page"),
        )
    range_entry = entry
    found = items.join(range_entry.select("document_id", "range", "entry"), ["document_id", "range"]).select(
        "document_id", "range", _starts(F.col("items"), F.col("entry"), limit).alias("starts")
    )
    # One narrow row for each range takes part in the window over a document.
    earlier = W.partitionBy("document_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = found.select("document_id", "range", F.try_element_at("starts", F.lit(-1)).alias("last_start"))
    opened = ends.select(
        "document_id", "range", F.last("last_start", ignorenulls=True).over(earlier).alias("open_block")
    )
    return found.join(opened, ["document_id", "range"])


def structural_blocks(units: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Blocks of consecutive units: a new one at a page change, at a header, or at the token limit.

    The text of a block joins its units by a blank line; page, source and type are the first unit's.
    ``block_seq`` is the sequence number of that unit.
    """
    block = F.coalesce(
        F.array_max(F.filter("starts", lambda s: s <= F.col("unit_seq"))), F.col("open_block")
    )
    assigned = (
        units.filter(~is_blank("text"))
        .withColumn("range", F.floor(F.col("unit_seq") / RANGE))
        .join(block_starts(units, opts), ["document_id", "range"])
        .withColumn("block_seq", block)
    )
    # A block is one unit, or units of together at most chunk_max_tokens: the list is bounded.
    unit = F.struct("unit_seq", "page", "source", "type", "text")
    merged = assigned.groupBy("document_id", "block_seq").agg(F.sort_array(F.collect_list(unit)).alias("members"))
    first = F.get("members", F.lit(0))
    return merged.select(
        "document_id", "block_seq",
        first["page"].alias("page"), first["source"].alias("source"), first["type"].alias("type"),
        F.array_join(F.transform("members", lambda m: m["text"]), "\n\n").alias("text"),
        F.size("members").alias("n_units"),
    )


# --- splitting inside a block ---------------------------------------------------------------------

def _join_from(sents: Column, starts: Column) -> Column:
    """Texts of the runs of sentences that begin at the given 1-based positions."""
    return F.transform(
        starts,
        lambda s, j: F.array_join(
            F.slice(sents, s, F.coalesce(F.get(starts, j + 1), F.size(sents) + 1) - s), " "
        ),
    )


def semantic_pieces(text: Column, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> Column:
    """Cut where a sentence is not similar to the one before; a one-sentence text stays as it is."""
    sim = similarity or LexicalSimilarity()

    def cut(sents: Column) -> Column:
        def pieces(adjacent: Column) -> Column:
            weak = F.filter(
                F.transform(adjacent, lambda a, i: F.when(a < opts.similarity_threshold, i + 2)),
                lambda p: p.isNotNull(),
            )
            return let(F.concat(F.array(F.lit(1)), weak), lambda starts: _join_from(sents, starts))

        return F.when(F.size(sents) <= 1, F.array(text)).otherwise(let(sim.adjacent(sents), pieces))

    return let(sentences(text), cut)


def weakest_boundary(adjacent: Column) -> Column:
    """``struct<position, similarity>`` of the first minimum; position p lies after sentence p."""
    return let(
        F.array_min(adjacent),
        lambda low: F.struct(
            F.array_position(adjacent, low).cast("int").alias("position"), low.alias("similarity")
        ),
    )


def refined_pieces(text: Column, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> Column:
    """Split a large text with many salient terms once, at its weakest boundary, if that is weak enough."""
    sim = similarity or LexicalSimilarity()
    half = opts.chunk_min_tokens // 2

    def split(sents: Column, at: Column) -> Column:
        left = F.array_join(F.slice(sents, 1, at), " ")
        right = F.array_join(F.slice(sents, at + 1, F.size(sents)), " ")
        return let(
            F.array(left, right),
            lambda lr: F.when(
                (token_estimate(lr[0]) >= half) & (token_estimate(lr[1]) >= half), lr
            ).otherwise(F.array(text)),
        )

    def at_weakest(sents: Column) -> Column:
        return F.when(F.size(sents) < 3, F.array(text)).otherwise(
            let(
                weakest_boundary(sim.adjacent(sents)),
                lambda w: F.when(w["similarity"] > opts.refine_max_similarity, F.array(text))
                .otherwise(split(sents, w["position"])),
            )
        )

    eligible = (token_estimate(text) >= opts.refine_min_tokens) & (
        F.size(salient_terms(text)) >= opts.refine_min_terms
    )
    return F.when(eligible, let(sentences(text), at_weakest)).otherwise(F.array(text))


def sized_pieces(text: Column, opts: Options = DEFAULTS) -> Column:
    """Windows of ``chunk_max_tokens`` words for texts over the token limit; others stay as they are.

    Windows overlap by one word, and windows under the minimum of tokens are dropped.
    """
    size = opts.chunk_max_tokens
    step = max(1, size - min(1, opts.chunk_overlap_tokens // 10))

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step))
        segments = F.transform(starts, lambda s: F.array_join(F.slice(words, s, size), " "))
        return F.filter(segments, lambda g: token_estimate(g) >= opts.chunk_min_tokens)

    return F.when(token_estimate(text) <= size, F.array(text)).otherwise(
        let(F.split(strip(text), r"(?U)\s+"), windows)
    )


def coherence(text: Column, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> Column:
    """Mean similarity of adjacent sentences; a fixed value for one-sentence texts."""
    sim = similarity or LexicalSimilarity()

    def mean(sents: Column) -> Column:
        return let(
            sim.adjacent(sents),
            lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a),
        )

    return let(
        sentences(text),
        lambda s: F.when(F.size(s) <= 1, F.lit(opts.coherence_single)).otherwise(mean(s)),
    )


def _exploded(blocks: DataFrame, pieces: Column, name: str) -> DataFrame:
    others = [c for c in blocks.columns if c != "text"]
    return blocks.select(*others, F.posexplode(pieces).alias(name, "text"))


def semantic_split(blocks: DataFrame, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> DataFrame:
    return _exploded(blocks, semantic_pieces(F.col("text"), opts, similarity), "piece")


def entity_refine(blocks: DataFrame, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> DataFrame:
    return _exploded(blocks, refined_pieces(F.col("text"), opts, similarity), "half")


def size_control(blocks: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    return _exploded(blocks, sized_pieces(F.col("text"), opts), "segment")


def adjacent_similarity(blocks: DataFrame, similarity: AdjacentSimilarity | None = None) -> DataFrame:
    """One row for each pair of neighbouring sentences of a block; position counts from 1."""
    sim = similarity or LexicalSimilarity()
    pairs = blocks.select(
        "document_id", "block_seq", F.posexplode(sim.adjacent(sentences("text"))).alias("pos", "similarity")
    )
    return pairs.select("document_id", "block_seq", (F.col("pos") + 1).alias("position"), "similarity")


# --- the whole stage ------------------------------------------------------------------------------

def split_blocks(blocks: DataFrame, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> DataFrame:
    """Blocks with the arrays of all later stages: ``semantic, refined, sized, scored``."""
    refine = lambda t: refined_pieces(t, opts, similarity)
    size = lambda t: sized_pieces(t, opts)
    score = lambda t: F.struct(t.alias("text"), coherence(t, opts, similarity).alias("coherence_score"))
    staged = let(
        semantic_pieces(F.col("text"), opts, similarity),
        lambda semantic: let(
            F.flatten(F.transform(semantic, refine)),
            lambda refined: let(
                F.flatten(F.transform(refined, size)),
                lambda sized: F.struct(
                    F.size(semantic).alias("n_semantic"), F.size(refined).alias("n_refined"),
                    F.size(sized).alias("n_sized"), F.transform(sized, score).alias("scored"),
                ),
            ),
        ),
    )
    keep = lambda c: c["coherence_score"] >= opts.coherence_min
    # A generator keeps the optimizer from repeating the staged expression in every use of it.
    return blocks.select(
        "document_id", "block_seq", "page", "source", "type", F.inline(F.array(staged))
    ).withColumn("kept", F.filter("scored", keep))


def number_chunks(split: DataFrame) -> DataFrame:
    """Kept chunks with a dense sequence number in their document and an id that reruns reproduce."""
    counted = split.filter(F.size("kept") > 0).withColumn("n_kept", F.size("kept"))
    placed = with_offset(counted, ["document_id"], "block_seq", "n_kept", "offset")
    rows = placed.select(
        "document_id", "page", "source", "type", "offset", F.posexplode("kept").alias("pos", "chunk")
    )
    seq = (F.col("offset") + F.col("pos")).cast("bigint")
    return rows.select(
        "document_id",
        F.sha2(F.concat_ws("#", F.col("document_id"), seq.cast("string")), 256).alias("chunk_id"),
        seq.alias("chunk_seq"),
        F.col("chunk.text").alias("text"), "source", "page", "type",
        F.col("chunk.coherence_score").alias("coherence_score"),
    )


def chunk_units(units: DataFrame, opts: Options = DEFAULTS, similarity: AdjacentSimilarity | None = None) -> DataFrame:
    """Units (already deduplicated) to chunks."""
    return number_chunks(split_blocks(structural_blocks(units, opts), opts, similarity))


def chunk_stats(split: DataFrame) -> DataFrame:
    """Number of texts after each stage, for each document."""
    return split.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("structural"),
        F.sum("n_semantic").alias("semantic"),
        F.sum("n_refined").alias("refined"),
        F.sum("n_sized").alias("sized"),
        F.sum(F.size("kept")).alias("kept"),
        F.sum(F.col("n_sized") - F.size("kept")).alias("dropped"),
    )
