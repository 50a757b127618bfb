"""Entity and relation extraction over chunk tables, and its merge with outside taggers and extractors.

Extracted chunks carry two arrays, ``entities<label, type>`` and ``relationships<from, to, type>``. Both
are bounded by the per-chunk caps, so they stay inside the row until graph rows are made from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.extraction import (
    confidence_of, entities_of, extraction_of, first_per_label, needs_augmentation, relations_of,
)
from ..functions.labels import canonical_label, entity_type_or_concept, graph_key, relation_type_or_null
from ..functions.text import let, strip, text_or_empty
from ..options import DEFAULTS, Options
from ..session import run_table
from ..sources.responses import parse_responses
from .skew import salted_join

_ENTITIES = "array<struct<label:string,type:string>>"
_RELATIONS = "array<struct<`from`:string,`to`:string,type:string>>"


def text_hash(c: Column) -> Column:
    return F.sha2(strip(text_or_empty(c)), 256)


def _with_confidence(df: DataFrame, opts: Options) -> DataFrame:
    n_entities, n_relations = F.size("entities"), F.size("relationships")
    confidence = confidence_of(n_entities, n_relations, F.col("text"))
    return df.withColumn("confidence", confidence).withColumn(
        "needs_augmentation", needs_augmentation(F.col("confidence"), n_entities, n_relations, opts)
    )


def extract_chunks(chunks: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Add ``entities``, ``relationships``, ``confidence`` and ``needs_augmentation`` by the rules."""
    trimmed = chunks.withColumn("text", strip(text_or_empty("text")))
    others = trimmed.columns
    # A generator, so that the extraction is not repeated by each use of its result.
    found = trimmed.select(*others, F.inline(F.array(extraction_of("text", opts))))
    return _with_confidence(found, opts)


def extract_once(chunks: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """The same, extracting each distinct text once; ``reused`` marks all but its first chunk.

    The join back has one row for each text on one side; texts with very many chunks are salted.
    """
    hashed = chunks.withColumn("text", strip(text_or_empty("text"))).withColumn("text_hash", text_hash(F.col("text")))
    position = F.struct("document_id", "chunk_seq")
    # Combined before the shuffle; one text stands for all of its hash.
    distinct = hashed.groupBy("text_hash").agg(
        F.first("text").alias("text"), F.min(position).alias("first_use"), F.count(F.lit(1)).alias("__uses"))
    # Written, since the join looks at the sizes and at the results.
    results = run_table(extract_chunks(distinct, opts).drop("text"), "extracted")
    return (
        salted_join(hashed, results, ["text_hash"], ["document_id", "chunk_seq"], rows="__uses")
        .withColumn("reused", position != F.col("first_use"))
        .drop("first_use")
    )


def tagger_type(tag: Column) -> Column:
    return (
        F.when(tag.isin("DATE", "TIME"), F.lit("date"))
        .when(tag.isin("MONEY", "QUANTITY", "PERCENT", "CARDINAL"), F.lit("number"))
        .otherwise(F.lit("concept"))
    )


def tagger_entities(tags: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """First entities of each chunk from ``chunk_id, tag_seq, text, tag``, as one array."""
    label = canonical_label("text")
    usable = tags.filter(F.length(strip("text")) <= 64).select(
        "chunk_id", "tag_seq", label.alias("label"), tagger_type(F.col("tag")).alias("type")
    ).filter(F.col("label") != "")
    first = W.partitionBy("chunk_id", "label").orderBy("tag_seq")
    capped = W.partitionBy("chunk_id").orderBy("tag_seq")
    kept = (
        usable.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
        .withColumn("__n", F.row_number().over(capped)).filter(F.col("__n") <= opts.entities_per_chunk)
    )
    return kept.groupBy("chunk_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("tag_seq", "label", "type"))),
            lambda x: F.struct(x["label"].alias("label"), x["type"].alias("type")),
        ).alias("tag_entities")
    )


def extract_tagged(chunks: DataFrame, tags: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Extraction with a tagger's entities after the rules' own, which win.

    The relation rules run on the merged labels, so a relation may have ends that only the tagger found; confidence
    and the gate follow from both.
    """
    trimmed = chunks.withColumn("text", strip(text_or_empty("text")))
    others = trimmed.columns
    joined = trimmed.join(tagger_entities(tags, opts), "chunk_id", "left")
    merged = first_per_label(F.concat(entities_of("text", opts), F.coalesce("tag_entities", F.array().cast(_ENTITIES))))
    both = let(merged, lambda es: F.struct(es.alias("entities"), relations_of("text", es, opts).alias("relationships")))
    return _with_confidence(joined.select(*others, F.inline(F.array(both))), opts)


def merge_responses(extracted: DataFrame, responses: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Merge an outside extractor's answers (``chunk_hash, response``) into the chunks that asked for one.

    Response entities come after the rules' own; relations are normalised, made distinct and capped,
    and their ends need not be entities. Confidence never falls. ``used_response`` marks merged chunks.
    """
    parsed = parse_responses(responses).select(
        F.col("chunk_hash").alias("text_hash"),
        F.col("entities").alias("r_entities"), F.col("relationships").alias("r_relationships"),
    )
    hashed = extracted if "text_hash" in extracted.columns else extracted.withColumn("text_hash", text_hash(F.col("text")))
    joined = hashed.join(parsed, "text_hash", "left")
    asked = F.col("needs_augmentation") & F.col("r_entities").isNotNull()
    entities = first_per_label(F.concat("entities", F.coalesce("r_entities", F.array().cast(_ENTITIES))))
    answered = F.filter(
        F.transform(
            F.coalesce("r_relationships", F.array().cast(_RELATIONS)),
            lambda r: F.struct(
                canonical_label(r["from"]).alias("from"), canonical_label(r["to"]).alias("to"),
                relation_type_or_null(r["type"]).alias("type"),
            ),
        ),
        lambda r: (r["from"] != "") & (r["to"] != "") & r["type"].isNotNull(),
    )
    relations = F.slice(F.array_distinct(F.concat("relationships", answered)), 1, opts.relations_after_merge)
    merged = joined.select(
        *[c for c in hashed.columns if c not in ("entities", "relationships")],
        asked.alias("used_response"),
        F.when(asked, entities).otherwise(F.col("entities")).alias("entities"),
        F.when(asked, relations).otherwise(F.col("relationships")).alias("relationships"),
    )
    renewed = confidence_of(F.size("entities"), F.size("relationships"), F.col("text"))
    return merged.withColumn("confidence", F.greatest("confidence", renewed))


def mention_rows(extracted: DataFrame) -> DataFrame:
    """One row for each distinct entity of each chunk."""
    rows = extracted.select("document_id", "chunk_id", "chunk_seq", F.inline("entities").alias("label", "kind"))
    return rows.select(
        "document_id", "chunk_id", "chunk_seq",
        graph_key("document_id", "label").alias("graph_key"),
        F.col("label").alias("name"), entity_type_or_concept("kind").alias("entity_type"),
    )


def relation_rows(extracted: DataFrame) -> DataFrame:
    """One row for each distinct relation of each chunk."""
    rows = extracted.select(
        "document_id", "chunk_id", "chunk_seq", F.inline("relationships").alias("source", "target", "kind")
    )
    return rows.select(
        "document_id", "chunk_id", "chunk_seq",
        graph_key("document_id", "source").alias("from_key"), graph_key("document_id", "target").alias("to_key"),
        F.col("source").alias("from_name"), F.col("target").alias("to_name"), F.col("kind").alias("rel_type"),
    )


def extraction_stats(extracted: DataFrame) -> DataFrame:
    """Chunks, entity rows and relation rows of a build, in one row."""
    return extracted.agg(
        F.count(F.lit(1)).alias("chunks_processed"),
        F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities_created"),
        F.coalesce(F.sum(F.size("relationships")), F.lit(0)).alias("relations_created"),
    )
