"""Responses of an outside extractor: JSON text, possibly inside a fence, read into arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical_label, entity_type_or_concept
from ..functions.text import ColumnOrName, as_col, is_blank, strip

RESPONSE_SCHEMA = """
    entities array<struct<label string, text string, type string>>,
    relationships array<struct<
        `from` string, subject string, `to` string, object string, type string, predicate string>>
"""
PLAIN_SCHEMA = "entities array<string>"


def json_object_text(c: ColumnOrName) -> Column:
    """The JSON part of a response: the first fenced block, else from the first to the last brace."""
    raw = strip(as_col(c))
    fenced = strip(F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1))
    braced = F.regexp_extract(raw, r"\{[\s\S]*\}", 0)
    return F.when(raw.contains("```") & (F.length(fenced) > 0), fenced).otherwise(braced)


def parse_responses(responses: DataFrame, response: ColumnOrName = "response") -> DataFrame:
    """Add ``entities`` and ``relationships``; unreadable or missing JSON gives empty arrays.

    Entities may be objects or plain strings; relation ends may be named from/to or subject/object.
    """
    text = json_object_text(response)
    objects = F.from_json(text, RESPONSE_SCHEMA)
    strings = F.from_json(text, PLAIN_SCHEMA)["entities"]
    from_objects = F.transform(
        objects["entities"],
        lambda e: F.struct(
            canonical_label(F.coalesce(e["label"], e["text"])).alias("label"),
            entity_type_or_concept(e["type"]).alias("type"),
        ),
    )
    from_strings = F.transform(
        F.filter(strings, lambda s: ~s.startswith("{")),
        lambda s: F.struct(canonical_label(s).alias("label"), F.lit("concept").alias("type")),
    )
    entities = F.concat(
        F.filter(F.coalesce(from_objects, F.array()), lambda e: e["label"] != ""),
        F.filter(F.coalesce(from_strings, F.array()), lambda e: e["label"] != ""),
    )
    relationships = F.coalesce(
        F.transform(
            objects["relationships"],
            lambda r: F.struct(
                F.coalesce(r["from"], r["subject"]).alias("from"),
                F.coalesce(r["to"], r["object"]).alias("to"),
                F.coalesce(r["type"], r["predicate"]).alias("type"),
            ),
        ),
        F.array().cast("array<struct<`from`:string,`to`:string,type:string>>"),
    )
    readable = ~is_blank(response) & (F.length(text) > 0)
    none = F.array().cast("array<struct<label:string,type:string>>")
    return responses.withColumn("entities", F.when(readable, entities).otherwise(none)).withColumn(
        "relationships", relationships
    )
