"""Text, table and recognised-image units from document tables.

Units carry ``document_id, unit_seq, page, source, type, text``; ``unit_seq`` is unique in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnOrName, as_col, ascii_share, clip, is_blank, strip, text_or_empty
from ..operators.ordering import with_position

UNIT_COLUMNS = ["document_id", "unit_seq", "page", "source", "type", "text"]

# Unit sequence numbers of the three kinds of unit follow each other: text, tables, images.
TYPE_STRIDE = 1 << 40


def page_units(docs: DataFrame, document_id: ColumnOrName, text: ColumnOrName, separator: str = "\n") -> DataFrame:
    """One unit for each non-blank page; pages are the parts of the text between separators."""
    pages = docs.select(
        as_col(document_id).cast("string").alias("document_id"),
        F.posexplode(F.split(as_col(text), separator)).alias("pos", "raw"),
    )
    return pages.filter(~is_blank("raw")).select(
        "document_id",
        F.col("pos").cast("bigint").alias("unit_seq"),
        (F.col("pos") + 1).cast("int").alias("page"),
        F.concat(F.lit("page_"), F.col("pos") + 1).alias("source"),
        F.lit("text").alias("type"),
        strip("raw").alias("text"),
    )


def line_units(
    docs: DataFrame, document_id: ColumnOrName, text: ColumnOrName, lines_per_page: int = 20
) -> DataFrame:
    """One unit for each non-blank line, with a fixed number of lines to the page."""
    page = (F.floor((F.col("page") - 1) / lines_per_page) + 1).cast("int")
    return (
        page_units(docs, document_id, text, "\n")
        .withColumn("page", page)
        .withColumn("source", F.concat(F.lit("page_"), F.col("page")))
        .select(*UNIT_COLUMNS)
    )


def html_units(pages: DataFrame, page_id: ColumnOrName, html: ColumnOrName) -> DataFrame:
    """The visible text of a web page as one unit; style and script bodies are dropped before the tags."""
    visible = F.regexp_replace(as_col(html), r"(?is)<(style|script)[^>]*>.*?</(style|script)>", " ")
    visible = F.regexp_replace(visible, r"(?s)<[^>]*>", " ")
    visible = strip(F.regexp_replace(visible, r"(?U)\s+", " "))
    return pages.select(
        as_col(page_id).cast("string").alias("document_id"),
        F.lit(0).cast("bigint").alias("unit_seq"),
        F.lit(1).alias("page"),
        F.lit("page_1").alias("source"),
        F.lit("text").alias("type"),
        visible.alias("text"),
    ).filter(~is_blank("text"))


def table_text(raw_table: ColumnOrName) -> Column:
    """Text of ``array<array<string>>``: cells trimmed and joined by bars, rows by line ends."""
    return F.array_join(
        F.transform(
            as_col(raw_table),
            lambda row: F.array_join(F.transform(row, lambda cell: strip(text_or_empty(cell))), " | "),
        ),
        "\n",
    )


def row_text(*cells: Column) -> Column:
    """The same for one relational row: one trimmed, bar-separated line."""
    return F.concat_ws(" | ", *[strip(text_or_empty(c.cast("string"))) for c in cells])


def _numbered(units: DataFrame, index: str) -> DataFrame:
    """Add ``unit_seq``, the place of each unit in its document by page and index, from 0 and without gaps."""
    keyed = units.withColumn("__order", F.coalesce(F.col("page").cast("bigint"), F.lit(0)) * (1 << 32) + F.coalesce(index, F.lit(0)))
    # Units without a document are numbered too.
    keyed = keyed.withColumn("__document", F.coalesce(F.concat(F.lit("="), F.col("document_id").cast("string")), F.lit("")))
    placed = with_position(keyed, ["__document"], "__order", "unit_seq")
    return placed.withColumn("unit_seq", F.col("unit_seq") - 1).drop("__order", "__document")


def table_units(tables: DataFrame) -> DataFrame:
    """Units of ``document_id, page, table_index, raw_table``; empty tables are dropped.

    Two tables of a document do not share page and index.
    """
    numbered = _numbered(tables.filter(F.size("raw_table") > 0), "table_index")
    return numbered.select(
        F.col("document_id").cast("string").alias("document_id"), "unit_seq",
        F.col("page").cast("int").alias("page"),
        F.format_string("page_%d_table_%d", F.col("page").cast("int"), F.col("table_index").cast("bigint")).alias("source"),
        F.lit("table").alias("type"),
        table_text("raw_table").alias("text"),
    )


def image_units(image_text: DataFrame) -> DataFrame:
    """Units of ``document_id, page, image_index, recognised, translated``; blank recognitions are dropped."""
    numbered = _numbered(image_text.filter(~is_blank("recognised")), "image_index")
    return numbered.select(
        F.col("document_id").cast("string").alias("document_id"), "unit_seq",
        F.col("page").cast("int").alias("page"),
        F.format_string("page_%d_img_%d", F.col("page").cast("int"), F.col("image_index").cast("bigint")).alias("source"),
        F.lit("image").alias("type"),
        F.coalesce(F.nullif(F.col("translated"), F.lit("")), F.col("recognised")).alias("text"),
    )


def chart_units(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Chart text of each page: recognised text, else page text of over 20 characters cut to 2,000.

    ``pages``: document_id, page, text. ``recognised``: document_id, page, recognised.
    """
    own = strip(text_or_empty("recognised"))
    page_text = strip(text_or_empty("text"))
    chosen = (
        F.when(F.length(own) > 0, own)
        .when(F.length(page_text) > 20, strip(clip(page_text, 2000)))
    )
    return (
        pages.select("document_id", "page", "text")
        .join(recognised.select("document_id", "page", "recognised"), ["document_id", "page"], "left")
        .select(
            "document_id",
            F.col("page").cast("bigint").alias("unit_seq"),
            F.col("page").cast("int").alias("page"),
            F.concat(F.lit("page_"), F.col("page"), F.lit("_chart")).alias("source"),
            F.lit("image").alias("type"),
            chosen.alias("text"),
        )
        .filter(~is_blank("text"))
    )


def gather(text_units: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Union of the three kinds in the order text, table, image, with one sequence over all of them.

    A text unit may carry ``translated`` (preferred) and ``original``; a table unit ``context_ready``
    (preferred) and ``translated``; an image unit ``merged_context``. Otherwise ``text`` is used.
    """
    preferred = {
        "text": ["translated", "original", "text"],
        "table": ["context_ready", "translated", "text"],
        "image": ["merged_context", "text"],
    }

    def part(df: DataFrame, kind: str, rank: int) -> DataFrame:
        present = [c for c in preferred[kind] if c in df.columns]
        text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in present])
        return df.filter(~is_blank(text)).select(
            "document_id",
            (F.col("unit_seq") + F.lit(rank * TYPE_STRIDE)).alias("unit_seq"),
            F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce("source", F.lit("page_0")).alias("source"),
            F.lit(kind).alias("type"),
            strip(text).alias("text"),
        )

    out = part(text_units, "text", 0)
    if tables is not None:
        out = out.unionByName(part(tables, "table", 1))
    if images is not None:
        out = out.unionByName(part(images, "image", 2))
    return out


def route_for_translation(units: DataFrame, limit: int = 3000) -> DataFrame:
    """Flag units that need a language check (at most 95 % ASCII) and give the text to send for it."""
    ascii_enough = ascii_share("text") > F.lit(0.95)
    return units.withColumn("needs_translation", ~ascii_enough).withColumn(
        "translation_input", F.when(ascii_enough, F.col("text")).otherwise(clip("text", limit))
    )


def event_previews(units: DataFrame) -> DataFrame:
    """Shortened text columns as the progress feed carries them."""
    return units.select(
        "document_id", "unit_seq", "page", "source", "type",
        clip("text", 2000).alias("text_preview"),
        clip("text", 600).alias("original_preview"),
        clip("text", 1500).alias("table_preview"),
        clip("text", 1200).alias("image_preview"),
        clip("text", 500).alias("chunk_preview"),
    )
