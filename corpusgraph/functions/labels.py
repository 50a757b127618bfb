"""Entity label and relation type normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, as_col, let, strip, text_or_empty

# Labels that are never entities.
STOP_LABELS = [
    "significant", "figure", "growth", "strong", "past", "performance",
    "the", "this", "that", "these", "those", "data", "table", "chart",
    "document", "section", "page", "item", "value", "total", "following",
]

# Label synonyms.
LABEL_SYNONYMS = {
    "sales": "revenue",
    "turnover": "revenue",
    "income": "revenue",
    "profit": "earnings",
    "net income": "earnings",
    "costs": "cost",
    "expenses": "cost",
    "yr": "year",
    "fy": "fiscal year",
}

# The kinds of entity and of relation.
ENTITY_TYPES = ["concept", "number", "date", "metric"]
RELATION_TYPES = ["HAS_VALUE", "INCREASED_FROM", "DECREASED_FROM", "USED_FOR", "RELATED_TO"]

# Other spellings of a relation type.
RELATION_ALIASES = {
    "VALUE": "HAS_VALUE",
    "HAS": "HAS_VALUE",
    "CONTAINS": "RELATED_TO",
    "PART": "RELATED_TO",
    "PART_OF": "RELATED_TO",
    "INCREASE": "INCREASED_FROM",
    "INCREASES": "INCREASED_FROM",
    "DECREASE": "DECREASED_FROM",
    "DECREASES": "DECREASED_FROM",
    "USE": "USED_FOR",
    "USES": "USED_FOR",
    "FOR": "USED_FOR",
    "RELATES": "RELATED_TO",
    "RELATE": "RELATED_TO",
    "SIMILAR": "RELATED_TO",
}


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def canonical_label(raw: ColumnOrName) -> Column:
    """Canonical entity label, or the empty string where the text cannot be an entity."""

    def accept(s: Column) -> Column:
        rejected = (
            (F.length(s) == 0)
            | (F.length(s) > 64)
            | s.isin(STOP_LABELS)
            | ((F.length(s) > 24) & s.rlike(r"(?U)^(in|the|a|an)\s+"))
            | ((F.length(s) > 32) & s.contains(","))
        )
        unfinished = s.endswith("…") | s.endswith("...")
        trimmed = F.when(unfinished, strip(F.rtrim(s, F.lit("….")))).otherwise(s)
        return F.when(rejected, F.lit("")).otherwise(trimmed)

    def synonym(s: Column) -> Column:
        named = F.coalesce(F.try_element_at(literal_map(LABEL_SYNONYMS), s), s)
        return F.when(F.length(s) < 2, F.lit("")).otherwise(F.substring(named, 1, 200))

    squeezed = F.regexp_replace(F.lower(strip(text_or_empty(raw))), r"(?U)\s+", " ")
    return let(let(squeezed, accept), synonym)


def graph_key(document_id: ColumnOrName, label: ColumnOrName) -> Column:
    return F.concat_ws("::", as_col(document_id), as_col(label))


def entity_type_or_concept(raw: ColumnOrName) -> Column:
    t = F.lower(strip(F.coalesce(as_col(raw), F.lit("concept"))))
    return F.when(t.isin(ENTITY_TYPES), t).otherwise(F.lit("concept"))


def relation_type_or_null(raw: ColumnOrName) -> Column:
    """Exact type, then alias, then either text containing the other (types tried in list order)."""

    def resolve(t: Column) -> Column:
        loose = F.coalesce(*[F.when(t.contains(k) | F.lit(k).contains(t), F.lit(k)) for k in RELATION_TYPES])
        return (
            F.when(t.isin(RELATION_TYPES), t)
            .otherwise(F.coalesce(F.try_element_at(literal_map(RELATION_ALIASES), t), loose))
        )

    cleaned = F.regexp_replace(F.upper(strip(text_or_empty(raw))), r"[^A-Z_]", "_")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"_+", "_"), r"^_|_$", "")
    return F.when(F.length(text_or_empty(raw)) > 0, let(cleaned, resolve))
