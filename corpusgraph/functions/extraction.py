"""Rule extraction of entities and relations from one text, as column expressions.

Everything here works inside the row, so extraction over a chunk table is a map without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options
from .labels import canonical_label
from .text import ColumnOrName, as_col, is_blank, let, sentences

# The patterns of entity mentions.
YEAR = r"\b(20\d{2}|19\d{2})\b"
AMOUNT = r"\b(\d+(?:\.\d+)?)\s*(?:%|percent|million|billion|M|B|USD|usd|bn|mn)\b"
ML_TERM = r"\b(LSTM|CNN|RNN|GRU|Transformer|BERT|GPT|GAN|VAE|attention|neural network|deep learning|machine learning)\b"
FINANCE_TERM = r"\b(revenue|cost|profit|earnings|margin|ebitda|sales|growth|forecast|budget)\b"
PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"
SENTENCE_NUMBER = r"\b\d+(?:\.\d+)?%?\b"

# The patterns of relations; two captured ends, over lower-case text.
ROSE = r"(increased|rose|grew|up)\s+from\s+([\w\s\.%]+?)\s+to\s+([\w\s\.%]+?)(?:[.\n,;]|$)"
FELL = r"(decreased|fell|dropped|down)\s+from\s+([\w\s\.%]+?)\s+to\s+([\w\s\.%]+?)(?:[.\n,;]|$)"
IS_USED_FOR = r"([\w][\w\s]{2,40}?)\s+is\s+used\s+for\s+([\w][\w\s]{2,40}?)(?:[.\n,;]|$)"
USED_FOR = r"([\w][\w\s]{2,40}?)\s+used\s+for\s+([\w][\w\s]{2,40}?)(?:[.\n,;]|$)"

SHORT_SENTENCE = 160
PHRASE_CHARS = 28


def find_all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?U){pattern}"), F.lit(group))


def find_words(low: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern in any case, given lower-case text: cheaper than matching without case."""
    return find_all(low, pattern.lower(), group)


def has_words(low: Column, pattern: str) -> Column:
    return low.rlike(f"(?U){pattern.lower()}")


def _starting(first: str, pattern: str) -> str:
    """The same pattern, with the class of its first character tried before the word's edge, which costs more."""
    return f"(?={first}){pattern}"


def _entity(label: Column, kind: str) -> Column:
    return F.struct(label.alias("label"), F.lit(kind).alias("type"))


def _labelled(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: _entity(canonical_label(m), kind))


def year_entities(c: ColumnOrName) -> Column:
    return _labelled(find_all(as_col(c), _starting("[12]", YEAR), 1), "date")


def amount_entities(c: ColumnOrName) -> Column:
    return _labelled(find_words(F.lower(as_col(c)), _starting(r"\d", AMOUNT), 0), "number")


def ml_entities(c: ColumnOrName) -> Column:
    return _labelled(find_words(F.lower(as_col(c)), ML_TERM, 1), "concept")


def finance_entities(c: ColumnOrName) -> Column:
    return _labelled(find_words(F.lower(as_col(c)), FINANCE_TERM, 1), "metric")


def phrase_entities(c: ColumnOrName) -> Column:
    phrases = F.filter(find_all(as_col(c), _starting("[A-Z]", PHRASE), 1), lambda m: F.length(m) < PHRASE_CHARS)
    return _labelled(phrases, "concept")


def first_per_label(entities: Column) -> Column:
    """Drop empty labels and all but the first entity of each label, keeping order."""
    named = F.filter(entities, lambda e: e["label"] != "")
    return let(
        named,
        lambda es: let(
            F.transform(es, lambda e: e["label"]),
            lambda labels: F.filter(es, lambda e, i: F.array_position(labels, e["label"]) == i + 1),
        ),
    )


def entities_of(c: ColumnOrName, opts: Options = DEFAULTS) -> Column:
    """``array<struct<label, type>>``: years, amounts, ML terms, finance terms, phrases; first type wins."""
    text = as_col(c)
    found = F.concat(
        year_entities(text), amount_entities(text), ml_entities(text), finance_entities(text), phrase_entities(text)
    )
    return F.slice(first_per_label(found), 1, opts.entities_per_chunk)


def _relation(source: Column, target: Column, kind: str) -> Column:
    return F.struct(source.alias("from"), target.alias("to"), F.lit(kind).alias("type"))


def _captured(low: Column, pattern: str, first: int, second: int, kind: str) -> Column:
    return F.zip_with(
        find_all(low, pattern, first),
        find_all(low, pattern, second),
        lambda a, b: _relation(canonical_label(a), canonical_label(b), kind),
    )


_NO_RELATIONS = "array<struct<`from`:string,`to`:string,type:string>>"


def _where(condition: Column, relations: Column) -> Column:
    """Relations of texts that can have any; a plain search is far cheaper than the patterns."""
    return F.when(condition, relations).otherwise(F.array().cast(_NO_RELATIONS))


def change_relations(low: Column) -> Column:
    return _where(
        low.contains("from"),
        F.concat(
            _captured(low, ROSE, 2, 3, "INCREASED_FROM"), _captured(low, FELL, 2, 3, "DECREASED_FROM")
        ),
    )


def use_relations(low: Column) -> Column:
    return _where(
        low.contains("used"),
        F.concat(
            _captured(low, IS_USED_FOR, 1, 2, "USED_FOR"), _captured(low, USED_FOR, 1, 2, "USED_FOR")
        ),
    )


def _labels_in(sentence: Column, pattern: str, group: int) -> Column:
    found = F.transform(find_words(sentence, pattern, group), canonical_label)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def _known(labels: Column, sentence: Column, pattern: str, group: int) -> Column:
    """Distinct labels of the matches in a sentence that are entities of the chunk."""
    return F.array_intersect(_labels_in(sentence, pattern, group), labels)


def _with_metrics(sents: Column, labels: Column) -> Column:
    """Sentences with finance terms that are entities, and these: both rules need them."""
    told = F.transform(sents, lambda s: F.struct(s.alias("text"), _known(labels, s, FINANCE_TERM, 1).alias("metrics")))
    return F.filter(told, lambda s: F.size(s["metrics"]) > 0)


def value_relations(sents: Column, labels: Column) -> Column:
    """Each finance term with each number of its sentence, where both are entities."""
    return _value_pairs(_with_metrics(sents, labels), labels)


def _value_pairs(told: Column, labels: Column) -> Column:
    return F.flatten(
        F.transform(
            told,
            lambda s: let(
                _known(labels, s["text"], _starting(r"\d", SENTENCE_NUMBER), 0),
                lambda numbers: F.flatten(
                    F.transform(
                        s["metrics"],
                        lambda metric: F.transform(numbers, lambda n: _relation(metric, n, "HAS_VALUE")),
                    )
                ),
            ),
        )
    )


def association_relations(sents: Column, labels: Column) -> Column:
    """Each ML term with each other finance term of a short sentence, where both are entities."""
    return _association_pairs(_with_metrics(sents, labels), labels)


def _association_pairs(told: Column, labels: Column) -> Column:
    return F.flatten(
        F.transform(
            F.filter(told, lambda s: F.length(s["text"]) <= SHORT_SENTENCE),
            lambda s: F.flatten(
                F.transform(
                    _known(labels, s["text"], ML_TERM, 1),
                    lambda term: F.transform(
                        F.filter(s["metrics"], lambda m: m != term),
                        lambda m: _relation(term, m, "RELATED_TO"),
                    ),
                )
            ),
        )
    )


def with_known_ends(relations: Column, labels: Column) -> Column:
    return F.filter(
        relations,
        lambda r: F.array_contains(labels, r["from"]) & F.array_contains(labels, r["to"]),
    )


def relations_of(c: ColumnOrName, entities: Column, opts: Options = DEFAULTS) -> Column:
    """``array<struct<from, to, type>>``: the rules in order, both ends known, first of each kept."""
    return let(
        F.transform(entities, lambda e: e["label"]),
        lambda labels: let(
            F.lower(as_col(c)),
            lambda low: F.slice(
                F.array_distinct(
                    with_known_ends(
                        F.concat(change_relations(low), use_relations(low), _sentence_relations(low, labels)),
                        labels,
                    )
                ),
                1,
                opts.relations_per_chunk,
            ),
        ),
    )


def _sentence_relations(low: Column, labels: Column) -> Column:
    """Both rules that pair a finance term with something else in its sentence."""
    def pairs(told: Column) -> Column:
        related = _where(has_words(low, ML_TERM), _association_pairs(told, labels))
        return F.concat(_value_pairs(told, labels), related)

    return _where((F.size(labels) > 1) & has_words(low, FINANCE_TERM), let(_with_metrics(sentences(low), labels), pairs))


def confidence_of(n_entities: Column, n_relations: Column, c: ColumnOrName) -> Column:
    text = as_col(c)
    coverage = F.least(F.lit(1.0), n_entities * F.lit(0.12) + n_relations * F.lit(0.18))
    length_bonus = F.least(F.lit(0.25), F.length(text) / F.lit(2000.0))
    relation_bonus = F.when(n_relations > 0, F.lit(0.2)).otherwise(F.lit(0.0))
    total = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), coverage + length_bonus * F.lit(0.5) + relation_bonus)
    )
    return F.when(is_blank(text), F.lit(0.0)).otherwise(total)


def needs_augmentation(
    confidence: Column, n_entities: Column, n_relations: Column, opts: Options = DEFAULTS
) -> Column:
    """Chunks whose rule result is thin: the work list for an outside extractor."""
    return (confidence < opts.augment_below) | ((n_entities >= 3) & (n_relations == 0))


def extraction_of(c: ColumnOrName, opts: Options = DEFAULTS) -> Column:
    """``struct<entities, relationships>`` of one text; the text is trimmed first by the caller."""
    text = as_col(c)
    return let(
        entities_of(text, opts),
        lambda es: F.struct(es.alias("entities"), relations_of(text, es, opts).alias("relationships")),
    )
