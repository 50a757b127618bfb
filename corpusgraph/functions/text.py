"""Column expressions over text: normal forms, sentences, token estimates, headers, terms.

Patterns start with ``(?U)`` where word, digit, space and boundary classes must be Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: ColumnOrName) -> Column:
    """Trim white space of every kind; unlike a pattern, this looks at the ends of the text only."""
    return F.btrim(as_col(c), F.lit(WHITE_SPACE))


def strip_end(c: ColumnOrName) -> Column:
    return F.rtrim(as_col(c), F.lit(WHITE_SPACE))


def is_blank(c: ColumnOrName) -> Column:
    return F.coalesce(~as_col(c).rlike(r"(?U)\S"), F.lit(True))


def text_or_empty(c: ColumnOrName) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def token_estimate(c: ColumnOrName) -> Column:
    """One token for four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(as_col(c)) / 4).cast("int"))


def sentences(c: ColumnOrName) -> Column:
    """Array of trimmed sentences; a sentence ends at ``. ! ?`` before white space."""
    parts = F.split(strip(c), r"(?U)(?<=[.!?])\s+")
    return F.filter(parts, lambda s: F.length(s) > 0)


def is_section_header(c: ColumnOrName) -> Column:
    # The patterns and lengths of headers.
    t = strip(c)
    upper_case = (t == F.upper(t)) & (t != F.lower(t))
    return (F.length(t) <= 120) & (
        t.rlike(r"(?iU)^Section\s+\d+\s*[:\.]")
        | t.rlike(r"(?U)^#+\s+\w")
        | t.rlike(r"(?U)^[\d\.\-]+\s+\w+")
        | (upper_case & (F.length(t) < 80))
    )


def normal_form(c: ColumnOrName) -> Column:
    """Lower case, punctuation to blanks, single blanks, ``5 million`` -> ``5m``, ``5 bn`` -> ``5b``."""
    # The patterns of the normal form.
    s = F.lower(strip(text_or_empty(c)))
    # Punctuation and white space in one pass; a single blank stays as it is. Small letters are tried first, which spares most
    # characters the Unicode classes.
    s = F.regexp_replace(s, r"(?U)[^a-z\w.\-\x20][^a-z\w.\-]*|\x20[^a-z\w.\-]+", " ")

    def short_amounts(t: Column) -> Column:
        millions = F.regexp_replace(t, r"(?U)\b(\d+)\s*(?:million|mn|m)\b", "$1m")
        both = F.regexp_replace(millions, r"(?U)\b(\d+)\s*(?:billion|bn|b)\b", "$1b")
        return F.when(t.rlike(r"(?U)\d\s*[mb]"), both).otherwise(t)

    return strip(let(s, short_amounts))


def content_hash(c: ColumnOrName) -> Column:
    return F.sha2(normal_form(c), 256)


def word_tokens(c: ColumnOrName) -> Column:
    """Lower-case runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# Fixed value: the terms whose variety marks a chunk as mixing topics.
SALIENT_TERMS = r"\b(20\d{2}|19\d{2}|LSTM|CNN|RNN|GRU|Transformer|BERT|GPT|revenue|cost|profit|earnings|margin|%)\b"


def salient_terms(c: ColumnOrName) -> Column:
    found = F.regexp_extract_all(as_col(c), F.lit("(?iU)" + SALIENT_TERMS), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def ascii_share(c: ColumnOrName) -> Column:
    t = text_or_empty(c)
    ascii_only = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    return ascii_only / F.greatest(F.lit(1), F.length(t))


def last_key_part(c: ColumnOrName) -> Column:
    """Text after the last ``::`` of a graph key."""
    return F.element_at(F.split(as_col(c), "::"), -1)


def clip(c: ColumnOrName, chars: int) -> Column:
    return F.substring(as_col(c), 1, chars)


def ellipsis(c: ColumnOrName, chars: int) -> Column:
    """First ``chars`` characters without trailing blanks, and an ellipsis where text was cut."""
    t = as_col(c)
    cut = strip_end(clip(t, chars))
    return F.when(F.length(t) > chars, F.concat(cut, F.lit("…"))).otherwise(cut)
