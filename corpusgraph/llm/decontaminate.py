"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes tokens: words of letters and digits, in lower case. Numbers, names (capitalised words that do not begin
a sentence) and units (after a number) are typed placeholders in its template; their values are slots.
Windows of ``WINDOW`` tokens are hashed by two templates, one with names as placeholders and one with names as
lower-cased words, since letter case and punctuation decide what looks like a name. They meet the benchmark's windows
by either. Hits of one document and
item on one diagonal (the same distance between their places) belong together. They count if the slots are
consistent, that is if the item's slot values map one to one to the document's; so a question with other numbers or
names is caught, and a text that only looks alike is not. Words put in or left out move the diagonal: diagonals that
follow each other within ``MAX_DRIFT`` are one passage. Its windows with the item's own values count whatever the others
hold; those with other values count, all or those of one diagonal, if their slots are consistent. A document is contaminated by an item if ``MIN_COVERED``
tokens, or ``MIN_SHARE`` of a shorter item, lie in such windows.

The document side is one scan with no shuffle up to the join. The benchmark's windows are broadcast only if they
are counted to be at most ``MAX_BROADCAST``; beyond that both sides are shuffled by window hash, each window with its own words. Only hits are
shuffled after the join.

``n_covered`` and ``reworded`` are of windows with names as placeholders on one diagonal where these are
enough alone, else of all.

Defined results: null or empty texts hit nothing. Items with the same text count as the one with the smallest id.
Items shorter than a window are one window of their own length. Windows with more placeholders than other tokens say
too little: they count only where all their lower-cased words are the document's. Rows that share an id are one
document. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, row_key

WINDOW = 8
MIN_COVERED = 13
MIN_SHARE = 0.8
MAX_BROADCAST = 200_000
# Hits whose diagonals follow each other at no more than this are of one passage.
MAX_DRIFT = 8
UNITS = ("km m cm mm kg g mg lb lbs oz l ml mph kmh miles mile meters metres meter metre feet foot ft inches inch dollars "
         "dollar euros euro cents pounds percent hours hour minutes minute seconds second days day weeks week months month "
         "years year degrees tons tonnes litres liters gallons").split()
# Put before a name.
NAME = "\x01"
# Stands for a point or comma between digits.
POINT = "\x02"
# A capital after a small letter, digit, comma or semicolon and a blank begins a name.
NAME_START = r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;]\s)"
POINT_IN_NUMBER = r"[.,](?<=[0-9].)(?=[0-9])"
BETWEEN_WORDS = r"[^\p{L}\p{N}\x01\x02]+"
KINDS = ["", "number", "name", "unit"]
# Hashes of the templates, the one with names as placeholders first, and of the words themselves.
FORMS = ["named", "worded", "literal"]


def _is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def _is_unit(token: Column, i: Column) -> Column:
    return token.isin(UNITS) & _is_number(F.get("tokens", i - 1))


def with_tokens(rows: DataFrame) -> DataFrame:
    """``tokens`` (lower-cased words), names ``marked``, and the hashes of each form (``FORMS``) in place of ``text``.

    Each step is a column of its own, so that a token's look at the one before does not split the text anew.
    """
    named = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), NAME_START, NAME)
    marked = F.lower(F.regexp_replace(named, POINT_IN_NUMBER, POINT))
    rows = rows.withColumn("marked", F.split(marked, BETWEEN_WORDS)).drop("text")
    rows = rows.withColumn("marked", F.filter("marked", lambda t: t != ""))
    rows = rows.withColumn("tokens", F.transform("marked", lambda t: F.when(t < "0", F.substring(t, 2, 2**31 - 1)).otherwise(t)))
    number, name, unit = (F.xxhash64(F.lit(NAME + k)) for k in KINDS[1:])
    rows = rows.withColumn("literal", F.transform("tokens", lambda t: F.xxhash64(t)))
    rows = rows.withColumn("worded", F.transform("tokens", lambda t, i: (
        F.when(_is_number(t), number).when(_is_unit(t, i), unit).otherwise(F.get("literal", i)))))
    return rows.withColumn("named", F.transform("marked", lambda t, i: F.when(t < "0", name).otherwise(F.get("worded", i))))


def _windows(form: str, size: int) -> Column:
    """The hash of the ``size`` templates from ``place`` on."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(form), F.col("place") + k) for k in range(size)])


def windows(rows: DataFrame, size: int) -> DataFrame:
    """``place, form, window`` of every ``size`` consecutive tokens in place of the hashes; equal forms give one row.

    Hashes are taken from the arrays after the explode, where Spark compiles them.
    """
    keep = [c for c in rows.columns if c not in FORMS]
    places = rows.filter(F.size("tokens") >= size).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("tokens") - size)))
    hashed = places.withColumns({f: _windows(f, size) for f in FORMS})
    forms = F.array(F.col("named"), *[F.when(F.col(b) != F.col(a), F.col(b)) for a, b in zip(FORMS, FORMS[1:])])
    return hashed.select(*keep, "place", F.posexplode(forms).alias("form", "window")).filter("window is not null")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_item, size, at, window, item_form, item_tokens, kinds`` of the windows, by each form that says enough."""
    items = benchmark.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    worded = F.transform("tokens", lambda t, i: F.when(_is_number(t), "number").when(_is_unit(t, i), "unit").otherwise(""))
    named = F.transform("marked", lambda t, i: F.when(t < "0", "name").otherwise(F.get("worded_kinds", i)))
    hashed = with_tokens(items).withColumn("worded_kinds", worded).withColumn("named_kinds", named)
    hashed = hashed.withColumn("n_item", F.size("tokens")).filter("n_item > 0").drop("marked")
    hashed = hashed.withColumn("size", F.least("n_item", F.lit(WINDOW)))
    sized = [windows(hashed.filter(F.col("size") == k), k) for k in range(1, WINDOW + 1)]
    part = lambda c: F.slice(c, F.col("place") + 1, F.col("size"))
    own = reduce(DataFrame.unionByName, sized).select(
        "item_id", "n_item", "size", F.col("place").alias("at"), "window", F.col("form").alias("item_form"), part("tokens").alias("item_tokens"),
        F.when(F.col("form") == 0, part("named_kinds")).otherwise(part("worded_kinds")).alias("kinds"))
    says_little = 2 * F.size(F.filter("kinds", lambda k: k != "")) > F.col("size")
    # Windows whose words and names say too little by any template meet by all their words.
    return own.filter((F.col("item_form") == FORMS.index("literal")) == says_little)


def _one_to_one(slots: Column) -> Column:
    item_side = F.transform(slots, lambda s: F.struct(s["k"], s["b"]))
    document_side = F.transform(slots, lambda s: F.struct(s["k"], s["d"]))
    return (F.size(F.array_distinct(item_side)) == F.size(slots)) & (F.size(F.array_distinct(document_side)) == F.size(slots))


def _covered(ats: Column) -> Column:
    """How many tokens of the item lie in windows that begin at ``ats``."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(ats), start, lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.col("size"), at - acc["last"])).alias("n")),
        lambda acc: acc["n"])


def _judged(ats: Column, slots: Column) -> Column:
    """``n_covered, changed`` if the windows are enough and their slots consistent, else null."""
    n = _covered(ats)
    enough = n >= F.least(F.lit(float(MIN_COVERED)), MIN_SHARE * F.col("n_item"))
    return F.when(_one_to_one(slots) & enough, F.struct(
        n.alias("n_covered"), F.exists(slots, lambda s: s["b"] != s["d"]).alias("changed")))


def contaminated(docs: DataFrame, benchmark: DataFrame, keep_key: bool = False) -> DataFrame:
    """``doc_id, item_id, n_covered, n_item, reworded``: a row for each document and item that meet in it.

    ``keep_key``: a row for each row of ``docs`` instead, with ``row``, which tells rows of one id apart.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    known = scratch.table(benchmark_windows(benchmark))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()
    hashed = with_tokens(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")).drop("marked")
    hits = None
    for k in sorted(size["sizes"]) or [WINDOW]:  # one size, and those of shorter items
        places = windows(hashed, k)
        items = known.filter(F.col("size") == k)
        in_window = F.slice("tokens", F.col("place") + 1, F.lit(k))
        if size["n"] <= MAX_BROADCAST:
            items = F.broadcast(items)
        else:
            # A shuffled window carries its own words, not those of its document.
            places, in_window = places.withColumn("in_window", in_window).drop("tokens"), F.col("in_window")
        met = places.join(items, "window").select(
            "doc_id", "row", "item_id", "n_item", "size", "at", (F.col("place") - F.col("at")).alias("diagonal"),
            ((F.col("form") == 0) & (F.col("item_form") == 0)).alias("plain"),
            F.filter(F.arrays_zip(F.col("kinds").alias("k"), F.col("item_tokens").alias("b"), in_window.alias("d")),
                     lambda s: s["k"] != "").alias("slots"))
        hits = met if hits is None else hits.unionByName(met)
    edited = F.exists("slots", lambda s: s["b"] != s["d"])
    lines = hits.groupBy("doc_id", "row", "item_id", "n_item", "size", "diagonal").agg(
        F.collect_set(F.when(F.col("plain"), F.col("at"))).alias("plain_ats"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("plain"), F.col("slots"))))).alias("plain_slots"),
        F.collect_set(F.when(~edited, F.col("at"))).alias("same_ats"), F.collect_set(F.when(edited, F.col("at"))).alias("ats"),
        F.array_distinct(F.flatten(F.collect_set(F.when(edited, F.col("slots"))))).alias("slots"))
    by_place = W.partitionBy("doc_id", "row", "item_id").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_place) > MAX_DRIFT, F.lit(False))
    near = lines.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(by_place))
    passages = near.groupBy("doc_id", "row", "item_id", "n_item", "size", "passage").agg(F.collect_list(F.struct(
        "plain_ats", "plain_slots", "same_ats", "ats", "slots")).alias("lines"))
    passages = passages.withColumns({n: F.array_distinct(F.flatten(f"lines.{n}")) for n in ("same_ats", "ats", "slots")})
    plain = F.transform("lines", lambda x: _judged(x["plain_ats"], x["plain_slots"]))
    none = F.array().cast(passages.schema["slots"].dataType)
    wide = F.concat(
        F.array(_judged(F.col("same_ats"), none), _judged(F.array_union("same_ats", "ats"), F.col("slots"))),
        F.transform("lines", lambda x: _judged(F.array_union("same_ats", x["ats"]), x["slots"])))
    judged = passages.select("doc_id", "row", "item_id", "n_item", *[
        F.struct(F.array_max(r.getField("n_covered")).alias("n_covered"), F.array_min(r.getField("changed")).alias("changed")).alias(n)
        for n, r in (("plain", plain), ("wide", wide))]).filter("plain.n_covered is not null or wide.n_covered is not null")
    first = lambda f, n: F.coalesce(f(f"plain.{n}"), f(f"wide.{n}"))
    return judged.groupBy("doc_id", *(["row"] if keep_key else []), "item_id").agg(
        first(F.max, "n_covered").cast("bigint").alias("n_covered"), F.max("n_item").cast("bigint").alias("n_item"),
        first(F.min, "changed").alias("reworded"))
