"""Secret scans: a trigram inverted index finds the texts that a rule can match, the rule's pattern verifies them.

1. *Queries.* The Boolean trigram query of a rule is derived from its pattern: literal runs give the trigrams that every
   match must hold, alternatives are joined by OR (``trigram_query``). Letters are taken small, so one index serves
   patterns of either case. A pattern without mandatory trigrams (``[0-9a-f]+``) has no query.
2. *Index.* Texts are numbered and written once. For each trigram that a rule asks for, a posting bitmap holds the texts
   with it, one bitmap of 4 KB for 32,768 texts. Postings come from one pass over the texts; map-side aggregation means
   that bitmaps alone are shuffled.
3. *Intersection.* The postings of an alternative's trigrams are ANDed, those of a rule's alternatives ORed, block by
   block. The bits left are the rule's candidate texts, written as ids.
4. *Verification.* Candidates alone are searched by the rules they are candidates of. Where the written list of
   candidates is small, Spark broadcasts it by its size; else texts and candidates meet on unique numbers.
   Rules without a query search every text in the scan, without a shuffle.

Places are code points. A match's place follows from the lengths of what lies between matches, summed in blocks, so a text
with very many matches costs no more than in proportion. All is built from DataFrame functions: no Python in a worker.

Defined results: a null or empty text has no spans. Rows are judged each by itself, so equal rows give equal rows and a null
id is kept. Matches of one rule do not overlap; those of different rules may. Equal starts are ordered as the rules are
listed. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Running sums over the matches of a text go in blocks of this many.
SUM_BLOCK = 512
#: A trigram query keeps at most this many alternatives; beyond, its weakest conditions go (it stays a necessary one).
MAX_ALTERNATIVES = 64
_MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``fold``: letters in either case. A match counts if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


#: The base rules. A run shorter than asked is dropped after matching, not skipped while matching.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds with well-known prefixes. Repeats that start anew at many places of one run are bounded, so no text makes
#: the search quadratic.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[opusr]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,255}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login_url", r"://[A-Za-z0-9._~%-]{1,128}:[A-Za-z0-9._~%!$&+=-]{1,128}@"),
)
RULES = BASE_RULES + MORE_RULES

Query = list[frozenset[str]] | None


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i: i + 3] for i in range(len(text) - 2))


def _fewest(alternatives: set[frozenset[str]]) -> list[frozenset[str]]:
    """Without alternatives that hold all of another; the order is fixed."""
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _both(a: Query, b: Query) -> Query:
    """AND of two queries; where that grows too far, the one with fewer alternatives alone."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MAX_ALTERNATIVES:
        return min(a, b, key=len)
    return _fewest({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    found = [_trigrams(s) for s in strings]
    return _fewest(set(found)) if found and all(found) else None


def _part(op, value) -> tuple[set[str] | None, Query]:
    """All strings that one part of a pattern matches where they are few, else None, and a necessary query."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, None
    if name == "AT":
        return {""}, None
    if name == "IN" and all(str(kind) == "LITERAL" for kind, _ in value):
        return {chr(code).lower() for _, code in value}, None
    if name == "SUBPATTERN":
        return _walk(value[3])
    if name == "BRANCH":
        branches = [_walk(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in branches):
            return set().union(*(strings for strings, _ in branches)), None
        queries = [query if strings is None else _of_strings(strings) for strings, query in branches]
        return None, None if any(q is None for q in queries) else _fewest({a for q in queries for a in q})
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = value
        strings, query = _walk(body)
        if strings is not None and int(high) <= 4 and len(strings) <= 4:
            return {"".join(p) for n in range(low, int(high) + 1) for p in product(strings, repeat=n)}, None
        return None, None if not low else query if strings is None else _of_strings(strings)
    return None, None


def _walk(parts) -> tuple[set[str] | None, Query]:
    """The same for a sequence: neighbouring parts with few strings are joined to longer ones."""
    run, query, whole = {""}, None, True
    for op, value in parts:
        strings, inner = _part(op, value)
        if strings is not None and len(strings) * len(run) <= _MAX_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query = _both(_both(query, _of_strings(run)), inner)
            run, whole = {""} if strings is None else strings, False
    return (run, None) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams in small letters, one of which every match holds in full; None if there are none."""
    strings, query = _walk(re._parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _grown(values: Column, start: Column) -> Column:
    """``start`` and the running sums of ``values`` after it."""
    return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def find_spans(texts: DataFrame, rules: dict[int, Rule], gate: str | None = None) -> DataFrame:
    """``texts`` without ``text`` and with ``spans``: the matches of all ``rules`` (by rank), unordered.

    ``gate``: a column with a bit mask of the ranks that a text is searched for. Steps are columns of their own, so that
    no expression is computed twice.
    """
    kept = [c for c in texts.columns if c != "text"]
    zero, none = F.lit(0).cast("bigint"), F.array().cast(_SPANS)
    wanted = {r: F.lit(True) if gate is None else F.expr(f"({gate} & {1 << r}L) <> 0") for r in rules}
    found = texts.select(*kept, "text", *[
        F.when(wanted[r], F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))).alias(f"found{r}")
        for r, rule in rules.items()])
    for r, rule in rules.items():
        some = F.size(f"found{r}") > 0
        judged = F.col(f"found{r}") if not rule.group else F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group))
        found = found.withColumns({
            f"judged{r}": F.when(some, judged),
            f"between{r}": F.when(some, F.split("text", rule.regex, -1)),
        })
    found = found.drop("text")
    for r, rule in rules.items():
        found = (
            found.withColumn("steps", F.zip_with(
                F.slice(f"between{r}", 1, F.size(f"found{r}")), f"found{r}", lambda a, b: (F.length(a) + F.length(b)).cast("bigint")))
            .withColumn("blocks", F.when(F.size("steps") > 0, F.transform(
                F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / SUM_BLOCK).cast("int")),
                lambda b: F.slice("steps", b * SUM_BLOCK + 1, SUM_BLOCK))))
            .withColumn("before", _grown(F.transform("blocks", lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), zero))
            .withColumn("ends", F.flatten(F.zip_with(
                "blocks", F.slice("before", 1, F.size("blocks")), lambda b, s: F.slice(_grown(b, s), 2, SUM_BLOCK))))
            .withColumn(f"found{r}", F.zip_with(F.zip_with("ends", f"found{r}", lambda end, m: F.struct(
                (end - F.length(m)).alias("start"), F.lit(r).alias("rank"), end.alias("end"))),
                f"judged{r}", lambda span, v: F.when(F.length(v) >= rule.least, span)))
            .drop("steps", "blocks", "before", "ends", f"between{r}", f"judged{r}"))
    spans = F.concat(none, *[F.coalesce(F.array_compact(f"found{r}"), none) for r in rules])
    return found.select(*kept, spans.alias("spans"))


_SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def build_index(numbered: DataFrame, trigrams: list[str]) -> DataFrame:
    """``bucket, trigram, texts``: a bitmap of the texts (by number ``row``) that hold each trigram, letters small."""
    small = numbered.select("row", F.lower("text").alias("small"))
    held = F.array_compact(F.array(*[F.when(F.contains("small", F.lit(t)), F.lit(t)) for t in trigrams]))
    return (
        small.select("row", F.explode(held).alias("trigram"))
        .groupBy(F.bitmap_bucket_number("row").alias("bucket"), "trigram")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("texts")))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """``row, rules``: the numbers of texts that fulfil a rule's query, and those rules as a bit mask."""
    spark = index.sparkSession
    wanted = [(rank, n, t, len(alternative)) for rank, query in queries.items()
              for n, alternative in enumerate(query) for t in sorted(alternative)]
    asked = F.broadcast(spark.createDataFrame(wanted, "rank int, alternative int, trigram string, terms int"))
    held = (
        index.join(asked, "trigram").groupBy("bucket", "rank", "alternative")
        .agg(F.bitmap_and_agg("texts").alias("texts"), F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
        .filter("n = terms").groupBy("bucket", "rank").agg(F.bitmap_or_agg("texts").alias("texts"))
        .filter("bitmap_count(texts) > 0"))
    eight = F.conv(F.hex(F.substring("texts", F.floor(F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return (
        held.select("bucket", "rank", "texts", F.explode(F.sequence(F.lit(0), F.lit(32767))).alias("bit"))
        .filter(eight.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) > 0)
        .select(((F.col("bucket") - 1) * 32768 + F.col("bit") + 1).alias("row"), "rank")
        .groupBy("row").agg(F.bit_or(F.expr("shiftleft(1L, rank)")).alias("rules")))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: for each row of ``docs`` its spans, ordered by start and rule."""
    scratch = Scratch(docs.sparkSession, "secrets")
    queries = {rank: trigram_query(rule.pattern) for rank, rule in enumerate(rules)}
    indexed = {rank: query for rank, query in queries.items() if query is not None}
    text = F.coalesce("text", F.lit(""))
    numbered = scratch.table(docs.select(
        F.col("doc_id"), text.alias("text"), (F.monotonically_increasing_id() + 1).alias("row")))

    scanned = find_spans(numbered, {r: rules[r] for r in queries if r not in indexed})
    if indexed:
        trigrams = sorted({t for query in indexed.values() for alternative in query for t in alternative})
        chosen = scratch.table(candidates(build_index(numbered, trigrams), indexed))
        verified = scratch.table(
            find_spans(numbered.join(chosen, "row").select("row", "rules", "text"), {r: rules[r] for r in indexed}, "rules")
            .filter("size(spans) > 0").select("row", F.col("spans").alias("verified")))
        spans = F.concat("spans", F.coalesce("verified", F.array().cast(_SPANS)))
        scanned = scanned.join(verified, "row", "left").withColumn("spans", spans)
    return scanned.select("doc_id", F.array_sort("spans").alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds, and all spans."""
    found = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")

    counts = [count(rank).alias(f"n_{rule.kind}") for rank, rule in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
