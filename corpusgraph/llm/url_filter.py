"""URL filter by a path-template tree with smoothed labelled purity, below fixed allow and block rules.

Every host has a tree of path segments. Digits, hexadecimal runs and dates inside a segment are generalised by
pattern; then, level by level, the children of a node that has more than ``MAX_CHILDREN`` of them turn into one
wildcard, except those with a share of at least ``OWN_SHARE``. Sibling branches whose labelled rates do not differ
from their siblings' (two-proportion z below ``SIMILAR_Z``) become one branch, subtrees included, shown as ``~``.
A branch's purity is its good share, smoothed towards the purity of its parent with ``PRIOR`` pseudo-labels, from
the root (all pages) over the host down to the template. A branch with all labels of its parent is no new evidence
and keeps the parent's purity.

Templates with a purity below a threshold are blocked: ``MIN_PURITY``, or the higher threshold that the labels bear
out. For that, a tree without the labels of every ``FOLDS``-th document is built, and the threshold is the purity
below which the share of bad among the labels left out exceeds that of the others most clearly, by a z of at least
``CLEAR_Z``.

All steps work on templates with counts (combined before the shuffle), so a host that holds a third of all pages is
no hot group. Paths are taken whole; the level loops end where no node has several templates.

Defined results: a null url or one without ``://`` has an empty host and path, and is judged as that one template.
Rows with one id are judged alone. A page without a label counts as a page, not as evidence. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_CHILDREN = 30
OWN_SHARE = 0.05
SIMILAR_Z = 2.0
PRIOR = 20.0
MIN_PURITY = 0.5
FOLDS = 5
CLEAR_Z = 3.0
BINS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    rule = verdict = F.lit(None).cast("string")
    for kind, top, start in reversed(ordered):
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(start)
        rule = F.when(fits, F.lit(top + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Segments with variable parts generalised by pattern."""
    dated = F.regexp_replace(path, r"\d{4}-\d{2}-\d{2}", "{date}")
    hexed = F.regexp_replace(dated, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{hex}")
    return F.filter(F.split(F.regexp_replace(hexed, r"\d+", "{n}"), "/"), lambda s: s != "")


def _at(level: int) -> tuple[Column, Column]:
    """The node above a level, and the segment at it."""
    return F.slice("tree", 1, level - 1).alias("parent"), F.get("tree", F.lit(level - 1)).alias("child")


def _replaced(level: int, child: Column) -> Column:
    return F.concat(F.slice("tree", 1, level - 1), F.array(child), F.slice("tree", level + 1, F.size("tree")))


def _joined(now: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """Left join of what was found for (host, parent, child)."""
    keyed = now.withColumns({c: e for c, e in zip(("parent", "child"), _at(level))})
    return keyed.join(found, ["host", "parent", "child"], "left")


def template_tree(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``tree``, the generalised template, to each raw template ``host, segments`` with its counts."""
    now = scratch.table(counts.withColumn("tree", F.col("segments")))
    level = 1
    while True:
        here = now.filter(F.size("tree") >= level).select("host", *_at(level), "n")
        widest = here.groupBy("host", "parent").count().agg(F.max("count")).first()[0] or 0
        if widest <= MAX_CHILDREN:
            return now
        children = here.groupBy("host", "parent", "child").agg(F.sum("n").alias("own"))
        totals = children.groupBy("host", "parent").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("kinds"))
        rare = children.join(totals, ["host", "parent"]).filter(
            (F.col("kinds") > MAX_CHILDREN) & (F.col("own") < OWN_SHARE * F.col("all"))
        ).select("host", "parent", "child", F.lit(True).alias("rare"))
        now = scratch.table(_joined(now, rare, level).withColumn(
            "tree", F.when(F.col("rare"), _replaced(level, F.lit("*"))).otherwise(F.col("tree"))).drop("parent", "child", "rare"))
        level += 1


def purities(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, segments, template, purity, good, bad`` of every raw template."""
    total = tree.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    good, bad = total["g"] or 0, total["b"] or 0
    root = (good + 1.0) / (good + bad + 2.0)
    hosts = tree.groupBy("host").agg(F.sum("good").alias("p_good"), F.sum("bad").alias("p_bad")).withColumn(
        "purity", (F.col("p_good") + PRIOR * root) / (F.col("p_good") + F.col("p_bad") + PRIOR))
    now = scratch.table(tree.join(hosts, "host"))
    level = 1
    while True:
        several = now.filter(F.size("tree") >= level - 1).groupBy("host", _at(level)[0]).agg(
            (F.min("tree") != F.max("tree")).alias("several")).filter("several")
        if several.isEmpty():
            break
        branch = now.filter(F.size("tree") >= level).groupBy("host", *_at(level)).agg(
            F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("purity").alias("up"),
            F.first("p_good").alias("pg"), F.first("p_bad").alias("pb"))
        n, rest = F.col("g") + F.col("b"), F.col("pg") + F.col("pb") - F.col("g") - F.col("b")
        mean = (F.col("pg") + 0.5) / (F.col("pg") + F.col("pb") + 1.0)
        gap = F.abs(F.col("g") / n - (F.col("pg") - F.col("g")) / rest)
        differs = F.when((n == 0) | (rest == 0), F.lit(False)).otherwise(
            gap >= SIMILAR_Z * F.sqrt(mean * (1 - mean) * (1 / n + 1 / rest)))
        branch = scratch.table(branch.withColumn("differs", differs))
        pooled = branch.filter("not differs").groupBy("host", "parent").agg(
            F.sum("g").alias("mg"), F.sum("b").alias("mb"), F.count(F.lit(1)).alias("alike"))
        g = F.when(F.col("differs"), F.col("g")).otherwise(F.col("mg"))
        b = F.when(F.col("differs"), F.col("b")).otherwise(F.col("mb"))
        judged = branch.join(pooled, ["host", "parent"], "left").select(
            "host", "parent", "child", g.alias("og"), b.alias("ob"),
            F.when((g == F.col("pg")) & (b == F.col("pb")), F.col("up")).otherwise((g + PRIOR * F.col("up")) / (g + b + PRIOR)).alias("own"),
            (~F.col("differs") & (F.col("alike") > 1)).alias("merged"))
        now = scratch.table(_joined(now, judged, level).withColumns({
            "tree": F.when(F.col("merged"), _replaced(level, F.lit("~"))).otherwise(F.col("tree")),
            "purity": F.coalesce("own", "purity"), "p_good": F.coalesce("og", "p_good"), "p_bad": F.coalesce("ob", "p_bad"),
        }).drop("parent", "child", "own", "og", "ob", "merged"))
        level += 1
    return now.select("host", "segments", F.concat(F.lit("/"), F.concat_ws("/", "tree")).alias("template"), "purity", "good", "bad")


def clear_threshold(bins: list[tuple[int, int, int]]) -> float:
    """The threshold of the clearest difference, from (bin of the purity, good, bad) of the labels left out; else
    ``MIN_PURITY``, which is also the least."""
    good, bad = sum(g for _, g, _ in bins), sum(b for _, _, b in bins)
    best, threshold, below_good, below_bad = CLEAR_Z, MIN_PURITY, 0, 0
    for place, g, b in sorted(bins):
        below_good, below_bad = below_good + g, below_bad + b
        n, rest = below_good + below_bad, good + bad - below_good - below_bad
        if not n or not rest:
            continue
        mean = (bad + 0.5) / (good + bad + 1.0)
        z = (below_bad / n - (bad - below_bad) / rest) / math.sqrt(mean * (1 - mean) * (1 / n + 1 / rest))
        if z > best:
            best, threshold = z, max(MIN_PURITY, (place + 1) / BINS)
    return threshold


def held_out_bins(pages: DataFrame, scratch: Scratch) -> list[tuple[int, int, int]]:
    """(bin of the purity, good, bad) of the labels of every ``FOLDS``-th document, under the tree of all the others.

    At most ``BINS`` + 1 rows reach the driver. ``pages``: as for ``label_counts``.
    """
    left_out = F.coalesce(F.crc32(F.col("shown").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    learned = pages.withColumn("good", F.when(~left_out, F.col("good")))
    tested = label_counts(pages.filter(left_out)).select("host", "segments", F.col("good").alias("g"), F.col("bad").alias("b"))
    table = purities(template_tree(label_counts(learned), scratch), scratch)
    binned = table.join(tested, ["host", "segments"]).groupBy(F.floor(F.col("purity") * BINS).cast("int").alias("place")).agg(
        F.sum("g").alias("g"), F.sum("b").alias("b"))
    return [(r["place"], r["g"], r["b"]) for r in binned.collect()]


def label_counts(pages: DataFrame) -> DataFrame:
    """``host, segments, n, good, bad`` of rows ``host, segments, n, good`` (1, 0, or null without a label)."""
    return pages.groupBy("host", "segments").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("good") == 0, F.col("n")).otherwise(0)).alias("bad"))


def labelled_pages(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, segments, shown, n, good``: how many pages of each template show a document, and its label.

    Pages without a number take no part in the join with labels.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("shown")).agg(
        F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"))
    counted = parsed.groupBy("host", "segments", "shown").agg(F.count(F.lit(1)).alias("n"))
    numbered = counted.filter("shown is not null").join(known, "shown", "left")
    return numbered.unionByName(counted.filter("shown is null").withColumn("good", F.lit(None).cast("int")))


def _parsed(pages: DataFrame) -> DataFrame:
    host, path = host_of(), path_of()
    number = F.regexp_extract(path, r"(\d{1,18})(?:\.[A-Za-z]+)?/?\z", 1)
    return pages.select(
        "page_id", host.alias("host"), path.alias("path"), _segments(path).alias("segments"),
        F.when(number != "", number.cast("bigint")).alias("shown"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row of ``pages``.

    ``labels``: ``doc_id, quality``. A page shows the document whose id ends its path; that document's label is the
    page's. Several labels of one document count as the worst.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    parsed = _parsed(pages)
    labelled = scratch.table(labelled_pages(parsed, labels))
    threshold = clear_threshold(held_out_bins(labelled, scratch))
    table = purities(template_tree(label_counts(labelled), scratch), scratch).drop("good", "bad")
    judged = parsed.drop("shown").join(table, ["host", "segments"], "left")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
