"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score +1, words inside menus, headers, footers, sidebars, notices,
adverts, forms and comment sections nothing, and tags score the negative weight of their kind. A linear scan finds
the contiguous region with the highest sum; its words outside those elements are the text. Weights come from
labelled pages (pages whose document's text is known): a kind of tag that stands between words of the text costs
little, one that stands elsewhere costs the logarithm of its odds. An advert amid the text so costs little, a menu
before it much. A tag inside one of those elements is another kind than the same tag elsewhere. Kinds without a label
have default weights.

The fit uses at most ``LABELLED_PAGES`` pages (those with the smallest id hashes). All pages are extracted whole.

Defined results: null or empty html, or html without words outside the elements above, gives an empty text. An
element that is not closed ends with its parent; a button, selection, picture, player or the like that is not closed
ends with its parent or at the next block tag, whichever comes first. Scripts, styles, titles and text fields run to
their closing tag as in browsers, and to the next block tag where the page has no such tag left. A comment without an
end takes the rest of the page, as in browsers. A tag that is cut off at the end of the page is dropped. Rows with
one id are extracted alone. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

LABELLED_PAGES = 500
SMALLEST = 0.05
CONTAINER = 0.5
# Marks the kinds of tags inside menus, adverts and the like.
INSIDE = "~"

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Their content is no markup.
RAW_TEXT = frozenset("script style textarea title".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TEXT}
# Never part of the text, whole elements at once.
HIDDEN = RAW_TEXT | frozenset("noscript template svg math iframe object select button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer footnav form gdpr header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promos promotion related replies reply respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
CONTAINERS = frozenset("html body article main section div table".split())
WHOLE = frozenset("html body article main".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if "=" in text else {}


def _is_aside(tag: str, attributes: dict[str, str], raw: str, by_name: bool) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if attributes:
        if attributes.get("role", "").lower() in ASIDE_ROLES or attributes.get("aria-hidden") == "true":
            return True
        if "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return True
        names = attributes.get("class", "") + " " + attributes.get("id", "") if by_name else ""
        parts = {p.lower() for p in _NAME_PART.findall(names)}
        if parts & ASIDE_NAMES and (tag not in WHOLE or (tag == "article" and parts & {"comment", "comments", "reply", "replies"})):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", raw)) if "hidden" in raw else False


def _kind(tag: str, attributes: dict[str, str], closing: bool) -> str:
    """Tag name, its first class, and whether it opens or closes."""
    named = attributes.get("class", "").split()
    return ("/" if closing else "") + tag + ("." + named[0].lower() if named else "")


class _Tag(NamedTuple):
    start: int
    end: int
    name: str
    closing: bool
    alone: bool
    rest: str


def _tags(page: str) -> list[_Tag]:
    """The tags of a page in order. The element of a raw text is one tag of its own."""
    tags: list[_Tag] = []
    at, endless = 0, set()
    while m := _MARKUP.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        alone = name in VOID or (m[3] or "").endswith("/")
        if name in RAW_TEXT and not m[1] and not alone:
            # A search that found no end is not made again.
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end is None:
                endless.add(name)
                block = _BLOCK_TAG.search(page, at)
                at = block.start() if block else len(page)
            else:
                at = end.end()
            alone = True
        tags.append(_Tag(m.start(), at, name, bool(m[1]), alone, m[3] or ""))
    return tags


def _ends(tags: list[_Tag]) -> tuple[dict[int, int], dict[int, int]]:
    """For opening tags of hidden elements: their closing tag, or else the tag that ends them with their parent."""
    closed: dict[int, int] = {}
    ended: dict[int, int] = {}
    stack: list[int] = []
    open_now: Counter[str] = Counter()
    for i, tag in enumerate(tags):
        if not tag.name or tag.alone:
            continue
        if not tag.closing:
            if tag.name == "body":
                ended.update((j, i) for j in stack if tags[j].name in HIDDEN)
                stack, open_now = [], Counter()
            stack.append(i)
            open_now[tag.name] += 1
        elif open_now[tag.name]:
            while True:
                j = stack.pop()
                open_now[tags[j].name] -= 1
                same = tags[j].name == tag.name
                if tags[j].name in HIDDEN:
                    (closed if same else ended)[j] = i
                if same:
                    break
    return closed, ended


def parts_of(page: str, by_name: bool = True) -> list[tuple[str, str, int, bool]]:
    """``(tag kind or "", text, block, aside)`` of the markup and text of a page, in order.

    ``by_name``: classes and ids tell adverts and the like, besides tags and roles.
    """
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, bool, str]] = []
    open_now: Counter[str] = Counter()
    tags = _tags(page)
    closed, ended = _ends(tags) if any(t.name in HIDDEN for t in tags) else ({}, {})
    asides = block = at = i = 0
    while i < len(tags):
        tag = tags[i]
        name, here = tag.name, i
        if tag.start > at:
            out.append(("", page[at:tag.start], block, asides > 0))
        at = tag.end
        i += 1
        if name in HIDDEN:
            if tag.closing or tag.alone:
                continue
            if here in closed:
                i = closed[here] + 1
                at = tags[i - 1].end
            else:
                last = ended.get(here, len(tags))
                while i < last and tags[i].name not in BLOCKS:
                    i += 1
                at = tags[i].start if i < len(tags) else len(page)
            continue
        if not name:
            continue
        if name == "br":
            out.append(("", " ", block, asides > 0))
            continue
        if name not in INLINE:
            block += 1
        if tag.alone:
            out.append(((INSIDE if asides else "") + name, "", block, asides > 0))
            continue
        if tag.closing:
            if open_now[name]:
                while True:
                    opened, aside, kind = stack.pop()
                    open_now[opened] -= 1
                    asides -= aside
                    if opened == name:
                        break
                out.append(((INSIDE if asides else "") + "/" + kind, "", block, asides > 0))
            continue
        attributes = _attributes(tag.rest)
        aside = _is_aside(name, attributes, tag.rest, by_name)
        if name == "body":
            stack, asides, open_now = [], 0, Counter()
        kind = _kind(name, attributes, False)
        stack.append((name, aside, kind))
        open_now[name] += 1
        asides += aside
        out.append(((INSIDE if asides else "") + kind, "", block, asides > 0))
    if at < len(page):
        out.append(("", page[at:], block, asides > 0))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the first contiguous region with the highest sum; empty if no sum is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best region; where names mark the whole page as aside, they are left out of account."""
    return _main_text(parts_of(page), weights) or _main_text(parts_of(page, by_name=False), weights)


def _main_text(parts: list[tuple[str, str, int, bool]], weights: dict[str, float]) -> str:
    scores = []
    for kind, text, _, aside in parts:
        if kind:
            plain = kind.split(".")[0]
            scores.append(-weights.get(kind, weights.get(plain, CONTAINER if plain.lstrip("/") in CONTAINERS else SMALLEST)))
        else:
            scores.append(0.0 if aside else float(len(text.split())))
    low, high = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for kind, text, block, aside in parts[low:high]:
        if not kind and not aside:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _tag_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each kind of tag: how often it stands between words of the known text (not counting those of menus, adverts
    and the like), and how often not."""
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page, text in zip(strings(batch.column("html")).to_pylist(), strings(batch.column("text")).to_pylist()):
            lines = {" ".join(x.split()) for x in text.split("\n")}
            first = " ".join(text.split())
            parts = parts_of(page)
            blocks: dict[int, list[str]] = {}
            for kind, piece, block, aside in parts:
                if not kind and not aside:
                    blocks.setdefault(block, []).append(piece)
            known = {}
            for block, pieces in blocks.items():
                line = " ".join(html.unescape("".join(pieces)).split())
                if line:
                    known[block] = line in lines or first.startswith(line)
            before, waiting = False, []
            for kind, _, block, aside in parts:
                if kind:
                    waiting.append(kind)
                elif block in known and not aside:
                    (inside if before and known[block] else outside).update(waiting)
                    before, waiting = known[block], []
            outside.update(waiting)
        kinds = sorted(inside | outside)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()),
             pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])


def learn_weights(pages: DataFrame, documents: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights of tag kinds from at most ``limit`` pages whose url ends with the id of a document."""
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.[A-Za-z]+)?/?(?:[?#].*)?\z", 1)
    shown = pages.filter("html is not null").select(F.when(number != "", number.cast("bigint")).alias("shown"), "html")
    # The sample has at most ``limit`` ids, and one page for each.
    ids = F.broadcast(shown.filter("shown is not null").select("shown").distinct().orderBy(F.xxhash64("shown"), "shown").limit(limit))
    sample = shown.join(ids, "shown").groupBy("shown").agg(F.min("html").alias("html"))
    known = documents.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("shown"), "text").join(ids, "shown")
    places = sample.join(known, "shown").select("html", "text").mapInArrow(
        _tag_places, "kind string, inside bigint, outside bigint")
    # One row for each kind of tag in the sample.
    sums = places.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return {r["kind"]: max(SMALLEST, math.log2((r["outside"] + 0.5) / (r["inside"] + 0.5))) for r in sums}


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in strings(batch.column("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract(weights or {}), "page_id bigint, url string, text string, n_chars bigint")
