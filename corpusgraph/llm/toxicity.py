"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, takes away accents and characters without a width, replaces homoglyphs by the Latin letters they
imitate, undoes digits and signs that stand for letters inside a word, and turns all that is no letter into blanks. A
word wholly of look-alikes may belong to another script: it stays, and its Latin form is matched besides. Lexicon entries are beginnings of words; of
several entries at one place the longest counts. Their weights are smoothed log odds of document frequencies. A
phrase of two words around an entry that labelled clean documents use more often is an exception: as the longer
match it takes the entry's place, with weight zero. A text's score is a logistic function of its weight sum,
plain and per hundred words.

Lexicon, exceptions and the logistic fit come from at most ``MAX_LABELLED`` labelled documents (those with the
smallest id hashes), of which a quarter is held back from the lexicon for the fit. Scoring is one pass with no
shuffle over all whole texts. The lexicon has at most ``MAX_ENTRIES`` entries.

Defined results: null or empty text has no match and scores like any text without matches. Several labels of one
document count as toxic if one does; of several rows with one id the smallest text is learned from, and all are scored. Without labels of both kinds, every score is the smoothed share of toxic
labels. Null ids are never labelled. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import strings

MAX_LABELLED = 20_000
MAX_ENTRIES = 3_000
MIN_TOXIC_DOCS = 5
MIN_WEIGHT = 1.5
SHORTEST, LONGEST = 4, 12
MIN_EXCEPTION_DOCS = 3

# Letters of other scripts and the Latin letters that they look like.
HOMOGLYPHS = {
    "а": "a", "б": "b", "в": "b", "г": "r", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ω": "w",
}
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_ALIKE = re.compile("[" + "".join(HOMOGLYPHS) + r"\d@$!]*[" + "".join(HOMOGLYPHS) + "]")
# Accents and characters without a width, once letters are taken apart.
_MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SIGN = re.compile(r"(?:(?<=[^\W\d_])|(?<![\w@$!]))[013457@$!]+(?=[^\W\d_])")
_LATIN = re.compile(r"[a-z]")
_OTHER = re.compile(r"[\W\d_]+")


def _latin(text: str) -> str:
    text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return _OTHER.sub("  ", text)


def fold(text: str) -> str:
    """The folded text: words of letters, each with a blank of its own at both ends."""
    return fold_both(text)[0]


def fold_both(text: str) -> tuple[str, str]:
    """The folded text, and the Latin forms of its words that consist of look-alikes alone (as a text of the same form).

    Such a word may be a word of its own script, so it stays in the text as it is.
    """
    text = text.lower()
    alike: list[str] = []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()

        def word(m: re.Match) -> str:
            if _LATIN.search(m[0]):
                return m[0].translate(_FOLD)
            if _ALIKE.fullmatch(m[0]):
                alike.append(m[0].translate(_FOLD))
            return m[0]

        text = re.sub(r"\w+", word, text)
    return " " + _latin(text).strip() + " ", " " + _latin(" ".join(alike)).strip() + " "


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that hold each beginning of a word; the null row counts documents."""
    for batch in batches:
        seen = (Counter(), Counter())
        docs = [0, 0]
        for text, toxic in zip(strings(batch.column("text")).to_pylist(), batch.column("toxic").to_pylist()):
            docs[toxic] += 1
            seen[toxic].update(_beginnings(set(fold(text).split())))
        entries = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([
            pa.array([*entries, None], pa.string()), pa.array([*(seen[1][e] for e in entries), docs[1]], pa.int64()),
            pa.array([*(seen[0][e] for e in entries), docs[0]], pa.int64())], names=["entry", "toxic", "clean"])


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def lexicon_of(rows: list[tuple[str, int, int]], all_toxic: int, all_clean: int, limit: int = MAX_ENTRIES) -> dict[str, float]:
    """Weights of entries. A beginning that nearly always goes on in one way gives way to the longer entry, and an
    entry whose shorter beginning weighs as much is left out."""
    docs = {e: t for e, t, _ in rows}
    absorbed = {e[:-1] for e, t in docs.items() if t >= 0.95 * docs.get(e[:-1], math.inf)}
    weights = {e: log_odds(t, c, all_toxic, all_clean) for e, t, c in rows if e not in absorbed}
    kept: dict[str, float] = {}
    for entry in sorted(weights, key=lambda e: (len(e), e)):
        shorter = max((kept[entry[:n]] for n in range(SHORTEST, len(entry)) if entry[:n] in kept), default=-math.inf)
        if weights[entry] > shorter + 0.25:
            kept[entry] = weights[entry]
    best = sorted(kept, key=lambda e: (-kept[e] * math.log1p(docs[e]), e))[:limit]
    return {e: kept[e] for e in best}


def _automaton(lexicon: dict[str, float], exceptions: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        found.add_word(" " + entry, weight)
    for phrase in exceptions:
        found.add_word(" " + phrase.replace(" ", "  ") + " ", 0.0)
    if len(found):
        found.make_automaton()
    return found


def weight_sum(folded: str, automaton) -> float:
    return sum(w for _, w in automaton.iter_long(folded)) if len(automaton) else 0.0


def _phrases(lexicon: dict[str, float]):
    """Documents of each kind that hold each pair of words of which one begins with an entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(strings(batch.column("text")).to_pylist(), batch.column("toxic").to_pylist()):
                words = fold(text).split()
                hit = [any(w[:n] in lexicon for n in range(SHORTEST, min(len(w), LONGEST) + 1)) for w in words]
                seen[toxic].update({f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y})
            entries = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(entries, pa.string()), pa.array([seen[1][e] for e in entries], pa.int64()),
                pa.array([seen[0][e] for e in entries], pa.int64())], names=["entry", "toxic", "clean"])
    return run


def _sums(lexicon: dict[str, float], exceptions: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(lexicon, exceptions)
        for batch in batches:
            total, words = [], []
            for text in strings(batch.column("text")).to_pylist():
                folded, alike = fold_both(text)
                total.append(weight_sum(folded, automaton) + weight_sum(alike, automaton))
                words.append(folded.count(" ") // 2)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(total, pa.float64()), pa.array(words, pa.float64())],
                names=[*keep, "total", "words"])
    return run


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    rate = 100 * total / np.maximum(words, 100)
    return np.stack([np.ones_like(total), np.log1p(np.maximum(total, 0)), np.log1p(np.maximum(rate, 0))], axis=1)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for the ridge-penalised logistic likelihood; the constant has no penalty."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return b


class ToxicityModel:
    """A fitted lexicon with exceptions and logistic coefficients."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], coefficients: np.ndarray):
        self.lexicon, self.exceptions, self.coefficients = lexicon, exceptions, coefficients

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
        b = [float(c) for c in self.coefficients]
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
        sums = rows.mapInArrow(
            _sums(self.lexicon, self.exceptions), "doc_id bigint, held_out boolean, total double, words double")
        total, rate = F.greatest("total", F.lit(0.0)), 100 * F.col("total") / F.greatest("words", F.lit(100.0))
        logit = b[0] + b[1] * F.log1p(total) + b[2] * F.log1p(F.greatest(rate, F.lit(0.0)))
        score = 1 / (1 + F.exp(-logit))
        return sums.select("doc_id", "held_out", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on labelled documents that are not held out, ``limit`` of them at most."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sample = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # The sample has at most ``limit`` ids.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4))
    # A document with very many rows counts once, by its smallest text.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    for_lexicon, for_fit = texts.filter(part > 0).select("text", "toxic"), texts.filter(part == 0).select("text", "toxic")

    def counts(run, floor) -> list:
        found = for_lexicon.mapInArrow(run, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return found, found.filter(floor)

    all_counts, frequent = counts(_count, (F.col("toxic") >= MIN_TOXIC_DOCS) | F.col("entry").isNull())
    totals = all_counts.filter("entry is null").first()
    all_toxic, all_clean = (totals["toxic"], totals["clean"]) if totals else (0, 0)
    if not all_toxic or not all_clean:
        share = (all_toxic + 1) / (all_toxic + all_clean + 2)
        return ToxicityModel({}, [], np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    odds = F.log((F.col("toxic") + 0.5) / (all_toxic + 1)) - F.log((F.col("clean") + 0.5) / (all_clean + 1))
    strong = frequent.filter(F.col("entry").isNotNull() & (odds >= MIN_WEIGHT))
    # At most ten candidates for each entry of the lexicon.
    top = strong.orderBy(F.desc(odds * F.log1p("toxic")), "entry").limit(10 * MAX_ENTRIES).collect()
    lexicon = lexicon_of([(r["entry"], r["toxic"], r["clean"]) for r in top], all_toxic, all_clean)
    _, pairs = counts(_phrases(lexicon), F.col("clean") >= MIN_EXCEPTION_DOCS)
    exceptions = [r["entry"] for r in pairs.filter(odds < 0).orderBy(F.desc("clean"), "entry").limit(MAX_ENTRIES).collect()]
    fitted = for_fit.mapInArrow(_sums(lexicon, exceptions), "toxic int, total double, words double").collect()
    x = _features(np.array([r["total"] for r in fitted]), np.array([r["words"] for r in fitted]))
    y = np.array([float(r["toxic"]) for r in fitted])
    if not len(y) or y.min() == y.max():
        share = (all_toxic + 1) / (all_toxic + all_clean + 2)
        return ToxicityModel(lexicon, exceptions, np.array([math.log(share / (1 - share)), 1.0, 1.0]))
    return ToxicityModel(lexicon, exceptions, logistic_fit(x, y))
