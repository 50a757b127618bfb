"""Quality rules: fixed base rules, then robust multivariate outliers for each language and source.

Every text becomes a vector of transformed statistics. For each (language, source) the minimum covariance
determinant is found deterministically: coordinatewise medians and deviations start it, then concentration steps
re-estimate location and scatter from the ``SUPPORT`` share of rows with the smallest Mahalanobis distances. All
rows take part in every step; a step is one grouped quantile and one grouped sum of products, both combined
before the shuffle, so a source that holds a third of all rows is no hot group. Groups with fewer than
``MIN_GROUP`` judged rows are pooled by language, and then over all.

Each feature's variance has a floor (most texts have no symbol at all), which regularises the scatter. A row is
rejected if its squared distance exceeds the chi-squared quantile ``CUTOFF``.

Defined results: a null text has no words and fails the base rules. Null language or source is a group like
another. Rows with one id are judged alone. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buffers, id_or_last, mix, row_key, slices, span_hashes, strings, word_spans

MIN_WORDS = 50
SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 100
CUTOFF = 0.99999
SYMBOLS = "#*$%&|<>"
# Smallest standard deviation of each feature.
FLOORS = {"word_length": 0.1, "symbols": 0.3, "dup_lines": 0.6, "repeats": 0.15}
FEATURES = list(FLOORS)
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(raw: np.ndarray, offs: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and words in three-word windows that their text holds twice or more."""
    starts, ends, row = word_spans(raw, offs)
    words = np.bincount(row, minlength=n_rows)
    covered = np.zeros(len(row) + 2, bool)
    if len(row) >= 3:
        h = span_hashes(raw, starts, ends)
        whole = row[:-2] == row[2:]
        three = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + mix(row[:-2].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(whole)
        order = at[np.argsort(three[at], kind="stable")]
        same = three[order[1:]] == three[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        for k in range(3):
            covered[hit + k] = True
    return words, np.bincount(row, weights=covered[: len(row)], minlength=n_rows).astype(np.int64)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column("text"))
        words, repeats = [], []
        for low, high in slices(texts):
            n, r = _repeated_words(*buffers(texts[low:high]), high - low)
            words.append(n)
            repeats.append(r)
        chars, symbols, dups = [], [], []
        for text in texts.to_pylist():
            chars.append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
            symbols.append(sum(map(text.count, SYMBOLS)))
            lines = [x for x in text.encode().split(b"\n") if x and not x.isspace()]
            dups.append(len(lines) - len(set(lines)))
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep),
             pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(chars, pa.int64()),
             pa.array(symbols, pa.int64()), pa.array(dups, pa.int64()),
             pa.array(np.concatenate(repeats) if repeats else [], pa.int64())], names=[*keep, *_STATS])


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the row's key (``__id, __row``) and its base statistics."""
    kinds = ", ".join(f"{n} bigint" for n in _STATS)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), id_or_last().alias("__id"), row_key().alias("__row"), "text",
    ).mapInArrow(_stats, f"doc_id bigint, lang string, source string, __id bigint, __row bigint, {kinds}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "word_length": F.log(chars / words),
        "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def chi2_quantile(p: float, d: int) -> float:
    """The Wilson-Hilferty approximation."""
    low, high = -10.0, 10.0
    for _ in range(80):
        z = (low + high) / 2
        low, high = (z, high) if 0.5 * math.erfc(-z / 2**0.5) < p else (low, z)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def _labels(stats: DataFrame) -> DataFrame:
    """The group of each (language, source): itself, its language's small sources, or all small ones."""
    judged = stats.filter(~base_failed())
    own = judged.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    pools = own.groupBy(F.col("__lang").alias("__pool")).agg(
        F.sum(F.when(F.col("__n") < MIN_GROUP, F.col("__n")).otherwise(0)).alias("__pooled"))
    whole = {"ignoreNullFields": "false"}
    label = (
        F.when(F.col("__n") >= MIN_GROUP, F.to_json(F.struct("__lang", "__source"), whole))
        .when(F.col("__pooled") >= MIN_GROUP, F.to_json(F.struct("__lang"), whole))
        .otherwise(F.lit("all")))
    joined = own.join(pools, F.col("__lang").eqNullSafe(F.col("__pool")))
    return joined.select("__lang", "__source", label.alias("group"))


def _with_group(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(
        labels, rows["lang"].eqNullSafe(labels["__lang"]) & rows["source"].eqNullSafe(labels["__source"]), "left",
    ).drop("__lang", "__source")


def _distance() -> Column:
    """Squared Mahalanobis distance to the group's ``centre`` by its inverse scatter ``inverse``."""
    at = [F.col(n) - F.element_at("centre", i + 1) for i, n in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        term = at[i] * at[j] * F.element_at("inverse", i * len(FEATURES) + j + 1)
        total = total + (term if i == j else 2 * term)
    return total


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Location and inverse of the floored scatter from each group's sums (one row for each group)."""
    d = len(FEATURES)
    floor = np.diag([FLOORS[n] ** 2 for n in FEATURES])
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            n = row["n"]
            centre = np.array([row[f"s{i}"] for i in range(d)]) / n
            scatter = np.zeros((d, d))
            for i, j in _PAIRS:
                scatter[i, j] = scatter[j, i] = row[f"p{i}_{j}"] / n - centre[i] * centre[j]
            # The half with the smallest distances spreads too little; the factor undoes that for normal data.
            scatter = scatter / _shrinkage(d) + floor
            out.append({"group": row["group"], "centre": centre.tolist(), "inverse": np.linalg.inv(scatter).ravel().tolist()})
        yield pd.DataFrame(out, columns=["group", "centre", "inverse"])


def _shrinkage(d: int) -> float:
    """Variance of normal data that is cut at the SUPPORT quantile of its distance: P(chi2(d+2) < q) / SUPPORT."""
    q = chi2_quantile(SUPPORT, d)
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if chi2_quantile(p, d + 2) < q else (low, p)
    return p / SUPPORT


def estimates(rows: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """``group, centre, inverse`` after ``steps`` concentration steps over ``rows`` (group and features)."""
    d = len(FEATURES)
    # One row for each group, written, so that its size is known and the rows of a large group need no shuffle to meet it.
    middle = scratch.table(rows.groupBy("group").agg(*[F.percentile_approx(n, 0.5, 1000).alias(f"m_{n}") for n in FEATURES]))
    spread = rows.join(middle, "group").groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{n}")), 0.5, 1000).alias(f"d_{n}") for n in FEATURES])
    start = middle.join(spread, "group").select(
        "group", F.array(*[F.col(f"m_{n}") for n in FEATURES]).alias("centre"),
        F.array(*[(1 / (F.pow(1.4826 * F.col(f"d_{FEATURES[i]}"), 2) + FLOORS[FEATURES[i]] ** 2)) if i == j else F.lit(0.0)
                  for i in range(d) for j in range(d)]).alias("inverse"))
    now = scratch.table(start)
    for _ in range(steps):
        near = rows.join(now, "group").withColumn("d2", _distance()).drop("centre", "inverse")
        cut = scratch.table(near.groupBy("group").agg(F.percentile_approx("d2", SUPPORT, 1000).alias("cut")))
        sums = near.join(cut, "group").filter("d2 <= cut").groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in _PAIRS])
        now = scratch.table(sums.mapInPandas(_estimates, "group string, centre array<double>, inverse array<double>"))
    return now


def judge_quality(docs: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF, keep_key: bool = False) -> DataFrame:
    """``doc_id``, base statistics, ``base_failed``, ``distance`` (null where the base rules fail), ``kept``.

    ``keep_key``: add ``__id, __row``, which tell rows apart by id and text.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(text_stats(docs))
    rows = _with_group(stats, scratch.table(_labels(stats))).withColumns(features())
    table = estimates(rows.filter(~base_failed()).select("group", *FEATURES), scratch, steps)
    limit = chi2_quantile(cutoff, len(FEATURES))
    failed = base_failed()
    judged = rows.join(table, "group", "left").withColumn("distance", F.when(~failed, _distance()))
    return judged.select(
        "doc_id", "lang", "source", *_STATS, failed.alias("base_failed"), "distance",
        (~failed & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)).alias("kept"), *(["__id", "__row"] if keep_key else []))
