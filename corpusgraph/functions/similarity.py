"""Text similarity: the embedder interface, and the lexical similarity used when no model is given."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .text import ColumnOrName, as_col, let, word_tokens


def _count(tokens: Column, token: Column) -> Column:
    """Occurrences of one token; ``array_remove`` is a linear scan without a lambda call per element."""
    return (F.size(tokens) - F.size(F.array_remove(tokens, token))).cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(tokens: Column) -> Column:
    return F.aggregate(
        F.array_distinct(tokens), F.lit(0.0), lambda acc, t: acc + F.pow(_count(tokens, t), F.lit(2.0))
    )


def token_dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.array_intersect(a, b), F.lit(0.0), lambda acc, t: acc + _count(a, t) * _count(b, t)
    )


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a dot product and squared norms; 0 where a vector is empty."""
    return F.when((norm_a > 0) & (norm_b > 0), dot / F.sqrt(norm_a * norm_b)).otherwise(F.lit(0.0))


def dense_dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


class AdjacentSimilarity(Protocol):
    """Similarity of each sentence to the one before it, inside a row.

    Takes ``array<string>`` of n sentences and gives ``array<double>`` of n - 1 values.
    """

    def adjacent(self, sents: Column) -> Column: ...


class LexicalSimilarity:
    """Cosine of word counts. All inputs are integers, so results do not depend on summation order."""

    def adjacent(self, sents: Column) -> Column:
        with_norms = F.transform(
            sents,
            lambda s: let(
                word_tokens(s),
                lambda t: F.struct(t.alias("tokens"), squared_norm(t).alias("norm")),
            ),
        )
        return let(
            with_norms,
            lambda v: F.zip_with(
                F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
                F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
                lambda a, b: cosine(token_dot(a["tokens"], b["tokens"]), a["norm"], b["norm"]),
            ),
        )


class ModelSimilarity:
    """Adjacent cosine from a user's vectoriser, ``array<string>`` -> ``array<array<float>>`` (a pandas UDF)."""

    def __init__(self, encode_all: Callable[[Column], Column]):
        self._encode_all = encode_all

    def adjacent(self, sents: Column) -> Column:
        return let(
            self._encode_all(sents),
            lambda v: F.zip_with(
                F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
                F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
                lambda a, b: cosine(dense_dot(a, b), dense_dot(a, a), dense_dot(b, b)),
            ),
        )


class Embedder(Protocol):
    """Adds a vector column to a table with a text column."""

    def encode(self, df: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame: ...


class HashedCounts:
    """Word counts hashed into ``dim`` buckets: the first 32 bits of each token's MD5, modulo ``dim``."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def vector(self, c: ColumnOrName) -> Column:
        buckets = F.transform(
            word_tokens(as_col(c)),
            lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(self.dim)),
        )
        return let(
            buckets,
            lambda b: F.transform(
                F.sequence(F.lit(0), F.lit(self.dim - 1)),
                lambda d: _count(b, d.cast("bigint")).cast("float"),
            ),
        )

    def encode(self, df: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame:
        return df.withColumn(output, self.vector(text))


class StoredVectors:
    """Vectors computed beforehand, joined by key (a text hash, a chunk id); null where there is none.

    Rows without a key get no vector and take no part in the join, where they would all meet in one task.
    """

    def __init__(self, table: DataFrame, key: str, vector: str = "embedding"):
        self._table = table.select(F.col(key), F.col(vector).alias("__vector")).filter(F.col(key).isNotNull())
        self._key = key

    def encode(self, df: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame:
        keyed = df.filter(F.col(self._key).isNotNull()).join(self._table, self._key, "left").select(
            *[F.col(c) for c in df.columns], F.col("__vector").alias(output))
        kind = self._table.schema["__vector"].dataType
        return keyed.unionByName(df.filter(F.col(self._key).isNull()).withColumn(output, F.lit(None).cast(kind)))


class BatchedModel:
    """A model that is loaded once in each worker and called on batches of texts.

    ``load`` gives a function from an array of texts to a matrix of floats, one row each; it runs in the worker, so
    models need not be shipped. Null texts are not shown to the model as such and get a null vector.
    """

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 512):
        self._load, self._batch_size = load, batch_size

    def encode(self, df: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame:
        predict = predict_batch_udf(self._load, return_type=ArrayType(FloatType()), batch_size=self._batch_size)
        return df.withColumn(output, F.when(F.col(text).isNotNull(), predict(F.coalesce(F.col(text), F.lit("")))))


class ModelEmbedder:
    """A user's Arrow-batched vectoriser, ``Column`` of text -> ``Column`` of ``array<float>``."""

    def __init__(self, encode: Callable[[Column], Column]):
        self._encode = encode

    def encode(self, df: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame:
        return df.withColumn(output, self._encode(F.col(text)))
