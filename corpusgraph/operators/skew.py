"""Joins of a table that may hold very many rows of one key with a table of one row for each key.

The adaptive skew join only splits a side that comes straight from an exchange; it cannot help where the
other side is an aggregate that already has the join's partitioning. So heavy keys are salted here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is heavy, and is spread over as many parts as it holds this many rows.
HEAVY_ROWS = 1_000_000


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str],
    how: str = "inner", rows: str | None = None,
) -> DataFrame:
    """``big.join(small, keys, how)`` with heavy keys of ``big`` spread over several tasks.

    ``spread_by``: columns that tell the rows of a key apart. ``rows``: a column of ``small`` that holds
    the rows of its key in ``big`` (or more), where that is known already; it is dropped. The list of heavy keys
    has at most (rows / HEAVY_ROWS) keys, which bounds what is broadcast.
    """
    if rows is None:
        sizes, count = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "__n"
    else:
        sizes, count = small, rows
    parts = F.ceil(F.col(count) / HEAVY_ROWS).cast("bigint")
    heavy = F.broadcast(sizes.filter(F.col(count) > HEAVY_ROWS).select(*keys, parts.alias("__parts")))
    one = F.coalesce("__parts", F.lit(1).cast("bigint"))
    left = big.join(heavy, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread_by), one)).drop("__parts")
    marked = small.join(heavy, keys, "left") if rows is None else small.withColumn(
        "__parts", F.when(F.col(rows) > HEAVY_ROWS, parts))
    right = marked.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).drop("__parts", rows or "__parts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
