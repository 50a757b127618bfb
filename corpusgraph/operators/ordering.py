"""Positions and neighbours inside an ordered group that may hold a large share of all rows.

A window over the whole group would put a hot group into one task. Here the integer order key is cut
into fixed ranges; windows run inside a range (at most ``width`` rows, since the order key is unique
inside the group), and only one summary row of each range takes part in a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import run_table

WIDTH = 65536
_RANGE = "__range"


def _with_range(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(_RANGE, F.floor(F.col(order) / F.lit(width)))


def with_position(
    df: DataFrame, group: list[str], order: str, name: str = "position",
    total: str | None = None, descending: bool = False, width: int = WIDTH,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and optionally the group's row count."""
    ranged = _with_range(df, order, width)
    keys = [*group, _RANGE]
    by_range = F.col(_RANGE).desc() if descending else F.col(_RANGE)
    by_order = F.col(order).desc() if descending else F.col(order)
    before = W.partitionBy(*group).orderBy(by_range).rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(W.partitionBy(*group)).alias("__total"),
    )
    local = F.row_number().over(W.partitionBy(*keys).orderBy(by_order))
    out = (
        ranged.withColumn("__local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("__offset") + F.col("__local"))
    )
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop(_RANGE, "__local", "__offset", "__total")


def with_offset(
    df: DataFrame, group: list[str], order: str, weight: str, name: str, width: int = WIDTH
) -> DataFrame:
    """Add the sum of ``weight`` over the rows before each row in its group."""
    ranged = _with_range(df, order, width)
    keys = [*group, _RANGE]
    before = W.partitionBy(*group).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys).agg(F.sum(weight).alias("__n"))
    offsets = sums.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, keys)
        .withColumn(name, F.col("__offset") + F.col("__local"))
        .drop(_RANGE, "__local", "__offset")
    )


def with_neighbour(
    df: DataFrame, group: list[str], order: str, value: Column, name: str,
    following: bool = False, width: int = WIDTH,
) -> DataFrame:
    """Add ``value`` of the row before (or after) each row in its group; null at the edge."""
    ranged = _with_range(df, order, width).withColumn("__value", F.struct(value.alias("v")))
    keys = [*group, _RANGE]
    edge = F.min_by if following else F.max_by
    shift = F.lead if following else F.lag
    edges = ranged.groupBy(*keys).agg(edge("__value", order).alias("__edge"))
    carried = edges.select(
        *keys, shift("__edge").over(W.partitionBy(*group).orderBy(_RANGE)).alias("__carried")
    )
    inside = shift("__value").over(W.partitionBy(*keys).orderBy(order))
    return (
        ranged.withColumn("__inside", inside)
        .join(carried, keys)
        .withColumn(name, F.coalesce("__inside", "__carried")["v"])
        .drop(_RANGE, "__value", "__inside", "__carried")
    )


def with_text_rank(df: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    """Add the 0-based rank of a unique string key in its group.

    Rows are dealt over partitions by sampled ranges of (group, key) and sorted there, so neither a large group nor a very
    common start of keys meets in one task. A row's rank is its place in its partition's part of the group, and the sizes of the
    group's parts in the partitions before: one row for each part, which are about as many as groups and partitions together.
    The sorted rows are written, since ranges are sampled anew in each run.
    """
    placed = run_table(
        df.repartitionByRange(*group, key).sortWithinPartitions(*group, key).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    ranged = placed.withColumn("__part", F.shiftright("__id", 33))
    keys = [*group, "__part"]
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        ranged.join(offsets, keys)
        .withColumn(name, F.col("__offset") + F.col("__id") - F.col("__first"))
        .drop("__id", "__part", "__first", "__offset")
    )
