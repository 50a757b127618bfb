"""The progress feed of ingest sessions, as batch tables and as streams.

Feed rows: ``session_id, seq, type, ...`` with ``seq`` unique in its session. Functions built on grouped
aggregates and ``dropDuplicates`` take streaming tables too; those that rank or look at neighbours are
for batch tables (or inside ``foreachBatch``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import with_neighbour, with_position
from ..options import DEFAULTS, Options

TERMINAL = ["completed", "failed"]


def session_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


def retained(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """What a bounded buffer still holds: passing the maximum trims it to its newest ``feed_keep`` rows.

    After n rows it holds all of them up to the maximum, else the trimmed size plus what came since.
    """
    cycle = opts.feed_max - opts.feed_keep + 1
    held = F.when(F.col("total") <= opts.feed_max, F.col("total")).otherwise(
        opts.feed_keep + F.pmod(F.col("total") - (opts.feed_max + 1), F.lit(cycle))
    )
    placed = with_position(events, ["session_id"], "seq", "age", total="total", descending=True)
    return placed.filter(F.col("age") <= held).drop("age", "total")


def read_from(events: DataFrame, offset: int) -> DataFrame:
    """Events of each session from an absolute sequence number on, with the session's event count."""
    totals = session_counts(events).withColumnRenamed("events", "total")
    return events.filter(F.col("seq") >= offset).join(totals, "session_id")


def latest_state(updates: DataFrame) -> DataFrame:
    """Last value of each field of each job: ``job_id, field, value``."""
    return updates.groupBy("job_id", "field").agg(F.max_by("value", "seq").alias("value"))


def progress_state(updates: DataFrame) -> DataFrame:
    """Progress patches (``job_id, section, key, value``) merged key by key, last write winning, as maps."""
    last = updates.groupBy("job_id", "section", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("job_id", "section").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("progress")
    )


def ordered_logs(logs: DataFrame) -> DataFrame:
    """Log lines of each job with their place in its list, as rows: a list may be of any length."""
    return with_position(logs, ["job_id"], "seq", "position").select("job_id", "position", "phase", "message")


def percent(current: Column, total: Column) -> Column:
    """Whole per cent, halves rounded to even; 0 for an empty total."""
    share = F.bround(F.lit(100.0) * current / total).cast("int")
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0)).otherwise(share)


def changes_only(states: DataFrame) -> DataFrame:
    """States (``session_id, seq, state``) that differ from the one before in their session."""
    seen = with_neighbour(states, ["session_id"], "seq", F.struct(F.col("state").alias("state")), "previous")
    changed = F.col("previous").isNull() | ~F.col("previous.state").eqNullSafe(F.col("state"))
    return seen.filter(changed).drop("previous")


def changes_only_stream(states: DataFrame) -> DataFrame:
    """The same on a stream; the state of a session is its last emitted value."""
    output = "session_id bigint, seq bigint, state string"

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        last = state.get[0] if state.exists else None
        started, out = state.exists, []
        for seq, value in zip(rows["seq"], rows["state"]):
            if not started or value != last:
                out.append((key[0], seq, value))
            started, last = True, value
        state.update((last,))
        yield pd.DataFrame(out, columns=["session_id", "seq", "state"])

    return states.groupBy("session_id").applyInPandasWithState(
        emit, output, "last string", "append", GroupStateTimeout.NoTimeout
    )


def latest_per_source(units: DataFrame) -> DataFrame:
    """Last version of each unit of a session, by its source."""
    values = F.struct(*[F.col(c) for c in units.columns if c not in ("session_id", "source")])
    return units.groupBy("session_id", "source").agg(F.max_by(values, "seq").alias("v")).select(
        "session_id", "source", "v.*"
    )


def first_per_chunk(chunk_events: DataFrame) -> DataFrame:
    """First event of each chunk of a session (batch); see :func:`distinct_chunks` for streams."""
    values = F.struct(*[F.col(c) for c in chunk_events.columns if c not in ("session_id", "chunk_id")])
    return chunk_events.groupBy("session_id", "chunk_id").agg(F.min_by(values, "seq").alias("v")).select(
        "session_id", "chunk_id", "v.*"
    )


def distinct_chunks(chunk_events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Chunk events with repeats of a chunk dropped, on a stream; a watermark on ``ts`` bounds the state."""
    if watermark:
        return chunk_events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "chunk_id"])
    return chunk_events.dropDuplicates(["session_id", "chunk_id"])


def newest(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Newest rows of each session, as the feed view shows them."""
    order = W.partitionBy("session_id").orderBy(F.col("seq").desc())
    return events.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= opts.feed_view)


def terminal_status(events: DataFrame) -> DataFrame:
    """Last terminal status of each finished session: ``session_id, status`` (events of type ``done``)."""
    done = events.filter((F.col("type") == "done") & F.col("status").isin(TERMINAL))
    return done.groupBy("session_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def step_durations(timeline: DataFrame) -> DataFrame:
    """Milliseconds from each step to the next of its session; null for the last step."""
    timed = with_neighbour(timeline, ["session_id"], "seq", F.col("ts"), "next_ts", following=True)
    ms = F.timestamp_diff("MILLISECOND", F.col("ts"), F.col("next_ts"))
    return timed.withColumn("duration_ms", ms).drop("next_ts")
