"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans rely on: adaptive re-planning, and splitting of skewed join
# partitions even where that costs one more exchange. Text work is heavy for its bytes, so small shuffle
# partitions are not merged down to a single task.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Bytes of tables that one task reads, where the session has Spark's default. Stored text and vectors grow many times when read,
# and rows that come from a few of them are held in a task's memory.
READ_BYTES = "16m"
_DEFAULT_READ_BYTES = ("134217728b", "128m", "128MB")


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get("spark.sql.files.maxPartitionBytes") in _DEFAULT_READ_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", READ_BYTES)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only for a local master with none set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
        configured = tempfile.mkdtemp(prefix="corpusgraph-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def run_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a cut of the lineage that a lost executor
    does not undo, with sizes that later plans know and columns they can prune."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an input that one task takes at most, where it is spread.
TASK_ROWS = 250_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input whose rows arrive in few tasks: one small file, or a large file of few row groups.

    A row group is read by one task, however many splits the file's bytes make, so rows are counted by task; a count
    reads no columns. A task with twice its share of the rows is too many, however few they are: a row may be a long text.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < wanted:
        sizes = [df.count()]
        uneven = True
    else:
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        uneven = max(sizes, default=0) > 2 * sum(sizes) / wanted
    if not uneven:
        return df
    parts = max(wanted, -(-sum(sizes) // TASK_ROWS))
    # Random targets, by a fixed seed: dealing out in turn would sort the rows of each task first.
    return df.repartition(parts, *keys) if keys else df.repartition(parts, F.rand(17))
