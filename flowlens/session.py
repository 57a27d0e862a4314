"""Session helpers: durable lineage cuts, shared scratch folders, size-checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold this many narrow rows (tens of MB at most).
MAX_BROADCAST_ROWS = 1_000_000
# Input bytes of text for each partition of a wide shuffle, and the bytes that adaptive execution
# may join into one: rows take ten times as much room in a task's memory.
SHUFFLE_TEXT_BYTES = 32_000_000
SHUFFLE_JOINED = "8m"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local test sessions."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/flowlens-{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, name: str, parts: int, *columns: str) -> DataFrame:
    """``df`` stored in ``parts`` buckets of ``columns`` in the shared folder.

    Grouping the result by these columns shuffles nothing, however often it is read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"flowlens_{name}_{uuid.uuid4().hex}"
    df.repartition(parts, *columns).write.bucketBy(parts, *columns).option("path", path).saveAsTable(table)
    return spark.table(table)


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """A whole number (int) for each of ``parts`` hash partitions or buckets, which falls there."""
    rows = spark.range(32 * parts).select(
        F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("part")
    ).groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()
    return [row["key"] for row in rows]


@contextmanager
def held_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """SQL settings for the jobs started inside, and the former ones after them."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def wide_shuffle(spark: SparkSession, text_bytes: int) -> dict[str, str]:
    """Settings under which a task's share of a shuffled text table does not grow with the table."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {
        "spark.sql.shuffle.partitions": str(max(parts, math.ceil(text_bytes / SHUFFLE_TEXT_BYTES))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_JOINED,
    }


def broadcast_rows(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when ``rows``, a known bound on ``df``, is small; else leave it to AQE."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder, on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table of this job's own."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none if it does not exist."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(hadoop_path):
        return []
    return sorted(f.getPath().getName() for f in file_system.listStatus(hadoop_path) if f.isDirectory())


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, replacing ``target``."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    file_system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.delete(new, True)
    file_system.mkdirs(new.getParent())
    if not file_system.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")
