"""Batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowlens.session import held_settings, path_exists

# Values of a partitioned table whose files a task keeps open; beyond, Spark sorts the rows.
OPEN_FILES = 64


def write_partitioned(
    df: DataFrame, path: str, by: str | Sequence[str] = "label_8", rebalance: bool = False
) -> None:
    """Overwrite a Parquet table partitioned by ``by``.

    By default rows stay where they are, and an input task writes one file per
    value it holds. ``rebalance`` shuffles them into well-sized files first:
    adaptive execution then splits a value with a third of all rows over many
    tasks and packs small values together. Up to ``OPEN_FILES`` values need no sort of a task's rows.
    """
    columns = [by] if isinstance(by, str) else list(by)
    if rebalance:
        df = df.hint("rebalance", *columns)
    with held_settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_splits(
    split_df: DataFrame, path: str, stream_files: int | None = None
) -> dict[str, int]:
    """Write a frame with a ``split`` column as ``path/split=NAME`` and return row counts.

    With ``stream_files`` the replay holdout is also written, compacted into that
    many files, as ``{path}_stream``; the number of files otherwise follows the data.
    """
    write_partitioned(split_df, path, "split")
    spark = split_df.sparkSession
    if stream_files is not None and path_exists(spark, f"{path}/split=stream"):
        holdout = spark.read.parquet(f"{path}/split=stream")
        holdout.coalesce(stream_files).write.mode("overwrite").parquet(f"{path}_stream")
    counts = spark.read.parquet(path).groupBy("split").count().collect()
    return {row["split"]: row["count"] for row in counts}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Overwrite a table (statistics, profile, client assignment)."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows, columns matched by name with what is already there."""
    df.write.mode("append").parquet(path)


def pending_keys(requested: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that have no result yet."""
    finished = done.select(*keys).distinct()
    same = [requested[k].eqNullSafe(finished[k]) for k in keys]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    return requested.join(finished, condition, "left_anti")


def write_named_csv(df: DataFrame, path: str, name: str) -> None:
    """One CSV file of the given name in a folder of such files; for small tables, as one task writes it."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}/_{name}"
    df.coalesce(1).write.mode("overwrite").csv(staging, header=True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging)
    file_system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in file_system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    if not file_system.rename(part, target):
        raise OSError(f"cannot write {target}")
    file_system.delete(folder, True)
