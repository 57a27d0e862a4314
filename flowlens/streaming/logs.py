"""A compact log of windowed metrics: few folders, however long the stream runs.

Every trigger appends its ``update`` emissions as ``batch=N``. Each ``compact_every`` triggers the
log is folded: windows that can no longer change move to ``closed/date=D/upto=N``, the others to
``open=N``, and what the last fold had already covered is deleted. A window's counts only grow, so
reading a row twice, from a batch and from its fold, changes nothing: readers need no lock.

At any time there are at most ``2 * compact_every`` batch folders, two open ones, and two for each
day of history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.labels import CLASSES
from flowlens.session import drop_path, folder_names, move_folder
from flowlens.streaming.events import METRICS_TRIGGER, METRICS_WATERMARK_S, latest_per_window

COMPACT_EVERY = 100
DAY = 86_400_000
LOG_SCHEMA = ("window_start bigint, window_end bigint, org_id string, total bigint, attacks bigint, "
              "by_class map<string,bigint>")


def _numbers(names: Sequence[str], kind: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def _read(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(*folders)


def _closed(
    spark: SparkSession, path: str, days: Sequence[str] | None = None, below: int | None = None
) -> list[str]:
    """The newest fold of each day, or the newest before ``below``."""
    found = []
    for day in folder_names(spark, f"{path}/closed"):
        if days is not None and day not in days:
            continue
        folds = [n for n in _numbers(folder_names(spark, f"{path}/closed/{day}"), "upto")
                 if below is None or n < below]
        if folds:
            found.append(f"{path}/closed/{day}/upto={folds[-1]}")
    return found


def _live(spark: SparkSession, path: str) -> list[str]:
    """The newest open fold and the batches after it."""
    names = folder_names(spark, path)
    folds = _numbers(names, "open")
    since = folds[-1] if folds else -1
    batches = [n for n in _numbers(names, "batch") if n > since]
    return ([f"{path}/open={since}"] if folds else []) + [f"{path}/batch={n}" for n in batches]


def read_metrics_log(spark: SparkSession, path: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """The last counts of every window in the log at ``path``."""
    path = path.rstrip("/")
    return latest_per_window(_read(spark, _live(spark, path) + _closed(spark, path)), classes)


def fold_log(
    spark: SparkSession, path: str, upto: int, classes: Sequence[str] = CLASSES,
    hold_s: int = 2 * METRICS_WATERMARK_S,
) -> None:
    """Fold the batches up to ``upto``; repeating a fold is harmless.

    A window is closed ``hold_s`` seconds behind the newest one; should it change all the same,
    its later counts are folded into its day again.
    """
    names = folder_names(spark, path)
    before = [n for n in _numbers(names, "open") if n < upto]
    batches = [n for n in _numbers(names, "batch") if n <= upto and (not before or n > before[-1])]
    rows = latest_per_window(_read(spark, [f"{path}/open={n}" for n in before[-1:]] + [
        f"{path}/batch={n}" for n in batches]), classes)
    newest = rows.agg(F.max("window_end")).first()[0]
    if newest is None:
        return
    done = F.col("window_end") <= newest - hold_s * 1000
    day = F.date_from_unix_date(F.floor(F.col("window_start") / DAY).cast("int")).cast("string")
    days = [f"date={r[0]}" for r in rows.filter(done).select(day).distinct().collect()]
    if days:
        earlier = _read(spark, _closed(spark, path, days, upto))
        both = latest_per_window(rows.filter(done).unionByName(earlier), classes)
        staging = f"{path}/_fold={upto}"
        both.withColumn("date", day).repartition("date").write.mode("overwrite").partitionBy("date").parquet(staging)
        for name in days:
            move_folder(spark, f"{staging}/{name}", f"{path}/closed/{name}/upto={upto}")
            folds = _numbers(folder_names(spark, f"{path}/closed/{name}"), "upto")
            for old in [n for n in folds if n < upto][:-1]:
                drop_path(spark, f"{path}/closed/{name}/upto={old}")
        drop_path(spark, staging)
    rows.filter(~done).coalesce(1).write.mode("overwrite").parquet(f"{path}/open={upto}")
    # Readers of the fold before this one may still be at its files; what it covered can go.
    for n in before[:-1]:
        drop_path(spark, f"{path}/open={n}")
    for n in _numbers(names, "batch"):
        if before and n <= before[-1]:
            drop_path(spark, f"{path}/batch={n}")


def metrics_log_sink(
    metrics: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
    classes: Sequence[str] = CLASSES, compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Append every ``update`` emission to the log at ``path`` and fold it now and then.

    A batch owns one folder and overwrites it when repeated.
    """
    path = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            fold_log(batch.sparkSession, path, batch_id, classes)

    return (
        metrics.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": METRICS_TRIGGER})).foreachBatch(write).start()
    )
