"""Event streams: parsing, contracts, windowed metrics and the running queries.

Everything up to the sinks works on batch and streaming frames alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.scalar import class_count_map, model_version
from flowlens.labels import CLASSES
from flowlens.operators.profile import FeatureStats
from flowlens.operators.scoring import Model, score_events
from flowlens.schemas import ALERT_EVENT, CONTRACTS, DEFAULTS, FLOW_EVENT, REQUIRED
from flowlens.session import drop_path, path_exists

# Fixed values of the running queries.
METRICS_WINDOW_S = 10
METRICS_WINDOW = f"{METRICS_WINDOW_S} seconds"
METRICS_WATERMARK_S = 30
METRICS_WATERMARK = f"{METRICS_WATERMARK_S} seconds"
ALERTS_TRIGGER = "1 second"
METRICS_TRIGGER = "10 seconds"

CORRUPT = "_corrupt"


def flow_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Streaming source of raw events.

    ``kafka`` subscribes at the newest offsets and tolerates lost ones unless the
    options say otherwise; file formats read new files below ``path``.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", "failOnDataLoss": "false", **options}
    if schema is not None:
        reader = reader.schema(schema)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def require(contract: str) -> Column:
    """Why a row violates its contract: the first missing required field, else NULL."""
    return F.coalesce(*[
        F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED[contract]
    ])


def with_defaults(df: DataFrame, contract: str) -> DataFrame:
    """Columns of the contract, typed and in order, defaults filled in."""
    defaults = DEFAULTS[contract]
    columns = []
    for field in CONTRACTS[contract].fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def validate_events(df: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows with defaults, and rejected rows with a ``reason``."""
    reason = require(contract)
    return (
        with_defaults(df.filter(reason.isNull()), contract),
        df.withColumn("reason", reason).filter(F.col("reason").isNotNull()),
    )


def parse_flows(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON text to FlowEvents, and the dead letters ``value, reason``.

    A text that is no JSON object, has a field of another type, or lacks a
    required field goes to the dead letters instead of failing the query.
    """
    schema = T.StructType(FLOW_EVENT.fields + [T.StructField(CORRUPT, T.StringType())])
    texts = raw.select(F.col(value).cast("string").alias("value"))
    event = F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT})
    # As a generator the parser runs once per text; as a plain column the optimizer
    # would copy it into every condition on its fields.
    parsed = texts.select("value", F.inline(F.array(event)))
    reason = F.coalesce(
        F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")), require("flow"))
    judged = parsed.withColumn("reason", reason)
    return (
        with_defaults(judged.filter(F.col("reason").isNull()), "flow"),
        judged.filter(F.col("reason").isNotNull()).select("value", "reason"),
    )


def encode_event(df: DataFrame, key: str) -> DataFrame:
    """``key, value`` with the whole row as JSON; NULL fields are left out.

    Maps such as ``probs`` travel as JSON text inside the event.
    """
    fields = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def _decode(raw: DataFrame, value: str, contract: str, nested: str) -> tuple[DataFrame, DataFrame]:
    """Events of a contract from JSON, and the rejected messages (``value, reason``).

    The map field ``nested`` is given as an object or as JSON text. A message that is
    no JSON object or lacks a required field is rejected.
    """
    fields = CONTRACTS[contract].fields
    kinds = {f.name: f.dataType for f in fields}
    flat = T.StructType([
        *[T.StructField(f.name, T.StringType() if f.name == nested else f.dataType) for f in fields],
        T.StructField(CORRUPT, T.StringType()),
    ])
    text = F.col(value).cast("string")
    event = F.from_json(text, flat, {"columnNameOfCorruptRecord": CORRUPT})
    parsed = raw.select(text.alias("value"), F.inline(F.array(event)))
    parsed = parsed.withColumn(nested, F.from_json(nested, kinds[nested].simpleString()))
    reason = F.coalesce(
        F.when(F.col("value").isNull() | F.col(CORRUPT).isNotNull(), F.lit("malformed")),
        require(contract))
    judged = parsed.withColumn("reason", reason)
    return (
        with_defaults(judged.filter(F.col("reason").isNull()), contract),
        judged.filter(F.col("reason").isNotNull()).select("value", "reason"),
    )


def decode_alerts(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """AlertEvents from JSON, ``probs`` as object or text; and the rejected messages."""
    return _decode(raw, value, "alert", "probs")


def decode_metrics(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """MetricsEvents from JSON, ``by_class`` as object or text; and the rejected messages."""
    return _decode(raw, value, "metrics", "by_class")


def window_metrics(
    alerts: DataFrame,
    classes: Sequence[str] = CLASSES,
    window: str = METRICS_WINDOW,
    watermark: str = METRICS_WATERMARK,
) -> DataFrame:
    """Per organisation and tumbling event-time window: total, attacks, rows by class.

    Rows are counted before the shuffle, so one busy organisation is no hot task.
    """
    return (
        alerts.select(
            F.timestamp_millis("ts_event").alias("event_time"), "org_id", "pred_class", "is_attack")
        .withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window), "org_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("is_attack")).alias("attacks"),
            class_count_map("pred_class", classes).alias("by_class"),
        )
        .select(
            F.unix_millis("window.start").alias("window_start"),
            F.unix_millis("window.end").alias("window_end"),
            "org_id", "total", "attacks", "by_class",
        )
    )


def latest_per_window(updates: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Final counts from a log of ``update``-mode emissions.

    The counts of a window only grow, so the last emission is the largest.
    """
    by_class: list[Column] = []
    for name in classes:
        by_class += [F.lit(name), F.max(F.col("by_class")[name])]
    return updates.groupBy("window_start", "window_end", "org_id").agg(
        F.max("total").alias("total"), F.max("attacks").alias("attacks"),
        F.create_map(*by_class).alias("by_class"),
    )


def write_events(
    df: DataFrame,
    checkpoint: str,
    key: str | None = None,
    fmt: str = "kafka",
    path: str | None = None,
    mode: str = "append",
    trigger: dict | None = None,
    **options: str,
) -> StreamingQuery:
    """Start a checkpointed query; with ``key`` rows are encoded as keyed JSON first."""
    out = encode_event(df, key) if key else df
    writer = (
        out.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(**(trigger or {"processingTime": ALERTS_TRIGGER}))
    )
    return writer.start(path) if path else writer.start()


def alerts_query(
    flows: DataFrame, model: Model, stats: FeatureStats, checkpoint: str, **sink
) -> StreamingQuery:
    """Score parsed flows and emit one alert each."""
    return write_events(score_events(flows, model, stats), checkpoint, **sink)


def metrics_query(
    alerts: DataFrame, checkpoint: str, classes: Sequence[str] = CLASSES, mode: str = "update",
    trigger: dict | None = None, **sink,
) -> StreamingQuery:
    """Windowed metrics over a stream of alerts, normally the table the alerts go to."""
    return write_events(
        window_metrics(alerts, classes), checkpoint, mode=mode,
        trigger=trigger or {"processingTime": METRICS_TRIGGER}, **sink)


def alerts_table_sink(
    alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Exactly-once Parquet table of alerts, the basis of the live queries."""
    return write_events(
        alerts, checkpoint, fmt="parquet", path=path,
        trigger=trigger or {"processingTime": ALERTS_TRIGGER})


def read_registry(spark: SparkSession, path: str) -> tuple[Model, FeatureStats]:
    """The newest active model: weights, classes and feature statistics as one row."""
    newest = spark.read.parquet(path).orderBy(F.col("updated_at").desc()).limit(1)
    row = newest.withColumn("version", model_version("kind", "model_file")).first()
    model = Model(tuple(row["dims"]), row["weights"], row["version"], tuple(row["classes"]))
    return model, FeatureStats(tuple(row["feature_names"]), tuple(row["mean"]), tuple(row["std"]))


def write_registry(
    spark: SparkSession, path: str, model: Model, stats: FeatureStats,
    kind: str, model_file: str, updated_at: str,
) -> None:
    """Add an active model; the newest ``updated_at`` is served."""
    row = (
        kind, model_file, updated_at, list(model.dims), [float(w) for w in model.weights],
        list(model.classes), list(stats.names), list(stats.mean), list(stats.std),
    )
    schema = (
        "kind string, model_file string, updated_at string, dims array<int>, "
        "weights array<double>, classes array<string>, feature_names array<string>, "
        "mean array<double>, std array<double>"
    )
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def publish_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch to ``path/batch=N``, once.

    The folder is written beside and renamed as a whole, so readers of ``path`` see
    all of it or nothing. A replayed batch that was published already stays as it
    is: written anew, its files would be new files to a stream that reads ``path``.
    """
    spark = df.sparkSession
    final = f"{path.rstrip('/')}/batch={batch_id}"
    if path_exists(spark, final):
        return
    staging = f"{path.rstrip('/')}/_staging-{batch_id}-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, final))
    file_system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.rename(source, target):
        raise OSError(f"cannot publish {final}")


def split_late_rows(
    alerts: DataFrame, kept_path: str, late_path: str, checkpoint: str,
    window_s: int = METRICS_WINDOW_S, watermark_s: int = METRICS_WATERMARK_S,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store the alerts in time at ``kept_path`` and those behind the watermark at ``late_path``.

    An alert is late if its window had ended ``watermark_s`` seconds before the newest event of
    the earlier micro-batches, which is when a windowed count may have let the window go. Nothing
    is lost: kept and late rows are the input. Each batch owns a folder per output, published
    once, and notes the newest event time for the next one.
    """
    clocks = f"{late_path.rstrip('/')}/_clock"

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{clocks}/batch={batch_id - 1}"
        newest = spark.read.parquet(before).first()["newest"] if path_exists(spark, before) else None
        rows = batch.persist()
        try:
            late = F.lit(False)
            if newest is not None:
                # Not with F.window, which drops rows without a time; those are kept.
                end = (F.floor(F.col("ts_event") / (window_s * 1000)) + 1) * (window_s * 1000)
                late = F.coalesce(end <= newest - watermark_s * 1000, F.lit(False))
            judged = rows.withColumn("_late", late)
            publish_batch(judged.filter("NOT _late").drop("_late"), kept_path, batch_id)
            publish_batch(judged.filter("_late").drop("_late"), late_path, batch_id)
            own = rows.agg(F.max("ts_event")).first()[0]
        finally:
            rows.unpersist()
        newest = max((t for t in (newest, own) if t is not None), default=None)
        spark.createDataFrame([(newest,)], "newest bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{clocks}/batch={batch_id}")
        # A replay needs the note before its own batch, never an older one.
        drop_path(spark, f"{clocks}/batch={batch_id - 2}")

    return (
        alerts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": METRICS_TRIGGER})).foreachBatch(split).start()
    )


def run_scoring_stream(
    raw: DataFrame,
    registry: str,
    alerts_path: str,
    dead_letter_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    on_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Parse, score once, and store alerts and dead letters of each micro-batch.

    The model registry is read per batch, so a new active model takes effect
    without a restart. Each batch owns one directory per output, published once
    (``publish_batch``), so a replay after a failure changes nothing. Metrics and
    live queries read the alerts table instead of scoring again. ``raw`` should
    bound what a batch admits (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        model, stats = read_registry(spark, registry)
        # Both outputs come from one read of the source.
        texts = batch.select("value").persist()
        try:
            flows, dead = parse_flows(texts)
            publish_batch(score_events(flows, model, stats), alerts_path, batch_id)
            publish_batch(dead, dead_letter_path, batch_id)
        finally:
            texts.unpersist()
        if on_batch:
            on_batch(batch_id)

    return (
        raw.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": ALERTS_TRIGGER}))
        .foreachBatch(score).start()
    )
