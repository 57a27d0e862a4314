"""Column contracts of the event streams and of the run documents."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts_event", T.LongType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("true_label", T.StringType()),
])

ALERT_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts_event", T.LongType()),
    T.StructField("ts_scored", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("pred_class", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probs", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("true_label", T.StringType()),
    T.StructField("model_version", T.StringType()),
])

METRICS_EVENT = T.StructType([
    T.StructField("window_start", T.LongType()),
    T.StructField("window_end", T.LongType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("total", T.LongType()),
    T.StructField("attacks", T.LongType()),
    T.StructField("by_class", T.MapType(T.StringType(), T.LongType())),
])

ACTIVE_MODEL = T.StructType([
    T.StructField("model_file", T.StringType()),
    T.StructField("model_card", T.MapType(T.StringType(), T.StringType())),
    T.StructField("kind", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

# Per contract: the fields that must be present, and the defaults of the others.
REQUIRED = {
    "flow": ("event_id", "ts_event", "features"),
    "alert": (
        "event_id", "ts_event", "ts_scored", "latency_ms",
        "pred_class", "confidence", "probs", "is_attack",
    ),
    "metrics": ("window_start", "window_end", "total", "attacks", "by_class"),
    "model": ("model_file", "kind", "updated_at"),
}
DEFAULTS = {
    "flow": {"org_id": "default", "device_id": ""},
    "alert": {"org_id": "default", "device_id": "", "model_version": ""},
    "metrics": {"org_id": "default"},
    "model": {},
}
CONTRACTS = {
    "flow": FLOW_EVENT, "alert": ALERT_EVENT,
    "metrics": METRICS_EVENT, "model": ACTIVE_MODEL,
}

CLASS_SCORE = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("support", T.LongType()),
])

TEST_METRICS = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("macro_f1", T.DoubleType()),
    T.StructField("weighted_f1", T.DoubleType()),
    T.StructField("per_class", T.MapType(T.StringType(), CLASS_SCORE)),
])

ROUND_ENTRY = T.StructType([
    T.StructField("round", T.IntegerType()),
    T.StructField("global_val_macro_f1", T.DoubleType()),
    T.StructField("global_val_accuracy", T.DoubleType()),
    T.StructField("mean_client_f1", T.DoubleType()),
    T.StructField("std_client_f1", T.DoubleType()),
    T.StructField("worst_client_f1", T.DoubleType()),
    T.StructField("mean_client_loss", T.DoubleType()),
    T.StructField("client_f1s", T.ArrayType(T.DoubleType())),
    T.StructField("mb_communicated", T.DoubleType()),
    T.StructField("wall_time_s", T.DoubleType()),
    T.StructField("selected_clients", T.ArrayType(T.IntegerType())),
])

RUN_DOCUMENT = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("alpha", T.StringType()),
    T.StructField("mu", T.DoubleType()),
    T.StructField("seed", T.LongType()),
    T.StructField("profile", T.StringType()),
    T.StructField("num_clients", T.IntegerType()),
    T.StructField("rounds", T.IntegerType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("input_dim", T.IntegerType()),
    T.StructField("drop_features", T.ArrayType(T.StringType())),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("wall_time_s", T.DoubleType()),
    T.StructField("test_metrics", TEST_METRICS),
    T.StructField("history", T.ArrayType(ROUND_ENTRY)),
])

PARTITION_DOCUMENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("alpha", T.StringType()),
    T.StructField("num_clients", T.IntegerType()),
    T.StructField("seed", T.LongType()),
    T.StructField("min_samples", T.LongType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("client_sizes", T.ArrayType(T.LongType())),
    T.StructField("class_distribution", T.ArrayType(T.ArrayType(T.LongType()))),
])
