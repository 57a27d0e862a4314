"""Scoring of flow events with a dense classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.network import logits, parameter_count, softmax_rows
from flowlens.functions.scalar import (
    argmax_class, columns_to_vector, features_to_vector, softmax,
)
from flowlens.labels import CLASSES
from flowlens.operators.profile import FeatureStats


@dataclass(frozen=True)
class Model:
    """Layer widths and flat weights; bounded by the architecture, not by the data."""

    dims: tuple[int, ...]
    weights: np.ndarray = field(repr=False)
    version: str = ""
    classes: tuple[str, ...] = CLASSES

    def __post_init__(self) -> None:
        if len(self.weights) != parameter_count(self.dims):
            raise ValueError(
                f"{len(self.weights)} weights for layers {self.dims}, "
                f"expected {parameter_count(self.dims)}"
            )


def list_rows(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list array, one list per row."""
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def matrix_of(lists: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """An Arrow list array as a matrix; a NULL element counts as 0, another length fails."""
    values = lists.flatten()
    if len(values) != len(lists) * width:
        raise ValueError(f"feature vectors do not all have {width} elements")
    if values.null_count:
        values = values.fill_null(0.0)
    return values.to_numpy(zero_copy_only=False).reshape(len(lists), width).astype(kind, copy=False)


# Rows that pass through the network at once: a layer's arrays then stay in the cache.
FORWARD_ROWS = 1024


def class_probabilities(
    vector: Column | str, model: Model, stats: FeatureStats | None = None, single: bool = False
) -> Column:
    """Class probabilities of a feature array.

    Arrow batches go through the dense layers as one matrix product per layer.
    With ``stats`` the vector holds raw features, which are standardised first
    and rounded to single precision like the served model's input. ``single``
    computes the layers in single precision, as a served model does.
    """
    dims, kind = tuple(model.dims), np.float32 if single else np.float64
    weights = np.asarray(model.weights, dtype=kind)
    mean = None if stats is None else np.array(stats.mean)
    std = None if stats is None else np.array(stats.std)

    @F.arrow_udf("array<float>" if single else "array<double>")
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = matrix_of(batch, dims[0], np.float64 if mean is not None else kind)
            if mean is not None:
                x = ((np.sign(x) * np.log1p(np.abs(x)) - mean) / std).astype(np.float32).astype(kind)
            result = np.empty((len(x), dims[-1]), kind)
            for at in range(0, len(x), FORWARD_ROWS):
                part = slice(at, at + FORWARD_ROWS)
                result[part] = softmax_rows(logits(weights, dims, x[part]))
            yield list_rows(result)

    return probabilities(vector)


def linear_probabilities(vector: Column | str, model: Model) -> Column:
    """Class probabilities of a model without hidden layers, from column expressions alone.

    Usable in SQL views and filters where no Python may run.
    """
    if len(model.dims) != 2:
        raise ValueError(f"layers {model.dims} are not linear")
    inputs, outputs = model.dims
    vector = F.col(vector) if isinstance(vector, str) else vector
    matrix = np.asarray(model.weights[:inputs * outputs], dtype=float).reshape(outputs, inputs)

    def score(row: np.ndarray, bias: float) -> Column:
        products = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x) + F.lit(float(bias))

    biases = model.weights[inputs * outputs:]
    return softmax(F.array(*[score(row, bias) for row, bias in zip(matrix, biases)]))


def score_events(
    df: DataFrame,
    model: Model,
    stats: FeatureStats,
    ts_scored: Column | int | None = None,
    features: Sequence[str] | str = "features",
    benign: str = "Benign",
) -> DataFrame:
    """FlowEvents to AlertEvents, one alert per event.

    ``features`` is a map column, or the names of feature columns. ``ts_scored``
    defaults to the time of the query (of the micro-batch on streams), which
    keeps retried tasks consistent. Works on one row as on a stream.
    """
    if ts_scored is None:
        ts_scored = F.unix_millis(F.current_timestamp())
    elif isinstance(ts_scored, int):
        ts_scored = F.lit(ts_scored)
    vector = (
        features_to_vector(features, stats.names) if isinstance(features, str)
        else columns_to_vector(features)
    )
    ts_scored = ts_scored.cast("long")
    scored = df.withColumn("_p", class_probabilities(vector, model, stats))
    names = F.array(*[F.lit(c) for c in model.classes])
    return scored.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts_event").cast("long").alias("ts_event"),
        ts_scored.alias("ts_scored"),
        (ts_scored - F.col("ts_event")).cast("double").alias("latency_ms"),
        F.coalesce("org_id", F.lit("default")).alias("org_id"),
        F.coalesce("device_id", F.lit("")).alias("device_id"),
        argmax_class("_p", model.classes).alias("pred_class"),
        F.array_max("_p").alias("confidence"),
        F.map_from_arrays(names, F.col("_p")).alias("probs"),
        (argmax_class("_p", model.classes) != benign).alias("is_attack"),
        F.col("true_label"),
        F.lit(model.version).alias("model_version"),
    )


def score_parity(
    left: DataFrame, right: DataFrame, key: str, probs: str = "probs", tolerance: float = 1e-4
) -> DataFrame:
    """How far two scorings of the same rows differ, as one row.

    ``rows`` were scored by both, ``unmatched`` by one of them only, ``mismatched``
    with vectors of different lengths, NULL or not a number on either side.
    ``within`` needs every row matched, every vector comparable and the largest
    difference within ``tolerance``.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"_key{name}"), F.col(probs).alias(f"_p{name}"))

    pairs = side(left, "a").join(side(right, "b"), F.col("_keya") == F.col("_keyb"), "full_outer")
    both = F.col("_keya").isNotNull() & F.col("_keyb").isNotNull()
    gap = F.array_max(F.zip_with("_pa", "_pb", lambda a, b: F.abs(a - b)))
    comparable = (
        F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
        & (F.size("_pa") == F.size("_pb"))
        & ~F.exists(F.concat("_pa", "_pb"), lambda v: v.isNull() | F.isnan(v))
    )
    comparable = F.coalesce(comparable, F.lit(False))
    return pairs.agg(
        F.count_if(both).alias("rows"),
        F.count_if(~both).alias("unmatched"),
        F.count_if(both & ~comparable).alias("mismatched"),
        F.max(F.when(both & comparable, gap)).alias("max_abs_diff"),
    ).withColumn(
        "within",
        (F.col("unmatched") == 0) & (F.col("mismatched") == 0)
        & F.coalesce(F.col("max_abs_diff") <= F.lit(float(tolerance)), F.lit(True)),
    )
