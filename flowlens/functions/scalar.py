"""Column expressions, all of them built from Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log1p(value: Column | str) -> Column:
    """``sign(x) * ln(1 + |x|)``: a logarithm that keeps the sign and maps 0 to 0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.signum(value) * F.log1p(F.abs(value))


def standard_score(value: Column | str, mean: float, std: float) -> Column:
    """Signed log of ``value``, centred and scaled."""
    return (signed_log1p(value) - F.lit(float(mean))) / F.lit(float(std))


def is_finite(value: Column | str) -> Column:
    """Neither NULL nor NaN nor infinite (always TRUE or FALSE)."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        value.isNotNull()
        & ~F.isnan(value)
        & (F.abs(value) != F.lit(float("inf")))
    )


def features_to_vector(features: Column | str, names: Sequence[str]) -> Column:
    """Feature map to an array in ``names`` order; absent or NULL features become 0.0.

    Maps written in model order are read by position; others by key.
    """
    features = F.col(features) if isinstance(features, str) else features
    zero = F.lit(0.0)
    by_key = F.array(*[F.coalesce(features[name], zero) for name in names])
    in_order = F.map_keys(features) == F.array(*[F.lit(name) for name in names])
    values = F.map_values(features)
    complete = ~F.exists(values, lambda v: v.isNull())
    return F.when(in_order & complete, values).otherwise(by_key)


def columns_to_vector(names: Sequence[str]) -> Column:
    """Columns to one array of doubles, in ``names`` order."""
    return F.array(*[F.col(name).cast("double") for name in names])


def columns_to_map(names: Sequence[str]) -> Column:
    """Columns to a map from column name to double."""
    return F.map_from_arrays(
        F.array(*[F.lit(name) for name in names]), columns_to_vector(names)
    )


def softmax(logits: Column | str) -> Column:
    """Softmax of an array, shifted by its maximum."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    weights = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(weights, lambda v: v / total)


def argmax_index(scores: Column | str) -> Column:
    """0-based position of the largest element, the first one on ties."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_class(scores: Column | str, classes: Sequence[str]) -> Column:
    """Name of the class with the largest score."""
    return F.get(F.array(*[F.lit(c) for c in classes]), argmax_index(scores))


def class_index(label: Column | str, classes: Sequence[str]) -> Column:
    """Class name to its 0-based index; NULL for an unknown name."""
    label = F.col(label) if isinstance(label, str) else label
    names = F.array(*[F.lit(c) for c in classes])
    return F.nullif(F.array_position(names, label), F.lit(0)).cast("int") - F.lit(1)


def class_name(index: Column | str, classes: Sequence[str]) -> Column:
    """0-based index to class name; NULL outside the dictionary."""
    index = F.col(index) if isinstance(index, str) else index
    return F.get(F.array(*[F.lit(c) for c in classes]), index)


def class_count_map(label: Column | str, classes: Sequence[str]) -> Column:
    """Aggregate: map from every class to its row count, zeros included."""
    label = F.col(label) if isinstance(label, str) else label
    pairs: list[Column] = []
    for name in classes:
        pairs += [F.lit(name), F.count_if(label == name)]
    return F.create_map(*pairs)


def model_version(kind: Column | str, model_file: Column | str) -> Column:
    """``kind:file`` identifier of a served model."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    model_file = F.col(model_file) if isinstance(model_file, str) else model_file
    return F.concat_ws(":", F.coalesce(kind, F.lit("unknown")), model_file)


def try_numeric(value: Column | str) -> Column:
    """Text to double where it is a number, else NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.trim(value).try_cast("double")


def divide_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 when the denominator is zero."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))
