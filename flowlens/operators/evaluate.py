"""Classification metrics from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalar import divide_or_zero


def confusion_counts(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """``truth, prediction, n`` for the pairs that occur: the only pass over the rows."""
    return df.groupBy(
        *by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, truth: str, prediction: str, classes: Sequence
) -> DataFrame:
    """All class pairs with their counts, zeros included."""
    counts = confusion_counts(df, truth, prediction)
    spark = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    grid = spark.createDataFrame(
        [(t, p) for t in classes for p in classes], f"truth {kind}, prediction {kind}"
    )
    return grid.join(counts, ["truth", "prediction"], "left").select(
        "truth", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_pivot(
    df: DataFrame, truth: str, prediction: str, classes: Sequence
) -> DataFrame:
    """The same as one row per true class and one column per predicted class."""
    counts = df.groupBy(F.col(truth).alias("truth")).agg(*[
        F.count_if(F.col(prediction) == F.lit(c)).alias(str(c)) for c in classes
    ])
    kind = df.schema[truth].dataType.simpleString()
    names = df.sparkSession.createDataFrame([(c,) for c in classes], f"truth {kind}")
    return names.join(counts, "truth", "left").na.fill(0, [str(c) for c in classes])


def per_class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction.

    ``counts`` is the output of ``confusion_counts``; a zero denominator scores 0.
    """
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("cls"), hit.cast("bigint").alias("tp"),
                 F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("tp"),
                 zero.alias("support"), F.col("n").alias("predicted")),
    )
    totals = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    precision = divide_or_zero(F.col("tp"), F.col("predicted"))
    recall = divide_or_zero(F.col("tp"), F.col("support"))
    f1 = divide_or_zero(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return totals.select(
        *by, "cls", precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), "support", "tp",
    )


def overall_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1 (over the classes that occur) and support-weighted F1."""
    return scores.groupBy(*by).agg(
        divide_or_zero(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        divide_or_zero(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
        .alias("weighted_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("rows"),
    )


def classification_metrics(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 (per ``by`` group)."""
    return overall_scores(
        per_class_scores(confusion_counts(df, truth, prediction, by), by), by
    )


def scores_of_matrix(matrix: np.ndarray) -> tuple[float, float, float]:
    """Accuracy, macro F1 and weighted F1 of one small confusion matrix (rows are the truth).

    For confusion counts that are already on the driver, one cell per class pair.
    """
    support, predicted, hits = matrix.sum(axis=1), matrix.sum(axis=0), np.diag(matrix)
    rows = matrix.sum()
    if rows == 0:
        return 0.0, 0.0, 0.0
    seen = (support + predicted) > 0
    f1 = 2.0 * hits[seen] / (support + predicted)[seen]
    return float(hits.sum() / rows), float(f1.mean()), float((f1 * support[seen]).sum() / rows)


def matrix_of_counts(counts: DataFrame, num_classes: int) -> np.ndarray:
    """Collect ``truth, prediction, n`` with integer classes: at most one row per class pair."""
    matrix = np.zeros((num_classes, num_classes), dtype=np.int64)
    for row in counts.collect():
        matrix[row["truth"], row["prediction"]] += row["n"]
    return matrix


def class_report(df: DataFrame, truth: str, prediction: str, classes: Sequence) -> DataFrame:
    """Precision, recall, F1 and support of every class of the dictionary, absent ones as 0."""
    kind = df.schema[truth].dataType.simpleString()
    names = df.sparkSession.createDataFrame([(c,) for c in classes], f"cls {kind}")
    scores = per_class_scores(confusion_counts(df, truth, prediction)).drop("tp")
    return names.join(scores, "cls", "left").na.fill(
        0, ["precision", "recall", "f1", "support"]
    )
