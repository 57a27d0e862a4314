"""Profiles and feature statistics: class counts, summaries, standardisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalar import class_index, columns_to_vector, signed_log1p, standard_score
from flowlens.labels import CLASSES
from flowlens.operators.clean import feature_columns

# Fixed value: deviations up to this count as none, and the scale becomes 1.
STD_FLOOR = 1e-10


def class_counts(df: DataFrame, coarse: str = "label_8", fine: str = "label_34") -> DataFrame:
    """Row counts and fractions per class and per fine label, in one pass.

    ``level`` says which of the two a row counts; labels are in order.
    """
    counts = (
        df.groupBy(coarse, fine).agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.explode(F.array(
                F.struct(F.lit(coarse).alias("level"), F.col(coarse).alias("label")),
                F.struct(F.lit(fine).alias("level"), F.col(fine).alias("label")),
            )).alias("_key"),
            "_n",
        )
        .groupBy("_key.level", "_key.label").agg(F.sum("_n").alias("rows"))
    )
    # The window sees one row per label of the dictionary.
    total = F.sum("rows").over(Window.partitionBy("level"))
    return counts.withColumn("fraction", F.col("rows") / total).orderBy("level", "label")


def _per_feature(
    df: DataFrame, names: Sequence[str], measures: Callable[[Column], dict[str, Column]]
) -> DataFrame:
    """One row per feature from one aggregation: ``pos, feature`` and the measures."""
    rows = [
        F.struct(
            F.lit(pos).alias("pos"), F.lit(name).alias("feature"),
            *[column.alias(measure) for measure, column in measures(F.col(f"`{name}`")).items()],
        )
        for pos, name in enumerate(names)
    ]
    return df.agg(F.array(*rows).alias("features")).select(F.inline("features"))


def feature_summary(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per feature: min, max, mean, population deviation, and NULL-or-NaN count."""
    def measures(value: Column) -> dict[str, Column]:
        present = F.count(F.nanvl(value.cast("double"), F.lit(None).cast("double")))
        return {
            "nulls": F.count(F.lit(1)) - present, "mean": F.mean(value),
            "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value),
        }

    found = _per_feature(df, list(features or feature_columns(df)), measures)
    return found.select("pos", "feature", "min", "max", "mean", "std", "nulls")


def fit_feature_stats(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Mean and population deviation of each feature's signed log: ``pos, feature, mean, std``."""
    def measures(value: Column) -> dict[str, Column]:
        deviation = F.stddev_pop(value)
        return {
            "mean": F.coalesce(F.mean(value), F.lit(0.0)),
            "std": F.when(deviation > STD_FLOOR, deviation).otherwise(F.lit(1.0)),
        }

    names = list(features or feature_columns(df))
    logs = df.select(*[signed_log1p(name).alias(name) for name in names])
    return _per_feature(logs, names, measures)


def stats_document(stats: DataFrame) -> DataFrame:
    """The statistics as one row of parallel arrays, in feature order, as models are served them."""
    ordered = stats.agg(F.sort_array(F.collect_list(
        F.struct("pos", "feature", "mean", "std"))).alias("rows"))
    return ordered.select(
        F.col("rows.feature").alias("feature_names"), F.col("rows.mean").alias("mean"),
        F.col("rows.std").alias("std"))


@dataclass(frozen=True)
class FeatureStats:
    """Feature statistics on the driver; their size is the number of features."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    @classmethod
    def collect(cls, stats: DataFrame) -> FeatureStats:
        rows = stats.orderBy("pos").collect()
        return cls(
            tuple(r["feature"] for r in rows),
            tuple(float(r["mean"]) for r in rows),
            tuple(float(r["std"]) for r in rows),
        )

    def drop(self, features: Sequence[str]) -> FeatureStats:
        """Without the named features (ablation)."""
        kept = [i for i, name in enumerate(self.names) if name not in set(features)]
        return FeatureStats(
            tuple(self.names[i] for i in kept),
            tuple(self.mean[i] for i in kept),
            tuple(self.std[i] for i in kept),
        )


def standardize(
    df: DataFrame, stats: FeatureStats, missing: str = "error", as_float: bool = False
) -> DataFrame:
    """Replace each feature by its standard score; other columns pass through.

    A feature the frame lacks is an error, or counts as 0.0 with ``missing="zero"``.
    """
    if missing not in ("error", "zero"):
        raise ValueError(f"unknown missing {missing!r}")
    absent = [name for name in stats.names if name not in df.columns]
    if absent and missing == "error":
        raise KeyError(f"features missing from the frame: {absent}")
    others = [c for c in df.columns if c not in set(stats.names)]
    scores = []
    for name, mean, std in zip(stats.names, stats.mean, stats.std):
        value = F.lit(0.0) if name in absent else F.col(name)
        if missing == "zero":
            value = F.coalesce(value, F.lit(0.0))
        score = standard_score(value, mean, std)
        scores.append((score.cast("float") if as_float else score).alias(name))
    return df.select(*others, *scores)


def training_frame(
    df: DataFrame,
    stats: FeatureStats,
    label: str = "label_8",
    classes: Sequence[str] = CLASSES,
    drop_features: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Design matrix as columns: ``features`` (standardised array) and ``label`` (index).

    A label that is NULL or none of ``classes`` fails the job.
    """
    stats = stats.drop(drop_features) if drop_features else stats
    scored = standardize(df, stats)
    index = class_index(label, classes)
    checked = F.coalesce(index, F.raise_error(F.concat(
        F.lit("unknown class: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))
    )).cast("int"))
    return scored.select(
        *keep, columns_to_vector(stats.names).alias("features"), checked.alias("label"))
