"""Cleaning: finite features, duplicate removal, label mapping."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowlens.functions.scalar import is_finite
from flowlens.labels import DEFAULT_TAXONOMY, Taxonomy

NON_FEATURES = ("label", "label_34", "label_8", "source_file", "row_key")


def feature_columns(df: DataFrame) -> list[str]:
    """Feature names: every column but labels, provenance and row key, in alphabetical order."""
    return sorted(set(df.columns) - set(NON_FEATURES))


def drop_non_finite(df: DataFrame) -> DataFrame:
    """Keep rows whose features are all finite and whose label is not blank."""
    label = F.col("label")
    conditions = [is_finite(name) for name in feature_columns(df)]
    conditions += [label.isNotNull(), F.trim(label) != ""]
    return df.filter(reduce(and_, conditions))


def deduplicate(df: DataFrame, scope: str = "global") -> DataFrame:
    """One row per distinct features and label, over all files or within each file.

    With ``global`` scope the surviving ``source_file`` is the smallest one, so
    the result does not depend on how the input is partitioned. Copies are
    merged before the shuffle, so a heavily repeated row costs no hot task.
    """
    keys = feature_columns(df) + ["label"]
    if scope == "per_file":
        return df.dropDuplicates(["source_file", *keys])
    if scope != "global":
        raise ValueError(f"unknown deduplication scope {scope!r}")
    if "source_file" not in df.columns:
        return df.dropDuplicates(keys)
    merged = df.groupBy(*keys).agg(F.min("source_file").alias("source_file"))
    return merged.select(*df.columns)


def map_labels(
    df: DataFrame,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    on_unmapped: str = "error",
) -> DataFrame:
    """Rename ``label`` to ``label_34`` and add its class as ``label_8``.

    Explicit labels come from a broadcast join with the dictionary (fixed size),
    the others from the prefix rules in order. A label that neither covers
    fails the job (``error``), becomes NULL (``null``) or goes away (``drop``);
    none of these needs a pass of its own.
    """
    if on_unmapped not in ("error", "null", "drop"):
        raise ValueError(f"unknown on_unmapped {on_unmapped!r}")
    df = df.withColumnRenamed("label", "label_34")
    rows = list(taxonomy.explicit.items())
    dictionary = df.sparkSession.createDataFrame(rows, "label_34 string, _class string")
    label = F.col("label_34")
    choices = [F.col("_class")]
    choices += [F.when(label.startswith(p), F.lit(c)) for p, c in taxonomy.prefixes]
    if on_unmapped == "error":
        message = F.concat(F.lit("Unmapped label: "), F.coalesce(label, F.lit("NULL")))
        choices.append(F.raise_error(message).cast("string"))
    columns = df.columns
    mapped = df.join(F.broadcast(dictionary), "label_34", "left").select(
        *columns, F.coalesce(*choices).alias("label_8")
    )
    return mapped.filter(F.col("label_8").isNotNull()) if on_unmapped == "drop" else mapped


def clean(
    df: DataFrame,
    scope: str = "global",
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    on_unmapped: str = "error",
) -> DataFrame:
    """Finite rows, then distinct rows, then rows with a class."""
    return (
        df.transform(drop_non_finite)
        .transform(deduplicate, scope)
        .transform(map_labels, taxonomy, on_unmapped)
    )


class StageCounter:
    """Row counts of pipeline stages that ride on the job writing the result."""

    def __init__(self) -> None:
        self._observations: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        """Count the rows passing through ``df`` under the name ``stage``."""
        observation = Observation(stage)
        self._observations[stage] = observation
        return df.observe(observation, F.count(F.lit(1)).alias("rows"))

    def counts(self) -> dict[str, int]:
        """Counts by stage; call after the action."""
        return {name: int(o.get["rows"]) for name, o in self._observations.items()}

    def loss(self, before: str, after: str) -> dict[str, float]:
        """Rows and percentage lost between two stages."""
        counts = self.counts()
        dropped = counts[before] - counts[after]
        percent = round(100.0 * dropped / counts[before], 2) if counts[before] else 0.0
        return {"dropped": dropped, "dropped_pct": percent}
