"""Comparison tables over experiment runs.

A run is one row; its rounds are the ``history`` array. Whatever concerns one run
alone (last round, total traffic, first round over a target) is computed inside
the row with array functions; only comparisons across runs aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.labels import CLASSES

# Fixed value: share of the best centralised score a federated run has to reach.
TARGET_SHARE = 0.95


def last_round(field: str) -> Column:
    """A field of the run's last round; NULL for a run without rounds."""
    return F.try_element_at("history", F.lit(-1))[field]


def total_megabytes() -> Column:
    return F.aggregate(
        F.coalesce(F.col("history.mb_communicated"), F.array().cast("array<double>")),
        F.lit(0.0), lambda acc, mb: acc + F.coalesce(mb, F.lit(0.0)),
    )


def run_label(method: str = "method") -> Column:
    return F.coalesce("model_type", method)


def run_summary(runs: DataFrame) -> DataFrame:
    """Run list: identity and test macro F1."""
    return runs.select(
        "run_name", "method", "alpha", "mu", "seed", "profile", "rounds",
        F.col("test_metrics.macro_f1").alias("macro_f1"),
    )


def run_detail(runs: DataFrame, run_name: str) -> DataFrame:
    """The document of one run."""
    return runs.filter(F.col("run_name") == run_name)


def prefer_profile(runs: DataFrame, profile: str = "lab") -> DataFrame:
    """The rows of ``profile`` if there are any, else all; ``smoke_only`` tells which."""
    present = runs.agg(
        F.coalesce(F.bool_or(F.col("profile") == profile), F.lit(False)).alias("_any")
    ).scalar()
    return runs.filter(~present | (F.col("profile") == profile)).withColumn(
        "smoke_only", ~present)


def experiment_rows(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Run documents and flat results as one table; columns either side lacks are NULL."""
    return documents.unionByName(results, allowMissingColumns=True)


def results_table(rows: DataFrame) -> DataFrame:
    """One line per run, whether its scores are nested (documents) or flat (results)."""
    return rows.select(
        F.coalesce("run_name", "method").alias("run"),
        run_label().alias("type"),
        F.coalesce("test_metrics.macro_f1", "test_macro_f1").alias("macro_f1"),
        F.coalesce("test_metrics.accuracy", "test_accuracy").alias("accuracy"),
        F.coalesce(F.col("train_rows"), F.col("num_clients").cast("bigint")).alias("rows"),
        "profile",
    )


def main_results(centralized: DataFrame, runs: DataFrame) -> DataFrame:
    """Method by alpha: mean scores, client spread, rounds to the target, traffic.

    ``rounds_to_target`` averages over the runs that reached the target; NULL
    means none did. ``std_macro_f1`` is NULL for a single run.
    """
    best = centralized.agg(
        F.coalesce(F.max("test_metrics.macro_f1"), F.lit(0.0)).alias("_best")).scalar()
    reached = F.array_min(F.transform(
        F.filter("history", lambda h: h["global_val_macro_f1"] >= F.col("_target")),
        lambda h: h["round"]))
    per_run = runs.withColumn("_target", best * F.lit(TARGET_SHARE)).select(
        "method", "alpha",
        F.struct("run_name", "mu", "profile").alias("_who"),
        F.coalesce("test_metrics.macro_f1", F.lit(0.0)).alias("_f1"),
        F.coalesce("test_metrics.accuracy", F.lit(0.0)).alias("_acc"),
        last_round("std_client_f1").alias("_spread"),
        reached.cast("double").alias("_rounds"),
        total_megabytes().alias("_mb"),
    )
    federated = per_run.groupBy("method", "alpha").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("_f1").alias("macro_f1"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("_f1")).alias("std_macro_f1"),
        F.avg("_acc").alias("accuracy"),
        F.avg("_spread").alias("client_f1_std"),
        F.avg("_rounds").alias("rounds_to_target"),
        F.avg("_mb").alias("mb_communicated"),
        F.min("_who").alias("_who"),
    )
    name = F.when(
        F.col("method") == "fedprox",
        F.concat(F.lit("FedProx (mu="), F.col("_who.mu").cast("string"), F.lit(")")),
    ).otherwise(F.upper("method"))
    nothing = F.lit(None).cast("double")
    lines = federated.select(
        name.alias("method"), "alpha", "runs", "macro_f1", "std_macro_f1", "accuracy",
        "client_f1_std", "rounds_to_target", "mb_communicated",
        F.col("_who.profile").alias("profile"),
    )
    baselines = centralized.select(
        F.upper("model_type").alias("method"), F.lit("-").alias("alpha"),
        F.lit(1).cast("bigint").alias("runs"),
        F.coalesce("test_metrics.macro_f1", F.lit(0.0)).alias("macro_f1"),
        nothing.alias("std_macro_f1"),
        F.coalesce("test_metrics.accuracy", F.lit(0.0)).alias("accuracy"),
        nothing.alias("client_f1_std"), nothing.alias("rounds_to_target"),
        nothing.alias("mb_communicated"), "profile",
    )
    return baselines.unionByName(lines)


def f1_by_alpha(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of macro F1 per method and alpha."""
    score = F.coalesce("test_metrics.macro_f1", F.lit(0.0))
    return runs.groupBy("method", "alpha").agg(
        F.avg(score).alias("mean_f1"), F.stddev_pop(score).alias("std_f1"),
        F.count(F.lit(1)).alias("runs"),
    )


def select_best(
    runs: DataFrame, profile: str, alpha: str = "0.5",
    methods: Sequence[str] = ("fedavg", "fedprox"),
) -> DataFrame:
    """The run with the best last-round validation F1, the first name on ties; 0 or 1 rows."""
    candidates = runs.filter(
        (F.col("profile") == profile) & (F.col("alpha") == alpha)
        & F.col("method").isin(list(methods)) & (F.size("history") > 0)
    )
    final = F.coalesce(last_round("global_val_macro_f1"), F.lit(0.0))
    return candidates.withColumn("final_val_f1", final).orderBy(
        F.col("final_val_f1").desc(), F.col("run_name")).limit(1)


def convergence(runs: DataFrame) -> DataFrame:
    """One row per run and round."""
    return runs.select("run_name", "method", "alpha", "mu", F.explode("history").alias("_h")).select(
        "run_name", "method", "alpha", "mu", F.col("_h.round").alias("round"),
        F.coalesce("_h.global_val_macro_f1", F.lit(0.0)).alias("macro_f1"),
        F.col("_h.mean_client_f1").alias("mean_client_f1"),
        F.col("_h.std_client_f1").alias("std_client_f1"),
    )


def _quantile(ordered: str, fraction: float) -> Column:
    """Linear interpolation in a sorted array column."""
    position = (F.size(ordered) - 1) * F.lit(fraction)
    low = F.floor(position).cast("int")
    a = F.get(F.col(ordered), low)
    b = F.coalesce(F.get(F.col(ordered), low + 1), a)
    return a + (b - a) * (position - low)


def client_fairness(runs: DataFrame) -> DataFrame:
    """Five-number summary of the clients' F1 in each run's last round."""
    ordered = runs.select(
        "run_name", "method", "alpha", F.sort_array(last_round("client_f1s")).alias("_f")
    ).filter(F.size("_f") > 0)
    return ordered.select(
        "run_name", "method", "alpha", F.size("_f").cast("bigint").alias("clients"),
        *[_quantile("_f", q).alias(name) for name, q in (
            ("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))],
    )


def client_f1_series(runs: DataFrame) -> DataFrame:
    """Per-client F1 of each run's last round, one row per client."""
    return runs.select(
        "run_name", "method", "alpha", F.posexplode(last_round("client_f1s")).alias("client", "f1"))


def communication_summary(runs: DataFrame, by: str = "all") -> DataFrame:
    """Megabytes exchanged: in total with MB per round, or per run beside its macro F1."""
    per_run = runs.select(
        "run_name", "method", "alpha", total_megabytes().alias("total_mb"),
        F.greatest(F.size(F.coalesce("history", F.array())), F.lit(0)).cast("bigint")
        .alias("rounds"),
        F.coalesce("test_metrics.macro_f1", F.lit(0.0)).alias("macro_f1"),
    )
    if by == "run":
        return per_run
    if by != "all":
        raise ValueError(f"unknown by {by!r}")
    return per_run.agg(
        F.coalesce(F.sum("total_mb"), F.lit(0.0)).alias("total_mb"),
        F.coalesce(F.sum("rounds"), F.lit(0)).alias("rounds"),
    ).withColumn("mb_per_round", F.col("total_mb") / F.greatest("rounds", F.lit(1)))


def per_class_matrix(runs: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """F1 per class, one row per run that reports classes; unreported classes are 0."""
    scores = F.col("test_metrics.per_class")
    return runs.filter(F.size(scores) > 0).select(
        F.coalesce("run_name", "method").alias("run"),
        *[F.coalesce(scores[c]["f1"], F.lit(0.0)).alias(c) for c in classes],
    )


def ablation_compare(
    centralized: DataFrame, marker: str = "no_iat", model_type: str = "mlp",
    classes: Sequence[str] = CLASSES,
) -> DataFrame:
    """Class F1 with and without a feature: the first run of either kind, by name.

    No rows unless both kinds exist.
    """
    scores = F.col("test_metrics.per_class")
    vector = F.array(*[F.coalesce(scores[c]["f1"], F.lit(0.0)) for c in classes])
    ablated = F.coalesce(F.col("run_name"), F.lit("")).contains(marker)
    run = F.struct(
        F.col("run_name"), F.coalesce("test_metrics.macro_f1", F.lit(0.0)).alias("macro_f1"),
        vector.alias("f1"),
    )
    sides = centralized.agg(
        F.min(F.when(~ablated & (F.col("model_type") == model_type), run)).alias("a"),
        F.min(F.when(ablated, run)).alias("b"),
    ).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    lines = F.array(*[
        F.struct(
            F.lit(c).alias("cls"),
            F.get(F.col("a.f1"), F.lit(i)).alias("f1_with"),
            F.get(F.col("b.f1"), F.lit(i)).alias("f1_without"),
        ) for i, c in enumerate(classes)
    ] + [F.struct(
        F.lit("macro").alias("cls"), F.col("a.macro_f1").alias("f1_with"),
        F.col("b.macro_f1").alias("f1_without"))])
    return sides.select(F.inline(lines)).withColumn(
        "difference", F.col("f1_with") - F.col("f1_without"))
