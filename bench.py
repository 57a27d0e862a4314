"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice in the same session, as a service would; the second time counts,
the first stands beside it as ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from flowlens.operators.profile import (  # noqa: E402
    FeatureStats, fit_feature_stats, standardize,
)
from flowlens.operators.ranking import stable_rank  # noqa: E402
from flowlens.functions.network import initial_weights  # noqa: E402
from flowlens.operators.scoring import Model, class_probabilities, score_events  # noqa: E402
from flowlens.functions.scalar import columns_to_vector  # noqa: E402
from flowlens.operators.split import stratified_sample, stratified_split  # noqa: E402
from flowlens.plans.fixtures import (  # noqa: E402
    EVENT_MODEL_STATS, EVENT_TAXONOMY, LINE_FEATURES, LINE_KEYS, flow_events, line_flows,
    linear_model,
)
from flowlens.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "window_metrics", "label_mapping", "finite_rows", "dedup_global", "clean_flows", "class_counts",
    "feature_summary", "feature_stats", "classification_metrics", "score_vectors", "score_mlp", "parse_flows", "metrics_stream", "latest_alerts", "live_summary",
    "latency_report", "client_distribution", "federated_average", "fedavg_rounds", "main_results",
    "convergence",
]


def ranked(spark: SparkSession, sf_dir: str):
    return stable_rank(line_flows(spark, sf_dir), "label_8", LINE_KEYS)


def split(spark: SparkSession, sf_dir: str):
    return stratified_split(line_flows(spark, sf_dir), "label_8", LINE_KEYS)


def sampled(spark: SparkSession, sf_dir: str):
    return stratified_sample(line_flows(spark, sf_dir), 50_000, "label_8", LINE_KEYS)


def standardized(spark: SparkSession, sf_dir: str):
    flows = line_flows(spark, sf_dir)
    return standardize(flows, FeatureStats.collect(fit_feature_stats(flows, LINE_FEATURES)))


def scored(spark: SparkSession, sf_dir: str):
    model = linear_model(2, EVENT_TAXONOMY.classes)
    return score_events(flow_events(spark, sf_dir), model, EVENT_MODEL_STATS, ts_scored=0)


def scored_lines(spark: SparkSession, sf_dir: str):
    """Every line, twice, through a network of the published size (1.2 million rows at sf0.1)."""
    dims = (len(LINE_FEATURES), 256, 128, 64, 8)
    lines = line_flows(spark, sf_dir)
    return lines.unionByName(lines).select(class_probabilities(
        columns_to_vector(LINE_FEATURES), Model(dims, initial_weights(dims, 42)), single=True))


# Operators as users run them. The registered queries round every double and rank by md5,
# so that SQL can repeat them, and would mostly measure that.
NATIVE = {
    "stable_rank": ranked, "stratified_split": split, "stratified_sample": sampled,
    "standardized": standardized, "score_events": scored, "score_lines_mlp": scored_lines,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {**{name: QUERIES[name] for name in HEADLINE}, **NATIVE}
    cold: dict[str, float] = {}
    times: dict[str, float] = {}
    for _ in range(2):
        cold, times = times, {}
        for name, run in runs.items():
            begun = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
