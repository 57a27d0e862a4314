"""Physical plans: what must not happen on a large cluster."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from flowlens.labels import CLASSES
from flowlens.operators.alerts import live_summary
from flowlens.operators.clean import deduplicate, map_labels
from flowlens.operators.profile import fit_feature_stats
from flowlens.operators.ranking import assign_intervals, hash_pair, ordered_rows, stable_rank
from flowlens.operators.reports import main_results, per_class_matrix
from flowlens.operators.split import stratified_split
from flowlens.plans.fixtures import (
    LINE_FEATURES, LINE_KEYS, alerts, centralized_runs, federated_runs, line_flows, run_documents, table,
)
from flowlens.plans.queries import QUERIES
from flowlens.session import held_settings, wide_shuffle
from flowlens.sources.flows import flow_csv_bytes
from flowlens.sources.sinks import write_partitioned
from flowlens.streaming.events import parse_flows, window_metrics

SF_DIR = "/root/testdata/sf0.001"
# Queries that only plan when called; the others run jobs of their own.
LAZY = [
    "replay_events", "pending_work", "finite_rows", "dedup_global", "dedup_per_file",
    "label_mapping", "clean_flows", "class_counts", "feature_summary", "feature_stats",
    "stable_rank", "confusion_matrix", "confusion_pivot", "classification_metrics", "class_report",
    "score_vectors", "score_events", "score_parity", "parse_flows", "dead_letters",
    "window_metrics", "latest_alerts", "org_counts", "live_summary", "delivery_report",
    "federated_average", "round_statistics", "main_results", "f1_by_alpha", "select_best",
    "convergence", "client_fairness", "communication_total", "communication_by_run",
    "per_class_matrix", "ablation_compare", "prefer_profile", "experiment_rows", "results_table",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|round|Single)", plan(df)))


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_products(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", LAZY)
def test_no_window_over_everything(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for match in re.finditer(r"Window \[.*", text):
        below = text[match.end():].split("\n")[1:3]
        assert not any("SinglePartition" in line for line in below)


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan(
        window_metrics(alerts(spark, SF_DIR)))
    stats = plan(fit_feature_stats(line_flows(spark, SF_DIR), LINE_FEATURES))
    assert "l_orderkey" not in stats.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    attacks = alerts(spark, SF_DIR).filter("true_label = 'purchase'")
    assert "EqualTo(event_type,purchase)" in plan(attacks)


def test_label_mapping_shuffles_nothing(spark):
    df = table(spark, SF_DIR, "events").select(F.col("event_type").alias("label"))
    assert shuffles(map_labels(df, on_unmapped="null")) == 0


def test_cuts_by_rank_do_not_shuffle_the_rows(spark):
    lines = line_flows(spark, SF_DIR)
    assert shuffles(stratified_split(lines, "label_8", LINE_KEYS)) == 0
    assert shuffles(assign_intervals(
        lines, [("A", 0, 10, 1)], "label_8", "int", "x", LINE_KEYS)) == 0


def test_ranking_shuffles_the_rows_once(spark):
    lines = line_flows(spark, SF_DIR)
    text = plan(ordered_rows(lines, "label_8", hash_pair(LINE_KEYS, 42)))
    wide = [line for line in text.split("\n") if "Exchange" in line and "BroadcastExchange" not in line]
    # By ranges of (class, hash, row), never by class alone.
    assert len(wide) == 1 and "rangepartitioning(_g#" in wide[0] and "_copy#" in wide[0]
    assert shuffles(stable_rank(lines, "label_8", LINE_KEYS)) <= 1


def test_deduplication_merges_copies_before_the_shuffle(spark):
    df = spark.range(10).select(
        F.lit(1.0).alias("a"), F.lit("x").alias("label"), F.lit("f").alias("source_file"))
    text = plan(deduplicate(df))
    assert text.count("Aggregate") == 2 and "partial_min" in text


def test_window_metrics_aggregate_before_the_shuffle(spark):
    text = plan(window_metrics(alerts(spark, SF_DIR), CLASSES))
    assert "partial_count" in text and "SortAggregate" not in text
    assert shuffles(window_metrics(alerts(spark, SF_DIR), CLASSES)) == 1


def test_json_is_parsed_once(spark):
    flows, _ = parse_flows(spark.createDataFrame([("{}",)], "value string"))
    assert plan(flows).count("from_json") == 1


def test_live_summary_scans_counts_and_latencies_once_each(spark):
    df = table(spark, SF_DIR, "events").select(
        F.col("event_id").cast("string"), F.lit("o").alias("org_id"), F.lit("Web").alias("pred_class"),
        F.lit(True).alias("is_attack"), F.col("user_id").alias("ts_scored"),
        F.col("value").alias("latency_ms"))
    assert plan(live_summary(df, 10)).count("FileScan") == 2


def test_per_run_reports_stay_inside_the_row(spark):
    assert shuffles(per_class_matrix(run_documents(spark, SF_DIR))) == 0
    # One shuffle of pre-aggregated groups, one for the scalar target.
    main = main_results(centralized_runs(spark, SF_DIR), federated_runs(spark, SF_DIR))
    assert shuffles(main) <= 2


def test_partitions_follow_the_text_and_settings_come_back(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("Label,x\n" + "A,1\n" * 50)
    (folder / "b.csv").mkdir()
    (folder / "b.csv" / "part-0").write_text("Label,x\nA,2\n")
    assert flow_csv_bytes(spark, str(folder)) == 8 + 200 + 12
    assert flow_csv_bytes(spark, str(folder), 1) == 208
    few, many = wide_shuffle(spark, 220), wide_shuffle(spark, 10**10)
    name = "spark.sql.shuffle.partitions"
    assert (few[name], many[name]) == ("8", "313")
    with pytest.raises(KeyError), held_settings(spark, many):
        assert spark.conf.get(name) == "313"
        raise KeyError
    assert spark.conf.get(name) == "8"


def test_a_partitioned_write_sorts_no_rows(spark, tmp_path, monkeypatch):
    seen = []
    save = DataFrameWriter.parquet

    def watched(writer, path, **options):
        seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return save(writer, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    rows = spark.range(100).select("id", F.concat(F.lit("c"), F.col("id") % 70).alias("label_8"))
    write_partitioned(rows, str(tmp_path / "t"))
    assert seen == ["64"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in back.select("id", "label_8").collect()} == {(i, f"c{i % 70}") for i in range(100)}
