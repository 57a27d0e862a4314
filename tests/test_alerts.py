import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from flowlens.labels import CLASSES
from flowlens.operators.alerts import (
    delivery_report, latency_report, latest_alerts, live_summary, org_counts,
)
from flowlens.operators.quantiles import exact_percentiles, order_key, value_of_key

SCHEMA = ("event_id string, ts_event bigint, ts_scored bigint, latency_ms double, org_id string, "
          "device_id string, pred_class string, confidence double, is_attack boolean, true_label string")


def alerts(spark, n=700):
    rows = [(f"e{i:04d}", i, i * 200, float(i), f"org-{i % 3}", "d",
             CLASSES[i % 4], 0.12345, i % 4 != 0, None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_newest_first_with_filters(spark):
    df = alerts(spark)
    assert [r["event_id"] for r in latest_alerts(df, 2).collect()] == ["e0699", "e0698"]
    attacks = latest_alerts(df, 500, only_attacks=True, org_id="org-1").collect()
    assert attacks and all(r["is_attack"] and r["org_id"] == "org-1" for r in attacks)
    assert latest_alerts(df, 1, display=True).first()["confidence"] == 0.123
    for limit in (0, 501):
        with pytest.raises(ValueError):
            latest_alerts(df, limit)


def test_live_summary(spark):
    df = alerts(spark)
    as_of = 699 * 200
    got = {(r["section"], r["key"]): r["value"] for r in live_summary(df, as_of).collect()}
    recent = [i for i in range(700) if i * 200 > as_of - 60_000]
    assert got[("rates", "events_per_s")] == round(len(recent) / 60, 1)
    assert got[("rates", "threats_in_window")] == sum(i % 4 != 0 for i in recent)
    assert got[("totals", "alerts")] == 700
    assert {c: got[("by_class", c)] for c in CLASSES} == {
        c: 175.0 if i < 4 else 0.0 for i, c in enumerate(CLASSES)}
    assert got[("by_org", "org-0")] == 234
    newest = np.arange(200, 700)
    assert got[("latency", "p50_ms")] == round(np.percentile(newest, 50), 1)
    assert got[("latency", "p95_ms")] == pytest.approx(np.percentile(newest, 95), abs=0.051)


def test_live_summary_without_alerts(spark):
    got = {(r["section"], r["key"]): r["value"]
           for r in live_summary(alerts(spark).limit(0), 0).collect()}
    assert set(got.values()) == {0.0}
    assert ("latency", "p95_ms") in got and ("by_class", "BruteForce") in got


def test_org_counts_are_ordered(spark):
    assert [tuple(r) for r in org_counts(alerts(spark)).collect()] == [
        ("org-0", 234), ("org-1", 233), ("org-2", 233)]


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(s.lists(s.floats(-1e6, 1e6), min_size=1, max_size=400), s.sampled_from([(4, 1), (12, 20), (12, 20_000)]))
def test_percentiles_equal_numpy(spark, values, limits):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    got = {r["fraction"]: r["value"]
           for r in exact_percentiles(df, "v", [0.0, 0.5, 0.95, 0.99, 1.0], *limits).collect()}
    for f, v in got.items():
        assert v == pytest.approx(np.percentile(values, f * 100), rel=1e-9, abs=1e-6)
    assert len(got) == 5


def test_percentiles_with_one_hot_value(spark):
    values = [5.0] * 3000 + list(map(float, range(3000)))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = {r["fraction"]: r["value"]
           for r in exact_percentiles(df, "v", [0.5, 0.95, 0.99], 8, 100).collect()}
    for f, v in got.items():
        assert v == pytest.approx(np.percentile(values, f * 100))


def test_percentiles_hold_infinities_and_no_window(spark):
    values = [float("-inf"), -1.0, 2.0, float("inf"), float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    keys = df.filter("NOT isnan(v)").select(order_key(F.col("v")).alias("_k"))
    plan = keys.groupBy(F.shiftright("_k", 52)).count()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "partial_count" in plan
    got = [r["value"] for r in exact_percentiles(df, "v", [0.0, 0.25, 0.5, 1.0]).collect()]
    assert got == [float("-inf"), -1.0, 2.0, float("inf")]
    assert exact_percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_order_keys_are_ordered_and_turn_back(spark):
    edges = [5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, 0.1, 3.0,
             0.9999999999999999, 1.0000000000000002, 2.0**60, 2.0**-60, 8.0, 7.999999999999999, float("inf")]
    rng = np.random.default_rng(2)
    values = sorted({*edges, *(-v for v in edges), 0.0, *(rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist()})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()
    keys = [r["k"] for r in sorted(rows, key=lambda r: r["v"])]
    assert keys == sorted(set(keys)) and [value_of_key(k) for k in keys] == values
    assert spark.sql("SELECT -0.0D AS v").select(order_key(F.col("v"))).first()[0] == 0


def test_latency_report(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "latency_ms double")
    got = {r["statistic"]: r["value"] for r in latency_report(df).collect()}
    assert got == {"p50": 3.0, "p95": 4.8, "p99": 5.0, "mean": 3.0, "min": 1.0, "max": 5.0}
    assert latency_report(df.limit(0)).count() == 0


def test_delivery_counts_repeated_alerts(spark):
    sent = spark.createDataFrame([(f"e{i}",) for i in range(10)], "event_id string")
    received = spark.createDataFrame([("e1",), ("e1",), ("e2",), ("other",)], "event_id string")
    row = delivery_report(received, sent, 2.0, 4.0).first().asDict()
    assert row == {"events_sent": 10, "events_received": 3, "receive_rate": 30.0,
                   "send_throughput_eps": 5.0, "end_to_end_throughput_eps": 0.8}


def test_latency_report_ignores_nan(spark):
    some = alerts(spark, 100)
    nan = some.withColumn("latency_ms", F.lit(float("nan"))).unionByName(some)
    assert {tuple(r) for r in latency_report(nan).collect()} == {
        tuple(r) for r in latency_report(some).collect()}
