import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.functions.network import initial_weights
from flowlens.labels import CLASSES
from flowlens.operators.profile import FeatureStats
from flowlens.operators.scoring import Model
from flowlens.schemas import ALERT_EVENT, FLOW_EVENT
from flowlens.plans import queries
from flowlens.streaming import events as st
from flowlens.streaming.events import (
    alerts_query, alerts_table_sink, decode_alerts, decode_metrics, encode_event, flow_stream, latest_per_window,
    metrics_query, parse_flows, run_scoring_stream, split_late_rows, validate_events, window_metrics,
    write_registry,
)
from flowlens.streaming.live import live_state_query, live_view, merge_alerts
from flowlens.streaming.logs import fold_log, metrics_log_sink, read_metrics_log

NOW = {"availableNow": True}
STATS = FeatureStats(("a", "b"), (0.0, 0.0), (1.0, 1.0))
ALERT_ROWS = "event_id string, ts_event bigint, org_id string, pred_class string, is_attack boolean"
METRICS = ("window_start bigint, window_end bigint, org_id string, total bigint, attacks bigint, "
           "by_class map<string,bigint>")


def model(seed, name):
    return Model((2, 4, 8), initial_weights((2, 4, 8), seed), name)


def write_lines(path, name, rows):
    os.makedirs(path, exist_ok=True)
    # Written aside first: a stream must not see half a file.
    aside = f"{path}/.{name}"
    with open(aside, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    os.rename(aside, f"{path}/{name}")


def flow(i, ts=1000, **extra):
    return {"event_id": f"e{i}", "ts_event": ts, "org_id": "org-1", "device_id": "d",
            "features": {"a": float(i), "b": 1.0}, **extra}


def test_broken_texts_become_dead_letters(spark):
    texts = [
        "nope", "{}", '{"ts_event": 1, "features": {}}', '{"event_id": "x", "ts_event": 1}',
        '{"event_id": "x", "ts_event": "soon", "features": {}}', None,
        '{"event_id": "ok", "ts_event": 5, "features": {"a": "NaN", "b": 2}}',
    ]
    flows, dead = parse_flows(spark.createDataFrame([(t,) for t in texts], "value string"))
    reasons = {r["value"]: r["reason"] for r in dead.collect()}
    assert reasons == {
        "nope": "malformed", "{}": "missing event_id", texts[2]: "missing event_id",
        texts[3]: "missing features", texts[4]: "malformed", None: "missing event_id"}
    row = flows.first()
    assert (row["event_id"], row["org_id"], row["device_id"], row["true_label"]) == (
        "ok", "default", "", None)
    assert row["features"]["a"] != row["features"]["a"]


def test_contract_defaults_and_required_fields(spark):
    df = spark.createDataFrame([("x", 0, None, None, {}, None), ("y", None, None, None, {}, None)],
                               FLOW_EVENT)
    valid, rejected = validate_events(df, "flow")
    assert valid.collect()[0].asDict() == {
        "event_id": "x", "ts_event": 0, "org_id": "default", "device_id": "", "features": {},
        "true_label": None}
    assert rejected.first()["reason"] == "missing ts_event"


def test_wire_format_drops_nulls_and_keeps_maps_as_text(spark):
    df = spark.createDataFrame([(
        "e", 1, 2, 1.0, "o", "d", "Web", 0.9, {"Web": 0.9, "Benign": 0.1}, True, None, "m")], ALERT_EVENT)
    wire = encode_event(df, "device_id").first()
    assert wire["key"] == "d"
    body = json.loads(wire["value"])
    assert "true_label" not in body
    assert json.loads(body["probs"]) == {"Web": 0.9, "Benign": 0.1}
    back = decode_alerts(encode_event(df, "device_id"))[0].first()
    assert back == df.first()
    nested = spark.createDataFrame([(json.dumps({**body, "probs": {"Web": 1.0}}),)], "value string")
    assert decode_alerts(nested)[0].first()["probs"] == {"Web": 1.0}
    bad = spark.createDataFrame([("nonsense",), ("[1]",), (None,), ('{"event_id": "x"}',)], "value string")
    good, rejected = decode_alerts(bad)
    assert good.count() == 0
    reasons = [r["reason"] for r in rejected.collect()]
    assert reasons.count("malformed") >= 2 and len(reasons) == 4


def test_repeated_classes_in_a_window(spark):
    df = spark.createDataFrame(
        [("a", 0, "o", "Web", True), ("b", 9999, "o", "Web", True), ("c", 1, "o", "Benign", False),
         ("d", 10000, "o", "Web", True)], ALERT_ROWS)
    first, second = window_metrics(df).orderBy("window_start").collect()
    assert (first["window_start"], first["window_end"], first["total"], first["attacks"]) == (0, 10000, 3, 2)
    assert first["by_class"] == {c: {"Web": 2, "Benign": 1}.get(c, 0) for c in CLASSES}
    assert second["total"] == 1


def alert(i, ts):
    return {"event_id": f"e{i}", "ts_event": ts, "org_id": "o", "pred_class": "Web", "is_attack": True}


def metrics_of(spark, source, log, state):
    stream = flow_stream(spark, "json", source, ALERT_ROWS, maxFilesPerTrigger="1")
    query = metrics_log_sink(window_metrics(stream), log, state, NOW)
    query.awaitTermination()
    return query


def test_late_rows_are_dropped_one_batch_after_the_watermark_moves(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for i, ts in enumerate((5000, 120_000, 121_000, 6000)):
        write_lines(source, f"{i}.json", [alert(i, ts)])
        os.utime(f"{source}/{i}.json", (1_000_000 + i, 1_000_000 + i))
    query = metrics_of(spark, source, log, state)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
                  for op in p["stateOperators"])
    assert dropped == 1
    final = read_metrics_log(spark, log)
    totals = {r["window_start"]: r["total"] for r in final.collect()}
    assert totals == {0: 1, 120_000: 2}


def test_restart_continues_without_repeating(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    write_lines(source, "0.json", [alert(0, 1000), alert(1, 2000)])
    metrics_of(spark, source, log, state)
    write_lines(source, "1.json", [alert(2, 3000)])
    metrics_of(spark, source, log, state)
    updates = spark.read.schema(METRICS).parquet(log)
    assert sorted(r["total"] for r in updates.collect()) == [2, 3]
    assert latest_per_window(updates).first()["total"] == 3


def test_scoring_stream_reloads_the_model(spark, tmp_path):
    base, source = str(tmp_path), str(tmp_path / "in")
    registry = f"{base}/registry"
    write_registry(spark, registry, model(1, "x"), STATS, "smoke", "first", "2024-01-01")

    def run():
        run_scoring_stream(
            flow_stream(spark, "text", source), registry, f"{base}/alerts", f"{base}/dead",
            f"{base}/state", NOW).awaitTermination()

    write_lines(source, "0.txt", [flow(0), "nope", flow(1)])
    run()
    write_registry(spark, registry, model(2, "x"), STATS, "production", "second", "2024-01-02")
    write_lines(source, "1.txt", [flow(2)])
    run()
    alerts = spark.read.parquet(f"{base}/alerts").collect()
    assert {r["event_id"]: r["model_version"] for r in alerts} == {
        "e0": "smoke:first", "e1": "smoke:first", "e2": "production:second"}
    assert [r["reason"] for r in spark.read.parquet(f"{base}/dead").collect()] == ["malformed"]


def test_alert_table_feeds_the_metrics(spark, tmp_path):
    """Scored once: the metrics stream reads what the alerts stream wrote."""
    source, table = str(tmp_path / "in"), str(tmp_path / "alerts")
    write_lines(source, "0.json", [flow(i, ts=1000 * i) for i in range(30)])
    flows = flow_stream(spark, "json", source, FLOW_EVENT)
    query = alerts_query(flows, model(1, "m"), STATS, str(tmp_path / "s1"),
                         fmt="parquet", path=table, trigger=NOW)
    query.awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 30
    stream = spark.readStream.schema(stored.schema).parquet(table)
    metrics_query(stream, str(tmp_path / "s2"), fmt="memory", trigger=NOW, mode="complete",
                  queryName="live_metrics").awaitTermination()
    got = {tuple(r)[:5] for r in spark.table("live_metrics").collect()}
    assert got == {tuple(r)[:5] for r in window_metrics(stored).collect()}
    assert sum(r[3] for r in got) == 30


def test_keyed_json_sink(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_lines(source, "0.json", [flow(i) for i in range(3)])
    alerts_query(flow_stream(spark, "json", source, FLOW_EVENT), model(1, "m"), STATS,
                 str(tmp_path / "s"), key="device_id", fmt="json", path=out,
                 trigger=NOW).awaitTermination()
    decoded, _ = decode_alerts(spark.read.json(out))
    assert decoded.filter(F.col("probs").isNotNull()).count() == 3


def test_alerts_consumed_into_a_table(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    write_lines(source, "0.json", [alert(i, i) for i in range(4)])
    stream = flow_stream(spark, "json", source, ALERT_ROWS)
    alerts_table_sink(stream, table, str(tmp_path / "s"), NOW).awaitTermination()
    alerts_table_sink(stream, table, str(tmp_path / "s"), NOW).awaitTermination()
    assert spark.read.parquet(table).count() == 4


def test_kafka_options_default_to_the_newest_offsets(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        flow_stream(spark, "kafka", subscribe="iot.flows", **{"kafka.bootstrap.servers": "none"})


def test_replayed_batch_is_counted_once(spark, tmp_path):
    """The metrics stream over the alerts table sees a replayed batch no second time."""
    source, base = str(tmp_path / "in"), str(tmp_path)
    write_registry(spark, f"{base}/registry", model(1, "x"), STATS, "smoke", "first", "2024-01-01")
    write_lines(source, "0.txt", [flow(i) for i in range(10)])

    def score():
        run_scoring_stream(
            flow_stream(spark, "text", source), f"{base}/registry", f"{base}/alerts", f"{base}/dead",
            f"{base}/state", NOW).awaitTermination()

    def total():
        stream = spark.readStream.schema(spark.read.parquet(f"{base}/alerts").schema).parquet(f"{base}/alerts")
        metrics_log_sink(window_metrics(stream), f"{base}/log", f"{base}/metrics", NOW).awaitTermination()
        return read_metrics_log(spark, f"{base}/log").agg(F.sum("total")).first()[0]

    score()
    before = total()
    os.remove(f"{base}/state/commits/0")  # the batch ran, but its commit was lost
    for name in os.listdir(f"{base}/state/commits"):
        if name.startswith(".0"):
            os.remove(f"{base}/state/commits/{name}")
    score()
    assert spark.read.parquet(f"{base}/alerts").count() == 10
    assert total() == before == 10


def test_metrics_messages(spark):
    body = {"window_start": 0, "window_end": 10, "org_id": "o", "total": 3, "attacks": 1}
    good = [{**body, "by_class": {"Web": 3}}, {**body, "by_class": json.dumps({"Web": 3})}]
    bad = ["nonsense", json.dumps({**body, "by_class": "no map"}), json.dumps(body), None]
    rows, rejected = decode_metrics(spark.createDataFrame(
        [(json.dumps(g),) for g in good] + [(b,) for b in bad], "value string"))
    assert [r["by_class"] for r in rows.collect()] == [{"Web": 3}] * 2
    assert rejected.count() == 4


def emission(spark, start, org, total):
    by_class = {c: 0 for c in CLASSES} | {"Web": total}
    return spark.createDataFrame([(start, start + 10_000, org, total, total, by_class)], METRICS)


def test_a_long_log_has_few_folders(spark, tmp_path):
    """Forty windows over three days, two emissions each, folded every fifth trigger."""
    log, expected, number = str(tmp_path / "log"), {}, 0
    for k in range(40):
        start = k * 6_000_000
        for total in (1, k + 2):
            emission(spark, start, "o", total).write.mode("overwrite").parquet(f"{log}/batch={number}")
            expected[start] = total
            if (number + 1) % 5 == 0:
                fold_log(spark, log, number)
                fold_log(spark, log, number)  # a repeated fold changes nothing
                names = os.listdir(log)
                assert sum(n.startswith("batch=") for n in names) <= 10
                assert sum(n.startswith("open=") for n in names) <= 2
                assert all(len(os.listdir(f"{log}/closed/{d}")) <= 2 for d in os.listdir(f"{log}/closed"))
            number += 1
    assert {r["window_start"]: r["total"] for r in read_metrics_log(spark, log).collect()} == expected
    assert sorted(os.listdir(f"{log}/closed")) == ["date=1970-01-01", "date=1970-01-02", "date=1970-01-03"]
    # A late change of a closed window reaches its day.
    emission(spark, 0, "o", 99).write.parquet(f"{log}/batch={number}")
    assert read_metrics_log(spark, log).filter("window_start = 0").first()["total"] == 99
    for n in range(number, number + 2):
        fold_log(spark, log, n)
    assert read_metrics_log(spark, log).filter("window_start = 0").first()["total"] == 99
    assert read_metrics_log(spark, str(tmp_path / "none")).count() == 0


def test_a_folded_log_survives_a_restart(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for part in range(3):
        for i in range(3):
            write_lines(source, f"{part}-{i}.json", [alert(10 * part + i, 20_000 * part + i)])
        stream = flow_stream(spark, "json", source, ALERT_ROWS, maxFilesPerTrigger="1")
        metrics_log_sink(window_metrics(stream), log, state, NOW, compact_every=2).awaitTermination()
    totals = {r["window_start"]: r["total"] for r in read_metrics_log(spark, log).collect()}
    assert totals == {0: 3, 20_000: 3, 40_000: 3}


def test_kept_and_late_rows_are_the_input(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path)
    # Windows of 10 s; with 30 s of patience the first window is let go at 40,000.
    for i, times in enumerate(([5000, 39_999], [9999, 40_000], [9999, 10_000, 40_001], [50_000, None])):
        write_lines(source, f"{i}.json", [alert(f"{i}-{t}", t) for t in times])
        os.utime(f"{source}/{i}.json", (1_000_000 + i, 1_000_000 + i))

    def run():
        stream = flow_stream(spark, "json", source, ALERT_ROWS, maxFilesPerTrigger="1")
        split_late_rows(stream, f"{base}/kept", f"{base}/late", f"{base}/s", trigger=NOW).awaitTermination()
        return (spark.read.parquet(f"{base}/kept").count(),
                [r["event_id"] for r in spark.read.parquet(f"{base}/late").collect()])

    assert run() == (8, ["e2-9999"])
    assert len(os.listdir(f"{base}/late/_clock")) <= 3
    write_lines(source, "9.json", [alert("new", 10_001), alert("old", 1)])
    kept, late = run()
    assert kept == 8 and sorted(late) == ["e2-9999", "enew", "eold"]


LIVE = ("event_id string, ts_event bigint, ts_scored bigint, latency_ms double, org_id string, "
        "device_id string, pred_class string, confidence double, is_attack boolean, true_label string")


def test_live_state_equals_the_batch_summary_after_each_batch(spark, tmp_path):
    from flowlens.operators.alerts import live_summary

    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = []
    for part in range(3):
        for i in range(120):
            k = 120 * part + i
            rows.append((f"e{k:04d}", k, 400 * k, None if k % 50 == 7 else float(k % 83), None if k % 31 == 0 else f"o{k % 3}",
                         "d", CLASSES[k % 4] if k % 9 else "other", 0.5, k % 4 != 0, None))
        new = spark.createDataFrame(rows[-120:] + ([("null", 1, None, 1.0, "o", "d", "Web", 0.1, True, None)] if not part else []), LIVE)
        new.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LIVE).parquet(source)
        live_state_query(stream, state, recent=100, slots=4, trigger=NOW).awaitTermination()
        for as_of in (rows[-1][2] // 1000 * 1000 + 1000, rows[-1][2] // 1000 * 1000 + 31_000):
            seen = spark.createDataFrame(rows, LIVE)
            expected = sorted(map(repr, map(tuple, live_summary(seen, as_of, recent=100).collect())))
            assert sorted(map(repr, map(tuple, live_view(spark, state, as_of, recent=100).collect()))) == expected
    with pytest.raises(ValueError, match="gone on"):
        live_view(spark, state, 5)


def test_live_state_is_bounded():
    import pandas as pd

    body = {"totals": [], "seconds": [], "newest": [], "clock": 0}
    for k in range(30):
        times = range(20_000 * k, 20_000 * k + 20_000, 100)
        body = merge_alerts(body, pd.DataFrame({
            "event_id": [f"e{t}" for t in times], "org_id": "o", "pred_class": "Web", "is_attack": True,
            "ts_scored": [float(t) for t in times], "latency_ms": 1.0}), 60, 50)
    assert len(body["seconds"]) <= 61 and len(body["newest"]) == 50 and body["totals"] == [["o", "Web", 6000]]
    assert body["newest"][0][0] == body["clock"] == 599_900


def test_arrivals_of_several_files_are_whole_batches(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.01"
    expected = {tuple(r) for r in queries.late_rows(spark, sf_dir).collect()}
    written = []
    monkeypatch.setattr(queries, "ARRIVAL_BYTES", 20_000)
    stream = st.flow_stream
    monkeypatch.setattr(st, "flow_stream", lambda *a, **k: written.append((a[2], k)) or stream(*a, **k))
    assert {tuple(r) for r in queries.late_rows(spark, sf_dir).collect()} == expected
    (path, options), = written
    assert options == {"maxFilesPerTrigger": "3"}
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 12
