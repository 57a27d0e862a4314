import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.functions.scalar import try_numeric
from flowlens.operators.profile import fit_feature_stats
from flowlens.plans.etl import STAGES, run_stages, split_table
from flowlens.schemas import PARTITION_DOCUMENT
from flowlens.sources.flows import (
    discover_flow_schema, load_feature_stats, read_flow_csv, snake_case, snake_case_columns,
    to_flow_events,
)
from flowlens.sources.runs import read_result_csv, read_run_documents
from flowlens.sources.sinks import append_results, pending_keys, write_splits, write_table


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(text)


def test_snake_case():
    assert [snake_case(n) for n in (
        "Flow Duration", " IAT ", "ackFlagNumber", "Protocol Type", "a__b", "HTTP", "Tot sum")] == [
        "flow_duration", "iat", "ack_flag_number", "protocol_type", "a_b", "http", "tot_sum"]


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError, match="a_b"):
        snake_case_columns(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))


def test_csv_scan(spark, tmp_path):
    put(tmp_path, "b.csv", "Flow Duration,IAT,Label\n1,Infinity,XSS\n2,-Infinity,XSS\n3,Inf,XSS\n")
    put(tmp_path, "a.csv", "Flow Duration,IAT,Label\n4,inf,XSS\n5,NaN,XSS\n6,,XSS\n7,text,XSS\n8,1\n9,1,XSS,9\n")
    df = read_flow_csv(spark, str(tmp_path))
    assert df.columns == ["flow_duration", "iat", "label", "source_file"]
    rows = df.collect()
    assert sorted(r["flow_duration"] for r in rows) == [1.0, 2.0, 3.0, 5.0, 6.0]
    assert {r["source_file"].rsplit("/", 1)[1] for r in rows} == {"a.csv", "b.csv"}
    first = read_flow_csv(spark, str(tmp_path), max_files=1).collect()
    assert sorted(r["flow_duration"] for r in first) == [5.0, 6.0]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_flow_csv(spark, str(tmp_path))
    put(tmp_path, "a.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError, match="no label column"):
        discover_flow_schema(spark, str(tmp_path / "a.csv"))


def test_stats_with_dropped_features(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0)], "iat double, rate double")
    write_table(fit_feature_stats(df), str(tmp_path / "stats"))
    assert [r["feature"] for r in load_feature_stats(
        spark, str(tmp_path / "stats"), ["iat"]).collect()] == ["rate"]


def test_documents_skip_bad_files(spark, tmp_path):
    put(tmp_path, "fl_a.json", json.dumps({
        "method": "fedavg", "alpha": 0.5, "test_metrics": {
            "macro_f1": 0.5, "per_class": {"Web": {"f1": 0.25, "support": 3}}},
        "history": [{"round": 1, "client_f1s": [0.1, 0.2]}]}, indent=2))
    put(tmp_path, "fl_b.json", json.dumps({"run_name": "named", "alpha": "iid"}))
    put(tmp_path, "fl_bad.json", "{ not json")
    rows = {r["run_name"]: r for r in read_run_documents(spark, f"{tmp_path}/fl_*.json").collect()}
    assert set(rows) == {"fl_a", "named"}
    assert rows["fl_a"]["alpha"] == "0.5"
    assert rows["fl_a"]["test_metrics"]["per_class"]["Web"]["f1"] == 0.25
    assert rows["fl_a"]["history"][0]["client_f1s"] == [0.1, 0.2]
    assert rows["named"]["alpha"] == "iid"


def test_partition_documents(spark, tmp_path):
    put(tmp_path, "partition_x.json", json.dumps(
        {"name": "x", "alpha": 0.5, "client_sizes": [3, 4], "class_distribution": [[1, 2], [4, 0]]}))
    row = read_run_documents(spark, f"{tmp_path}/partition_*.json", PARTITION_DOCUMENT).first()
    assert row["class_distribution"] == [[1, 2], [4, 0]]


def test_result_csv(spark, tmp_path):
    put(tmp_path, "r.csv", "run_name,mu,seed\na,0.01,42\nb,none,7\n")
    rows = read_result_csv(spark, str(tmp_path / "r.csv"), ["mu", "seed"]).collect()
    assert [tuple(r) for r in rows] == [("a", 0.01, 42.0), ("b", None, 7.0)]
    assert spark.range(1).select(try_numeric(F.lit("x1"))).first()[0] is None


def test_replay_identity(spark):
    df = spark.createDataFrame([(i, 1.0, "Web" if i % 2 else "Benign") for i in range(40)],
                               "i bigint, a double, label_8 string")
    rows = {int(r["event_id"]): r for r in to_flow_events(df, "i", ["a"], F.lit(7)).collect()}
    assert (rows[9]["org_id"], rows[9]["device_id"]) == ("org-2", "org-2-dev-1")
    assert (rows[0]["org_id"], rows[0]["device_id"]) == ("org-1", "org-1-dev-1")
    assert rows[3]["features"] == {"a": 1.0} and rows[3]["true_label"] == "Web"
    assert to_flow_events(df, "i", ["a"], F.lit(7), only_class="Benign").count() == 20


def test_pending_and_append(spark, tmp_path):
    requested = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "m string, s int")
    done = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9), (None, 3)], "m string, s int")
    assert [tuple(r) for r in pending_keys(requested, done, ["m", "s"]).collect()] == [("b", 2)]
    append_results(done, str(tmp_path / "t"))
    append_results(done, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_split_files(spark, tmp_path):
    df = spark.range(100).select(
        "id", F.when(F.col("id") < 10, "stream").otherwise("train").alias("split")).repartition(6)
    path = str(tmp_path / "s")
    assert write_splits(df, path, stream_files=2) == {"stream": 10, "train": 90}
    files = [f for f in os.listdir(f"{path}_stream") if f.endswith(".parquet")]
    assert 1 <= len(files) <= 2
    assert spark.read.parquet(f"{path}_stream").count() == 10


def test_stages_resume_and_force(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    lines = "\n".join(f"{i},{i % 7},{'XSS' if i % 3 else 'BenignTraffic'}" for i in range(600))
    put(raw, "a.csv", f"Flow Duration,Rate,Label\n{lines}\n5,inf,XSS\n1,1,\n5,5,XSS\nx,y,XSS\n")
    assert run_stages(spark, str(raw), out) == dict.fromkeys(STAGES, "done")
    counts = spark.read.parquet(f"{out}/stage_counts").first()
    assert (counts["raw"], counts["malformed"]) == (604, 2)  # "inf" is no number to the parser
    assert (counts["parsed"], counts["clean"]) == (602, 600)
    assert sum(split_table(spark, out, n).count() for n in ("stream", "train", "val", "test")) == 600
    assert {r["feature"] for r in spark.read.parquet(f"{out}/feature_stats").collect()} == {
        "flow_duration", "rate"}
    assert run_stages(spark, str(raw), out) == dict.fromkeys(STAGES, "skipped")
    plan = split_table(spark, out, "train").select("row_key", "label_8")
    assert plan.columns == ["row_key", "label_8"]
    again = run_stages(spark, str(raw), out, force=["profile"], rebalance=True)
    assert again == {**dict.fromkeys(STAGES, "skipped"), "profile": "done"}
    with pytest.raises(ValueError):
        run_stages(spark, str(raw), out, force=["deploy"])


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    put(tmp_path, "a.csv", "Rate,IAT,Label\n1,2,X\n")
    put(tmp_path, "b.csv", "IAT,Rate,Label\n20,10,Y\n")
    rows = {r["label"]: (r["rate"], r["iat"]) for r in read_flow_csv(spark, str(tmp_path)).collect()}
    assert rows == {"X": (1.0, 2.0), "Y": (10.0, 20.0)}
    put(tmp_path, "c.csv", "IAT,Label\n1,Z\n")
    with pytest.raises(ValueError, match="rate"):
        read_flow_csv(spark, str(tmp_path))


def test_moved_files_keep_their_splits(spark, tmp_path):
    lines = "\n".join(f"{i},{i % 7},{'XSS' if i % 3 else 'BenignTraffic'}" for i in range(300))
    keys = []
    for name in ("one", "two"):
        put(tmp_path / name, f"{name}.csv", f"Flow Duration,Rate,Label\n{lines}\n")
        run_stages(spark, str(tmp_path / name), str(tmp_path / f"out-{name}"))
        rows = split_table(spark, str(tmp_path / f"out-{name}"), "train").select("row_key").collect()
        keys.append({r["row_key"] for r in rows})
    assert keys[0] == keys[1] and keys[0]
