import math

import pytest
from pyspark.sql import functions as F

from flowlens.labels import CLASSES, DEFAULT_TAXONOMY
from flowlens.operators.clean import (
    StageCounter, clean, deduplicate, drop_non_finite, feature_columns, map_labels,
)


def mapped(spark, labels, **options):
    df = spark.createDataFrame([(l,) for l in labels], "label string")
    return {r["label_34"]: r["label_8"] for r in map_labels(df, **options).collect()}


def test_taxonomy_size():
    assert len(CLASSES) == 8
    assert len(DEFAULT_TAXONOMY.explicit) == 34
    assert set(DEFAULT_TAXONOMY.explicit.values()) == set(CLASSES)


def test_known_labels(spark):
    expected = {
        "BenignTraffic": "Benign", "DDoS-SYN_Flood": "DDoS", "DoS-UDP_Flood": "DoS",
        "VulnerabilityScan": "Recon", "DNS_Spoofing": "Spoofing", "XSS": "Web",
        "DictionaryBruteForce": "BruteForce", "Mirai-udpplain": "Mirai",
    }
    assert mapped(spark, expected) == expected


def test_prefix_fallback(spark):
    assert mapped(spark, ["DDoS-NewVariant", "DoS-Other"]) == {
        "DDoS-NewVariant": "DDoS", "DoS-Other": "DoS"}


def test_unknown_label(spark):
    with pytest.raises(Exception, match="Unmapped label: CompletelyUnknownAttack"):
        mapped(spark, ["XSS", "CompletelyUnknownAttack"])
    assert mapped(spark, ["XSS", "What"], on_unmapped="null") == {"XSS": "Web", "What": None}
    assert mapped(spark, ["XSS", "What"], on_unmapped="drop") == {"XSS": "Web"}
    with pytest.raises(ValueError):
        mapped(spark, ["XSS"], on_unmapped="guess")


def test_finite_rows_only(spark):
    rows = [
        (1.0, 2.0, "XSS"), (None, 2.0, "XSS"), (math.nan, 2.0, "XSS"), (math.inf, 2.0, "XSS"),
        (1.0, -math.inf, "XSS"), (1.0, 2.0, None), (1.0, 2.0, "  "), (-0.0, 0.0, " x "),
    ]
    df = spark.createDataFrame(rows, "b double, a double, label string")
    assert feature_columns(df) == ["a", "b"]
    assert sorted(r["label"] for r in drop_non_finite(df).collect()) == [" x ", "XSS"]


def test_deduplicate_scopes(spark):
    rows = [(1.0, "XSS", "f2"), (1.0, "XSS", "f1"), (1.0, "XSS", "f1"), (0.0, "XSS", "f1"),
            (-0.0, "XSS", "f1")]
    df = spark.createDataFrame(rows, "a double, label string, source_file string")
    kept = {(r["a"] + 0.0, r["source_file"]) for r in deduplicate(df).collect()}
    assert kept == {(1.0, "f1"), (0.0, "f1")}
    assert deduplicate(df, "per_file").count() == 3
    assert deduplicate(df.drop("source_file")).count() == 2
    with pytest.raises(ValueError):
        deduplicate(df, "weekly")


def test_clean_chain_keeps_columns(spark):
    df = spark.createDataFrame(
        [(1.0, "XSS", "f"), (1.0, "XSS", "g"), (None, "XSS", "f")],
        "a double, label string, source_file string")
    rows = clean(df).collect()
    assert len(rows) == 1
    assert rows[0].asDict() == {
        "a": 1.0, "label_34": "XSS", "source_file": "f", "label_8": "Web"}


def test_stage_counts_ride_on_the_write(spark, tmp_path):
    counter = StageCounter()
    df = counter.watch(spark.range(100), "raw")
    counter.watch(df.filter(F.col("id") < 30), "kept").write.parquet(str(tmp_path / "out"))
    assert counter.counts() == {"raw": 100, "kept": 30}
    assert counter.loss("raw", "kept") == {"dropped": 70, "dropped_pct": 70.0}
