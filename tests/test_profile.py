import numpy as np
import pytest

from flowlens.operators.profile import (
    FeatureStats, class_counts, feature_summary, fit_feature_stats, standardize, training_frame,
)


def numpy_stats(x):
    logs = np.sign(x) * np.log1p(np.abs(x))
    std = logs.std(axis=0)
    return logs.mean(axis=0), np.where(std > 1e-10, std, 1.0)


def stats_of(spark, x):
    names = [f"f{i:02d}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], names)
    return df, FeatureStats.collect(fit_feature_stats(df))


def test_negative_values(spark):
    x = np.array([[-1000, .001], [-1, .01], [0, .1], [1, 1], [1000, 10]])
    _, stats = stats_of(spark, x)
    mean, std = numpy_stats(x)
    np.testing.assert_allclose(stats.mean, mean, atol=1e-12)
    np.testing.assert_allclose(stats.std, std, atol=1e-12)


def test_constant_feature_has_unit_scale(spark):
    _, stats = stats_of(spark, np.full((4, 1), 7.0))
    assert stats.std == (1.0,)


def test_random_table_and_standardisation(spark):
    x = np.random.RandomState(42).randn(2000, 20) * 100
    df, stats = stats_of(spark, x)
    mean, std = numpy_stats(x)
    np.testing.assert_allclose(stats.mean, mean, atol=1e-10)
    np.testing.assert_allclose(stats.std, std, atol=1e-10)
    scored = np.array(standardize(df, stats).collect())
    expected = (np.sign(x) * np.log1p(np.abs(x)) - mean) / std
    np.testing.assert_allclose(np.sort(scored, axis=0), np.sort(expected, axis=0), atol=1e-9)


def test_missing_features(spark):
    stats = FeatureStats(("a", "b"), (0.0, 1.0), (1.0, 2.0))
    df = spark.createDataFrame([(3.0,)], "a double")
    with pytest.raises(KeyError):
        standardize(df, stats)
    row = standardize(df, stats, missing="zero").first()
    assert row["a"] == pytest.approx(np.log(4.0))
    assert row["b"] == -0.5


def test_training_frame_drops_and_indexes(spark):
    stats = FeatureStats(("a", "iat"), (0.0, 0.0), (1.0, 1.0))
    df = spark.createDataFrame([(0.0, 5.0, "Web"), (0.0, 5.0, "Benign")],
                               "a double, iat double, label_8 string")
    rows = training_frame(df, stats, drop_features=["iat"]).collect()
    assert sorted((tuple(r["features"]), r["label"]) for r in rows) == [((0.0,), 0), ((0.0,), 6)]


def test_summary_counts_nan_and_null(spark):
    df = spark.createDataFrame(
        [(1.0, None), (3.0, 2.0), (2.0, float("nan"))], "a double, b double")
    a, b = feature_summary(df).orderBy("pos").collect()
    assert (a["feature"], a["min"], a["max"], a["mean"], a["nulls"]) == ("a", 1.0, 3.0, 2.0, 0)
    assert a["std"] == pytest.approx(np.std([1, 2, 3]))
    assert b["nulls"] == 2


def test_class_counts_order_and_fraction(spark):
    df = spark.createDataFrame([("Web", "XSS"), ("Web", "XSS"), ("Web", "SqlInjection"),
                                ("Benign", "BenignTraffic")], "label_8 string, label_34 string")
    rows = [tuple(r) for r in class_counts(df).collect()]
    assert rows == [
        ("label_34", "BenignTraffic", 1, 0.25), ("label_34", "SqlInjection", 1, 0.25),
        ("label_34", "XSS", 2, 0.5), ("label_8", "Benign", 1, 0.25), ("label_8", "Web", 3, 0.75)]


@pytest.mark.parametrize("label", ["Other", None])
def test_unknown_class_fails_the_job(spark, label):
    df = spark.createDataFrame([(1.0, "Web"), (2.0, label)], "a double, label_8 string")
    stats = FeatureStats(("a",), (0.0,), (1.0,))
    with pytest.raises(Exception, match="unknown class"):
        training_frame(df, stats).collect()


def test_summary_of_a_feature_named_like_a_statistic(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, float("nan"))], "x double, x__min double")
    rows = {r["feature"]: r for r in feature_summary(df).collect()}
    assert (rows["x"]["min"], rows["x"]["nulls"]) == (1.0, 1)
    assert (rows["x__min"]["min"], rows["x__min"]["nulls"]) == (5.0, 1)
