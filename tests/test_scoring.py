import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.network import (
    erf, initial_weights, logits, loss_and_gradient, parameter_count, softmax_rows, train_epochs,
)
from flowlens.functions.scalar import argmax_class, softmax
from flowlens.labels import CLASSES
from flowlens.operators.profile import FeatureStats
from flowlens.operators.scoring import (
    Model, class_probabilities, linear_probabilities, score_events, score_parity,
)
from flowlens.schemas import FLOW_EVENT

NAMES = tuple(f"f{i}" for i in range(10))
STATS = FeatureStats(NAMES, (0.0,) * 10, (1.0,) * 10)
ALERT_COLUMNS = [
    "event_id", "ts_event", "ts_scored", "latency_ms", "org_id", "device_id", "pred_class",
    "confidence", "probs", "is_attack", "true_label", "model_version",
]


def model(hidden=(16, 8), seed=1):
    dims = (10, *hidden, 8)
    return Model(dims, initial_weights(dims, seed), "smoke:test")


def events(spark, n=5):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", 1000 + i, "org-1" if i % 2 else None, f"dev-{i}",
             {k: float(v) for k, v in zip(NAMES, rng.normal(size=10))}, "Benign")
            for i in range(n)]
    return spark.createDataFrame(rows, FLOW_EVENT), rows


def test_parameter_count_of_the_published_network():
    assert parameter_count((46, 256, 128, 64, 8)) == 54600


def test_erf_is_close():
    x = np.linspace(-5, 5, 201)
    np.testing.assert_allclose(erf(x), [math.erf(v) for v in x], atol=2e-7)


def test_gradient_matches_finite_differences():
    dims = (4, 6, 5, 3)
    w = initial_weights(dims, 0) + 0.01
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    _, gradient = loss_and_gradient(w, dims, x, y)
    for i in rng.choice(len(w), 40, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-5
        slope = (loss_and_gradient(w + step, dims, x, y)[0]
                 - loss_and_gradient(w - step, dims, x, y)[0]) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=2e-5)


def test_zero_mu_is_plain_sgd_and_mu_pulls_back():
    dims = (10, 16, 8, 8)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 10)), rng.integers(0, 8, 200)
    w = initial_weights(dims, 5)
    plain, _ = train_epochs(w, dims, x, y, 2, 0.01, 64, seed=9)
    zero, _ = train_epochs(w, dims, x, y, 2, 0.01, 64, seed=9, mu=0.0, anchor=w)
    strong, _ = train_epochs(w, dims, x, y, 2, 0.01, 64, seed=9, mu=10.0)
    np.testing.assert_allclose(plain, zero, atol=1e-12)
    assert np.linalg.norm(strong - w) < np.linalg.norm(plain - w)


def test_training_lowers_the_loss():
    dims = (10, 16, 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 10))
    y = np.argmax(x[:, :3], axis=1)
    w = initial_weights(dims, 5)
    trained, _ = train_epochs(w, dims, x, y, 30, 0.1, 32, seed=1)
    assert loss_and_gradient(trained, dims, x, y)[0] < 0.5 * loss_and_gradient(w, dims, x, y)[0]


def test_alerts_have_the_contract(spark):
    df, rows = events(spark)
    m = model()
    scored = score_events(df, m, STATS, ts_scored=5000)
    assert scored.columns == ALERT_COLUMNS
    got = {r["event_id"]: r for r in scored.collect()}
    assert len(got) == 5
    x = np.array([[r[4][k] for k in NAMES] for r in rows])
    x = (np.sign(x) * np.log1p(np.abs(x))).astype(np.float32).astype(float)
    p = softmax_rows(logits(m.weights, m.dims, x))
    for i, r in enumerate(rows):
        alert = got[r[0]]
        assert alert["pred_class"] == CLASSES[p[i].argmax()]
        assert alert["confidence"] == pytest.approx(p[i].max())
        assert set(alert["probs"]) == set(CLASSES)
        assert sum(alert["probs"].values()) == pytest.approx(1.0)
        assert alert["is_attack"] == (alert["pred_class"] != "Benign")
        assert alert["latency_ms"] == 5000 - r[1]
        assert alert["org_id"] == (r[2] or "default")
        assert alert["model_version"] == "smoke:test"


def test_empty_input_gives_empty_output(spark):
    df, _ = events(spark)
    scored = score_events(df.limit(0), model(), STATS)
    assert scored.columns == ALERT_COLUMNS
    assert scored.count() == 0


def test_absent_features_count_as_zero_and_order_does_not_matter(spark):
    m = model()
    rows = [("a", 1, "o", "d", {"f1": 1.0, "f0": 2.0}, None),
            ("b", 1, "o", "d", {k: {"f0": 2.0, "f1": 1.0}.get(k, 0.0) for k in NAMES}, None),
            ("c", 1, "o", "d", {k: {"f0": 2.0, "f1": 1.0}.get(k) for k in NAMES}, None)]
    scored = score_events(spark.createDataFrame(rows, FLOW_EVENT), m, STATS).collect()
    assert len({r["confidence"] for r in scored}) == 1


def test_wrong_width_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0] * 10,)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="do not all have 10 elements"):
        df.select(class_probabilities("v", model())).collect()
    with pytest.raises(ValueError):
        Model((10, 8), np.zeros(3))


def test_scorer_runs_once_per_row(spark):
    df, _ = events(spark)
    plan = score_events(df, model(), STATS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_linear_model_equals_column_expressions(spark):
    m = model(hidden=())
    df = spark.createDataFrame([([float(i + j) for j in range(10)],) for i in range(4)],
                               "v array<double>")
    w = m.weights[:80].reshape(8, 10)
    z = F.array(*[
        sum((F.get("v", F.lit(j)) * float(w[c, j]) for j in range(10)), F.lit(float(m.weights[80 + c])))
        for c in range(8)])
    rows = df.select(class_probabilities("v", m).alias("a"), softmax(z).alias("b")).collect()
    for r in rows:
        np.testing.assert_allclose(r["a"], r["b"], atol=1e-12)


def test_linear_scorer_needs_no_python(spark):
    m = Model((3, 4), initial_weights((3, 4), 1), "m")
    df = spark.createDataFrame([([1.0, -2.0, 0.5],)], "v array<double>").select(
        linear_probabilities("v", m).alias("a"), class_probabilities("v", m).alias("b"))
    row = df.first()
    np.testing.assert_allclose(row["a"], row["b"], atol=1e-12)
    assert "Arrow" not in df.select("a")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        linear_probabilities("v", Model((3, 2, 4), initial_weights((3, 2, 4), 1), "m"))


def test_first_class_wins_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(argmax_class("p", ["x", "y", "z"])).first()[0] == "y"


def test_parity(spark):
    a = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], "id int, probs array<double>")
    b = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.10005, 0.89995])], "id int, probs array<double>")
    row = score_parity(a, b, "id").first()
    assert row["rows"] == 2 and row["within"]
    assert row["max_abs_diff"] == pytest.approx(5e-5)
    assert not score_parity(a, b, "id", tolerance=1e-6).first()["within"]


def test_parity_fails_on_missing_rows_and_unequal_vectors(spark):
    schema = "id int, probs array<double>"
    a = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9]), (4, None)], schema)
    b = spark.createDataFrame([(1, [0.5]), (3, [0.1, 0.9]), (4, [float("nan")])], schema)
    row = score_parity(a, b, "id").first()
    assert (row["rows"], row["unmatched"], row["mismatched"], row["max_abs_diff"], row["within"]) == (
        2, 2, 2, None, False)
    same = a.filter("id <> 4")
    assert score_parity(same, same, "id").first()["within"]
