import pytest
from pyspark.sql import functions as F

from flowlens.labels import CLASSES
from flowlens.operators.evaluate import (
    class_report, classification_metrics, confusion_matrix, confusion_pivot,
)

# A published 8 x 8 confusion matrix and the scores published with it.
MATRIX = [
    [21, 86, 153, 328, 27, 140, 8, 237],
    [21, 64, 164, 347, 24, 155, 5, 220],
    [21, 71, 170, 330, 27, 136, 17, 228],
    [24, 82, 166, 309, 28, 137, 5, 249],
    [23, 77, 166, 327, 40, 134, 7, 226],
    [18, 90, 167, 332, 23, 143, 10, 217],
    [26, 74, 153, 349, 28, 156, 6, 208],
    [20, 84, 159, 323, 31, 150, 9, 224],
]
ACCURACY, MACRO_F1 = 0.122125, 0.10009288942185252
F1 = {
    "Benign": 0.03577512776831346, "DDoS": 0.07862407862407862, "DoS": 0.14795474325500435,
    "Mirai": 0.16954732510288065, "Recon": 0.06514657980456026, "Spoofing": 0.13296141329614133,
    "Web": 0.011246485473289597, "BruteForce": 0.1594873620505518,
}


@pytest.fixture(scope="module")
def published(spark):
    cells = [(t, p, n) for t, row in zip(CLASSES, MATRIX) for p, n in zip(CLASSES, row)]
    return spark.createDataFrame(cells, "truth string, prediction string, n int").select(
        "truth", "prediction", F.explode(F.sequence(F.lit(1), "n")))


def test_published_scores(published):
    row = classification_metrics(published, "truth", "prediction").first()
    assert row["rows"] == 8000
    assert row["accuracy"] == pytest.approx(ACCURACY, abs=1e-12)
    assert row["macro_f1"] == pytest.approx(MACRO_F1, abs=1e-12)
    assert row["weighted_f1"] == pytest.approx(MACRO_F1, abs=1e-12)


def test_published_class_scores(published):
    rows = {r["cls"]: r for r in class_report(published, "truth", "prediction", CLASSES).collect()}
    for name, f1 in F1.items():
        assert rows[name]["f1"] == pytest.approx(f1, abs=1e-12)
        assert rows[name]["support"] == 1000
    assert rows["Benign"]["precision"] == pytest.approx(0.1206896551724138)


def test_matrix_round_trip(published):
    cells = {(r["truth"], r["prediction"]): r["n"]
             for r in confusion_matrix(published, "truth", "prediction", CLASSES).collect()}
    assert [[cells[(t, p)] for p in CLASSES] for t in CLASSES] == MATRIX
    wide = {r["truth"]: r for r in confusion_pivot(published, "truth", "prediction", CLASSES).collect()}
    assert [[wide[t][p] for p in CLASSES] for t in CLASSES] == MATRIX


def test_macro_f1_ignores_classes_that_never_occur(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")],
                               "truth string, prediction string")
    row = classification_metrics(df, "truth", "prediction").first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 4 / 5) / 2)
    report = {r["cls"]: r for r in class_report(df, "truth", "prediction", ["a", "b", "c"]).collect()}
    assert (report["c"]["f1"], report["c"]["support"]) == (0.0, 0)


def test_zero_division(spark):
    df = spark.createDataFrame([("a", "b")], "truth string, prediction string")
    row = classification_metrics(df, "truth", "prediction").first()
    assert (row["accuracy"], row["macro_f1"], row["weighted_f1"]) == (0.0, 0.0, 0.0)
    empty = classification_metrics(df.limit(0), "truth", "prediction").first()
    assert (empty["accuracy"], empty["macro_f1"], empty["rows"]) == (0.0, 0.0, 0)
