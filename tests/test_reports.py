import pytest
from pyspark.sql import Row

from flowlens.labels import CLASSES
from flowlens.operators import reports as rp
from flowlens.schemas import RUN_DOCUMENT

# Published scores of three centralised and two federated runs.
CENTRAL = [("mlp_no_iat_smoke", "mlp", 0.11076528298648014, 0.123),
           ("mlp_smoke", "mlp", 0.10009288942185252, 0.122125),
           ("xgb_smoke", "xgb", 0.12569757829582529, 0.127625)]
ROUND_F1 = [0.06977385697609312, 0.070359842830315, 0.07256594471558739]
CLIENT_F1S = [0.0517063965987438, 0.08055731796002366, 0.03671544170466459, 0.08868930765836106]
TEST_F1, TEST_ACC = 0.06842374383513405, 0.122625


def document(**fields):
    return tuple(fields.get(name) for name in RUN_DOCUMENT.names)


def metrics(f1, accuracy, per_class=None):
    return (accuracy, f1, f1, per_class)


def history(f1s, std=0.02108666968533012):
    return [(i + 1, f1, f1 + 0.05, 0.06, std, 0.03, 2.1, CLIENT_F1S, 1.04, 0.3, [0, 1, 2, 3])
            for i, f1 in enumerate(f1s)]


@pytest.fixture(scope="module")
def central(spark):
    per_class = {c: (0.0, 0.0, 0.1 * i, 1000) for i, c in enumerate(CLASSES)}
    return spark.createDataFrame([
        document(run_name=n, model_type=m, profile="laptop", train_rows=40000,
                 test_metrics=metrics(f1, acc, per_class))
        for n, m, f1, acc in CENTRAL], RUN_DOCUMENT)


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([
        document(run_name=name, method=method, alpha="0.5", mu=mu, seed=42, profile="laptop",
                 num_clients=4, rounds=3, test_metrics=metrics(TEST_F1, TEST_ACC), history=history(ROUND_F1))
        for name, method, mu in (("fl_fedavg_a0.5_s42", "fedavg", 0.0),
                                 ("fl_fedprox_a0.5_mu0.01_s42", "fedprox", 0.01))], RUN_DOCUMENT)


def test_published_main_table(central, runs):
    rows = sorted(
        (r["method"], r["alpha"], f"{r['macro_f1']:.4f}", f"{r['accuracy']:.4f}",
         "-" if r["client_f1_std"] is None else f"{r['client_f1_std']:.4f}",
         r["rounds_to_target"], "-" if r["mb_communicated"] is None else f"{r['mb_communicated']:.2f}",
         r["profile"], r["std_macro_f1"])
        for r in rp.main_results(central, runs).collect())
    assert rows == [
        ("FEDAVG", "0.5", "0.0684", "0.1226", "0.0211", None, "3.12", "laptop", None),
        ("FedProx (mu=0.01)", "0.5", "0.0684", "0.1226", "0.0211", None, "3.12", "laptop", None),
        ("MLP", "-", "0.1001", "0.1221", "-", None, "-", "laptop", None),
        ("MLP", "-", "0.1108", "0.1230", "-", None, "-", "laptop", None),
        ("XGB", "-", "0.1257", "0.1276", "-", None, "-", "laptop", None),
    ]


def test_rounds_to_target_average_over_runs_that_reached_it(spark, central):
    target = 0.95 * 0.12569757829582529
    runs = spark.createDataFrame([
        document(run_name=f"r{i}", method="fedavg", alpha="iid", mu=0.0, profile="laptop",
                 test_metrics=metrics(f1, f1), history=history(f1s) if f1s else None)
        for i, (f1, f1s) in enumerate([
            (0.1, [0.0, target, 0.0]), (0.2, [0.0, 0.0, 0.0, target + 0.1]), (0.3, [0.0]), (0.4, None)])
    ], RUN_DOCUMENT)
    row = rp.main_results(central, runs).filter("method = 'FEDAVG'").first()
    assert row["rounds_to_target"] == 3.0
    assert row["runs"] == 4
    assert row["std_macro_f1"] == pytest.approx(0.1118033988749895)
    assert row["mb_communicated"] == pytest.approx(1.04 * (3 + 4 + 1 + 0) / 4)


def test_best_run_is_the_first_of_equals(runs):
    best = rp.select_best(runs, "laptop").collect()
    assert [r["run_name"] for r in best] == ["fl_fedavg_a0.5_s42"]
    assert best[0]["final_val_f1"] == ROUND_F1[-1]
    assert rp.select_best(runs, "lab").count() == 0


def test_profile_preference(spark, runs):
    smoke = rp.prefer_profile(runs, "lab")
    assert smoke.count() == 2 and smoke.first()["smoke_only"] is True
    one_lab = runs.unionByName(spark.createDataFrame(
        [document(run_name="big", profile="lab")], RUN_DOCUMENT))
    lab = rp.prefer_profile(one_lab, "lab").collect()
    assert [(r["run_name"], r["smoke_only"]) for r in lab] == [("big", False)]


def test_convergence_and_fairness(runs):
    rows = rp.convergence(runs).filter("method = 'fedavg'").orderBy("round").collect()
    assert [r["macro_f1"] for r in rows] == ROUND_F1
    row = rp.client_fairness(runs).first()
    assert (row["clients"], row["min"], row["max"]) == (4, min(CLIENT_F1S), max(CLIENT_F1S))
    assert row["median"] == pytest.approx((CLIENT_F1S[0] + CLIENT_F1S[1]) / 2)
    assert rp.client_f1_series(runs).count() == 8


def test_communication(runs, central):
    total = rp.communication_summary(runs.unionByName(central)).first()
    assert total["total_mb"] == pytest.approx(6.24)
    assert total["rounds"] == 6
    assert total["mb_per_round"] == pytest.approx(1.04)
    nothing = rp.communication_summary(runs.limit(0)).first()
    assert (nothing["total_mb"], nothing["rounds"], nothing["mb_per_round"]) == (0.0, 0, 0.0)
    by_run = {r["run_name"]: r["rounds"] for r in rp.communication_summary(central, "run").collect()}
    assert by_run["xgb_smoke"] == 0


def test_per_class_matrix_skips_runs_without_classes(central, runs):
    rows = rp.per_class_matrix(central.unionByName(runs)).collect()
    assert len(rows) == 3
    assert rows[0]["BruteForce"] == pytest.approx(0.7)


def test_ablation(central, runs):
    rows = {r["cls"]: r for r in rp.ablation_compare(central).collect()}
    assert rows["macro"]["f1_with"] == CENTRAL[1][2]
    assert rows["macro"]["f1_without"] == CENTRAL[0][2]
    assert len(rows) == 9
    assert rp.ablation_compare(central.filter("run_name = 'xgb_smoke'")).count() == 0


def test_documents_and_flat_results_in_one_table(spark, central):
    flat = spark.createDataFrame(
        [Row(run_name="fl", method="fedavg", test_macro_f1=0.5, test_accuracy=0.6, num_clients=4)]
    ).selectExpr("run_name", "method", "test_macro_f1", "test_accuracy", "int(num_clients) num_clients")
    rows = {r["run"]: r for r in rp.results_table(rp.experiment_rows(central, flat)).collect()}
    assert len(rows) == 4
    assert (rows["fl"]["type"], rows["fl"]["macro_f1"], rows["fl"]["rows"]) == ("fedavg", 0.5, 4)
    assert (rows["xgb_smoke"]["type"], rows["xgb_smoke"]["rows"]) == ("xgb", 40000)
    assert rp.run_detail(central, "xgb_smoke").count() == 1
    assert rp.run_summary(central).first()["macro_f1"] == CENTRAL[0][2]
