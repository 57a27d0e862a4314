from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from flowlens.functions.network import first_state, initial_weights, row_order, train_epochs
from flowlens.operators import federated
from flowlens.operators.evaluate import overall_scores, per_class_scores
from flowlens.operators.federated import (
    LocalTraining, as_vectors, client_confusion, client_results, evaluate_models, evaluate_weights,
    federated_average, fit_federated, fit_local_only, lay_out_clients, load_rounds, local_only_summary,
    mean_weights, megabytes_communicated, round_summary, run_document, sample_clients, train_clients,
)
from flowlens.operators.partition import (
    assign_clients, client_distribution, client_holdout, counts_from_fractions, dirichlet_counts,
    dirichlet_fractions, dirichlet_plan, iid_plan,
    partition_info, rebalance_plan, share_size, shares_from_counts,
)
from flowlens.session import held_settings

# A published partition of 8 x 5000 rows, K = 4, alpha = 0.5, seed 42.
PUBLISHED = [
    [119, 25, 1462, 558, 2484, 4206, 1786, 6],
    [981, 856, 590, 274, 43, 488, 918, 2558],
    [132, 0, 1978, 2580, 2052, 22, 754, 2394],
    [3768, 4119, 970, 1588, 421, 284, 1542, 42],
]


def test_published_partition():
    counts = dirichlet_counts(dict.fromkeys(range(8), 5000), 4, 0.5, 42, legacy_rng=True)
    assert [[int(counts[c][k]) for c in range(8)] for k in range(4)] == PUBLISHED
    shares = rebalance_plan(shares_from_counts(counts, 4))
    assert [share_size(x) for x in shares] == [10646, 6708, 9912, 12734]


@settings(max_examples=60, deadline=None)
@given(sizes=s.lists(s.integers(0, 400), min_size=1, max_size=8), k=s.integers(1, 9),
       alpha=s.sampled_from([0.05, 0.5, 5.0]), seed=s.integers(0, 99))
def test_plan_is_disjoint_and_complete(sizes, k, alpha, seed):
    shares = dirichlet_plan(dict(enumerate(sizes)), k, alpha, seed, min_samples=20)
    covered = {}
    for share in shares:
        for c, lo, hi in share:
            assert lo < hi
            for rank in range(lo, hi):
                assert (c, rank) not in covered
                covered[(c, rank)] = True
    assert len(covered) == sum(sizes)


def test_repair_raises_small_clients():
    shares = rebalance_plan([[(0, 0, 3)], [(0, 3, 100), (1, 0, 30)], [(1, 30, 130)]], 50)
    assert sum(map(share_size, shares)) == 230
    assert min(map(share_size, shares)) >= 50


def test_iid_sizes_differ_by_at_most_one():
    sizes = [share_size(x) for x in iid_plan(1003, 5)]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1


def table(spark, n=1200, d=6, k=3, hot=True):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, d))
    y = np.argmax(x[:, :k], axis=1)
    return spark.createDataFrame(
        [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)],
        "id bigint, features array<double>, label int").repartition(4), x, y


def test_rows_go_to_exactly_one_client(spark):
    df, _, y = table(spark)
    for alpha in (0.5, "iid"):
        got = assign_clients(df, 5, alpha, keys=["id"], seed=1)
        assert got.count() == 1200
        assert got.select("id").distinct().count() == 1200
        again = assign_clients(df.repartition(7), 5, alpha, keys=["id"], seed=1)
        assert {r["id"]: r["client_id"] for r in got.collect()} == {
            r["id"]: r["client_id"] for r in again.collect()}
    sizes = [r["count"] for r in got.groupBy("client_id").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_distribution_and_document(spark):
    df, _, y = table(spark)
    clients = assign_clients(df, 4, 0.5, keys=["id"])
    wide = client_distribution(clients, range(3)).collect()
    assert [sum(r[f"class_{c}"] for r in wide) for c in range(3)] == np.bincount(y).tolist()
    doc = partition_info(clients, "K4_a0.5_s42", 0.5, 42, range(3)).first()
    assert doc["total_samples"] == 1200 and doc["num_clients"] == 4
    assert [sum(r) for r in doc["class_distribution"]] == list(doc["client_sizes"])


def test_holdout_sizes(spark):
    df, _, _ = table(spark)
    held = client_holdout(assign_clients(df, 4, 0.5, keys=["id"]), 0.1, keys=["id"])
    for r in held.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if("is_val").alias("v")).collect():
        assert r["v"] == max(1, int(r["n"] * 0.1))


def test_weighted_average(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 100), ([5.0, 6.0, 7.0], 300)],
                               "weights array<double>, n int")
    assert as_vectors(federated_average(df)).first()["weights"] == [4.0, 5.0, 6.0]
    one = spark.createDataFrame([([1.0, 2.0, 3.0], 50)], "weights array<double>, n int")
    assert as_vectors(federated_average(one)).first()["weights"] == [1.0, 2.0, 3.0]


def test_communication_volume():
    assert round(megabytes_communicated(54600, 4), 2) == 1.04


def test_round_statistics(spark):
    df = spark.createDataFrame([(0.2, 1.0), (0.6, 3.0)], "macro_f1 double, loss double")
    row = round_summary(df, 54600).first()
    assert row["mean_client_f1"] == pytest.approx(0.4)
    assert row["std_client_f1"] == pytest.approx(0.2)
    assert (row["worst_client_f1"], row["mean_client_loss"]) == (0.2, 2.0)
    assert row["mb_communicated"] == round(megabytes_communicated(54600, 2), 2)


def test_client_sampling():
    assert sample_clients(range(10), 0.3, 42, 1) == sample_clients(range(10), 0.3, 42, 1)
    assert len(sample_clients(range(10), 0.01, 42, 1)) == 1
    assert sample_clients([0, 1, 2], 1.0, 0, 5) == [0, 1, 2]


SETTINGS = LocalTraining((6, 8, 3), epochs=2, rate=0.2, batch=32, dropout=0.0)


@pytest.fixture(scope="module")
def clients(spark):
    df, _, _ = table(spark)
    return lay_out_clients(assign_clients(df, 3, 0.5, keys=["id"]), "id")


def test_one_shard_equals_plain_training(spark, clients):
    start = initial_weights(SETTINGS.dims, 42)
    got = {r["client_id"]: r for r in train_clients(clients, start, SETTINGS).collect()}
    assert len(got) == 3
    rows = clients.filter("not is_val and client_id = 0").orderBy("row_key").collect()
    x = np.array([r["features"] for r in rows], dtype=np.float32).astype(float)
    y = np.array([r["label"] for r in rows])
    keys = np.array([r["row_key"] for r in rows])
    w, loss = train_epochs(start, SETTINGS.dims, x, y, 2, 0.2, 32, 42, keys=keys)
    np.testing.assert_allclose(got[0]["weights"], w, atol=1e-12)
    assert got[0]["loss"] == pytest.approx(loss) and got[0]["n"] == len(y)
    mean = mean_weights(spark.createDataFrame([(g["n"], g["weights"]) for g in got.values()],
                                              "n bigint, weights array<double>"))
    assert mean == pytest.approx(np.average([g["weights"] for g in got.values()], axis=0,
                                            weights=[g["n"] for g in got.values()]))


def test_row_order_is_that_of_spark(spark):
    keys = [0, 1, -1, 2**40, -2**62, 12345]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(
        F.xxhash64(F.lit(987654321012).cast("bigint"), "k")).collect()]
    assert row_order(np.array(keys), 987654321012).tolist() == got


def weights_of(spark, df, start, settings, shard_rows):
    laid = lay_out_clients(df, "id", shard_rows=shard_rows)
    return {r["client_id"]: r for r in train_clients(laid, start, settings, shard_rows).collect()}, laid


@pytest.mark.parametrize("batch, block, optimizer, dropout", [
    (32, 4096, "sgd", 0.0), (32, 8, "adamw", 0.3), (700, 64, "sgd", 0.2), (256, 48, "adamw", 0.0)])
def test_weights_do_not_depend_on_shards_or_neighbours(spark, batch, block, optimizer, dropout):
    """Small, handed on, or summed over tasks: the same weights, also beside an uncut client."""
    df, _, _ = table(spark, n=900)
    clients = df.withColumn("client_id", (F.col("id") >= 780).cast("int"))
    settings = replace(SETTINGS, batch=batch, block=block, optimizer=optimizer, dropout=dropout, rate=0.05, mu=0.1)
    start = initial_weights(SETTINGS.dims, 42)
    whole, _ = weights_of(spark, clients, start, settings, 10_000)
    cut, laid = weights_of(spark, clients, start, settings, 150)
    alone, _ = weights_of(spark, clients.filter("client_id = 1"), start, settings, 10_000)
    assert laid.filter("shards > 1").select("client_id").distinct().count() == 1
    for k in (0, 1):
        np.testing.assert_allclose(cut[k]["weights"], whole[k]["weights"], atol=1e-9)
        assert cut[k]["n"] == whole[k]["n"] and cut[k]["loss"] == pytest.approx(whole[k]["loss"])
    assert alone[1]["weights"] == whole[1]["weights"] == cut[1]["weights"]
    results = spark.createDataFrame([(k, r["n"], r["loss"], r["weights"], r["confusion"]) for k, r in cut.items()],
                                    "client_id int, n bigint, loss double, weights array<double>, confusion array<bigint>")
    assert [r["client_id"] for r in client_results(laid, results, settings)] == [0, 1]


@pytest.mark.parametrize("optimizer, dropout", [("sgd", 0.0), ("adamw", 0.3)])
def test_weights_do_not_depend_on_stretches(spark, monkeypatch, optimizer, dropout):
    """Clients in one task, of different numbers of stretches, over Arrow batches that cut mini-batches."""
    df, _, _ = table(spark, n=900)
    clients = df.withColumn("client_id", F.when(F.col("id") < 500, 0).when(F.col("id") < 700, 8).otherwise(-3))
    settings = replace(SETTINGS, optimizer=optimizer, dropout=dropout, rate=0.05, mu=0.1)
    start = initial_weights(SETTINGS.dims, 42)
    whole, _ = weights_of(spark, clients, start, settings, 10_000)
    monkeypatch.setattr(federated, "STRETCH_ROWS", 200)
    with held_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "50"}):
        cut, laid = weights_of(spark, clients, start, settings, 64)
    assert laid.filter("shards = 1").isEmpty() and sorted(cut) == [-3, 0, 8]
    for k in whole:
        np.testing.assert_allclose(cut[k]["weights"], whole[k]["weights"], atol=1e-9)
        assert cut[k]["n"] == whole[k]["n"] and cut[k]["loss"] == pytest.approx(whole[k]["loss"])


def test_jobs_of_a_large_client_do_not_grow_with_its_shards(spark):
    jobs = {}
    for n in (400, 1600):
        df, _, _ = table(spark, n=n)
        laid = lay_out_clients(df.withColumn("client_id", F.lit(0)), "id", shard_rows=64)
        spark.sparkContext.setJobGroup(f"stretch-{n}", "jobs of one epoch")
        train_clients(laid, initial_weights(SETTINGS.dims, 42), replace(SETTINGS, epochs=1), 64).collect()
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"stretch-{n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1600] <= jobs[400] + 5


def test_a_carried_state_is_training_without_a_break():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 6)), rng.integers(0, 3, 200)
    start = first_state(initial_weights(SETTINGS.dims, 1), "adamw")
    options = {"rate": 0.01, "batch": 64, "seed": 3, "dropout": 0.1, "optimizer": "adamw"}
    whole, _ = train_epochs(start, SETTINGS.dims, x, y, 4, **options)
    half, _ = train_epochs(start, SETTINGS.dims, x, y, 2, **options)
    rest, _ = train_epochs(half, SETTINGS.dims, x, y, 2, **options, first_epoch=2)
    np.testing.assert_allclose(rest, whole, atol=1e-12)


def test_rounds_resume(spark, clients, tmp_path):
    df, _, _ = table(spark)
    store = str(tmp_path / "rounds")
    weights, whole = fit_federated(clients, df, SETTINGS, rounds=4, store=None)
    _, first = fit_federated(clients, df, SETTINGS, rounds=3, store=store, checkpoint_every=2)
    assert load_rounds(spark, store)[0] == 3 and len(first) == 3
    resumed, history = fit_federated(clients, df, SETTINGS, rounds=4, store=store)
    assert [h["round"] for h in history] == [1, 2, 3, 4]
    np.testing.assert_allclose(resumed, weights, atol=1e-9)
    for a, b in zip(history, whole):
        assert a["global_val_macro_f1"] == pytest.approx(b["global_val_macro_f1"])
        assert a["client_f1s"] == pytest.approx(b["client_f1s"])
    assert history[-1]["global_val_macro_f1"] > history[0]["global_val_macro_f1"] - 0.05
    assert history[-1]["global_val_macro_f1"] > 0.7


def test_missing_store_starts_at_zero(spark, tmp_path):
    assert load_rounds(spark, str(tmp_path / "none")) == (0, None, [])


def test_unaveraged_clients(spark, clients):
    df, _, _ = table(spark)
    scores = fit_local_only(clients, df, SETTINGS, rounds=2)
    row = local_only_summary(scores).first()
    assert len(row["per_client_test_f1"]) == 3
    assert row["worst_client_f1"] == min(row["per_client_test_f1"])
    assert row["macro_f1"] == pytest.approx(np.mean(row["per_client_test_f1"]))


@pytest.mark.parametrize("test_rows, most_weights", [(100_000, 8_000_000), (300, 100)])
def test_many_models_meet_blocks_of_rows(spark, test_rows, most_weights):
    df, _, _ = table(spark)
    both = {k: initial_weights((6, 8, 3), k) for k in range(5)}
    models = spark.createDataFrame([(k, w.tolist()) for k, w in both.items()], "client_id int, weights array<double>")
    found = evaluate_models(df, models, (6, 8, 3), test_rows, most_weights).collect()
    assert len(found) == 5
    for r in found:
        assert r["macro_f1"] == pytest.approx(evaluate_weights(df, both[r["client_id"]], (6, 8, 3))["macro_f1"])


def test_holdout_scores_agree_however_they_are_computed(spark, clients):
    results = train_clients(clients, initial_weights(SETTINGS.dims, 42), SETTINGS)
    direct = {r["client_id"]: r["macro_f1"] for r in client_results(clients, results, SETTINGS)}
    counts = client_confusion(clients, results, SETTINGS.dims)
    by_spark = overall_scores(per_class_scores(counts, ["client_id"]), ["client_id"]).collect()
    assert direct == pytest.approx({r["client_id"]: r["macro_f1"] for r in by_spark})


def test_run_document_is_one_that_is_read_again(spark, clients, tmp_path):
    from flowlens.operators.reports import run_summary
    from flowlens.sources.runs import read_run_documents

    df, _, y = table(spark)
    weights, history = fit_federated(clients, df, SETTINGS, rounds=2)
    doc = run_document(spark, "fl_a0.5", "fedavg", 0.5, "laptop", clients, df, weights, history, SETTINGS, "abc")
    doc.coalesce(1).write.json(str(tmp_path / "runs"))
    row = read_run_documents(spark, str(tmp_path / "runs")).first()
    scores = evaluate_weights(df, weights, SETTINGS.dims)
    assert row["test_metrics"]["macro_f1"] == pytest.approx(scores["macro_f1"])
    per_class = row["test_metrics"]["per_class"]
    assert [per_class[c]["support"] for c in "abc"] == np.bincount(y).tolist()
    assert np.mean([per_class[c]["f1"] for c in "abc"]) == pytest.approx(scores["macro_f1"])
    assert (row["num_clients"], row["rounds"], row["train_rows"], len(row["history"])) == (3, 2, 1200, 2)
    assert run_summary(read_run_documents(spark, str(tmp_path / "runs"))).first()["macro_f1"] == row["test_metrics"]["macro_f1"]


def test_fractions_scale_with_a_class_and_leave_others_alone():
    plan = dirichlet_fractions("ab", 3, 0.5, seed=7)
    small = counts_from_fractions({"a": 10, "b": 999}, plan)
    large = counts_from_fractions({"a": 10_000, "b": 999}, plan)
    assert small["a"].sum() == 10 and large["a"].sum() == 10_000
    assert (small["b"] == large["b"]).all()
    assert np.abs(large["a"] / 10_000 - plan["a"]).max() <= 1e-4
    # A class that is absent gets no rows; a remainder goes to the lower of equal clients.
    assert counts_from_fractions({}, plan)["a"].tolist() == [0, 0, 0]
    assert counts_from_fractions({"a": 2}, {"a": np.full(3, 1 / 3)})["a"].tolist() == [1, 1, 0]


def test_a_class_without_a_plan_is_an_error(spark):
    rows = spark.range(20).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"))
    plan = dirichlet_fractions([0, 1], 2, 0.5)
    with pytest.raises(ValueError, match="without a plan"):
        assign_clients(rows, 2, 0.5, keys=["id"], fractions=plan)
    whole = dirichlet_fractions([0, 1, 2], 2, 0.5)
    found = assign_clients(rows, 2, 0.5, keys=["id"], min_samples=5, fractions=whole)
    sizes = {r["client_id"]: r["count"] for r in found.groupBy("client_id").count().collect()}
    assert sum(sizes.values()) == 20 and min(sizes.values()) >= 5
