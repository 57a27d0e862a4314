"""The baselines: AdamW against a plain loop, boosted trees against plain growth and each other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.network import epoch_places, epoch_seed, initial_weights, loss_and_gradient
from flowlens.operators.baselines import fit_mlp_baseline, predict_mlp
from flowlens.operators import boosting
from flowlens.operators.boosting import (
    BoostedTrees, Tree, best_splits, binary_rows, fit_boosted_trees, grow, histograms, margins_of, matrix_of_binary,
)
from flowlens.operators.evaluate import classification_metrics


def blobs(spark, n=600, d=5, k=3, noise=0.6, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    x = rng.normal(size=(n, d)) * noise
    x[np.arange(n), y] += 1.5
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label int").repartition(4)
    return df.filter("id % 4 > 0"), df.filter("id % 4 = 0"), x, y


def plain_adamw(x, y, keys, dims, epochs, rate, batch, seed):
    w, first, second, step = initial_weights(dims, seed), 0.0, 0.0, 0
    states = []
    for epoch in range(epochs):
        order = epoch_places(keys, epoch_seed(seed, epoch))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            _, g = loss_and_gradient(w, dims, x[rows], y[rows])
            step += 1
            w = w - rate * 0.01 * w
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        states.append(w)
    return states


@pytest.mark.parametrize("shard_rows", [10_000, 100])
def test_adamw_is_carried_over_epochs_and_shards(spark, shard_rows):
    train, val, x, y = blobs(spark)
    dims = (5, 8, 3)
    model, scores = fit_mlp_baseline(
        train, val, dims, "id", max_epochs=3, rate=0.02, batch=32, dropout=0.0, shard_rows=shard_rows)
    keys = np.array([i for i in range(600) if i % 4])
    states = plain_adamw(x[keys].astype(np.float32).astype(float), y[keys], keys, dims, 3, 0.02, 32, 42)
    best = int(np.argmax(scores))
    # Gradients are in single precision.
    np.testing.assert_allclose(model.weights, states[best], atol=2e-3)
    assert len(scores) == 3 and scores[best] > 0.8
    assert classification_metrics(predict_mlp(model, val), "label", "prediction").first()["macro_f1"] == pytest.approx(
        scores[best], abs=0.01)


def test_training_stops_after_patience(spark):
    train, val, _, _ = blobs(spark, 200)
    _, scores = fit_mlp_baseline(train, val, (5, 3), "id", max_epochs=30, patience=2, rate=0.0)
    assert len(scores) == 3


def plain_best(bins, g, h, width):
    best = (1e-6, -1, 0)
    for f in range(bins.shape[1]):
        for cut in range(width - 1):
            low = bins[:, f] <= cut
            gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            if hl >= 1 and hr >= 1:
                gain = round(gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr)**2 / (hl + hr + 1), 9)
                if gain > best[0]:
                    best = (gain, f, cut)
    return best


def plain_tree(bins, g, h, depth, rate, width):
    """{node: (feature, cut)} and the value of every row, by recursion."""
    splits, value = {}, np.empty(len(g))

    def go(node, rows, left):
        found = plain_best(bins[rows], g[rows], h[rows], width) if left else (0, -1, 0)
        if found[1] < 0:
            value[rows] = -rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        splits[node] = found[1:]
        low = bins[rows, found[1]] <= found[2]
        go(2 * node + 1, rows[low], left - 1)
        go(2 * node + 2, rows[~low], left - 1)

    go(0, np.arange(len(g)), depth)
    return splits, value


def test_growth_equals_recursion():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 6, (300, 4)).astype(np.uint8)
    g, h = rng.normal(size=300), rng.uniform(0.05, 0.5, 300)
    tree = grow(bins, g, h, 4, 0.3, 6)
    splits, value = plain_tree(bins, g, h, 4, 0.3, 6)
    assert {int(n): (int(tree.feature[n]), int(tree.cut[n])) for n in np.flatnonzero(tree.feature >= 0)} == splits
    np.testing.assert_allclose(tree.value[tree.leaves(bins)], value, atol=1e-9)


def test_nothing_to_split():
    found = best_splits(histograms(np.zeros((5, 2), np.uint8), np.zeros(5, int), 1, np.ones(5), np.ones(5), 3))
    assert found["feature"].tolist() == [-1]
    tree = grow(np.zeros((0, 2), np.uint8), np.zeros(0), np.zeros(0), 3, 0.1, 2)
    assert (tree.feature == -1).all()
    assert matrix_of_binary(binary_rows(np.zeros((0, 3), np.uint8)), 3).shape == (0, 3)
    full = np.arange(12, dtype=np.uint8).reshape(4, 3)
    assert matrix_of_binary(binary_rows(full).slice(1, 2), 3).tolist() == full[1:3].tolist()
    assert margins_of([[Tree.empty(2)] * 2], full, 2).tolist() == [[0.0, 0.0]] * 4


def test_levels_over_tasks_equal_local_trees(spark):
    train, val, x, y = blobs(spark, 500)
    options = {"max_trees": 3, "max_depth": 3, "bins": 16}
    local = fit_boosted_trees(train, val, 3, 5, **options)
    spread = fit_boosted_trees(train, val, 3, 5, local_rows=0, edges=local.edges, **options)
    assert len(local.rounds) == len(spread.rounds) == 3
    for a, b in zip(local.rounds, spread.rounds):
        for s, t in zip(a, b):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
            np.testing.assert_allclose(s.value, t.value, atol=1e-9)
    assert local.losses == pytest.approx(spread.losses)
    # The first round starts from equal probabilities.
    rows = np.array([i for i in range(500) if i % 4])
    bins = local.binned(x[rows])
    first = grow(bins, 1 / 3 - (y[rows] == 1), np.full(len(rows), 4 / 9), 3, 0.1, 16)
    assert first.feature.tolist() == local.rounds[0][1].feature.tolist()
    scored = local.predict(val.withColumn("probs", F.lit(1)))
    assert classification_metrics(scored, "label", "prediction").first()["macro_f1"] > 0.8
    assert all(sum(r["probs"]) == pytest.approx(1.0) for r in scored.collect())


def test_patience_and_stored_margins(spark):
    train, val, _, _ = blobs(spark, 240, noise=3.0, seed=1)
    model = fit_boosted_trees(train, val, 3, 5, max_trees=40, max_depth=4, rate=0.8, patience=4, bins=8)
    best = int(np.argmin(model.losses)) + 1
    assert len(model.rounds) == best and len(model.losses) in (best + 4, 40)
    # Losses of rounds after a store of the margins are those of the whole model.
    rounds = fit_boosted_trees(train, val.limit(0), 3, 5, max_trees=12, max_depth=2, bins=8).rounds
    again = fit_boosted_trees(train, train, 3, 5, max_trees=12, max_depth=2, bins=8, patience=99)
    assert len(rounds) == 12
    rows = train.collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    z = margins_of(again.rounds, again.binned(x), 3)
    p = np.exp(z)[np.arange(len(y)), y] / np.exp(z).sum(axis=1)
    assert -np.log(p).mean() == pytest.approx(again.losses[len(again.rounds) - 1])


def test_odd_values(spark):
    model = BoostedTrees([np.array([0.0, 1.0])], [], 2)
    assert model.binned(np.array([[np.nan], [-1.0], [0.0], [0.5], [1.0], [np.inf]]))[:, 0].tolist() == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError, match="255"):
        fit_boosted_trees(None, None, 2, 1, edges=[np.arange(300.0)])


def test_a_round_sends_one_probability_per_row_and_class(spark):
    rows = spark.range(300).select(
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("features"),
        (F.col("id") % 3).cast("int").alias("label"))
    model = boosting.BoostedTrees([np.arange(1.0, 7.0), np.arange(1.0, 5.0)], [], 3)
    booster = boosting.Booster(rows, rows.limit(0), model, 2, 0.1)
    booster.local_round()
    sent = booster.class_probabilities()
    assert sent.columns == ["p_cls", "p_row", "p"]
    assert sent.agg(F.sum(F.octet_length("p"))).first()[0] == 300 * 3 * 8
    stored = booster.class_bins()
    booster.local_round()
    assert booster.class_bins() is stored


def test_sums_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(7)
    bins = rng.integers(0, 12, (6000, 7)).astype(np.uint8)
    g, h = rng.normal(size=6000) / 3, rng.uniform(0.01, 0.5, 6000)
    order = rng.permutation(6000)
    tree, other = grow(bins, g, h, 6, 0.1, 12), grow(bins[order], g[order], h[order], 6, 0.1, 12)
    assert (tree.feature >= 0).sum() > 30
    for name in ("feature", "cut", "value", "gain"):
        assert getattr(tree, name).tolist() == getattr(other, name).tolist()
    assert tree.values(bins).tolist() == tree.value[tree.leaves(bins)].tolist()


def test_two_features_in_a_pass():
    rng = np.random.default_rng(8)
    bins, place = rng.integers(0, 256, (200_000, 3)).astype(np.uint8), rng.integers(0, 2, 200_000)
    g, h = boosting.summable(rng.normal(size=200_000)), boosting.summable(rng.uniform(size=200_000))
    rows = np.flatnonzero(place == 1)
    columns, plain = boosting.Columns(bins, 256), histograms(bins, place - 1, 1, g, h, 256)
    assert columns.histograms(np.zeros(len(rows), int), 1, g[rows], h[rows], rows).tolist() == plain.tolist()
    assert columns.histograms(place, 2, g, h)[1:].tolist() == plain.tolist()


def test_a_round_ships_and_counts_only_what_it_needs(spark):
    train, val, _, _ = blobs(spark, 300)
    train = train.withColumn("label", F.expr("cast(id % 10 as int)"))
    val = val.withColumn("label", F.expr("cast(id % 10 as int)"))
    booster = boosting.Booster(train, val, boosting.BoostedTrees([np.arange(-1.0, 3.0)] * 5, [], 10), 3, 0.1)
    for _ in range(2):
        trees = booster.local_round()
        assert booster.loss == pytest.approx(booster.validation_loss(), rel=1e-12)
        booster.model.rounds.append(trees)
        booster.pending.append(trees)
    # Trees that the stored margins hold stay at the driver; a class has a task to itself.
    booster.absorb()
    assert len(booster.model.rounds) == 2 and booster.shippable().model.rounds == booster.shippable().pending == []
    assert booster.class_bins().groupBy(F.spark_partition_id()).agg(
        F.countDistinct("cls").alias("n")).filter("n > 1").count() == 0
