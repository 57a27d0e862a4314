"""Centralised baselines: the network with AdamW and early stopping, and boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.network import first_state, initial_weights, parameter_count
from flowlens.functions.scalar import argmax_index
from flowlens.operators.boosting import BoostedTrees, fit_boosted_trees
from flowlens.operators.federated import (
    SHARD_ROWS, LocalTraining, evaluate_weights, lay_out, train_clients,
)
from flowlens.operators.scoring import Model, class_probabilities
from flowlens.session import durable


def fit_mlp_baseline(
    train: DataFrame,
    val: DataFrame,
    dims: Sequence[int],
    key: str,
    max_epochs: int = 50,
    patience: int = 5,
    rate: float = 0.001,
    batch: int = 2048,
    dropout: float = 0.3,
    seed: int = 42,
    shard_rows: int = SHARD_ROWS,
) -> tuple[Model, list[float]]:
    """Neural baseline on ``features, label``; ``key`` is a whole number that identifies a row.

    Mini-batches in hash order with AdamW. Weights, moments and step count are carried from epoch
    to epoch, and from shard to shard where the table is larger than one. Training stops after
    ``patience`` epochs without a better validation macro F1. Returns the best model and the
    validation scores.
    """
    settings = LocalTraining(
        tuple(dims), epochs=1, rate=rate, batch=batch, dropout=dropout, seed=seed,
        optimizer="adamw", single=True)
    rows = train.select(
        F.lit(0).alias("client_id"), F.col(key).alias("row_key"), "features", "label",
        F.lit(False).alias("is_val"))
    size = train.count()
    laid = lay_out(rows, "row_key", {0: size}, shard_rows, seed)
    val = durable(val.select("features", "label"))
    n = parameter_count(dims)
    state = first_state(initial_weights(dims, seed), "adamw")
    best, best_f1, waited, scores = state[:n].copy(), -1.0, 0, []
    for epoch in range(max_epochs):
        state = np.array(
            train_clients(
                laid, state, settings, shard_rows, epoch, any_large=size > shard_rows).first()["state"])
        scores.append(evaluate_weights(val, state[:n], dims, single=True)["macro_f1"])
        if scores[-1] > best_f1:
            best, best_f1, waited = state[:n].copy(), scores[-1], 0
        else:
            waited += 1
            if waited >= patience:
                break
    return Model(tuple(dims), best, classes=tuple(str(i) for i in range(dims[-1]))), scores


def predict_mlp(model: Model, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``probs``; columns of these names are replaced."""
    return df.withColumn("probs", class_probabilities("features", model)).withColumn(
        "prediction", argmax_index("probs"))


def fit_tree_baseline(
    train: DataFrame, val: DataFrame, num_classes: int, width: int, max_trees: int = 500,
    max_depth: int = 8, rate: float = 0.1, patience: int = 20,
) -> BoostedTrees:
    """Boosted trees with the usual settings of the tree baseline: see ``fit_boosted_trees``."""
    return fit_boosted_trees(
        train, val, num_classes, width, max_trees, max_depth, rate, patience)
