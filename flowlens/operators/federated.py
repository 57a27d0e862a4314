"""Federated training in Spark jobs whose result does not depend on how the rows are cut.

The training table carries ``client_id``, ``features``, ``label``, ``is_val`` and a row key. It
is stored once in buckets of (client, shard); a shard has about ``shard_rows`` rows at most and
is what one task holds.

A client's training is one sequence of mini-batches. The order of an epoch is a hash of the row
keys, dropout depends on the numbers of epoch, batch and block: nothing depends on shards, tasks
or other clients. A client of one shard is trained in one task. A larger one is sorted in ranges
of the epoch's order and trained in stretches of ``STRETCH_ROWS`` rows, a job each: a task reads
its stretch in order, holds an Arrow batch and a mini-batch of it, and hands the weights on. A
mini-batch larger than a shard is computed by many tasks, whose gradients are summed in Spark.
Weights are averaged with row counts.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.network import (
    BLOCK, apply_step, epoch_seed, first_state, gradient_sum, initial_weights, logits, parameter_count,
    train_epochs, train_rows,
)
from flowlens.functions.scalar import argmax_index
from flowlens.operators.evaluate import (
    confusion_counts, matrix_of_counts, overall_scores, per_class_scores, scores_of_matrix,
)
from flowlens.operators.partition import client_holdout
from flowlens.operators.ranking import group_sizes, rank_in_order
from flowlens.operators.scoring import Model, class_probabilities, matrix_of
from flowlens.schemas import ROUND_ENTRY, RUN_DOCUMENT
from flowlens.session import bucketed, drop_path, durable, path_exists, scratch_path

SHARD_ROWS = 250_000
# Rows of a large client that one task trains on before it hands the weights on: enough that their
# training outweighs the job, whatever the size of a shard.
STRETCH_ROWS = 250_000
# Models that one task scores hold at most this many numbers.
MAX_WEIGHTS_PER_PASS = 8_000_000
# Test rows that one task scores with its models.
TEST_ROWS = 100_000
# Tasks that sum weight vectors; the driver gets one vector of each.
SUM_TASKS = 16


@dataclass(frozen=True)
class LocalTraining:
    """Settings of local training; the defaults are those of the full-size profile.

    ``optimizer`` is sgd or adamw (with ``decay``). ``single`` computes gradients in single
    precision. ``block`` rows of a mini-batch are computed at once, and dropout is drawn by block.
    """

    dims: tuple[int, ...]
    epochs: int = 3
    rate: float = 0.001
    batch: int = 2048
    mu: float = 0.0
    dropout: float = 0.3
    seed: int = 42
    optimizer: str = "sgd"
    decay: float = 0.01
    single: bool = False
    block: int = BLOCK

    def __post_init__(self) -> None:
        if self.optimizer not in ("sgd", "adamw"):
            raise ValueError(f"unknown optimizer {self.optimizer!r}")

    @property
    def kind(self) -> type:
        return np.float32 if self.single else np.float64


def lay_out(df: DataFrame, key: str, sizes: dict[int, int], shard_rows: int, seed: int) -> DataFrame:
    """A table with ``client_id, features, label, is_val`` dealt into shards and stored.

    ``key`` is a whole number that identifies a row. The copy in the shared folder is bucketed
    by (client, shard), so that training reads it without another shuffle.
    """
    spark = df.sparkSession
    counts = spark.createDataFrame(
        [(k, max(1, math.ceil(n / shard_rows))) for k, n in sizes.items()], "client_id int, shards int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                sum(math.ceil(n / shard_rows) for n in sizes.values()))
    # One row per client, ``MAX_GROUPS`` at most.
    spread = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col(key)), F.col("shards"))
    rows = df.join(F.broadcast(counts), "client_id").select(
        "client_id", spread.cast("int").alias("shard"), "shards",
        F.col(key).cast("bigint").alias("row_key"),
        F.col("features").cast("array<float>").alias("features"), "label", "is_val")
    return bucketed(rows, "clients", parts, "client_id", "shard")


def lay_out_clients(
    df: DataFrame,
    key: str,
    shard_rows: int = SHARD_ROWS,
    val_fraction: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Holdout, shards and stored layout of a table with ``client_id, features, label``."""
    sizes = group_sizes(df, "client_id")
    held = client_holdout(df, val_fraction, keys=[key], seed=seed, sizes=sizes)
    return lay_out(held, key, sizes, shard_rows, seed)


def _arrays(table: pa.Table, settings: LocalTraining) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and row keys of Arrow rows."""
    features = table["features"].combine_chunks()
    return (matrix_of(features, settings.dims[0], settings.kind), table["label"].to_numpy(),
            table["row_key"].to_numpy())


def _confusion(weights: np.ndarray, dims: Sequence[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Confusion counts, flattened: one cell per class pair."""
    classes = dims[-1]
    counts = np.zeros(classes * classes, dtype=np.int64)
    for at in range(0, len(y), BLOCK):
        part = slice(at, at + BLOCK)
        predicted = logits(weights.astype(x.dtype), dims, x[part]).argmax(axis=1)
        counts += np.bincount(y[part] * classes + predicted, minlength=classes * classes)
    return counts


RESULT_SCHEMA = "client_id int, n bigint, loss double, state array<double>, confusion array<bigint>"
STATE = pa.schema([
    ("client_id", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()),
    ("state", pa.list_(pa.float64())), ("confusion", pa.list_(pa.int64())),
])


def _result(client: int, n: int, loss: float, state: np.ndarray, confusion: np.ndarray | None) -> pa.Table:
    lists = [pa.array([v], t) for v, t in ((state, STATE.field("state").type), (confusion, STATE.field("confusion").type))]
    return pa.table([pa.array([client], pa.int32()), pa.array([n]), pa.array([loss]), *lists], schema=STATE)


def train_small(
    df: DataFrame, start: np.ndarray, anchor: np.ndarray, settings: LocalTraining, first_epoch: int = 0
) -> DataFrame:
    """Clients of one shard, each in one task, with the confusion counts of their holdout."""
    n = parameter_count(settings.dims)

    def train(key: tuple, table: pa.Table) -> pa.Table:
        held = table["is_val"].to_numpy()
        x, y, keys = _arrays(table, settings)
        own = np.flatnonzero(~held)
        state, loss = train_epochs(
            start, settings.dims, x[own], y[own], settings.epochs, settings.rate, settings.batch,
            settings.seed, settings.dropout, settings.mu, anchor, keys[own], first_epoch,
            settings.optimizer, settings.decay, settings.block)
        out = np.flatnonzero(held)
        return _result(int(key[0].as_py()), len(own), loss, state, _confusion(state[:n], settings.dims, x[out], y[out]))

    return df.groupBy("client_id", "shard").applyInArrow(train, RESULT_SCHEMA)


def _stretch_batches(batch: int, shard_rows: int) -> int:
    """Mini-batches of a stretch."""
    return max(shard_rows, STRETCH_ROWS) // batch


def _epoch_table(
    rows: DataFrame, settings: LocalTraining, epoch: int, shard_rows: int
) -> tuple[str, int, int]:
    """The rows in an epoch's order as a stored table, partitioned by ``range``.

    Returns its path, the ranges of a mini-batch (0 where a range is a stretch of several of them)
    and the number of ranges of the largest client. Ranges end with a mini-batch, or with a block
    of one.
    """
    spark, batch = rows.sparkSession, settings.batch
    seed = epoch_seed(settings.seed, epoch)
    order = [F.xxhash64(F.lit(seed).cast("bigint"), F.col("row_key")), F.col("row_key")]
    place = F.col("rank") - 1
    if batch <= shard_rows:
        pieces = 0
        at = F.floor(place / (_stretch_batches(batch, shard_rows) * batch))
    else:
        piece = max(1, shard_rows // settings.block) * settings.block
        pieces = math.ceil(batch / piece)
        at = F.floor(place / batch) * pieces + F.floor(F.pmod(place, F.lit(batch)) / piece)
    path = scratch_path(spark, "epoch")
    ranked = rank_in_order(rows, "client_id", order, "rank")
    ranked.withColumn("range", at.cast("bigint")).write.partitionBy("range").parquet(path)
    return path, pieces, int(spark.read.parquet(path).agg(F.max("range")).first()[0]) + 1


def _held_state(held: pa.Table, start: np.ndarray) -> np.ndarray:
    """A client's own state; at first it has none, and ``start`` counts."""
    own = held["state"].combine_chunks().flatten()
    return np.array(own) if len(own) else start.copy()


def _client_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Arrow batches of rows that stand by client, cut where the client changes."""
    for batch in batches:
        ids = batch["client_id"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield int(ids[lo]), pa.Table.from_batches([batch.slice(lo, hi - lo)])


def _whole_batches(
    tables: Iterator[pa.Table], settings: LocalTraining
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of rows in order, cut after mini-batches; the last one may be shorter."""
    x, y = np.empty((0, settings.dims[0]), settings.kind), np.empty(0, np.int64)
    for table in tables:
        more_x, more_y, _ = _arrays(table, settings)
        x, y = np.concatenate([x, more_x]), np.concatenate([y, more_y])
        whole = len(y) // settings.batch * settings.batch
        if whole:
            yield x[:whole], y[:whole]
            x, y = x[whole:], y[whole:]
    if len(y):
        yield x, y


def _hand_on(
    rows: DataFrame, current: DataFrame, start: np.ndarray, anchor: np.ndarray,
    settings: LocalTraining, seed: int, first_batch: int,
) -> DataFrame:
    """Continue every client's state over one stretch of its epoch.

    A client's state goes before its rows, at rank 0. The task reads them in order and holds an
    Arrow batch and a mini-batch, never the stretch.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for client, runs in groupby(_client_runs(batches), itemgetter(0)):
            first = next(runs)[1]
            if first["rank"][0].as_py():
                raise ValueError(f"rows of client {client} without its state")
            state, n, loss = _held_state(first[:1], start), first["n"][0].as_py(), first["loss"][0].as_py()
            tables, number = chain([first[1:]], map(itemgetter(1), runs)), first_batch
            for x, y in _whole_batches(tables, settings):
                loss += train_rows(
                    state, settings.dims, x, y, settings.rate, settings.batch, seed, number,
                    settings.dropout, settings.mu, anchor, settings.optimizer, settings.decay, settings.block)
                n, number = n + len(y), number + len(y) // settings.batch
            yield from _result(client, n, loss, state, None).to_batches()

    spark = rows.sparkSession
    states = current.drop("confusion").withColumn("rank", F.lit(0).cast("bigint"))
    both = states.unionByName(
        rows.select("client_id", "rank", "row_key", "features", "label"), allowMissingColumns=True)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), current.count())
    return both.repartitionById(parts, F.col("client_id").cast("int")).sortWithinPartitions(
        "client_id", "rank").mapInArrow(train, RESULT_SCHEMA)


def _summed_step(
    rows: DataFrame, current: DataFrame, start: np.ndarray, anchor: np.ndarray,
    settings: LocalTraining, seed: int, number: int,
) -> DataFrame:
    """One step of every client that has rows in its mini-batch ``number``, computed by ranges."""
    n = parameter_count(settings.dims)

    def gradients(key: tuple, table: pa.Table, held: pa.Table) -> pa.Table:
        if not len(table) or not len(held):
            return STATE.empty_table()
        table = table.sort_by("rank")
        x, y, _ = _arrays(table, settings)
        block = (table["rank"][0].as_py() - 1) % settings.batch // settings.block
        loss, total = gradient_sum(
            _held_state(held, start)[:n].astype(settings.kind), settings.dims, x, y, settings.dropout,
            seed, number, block, settings.block)
        return _result(int(key[0].as_py()), len(y), loss, total.astype(np.float64) / len(y), None)

    parts = rows.select("client_id", "range").distinct()
    state = parts.join(current, "client_id").select(
        F.col("client_id").alias("state_client"), F.col("range").alias("state_range"), "state")
    partial = durable(
        rows.groupBy("client_id", "range").cogroup(state.groupBy("state_client", "state_range"))
        .applyInArrow(gradients, RESULT_SCHEMA))
    mean = as_vectors(federated_average(partial, "state", by=["client_id"]), ["client_id"])
    counts = partial.groupBy("client_id").agg(F.sum("n").alias("rows"), F.sum("loss").alias("added"))
    step = mean.join(counts, "client_id").withColumnsRenamed(
        {"client_id": "step_client", "weights": "gradient"})

    def move(key: tuple, held: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found):
            return held.select(STATE.names)
        state, rows_seen = _held_state(held, start), found["rows"][0].as_py()
        pulled = apply_step(
            state, np.array(found["gradient"].combine_chunks().flatten()), settings.rate,
            settings.optimizer, settings.decay, settings.mu, anchor)
        loss = held["loss"][0].as_py() + found["added"][0].as_py() + pulled * rows_seen
        return _result(held["client_id"][0].as_py(), held["n"][0].as_py() + rows_seen, loss, state, None)

    return current.groupBy("client_id").cogroup(step.groupBy("step_client")).applyInArrow(move, RESULT_SCHEMA)


def train_large(
    df: DataFrame, start: np.ndarray, anchor: np.ndarray, settings: LocalTraining, shard_rows: int,
    first_epoch: int = 0,
) -> DataFrame:
    """Clients of several shards: one job per stretch of an epoch, or per mini-batch above a shard.

    The results are those of ``train_small``; no task holds more than an Arrow batch and a
    mini-batch, or ``shard_rows`` rows or one block of a mini-batch above a shard.
    """
    spark = df.sparkSession
    rows = df.filter(~F.col("is_val")).select("client_id", "row_key", "features", "label")
    current = durable(df.select(F.col("client_id").cast("int")).distinct().select(
        "client_id", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("loss"),
        F.lit(None).cast("array<double>").alias("state"),
        F.lit(None).cast("array<bigint>").alias("confusion")))
    for epoch in range(first_epoch, first_epoch + settings.epochs):
        seed = epoch_seed(settings.seed, epoch)
        path, pieces, ranges = _epoch_table(rows, settings, epoch, shard_rows)
        table, at = spark.read.parquet(path), F.col("range")
        if not pieces:
            batches = _stretch_batches(settings.batch, shard_rows)
            for k in range(ranges):
                stretch = table.filter(at == k)
                clients = stretch.select("client_id").distinct()
                moved = _hand_on(
                    stretch, current.join(clients, "client_id", "left_semi"), start, anchor, settings,
                    seed, k * batches)
                current = durable(moved.unionByName(current.join(clients, "client_id", "left_anti")))
        else:
            for k in range(math.ceil(ranges / pieces)):
                current = durable(_summed_step(
                    table.filter(at.between(k * pieces, (k + 1) * pieces - 1)), current, start, anchor,
                    settings, seed, k))
        drop_path(spark, path)
    return current.withColumn("n", (F.col("n") / settings.epochs).cast("bigint"))


def train_clients(
    df: DataFrame, start: np.ndarray, settings: LocalTraining, shard_rows: int = SHARD_ROWS,
    first_epoch: int = 0, anchor: np.ndarray | None = None, any_large: bool | None = None,
) -> DataFrame:
    """Local training of every client: ``client_id, n, loss, weights, state, confusion``, stored.

    ``n`` counts training rows, ``loss`` sums row losses over all epochs. ``state`` goes on as the
    ``start`` of a later call. ``confusion`` scores the client's model on its holdout; it is NULL
    for clients of several shards (see ``client_confusion``). Neither ``shard_rows`` nor the size
    of other clients changes a client's weights. ``any_large`` tells, where that is known, whether
    clients of several shards are among them.
    """
    n = parameter_count(settings.dims)
    anchor = start[:n] if anchor is None else anchor
    if settings.optimizer == "adamw" and len(start) == n:
        start = first_state(start, "adamw")
    results = durable(train_small(df.filter("shards = 1"), start, anchor, settings, first_epoch))
    large = df.filter("shards > 1")
    if any_large is None:
        any_large = not large.isEmpty()
    if any_large:
        results = results.unionByName(train_large(large, start, anchor, settings, shard_rows, first_epoch))
    return results.withColumn("weights", F.slice("state", 1, n) if settings.optimizer == "adamw" else F.col("state"))


def federated_average(
    results: DataFrame, weights: str = "weights", rows: str = "n", by: Sequence[str] = ()
) -> DataFrame:
    """Row-weighted mean of weight vectors, in long form ``pos, value`` (per ``by`` group).

    The vectors are summed position by position before the shuffle.
    """
    parts = results.select(*by, F.col(rows).cast("double").alias("_n"), F.posexplode(weights))
    return parts.groupBy(*by, "pos").agg(
        (F.sum(F.col("_n") * F.col("col")) / F.sum("_n")).alias("value")
    )


def as_vectors(long_form: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form back to one array per group; its length is that of the model."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return long_form.groupBy(*by).agg(ordered.alias("_w")).select(
        *by, F.col("_w.value").alias("weights")
    )


def mean_weights(results: DataFrame) -> np.ndarray:
    """The row-weighted mean of the clients' weights, on the driver.

    ``SUM_TASKS`` tasks sum what they read; the driver adds one vector of each.
    """
    def total(batches):
        rows, weights = 0, 0.0
        for batch in batches:
            n = batch["n"].to_numpy()
            for i in range(len(n)):
                weights = weights + n[i] * np.asarray(batch["weights"][i].values)
            rows += int(n.sum())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([weights])], ["n", "weights"])

    parts = results.select("n", "weights").coalesce(SUM_TASKS).mapInArrow(
        total, "n bigint, weights array<double>").toArrow()
    sums = np.stack([np.asarray(w.values) for w in parts["weights"]])
    return sums.sum(axis=0) / parts["n"].to_numpy().sum()


CELLS = "client_id int, truth int, prediction int, n bigint"
COUNTS = pa.schema([
    ("client_id", pa.int32()), ("truth", pa.int32()), ("prediction", pa.int32()), ("n", pa.int64())])


def _cells(client: int, counts: np.ndarray, classes: int) -> pa.Table:
    at = np.flatnonzero(counts)
    return pa.table([
        pa.array(np.full(len(at), client), pa.int32()), pa.array(at // classes, pa.int32()),
        pa.array(at % classes, pa.int32()), pa.array(counts[at], pa.int64())], schema=COUNTS)


def client_confusion(df: DataFrame, results: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Each client's model on its own holdout: ``client_id, truth, prediction, n``.

    Each (client, shard) part of the holdout meets the client's weights and returns confusion
    counts, so a large holdout is scored by many tasks.
    """
    dims = tuple(dims)
    settings = LocalTraining(dims)
    holdout = df.filter("is_val").select("client_id", "shard", "row_key", "features", "label")
    parts = holdout.select("client_id", "shard").distinct()
    models = parts.join(results.select("client_id", "weights"), "client_id").select(
        F.col("client_id").alias("model_client"), F.col("shard").alias("model_shard"), "weights")

    def score(key: tuple, rows: pa.Table, model: pa.Table) -> pa.Table:
        if not len(rows) or not len(model):
            return COUNTS.empty_table()
        x, y, _ = _arrays(rows, settings)
        return _cells(key[0].as_py(), _confusion(
            np.array(model["weights"].combine_chunks().flatten()), dims, x, y), dims[-1])

    return (
        holdout.groupBy("client_id", "shard").cogroup(models.groupBy("model_client", "model_shard"))
        .applyInArrow(score, CELLS)
        .groupBy("client_id", "truth", "prediction").agg(F.sum("n").alias("n"))
    )


def client_results(df: DataFrame, results: DataFrame, settings: LocalTraining) -> list[dict]:
    """Per client its loss and the macro F1 of its model on its holdout, by client.

    One row per client reaches the driver. Only clients of several shards need a second look at
    their holdout.
    """
    classes = settings.dims[-1]
    rows = results.select("client_id", "n", "loss", "confusion").collect()
    again = [r["client_id"] for r in rows if r["confusion"] is None]
    matrices = {
        r["client_id"]: np.array(r["confusion"]).reshape(classes, classes)
        for r in rows if r["confusion"] is not None
    }
    if again:
        matrices.update((k, np.zeros((classes, classes), dtype=np.int64)) for k in again)
        chosen = F.col("client_id").isin(again)
        for cell in client_confusion(
            df.filter(chosen), results.filter(chosen), settings.dims
        ).collect():
            matrices[cell["client_id"]][cell["truth"], cell["prediction"]] += cell["n"]
    return [
        {"client_id": r["client_id"], "loss": r["loss"] / max(1, r["n"] * settings.epochs),
         "macro_f1": scores_of_matrix(matrices[r["client_id"]])[1]}
        for r in sorted(rows, key=lambda r: r["client_id"])
    ]


def model_matrix(
    df: DataFrame, weights: np.ndarray, dims: Sequence[int], single: bool = False
) -> np.ndarray:
    """Confusion counts of one model on ``features, label``; rows are the truth."""
    model = Model(tuple(dims), weights, classes=tuple(str(i) for i in range(dims[-1])))
    scored = df.select("label", argmax_index(
        class_probabilities("features", model, single=single)).alias("prediction"))
    return matrix_of_counts(confusion_counts(scored, "label", "prediction"), dims[-1])


def evaluate_weights(
    df: DataFrame, weights: np.ndarray, dims: Sequence[int], single: bool = False
) -> dict[str, float]:
    """Accuracy, macro and weighted F1 of one model on ``features, label``.

    The rows are reduced to confusion counts by one aggregation.
    """
    return dict(zip(("accuracy", "macro_f1", "weighted_f1"),
                    scores_of_matrix(model_matrix(df, weights, dims, single))))


def evaluate_models(
    df: DataFrame, models: DataFrame, dims: Sequence[int], test_rows: int = TEST_ROWS,
    most_weights: int = MAX_WEIGHTS_PER_PASS,
) -> DataFrame:
    """Macro F1 of the models (client_id, weights) on one table: ``client_id, macro_f1``.

    Blocks of rows meet groups of models in a cogroup: a task holds ``test_rows`` rows and about
    ``most_weights`` numbers of models. Only confusion counts leave it; no weights reach the driver.
    """
    dims = tuple(dims)
    settings = LocalTraining(dims)
    groups = max(1, math.ceil(models.count() * parameter_count(dims) / most_weights))
    blocks = max(1, math.ceil(df.count() / test_rows))

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    rows = df.select(
        "features", "label", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block"),
    ).select("*", F.col("block").alias("row_key"), numbers(groups).alias("models"))
    sent = models.select(
        "client_id", "weights", F.pmod(F.xxhash64("client_id"), F.lit(groups)).alias("model_group"),
    ).select("*", numbers(blocks).alias("model_block"))

    def score(key: tuple, table: pa.Table, group: pa.Table) -> pa.Table:
        if not len(table) or not len(group):
            return COUNTS.empty_table()
        x, y, _ = _arrays(table, settings)
        return pa.concat_tables([
            _cells(client, _confusion(np.asarray(weights.values), dims, x, y), dims[-1])
            for client, weights in zip(group["client_id"].to_pylist(), group["weights"])]).combine_chunks()

    counts = (
        rows.groupBy("block", "models")
        .cogroup(sent.groupBy("model_block", "model_group")).applyInArrow(score, CELLS)
        .groupBy("client_id", "truth", "prediction").agg(F.sum("n").alias("n"))
    )
    return overall_scores(per_class_scores(counts, ["client_id"]), ["client_id"]).select(
        "client_id", "macro_f1")


def megabytes_communicated(parameters: int, clients: int) -> float:
    """Single-precision weights up from every client and down once."""
    return parameters * 4 * (clients + 1) / 1024**2


def round_summary(results: DataFrame, parameters: int) -> DataFrame:
    """Client statistics of a round from ``macro_f1`` and ``loss`` per client, as one row."""
    volume = F.lit(parameters * 4.0 / 1024**2) * (F.count(F.lit(1)) + 1)
    return results.agg(
        F.avg("macro_f1").alias("mean_client_f1"),
        F.stddev_pop("macro_f1").alias("std_client_f1"),
        F.min("macro_f1").alias("worst_client_f1"),
        F.avg("loss").alias("mean_client_loss"),
        F.round(volume, 2).alias("mb_communicated"),
    )


def local_only_summary(scores: DataFrame) -> DataFrame:
    """Mean and worst of the clients' test scores, as one row."""
    ordered = F.sort_array(F.collect_list(F.struct("client_id", "macro_f1")))
    return scores.agg(
        F.avg("macro_f1").alias("macro_f1"),
        F.min("macro_f1").alias("worst_client_f1"),
        ordered.alias("_s"),
    ).select("macro_f1", "worst_client_f1", F.col("_s.macro_f1").alias("per_client_test_f1"))


def sample_clients(clients: Sequence[int], fraction: float, seed: int, round_no: int) -> list[int]:
    """``max(1, int(fraction * K))`` clients; depends on (seed, round) only, so runs can resume."""
    count = max(1, int(fraction * len(clients)))
    rng = np.random.default_rng((seed, round_no))
    return sorted(int(c) for c in rng.choice(sorted(clients), size=count, replace=False))


def load_rounds(spark: SparkSession, store: str) -> tuple[int, np.ndarray | None, list[dict]]:
    """Last stored round, its weights, and the history up to it."""
    if not path_exists(spark, store):
        return 0, None, []
    rows = spark.read.parquet(store)
    last = rows.agg(F.max("round")).first()[0]
    history = [
        r["entry"].asDict() for r in rows.select("round", "entry").orderBy("round").collect()
    ]
    weights = rows.filter((F.col("round") == last) & F.col("weights").isNotNull()).first()["weights"]
    return last, np.array(weights), history


def save_rounds(spark: SparkSession, store: str, weights: np.ndarray, entries: list[dict]) -> None:
    """Store rounds up to a checkpoint; the weights go with the last one.

    A checkpoint is one directory, overwritten as a whole: repeating it is harmless.
    """
    rows = [
        (e["round"], tuple(e.get(f) for f in ROUND_ENTRY.names),
         weights.tolist() if e is entries[-1] else None)
        for e in entries
    ]
    schema = f"round int, entry {ROUND_ENTRY.simpleString()}, weights array<double>"
    last = entries[-1]["round"]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(
        f"{store.rstrip('/')}/upto={last:06d}")


def fit_federated(
    clients: DataFrame,
    val: DataFrame,
    settings: LocalTraining,
    rounds: int = 20,
    fraction_fit: float = 1.0,
    store: str | None = None,
    checkpoint_every: int = 5,
    shard_rows: int = SHARD_ROWS,
    start: np.ndarray | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """Federated averaging over a table from ``lay_out_clients``.

    Returns the global weights and one history entry per round. With ``store``
    rounds are checkpointed there, and a later call continues after the last one.
    ``start`` are the weights before the first round, drawn from the seed by default.
    """
    spark = clients.sparkSession
    done, weights, history = load_rounds(spark, store) if store else (0, None, [])
    if weights is None:
        weights = initial_weights(settings.dims, settings.seed) if start is None else start
    ids = [r[0] for r in clients.select("client_id").distinct().collect()]
    val = durable(val.select("features", "label"))
    any_large = not clients.filter("shards > 1").isEmpty()
    parameters = parameter_count(settings.dims)
    pending: list[dict] = []
    for number in range(done + 1, rounds + 1):
        begun = time.monotonic()
        chosen = sample_clients(ids, fraction_fit, settings.seed, number)
        local = clients.filter(F.col("client_id").isin(chosen)) if len(chosen) < len(ids) else clients
        step = replace(settings, seed=settings.seed + 1_000_003 * number)
        results = train_clients(local, weights, step, shard_rows, any_large=any_large)
        weights = mean_weights(results)
        per_client = client_results(local, results, settings)
        overall = evaluate_weights(val, weights, settings.dims, settings.single)
        f1s = np.array([r["macro_f1"] for r in per_client])
        pending.append({
            "round": number,
            "global_val_macro_f1": overall["macro_f1"],
            "global_val_accuracy": overall["accuracy"],
            "mean_client_f1": float(f1s.mean()),
            "std_client_f1": float(f1s.std()),
            "worst_client_f1": float(f1s.min()),
            "mean_client_loss": float(np.mean([r["loss"] for r in per_client])),
            "client_f1s": f1s.tolist(),
            "mb_communicated": round(megabytes_communicated(parameters, len(chosen)), 2),
            "wall_time_s": round(time.monotonic() - begun, 2),
            "selected_clients": chosen,
        })
        if store and (number % checkpoint_every == 0 or number == rounds):
            save_rounds(spark, store, weights, pending)
            history, pending = history + pending, []
    return weights, history + pending


def metrics_of_matrix(matrix: np.ndarray, classes: Sequence[str]) -> dict:
    """Test metrics of a run document: overall scores, and those of every class."""
    accuracy, macro_f1, weighted_f1 = scores_of_matrix(matrix)
    per_class = {}
    for i, name in enumerate(classes):
        hits, support, predicted = (int(v) for v in (matrix[i, i], matrix[i].sum(), matrix[:, i].sum()))
        per_class[name] = {
            "precision": hits / predicted if predicted else 0.0,
            "recall": hits / support if support else 0.0,
            "f1": 2.0 * hits / (support + predicted) if support + predicted else 0.0,
            "support": support,
        }
    return {"accuracy": accuracy, "macro_f1": macro_f1, "weighted_f1": weighted_f1, "per_class": per_class}


def run_document(
    spark: SparkSession, run_name: str, method: str, alpha: float | str, profile: str,
    clients: DataFrame, test: DataFrame, weights: np.ndarray, history: list[dict],
    settings: LocalTraining, classes: Sequence[str],
) -> DataFrame:
    """The document of a finished run, one row: its settings, rounds, and scores on ``test``.

    ``train_rows`` counts the clients' rows, holdouts included.
    """
    sizes = group_sizes(clients, "client_id")
    matrix = model_matrix(test, weights, settings.dims, settings.single)
    entry = {
        "run_name": run_name, "method": method, "alpha": str(alpha), "mu": float(settings.mu),
        "seed": settings.seed, "profile": profile, "num_clients": len(sizes), "rounds": len(history),
        "train_rows": sum(sizes.values()), "input_dim": settings.dims[0],
        "wall_time_s": round(sum(h["wall_time_s"] for h in history), 1),
        "test_metrics": metrics_of_matrix(matrix, classes),
        "history": [Row(**{f: h.get(f) for f in ROUND_ENTRY.names}) for h in history],
    }
    return spark.createDataFrame([tuple(entry.get(f) for f in RUN_DOCUMENT.names)], RUN_DOCUMENT)


def fit_local_only(
    clients: DataFrame, test: DataFrame, settings: LocalTraining, rounds: int = 20,
    shard_rows: int = SHARD_ROWS, start: np.ndarray | None = None,
) -> DataFrame:
    """Every client alone for ``rounds * epochs`` epochs, then scored on the common test set.

    Returns ``client_id, macro_f1``. ``start`` are the first weights, drawn from the seed by default.
    """
    if start is None:
        start = initial_weights(settings.dims, settings.seed)
    alone = replace(settings, epochs=rounds * settings.epochs, mu=0.0)
    return evaluate_models(test, train_clients(clients, start, alone, shard_rows), settings.dims)
