"""The driver tables seen as flows, alerts, design matrices and experiment runs.

Every view is a projection of a whole table, computed by Spark.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.network import parameter_count
from flowlens.labels import Taxonomy
from flowlens.operators.clean import map_labels
from flowlens.operators.profile import FeatureStats
from flowlens.operators.scoring import Model

# Event types as fine labels; "error" is left to the prefix rule.
EVENT_TAXONOMY = Taxonomy(
    classes=("Benign", "DDoS", "Recon", "Web"),
    explicit={"view": "Benign", "click": "Benign", "purchase": "DDoS", "signup": "Recon"},
    prefixes=(("err", "Web"),),
)

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_ms"]
LINE_FEATURES = ["discount", "extendedprice", "quantity", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its timestamps have no zone; they are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double"
        else F.col(f.name)
        for f in df.schema.fields
    ])


def event_columns() -> list[Column]:
    return [
        F.col("event_id").cast("string").alias("event_id"),
        millis("ts").alias("ts_event"),
        F.concat(F.lit("org-"), (F.col("user_id") % 8 + 1).cast("string")).alias("org_id"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
    ]


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as FlowEvents with the features ``k`` and ``value``."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        *event_columns(),
        F.create_map(F.lit("k"), k, F.lit("value"), F.col("value")).alias("features"),
        F.col("event_type").alias("true_label"),
    )


def labelled_events(df: DataFrame) -> DataFrame:
    """``events`` rows as alerts, the class given by the event type (batch or stream)."""
    flows = df.select(*event_columns(), "value", F.col("event_type").alias("label"))
    return map_labels(flows, EVENT_TAXONOMY).select(
        "event_id", "ts_event",
        (F.col("ts_event") + F.floor("value")).alias("ts_scored"),
        F.col("value").alias("latency_ms"),
        "org_id", "device_id",
        F.col("label_8").alias("pred_class"),
        (F.col("value") / (F.col("value") + 10.0)).alias("confidence"),
        (F.col("label_8") != "Benign").alias("is_attack"),
        F.col("label_34").alias("true_label"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_events(table(spark, sf_dir, "events"))


def line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a cleaned flow table: four features, class, fine label and row key."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", millis("l_shipdate").alias("ship_ms"),
        *[F.col(f"l_{name}").alias(name) for name in LINE_FEATURES],
        F.col("l_linestatus").alias("label_34"), F.col("l_returnflag").alias("label_8"),
    )


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with NULL, NaN, infinite features and blank labels put in."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("double").alias("orderkey"),
        F.col("l_linenumber").cast("double").alias("linenumber"),
        F.when(key % 97 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(key % 89 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
        F.when(key % 83 == 0, F.lit(float("inf")))
        .when(key % 79 == 0, F.lit(float("-inf"))).otherwise(F.col("l_discount")).alias("discount"),
        F.when(key % 73 == 0, F.lit("  ")).otherwise(F.col("l_returnflag")).alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a design matrix: row key, features, label."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


@cache
def linear_model(features: int, classes: tuple[str, ...]) -> Model:
    """A linear classifier with weights by formula, so that SQL can compute it too."""
    c, j = np.arange(len(classes))[:, None], np.arange(features)[None, :]
    weights = ((c * 7 + j * 3) % 11 - 5) / 10.0
    bias = (np.arange(len(classes)) % 3) / 10.0
    return Model(
        (features, len(classes)), np.concatenate([weights.ravel(), bias]), "test:linear", classes)


DENSE_DIMS = (2, 3, 4)


def dense_weight(position: int) -> float:
    """A weight of the small network as a function of its place in the flat vector."""
    return ((position * 7) % 13 - 6) / 5.0


def dense_model() -> Model:
    """A network with one hidden layer, small enough to be written out in SQL."""
    count = parameter_count(DENSE_DIMS)
    return Model(
        DENSE_DIMS, np.array([dense_weight(i) for i in range(count)]), "test:dense",
        EVENT_TAXONOMY.classes)


TEN = tuple(f"c{i}" for i in range(10))
EVENT_MODEL_STATS = FeatureStats(("k", "value"), (3.0, 2.0), (1.5, 0.5))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as experiment runs: one run with three rounds per order.

    Status F is a centralised run, O and P are the two federated methods; scores
    are shares of the price.
    """
    score = F.col("o_totalprice") / 700_001.0
    method = F.when(F.col("o_orderstatus") == "O", "fedavg").when(
        F.col("o_orderstatus") == "P", "fedprox")
    traffic = 1.0 + (F.col("o_custkey") % 7) / 4.0

    def entry(number: int) -> Column:
        value = score * (number / 3.0)
        return F.struct(
            F.lit(number).alias("round"),
            value.alias("global_val_macro_f1"),
            (value * 1.1).alias("global_val_accuracy"),
            (value * 0.9).alias("mean_client_f1"),
            (value * 0.1).alias("std_client_f1"),
            (value * 0.5).alias("worst_client_f1"),
            F.array(*[value * w for w in (0.5, 1.2, 0.8, 1.0)]).alias("client_f1s"),
            traffic.alias("mb_communicated"),
        )

    def class_score(share: float) -> Column:
        return F.struct((score * share).alias("f1"))

    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.when(F.col("o_custkey") % 2 == 0, F.lit("no_iat-")).otherwise(F.lit("full-")),
            F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
        ).alias("run_name"),
        method.alias("method"),
        F.when(method.isNull(), F.lit("mlp")).alias("model_type"),
        F.substring("o_orderpriority", 1, 1).alias("alpha"),
        F.when(method == "fedprox", F.lit(0.01)).otherwise(F.lit(0.0)).alias("mu"),
        F.col("o_custkey").alias("seed"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("lab")).otherwise(F.lit("laptop")).alias("profile"),
        F.lit(4).alias("num_clients"),
        F.lit(3).alias("rounds"),
        F.col("o_orderkey").alias("train_rows"),
        F.struct(
            (score * 1.1).alias("accuracy"),
            score.alias("macro_f1"),
            F.create_map(
                F.lit("Benign"), class_score(1.5), F.lit("DDoS"), class_score(0.5),
            ).alias("per_class"),
        ).alias("test_metrics"),
        F.when(method.isNotNull(), F.array(*[entry(n) for n in (1, 2, 3)])).alias("history"),
    )


def centralized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_documents(spark, sf_dir).filter(F.col("method").isNull())


def federated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_documents(spark, sf_dir).filter(F.col("method").isNotNull())
