"""The registered queries: every operator over the driver tables, with its SQL twin.

``QUERIES[name]`` is a callable ``(spark, sf_dir) -> DataFrame``; ``ORACLES[name]``
the same result in DuckDB SQL, where SQL can say it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.network import initial_weights
from flowlens.functions.scalar import (
    argmax_index, class_index, class_name, columns_to_map, features_to_vector, is_finite,
    model_version, signed_log1p, try_numeric,
)
from flowlens.labels import Taxonomy
from flowlens.operators import alerts as al
from flowlens.operators import baselines as bl
from flowlens.operators import boosting as bs
from flowlens.operators import clean as cl
from flowlens.operators import evaluate as ev
from flowlens.operators import federated as fd
from flowlens.operators import partition as pt
from flowlens.operators import profile as pf
from flowlens.operators import ranking as rk
from flowlens.operators import reports as rp
from flowlens.operators import scoring as sc
from flowlens.operators import split as sp
from flowlens.operators.ranking import group_sizes
from flowlens.plans.etl import run_stages
from flowlens.plans.fixtures import (
    EVENT_MODEL_STATS, EVENT_TAXONOMY, LINE_FEATURES, LINE_KEYS, TEN, alerts, centralized_runs,
    dense_model, dense_weight, dirty_lines, federated_runs, flow_events, labelled_events, line_flows,
    linear_model, millis, rounded, run_documents, table, vectors,
)
from flowlens.session import durable, scratch_path, stored_bytes
from flowlens.sources.flows import load_feature_stats, read_flow_csv, to_flow_events
from flowlens.sources.runs import read_result_csv, read_run_documents
from flowlens.sources.sinks import (
    append_results, pending_keys, write_named_csv, write_partitioned, write_splits, write_table,
)
from flowlens.streaming import events as st
from flowlens.streaming import live as lv
from flowlens.streaming import logs as lg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL twin."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


# --- SQL building blocks -------------------------------------------------------------

CLASS_OF_EVENT = (
    "CASE event_type WHEN 'view' THEN 'Benign' WHEN 'click' THEN 'Benign' "
    "WHEN 'purchase' THEN 'DDoS' WHEN 'signup' THEN 'Recon' ELSE 'Web' END"
)

ALERTS = f"""alerts AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, (epoch_us(ts) // 1000) AS ts_event,
         (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) AS ts_scored, value AS latency_ms,
         'org-' || CAST(user_id % 8 + 1 AS VARCHAR) AS org_id,
         'dev-' || CAST(user_id AS VARCHAR) AS device_id,
         {CLASS_OF_EVENT} AS pred_class, value / (value + 10.0) AS confidence,
         {CLASS_OF_EVENT} <> 'Benign' AS is_attack, event_type AS true_label
  FROM events)"""

LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (epoch_us(l_shipdate) // 1000) AS ship_ms,
         l_discount AS discount, l_extendedprice AS extendedprice, l_quantity AS quantity,
         l_tax AS tax, l_linestatus AS label_34, l_returnflag AS label_8
  FROM lineitem)"""

RANKED = LINES + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label_8 ORDER BY h) AS rank,
         count(*) OVER (PARTITION BY label_8) AS class_rows, count(*) OVER () AS all_rows
  FROM (SELECT *, md5(concat_ws('|', 42, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms))
               AS h FROM lines))"""

DIRTY = """dirty AS (
  SELECT CAST(l_orderkey AS DOUBLE) AS orderkey, CAST(l_linenumber AS DOUBLE) AS linenumber,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_quantity END AS quantity,
         CASE WHEN l_orderkey % 89 = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS tax,
         CASE WHEN l_orderkey % 83 = 0 THEN 'Infinity'::DOUBLE
              WHEN l_orderkey % 79 = 0 THEN '-Infinity'::DOUBLE ELSE l_discount END AS discount,
         CASE WHEN l_orderkey % 73 = 0 THEN '  ' ELSE l_returnflag END AS label
  FROM lineitem)"""

FINITE = (
    "quantity IS NOT NULL AND isfinite(quantity) AND isfinite(tax) AND isfinite(discount) "
    "AND trim(label) <> ''"
)

RUNS = """docs AS (
  SELECT CASE WHEN o_custkey % 2 = 0 THEN 'no_iat-' ELSE 'full-' END
           || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_name,
         CASE o_orderstatus WHEN 'O' THEN 'fedavg' WHEN 'P' THEN 'fedprox' END AS method,
         CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'mlp' END AS model_type,
         substr(o_orderpriority, 1, 1) AS alpha,
         CASE WHEN o_orderstatus = 'P' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS mu,
         o_custkey AS seed,
         CASE WHEN o_custkey % 3 = 0 THEN 'lab' ELSE 'laptop' END AS profile,
         o_orderkey AS train_rows, o_totalprice / 700001.0::DOUBLE AS score,
         1.0::DOUBLE + (o_custkey % 7) / 4.0::DOUBLE AS mb
  FROM orders),
central AS (SELECT * FROM docs WHERE method IS NULL),
fed AS (SELECT * FROM docs WHERE method IS NOT NULL),
rounds AS (
  SELECT fed.*, r.round, score * r.share AS f1
  FROM fed, (VALUES (1, 1 / 3.0::DOUBLE), (2, 2 / 3.0::DOUBLE), (3, 1.0::DOUBLE)) r(round, share))"""


# --- Sources and sinks ---------------------------------------------------------------

@query("SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, "
       "value AS event_value, event_type AS label FROM events")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "events").select(
        F.col("event_id").alias("Event Id"), F.col("user_id").alias("userId"),
        F.col("value").alias("Event  Value"), F.col("event_type").alias(" Label "),
    ).write.csv(path, header=True)
    return read_flow_csv(spark, path).drop("source_file")


@query("SELECT CAST(event_id % 3 AS VARCHAR) AS part, event_type AS label, count(*) AS n, sum(event_id) AS ids "
       "FROM events WHERE event_id % 3 < 2 GROUP BY ALL")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow files of two column orders: the first two of three by name, rows counted by their file."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "events")
    for k, names in enumerate((["event_id", "value", "label"], ["label", "event_id", "value"], ["value", "event_id", "label"])):
        part = rows.filter(F.col("event_id") % 3 == k).withColumnRenamed("event_type", "label").select(*names)
        write_named_csv(part, path, f"part-{k}.csv")
    flows = read_flow_csv(spark, path, max_files=2)
    number = F.regexp_extract("source_file", r"part-(\d)\.csv$", 1)
    return flows.groupBy(number.alias("part"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("bigint").alias("ids"))


@query("""SELECT 'priority-' || substr(o_orderpriority, 1, 1) AS run_name, 'fedavg' AS method, 0.01::DOUBLE AS mu,
  count(*) AS train_rows, round(avg(o_totalprice) / 1000000, 6) AS macro_f1, 2 AS rounds,
  round(max(o_totalprice) / 1000000, 6) AS last_f1 FROM orders GROUP BY o_orderpriority""")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents, one JSON file each beside a broken one, read back."""
    path = scratch_path(spark, "runs")
    price = F.col("o_totalprice").cast("double") / 1_000_000
    runs = durable(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.concat(F.lit("priority-"), F.substring(F.first("o_orderpriority"), 1, 1)).alias("run_name"),
        F.lit("fedavg").alias("method"), F.lit(0.01).alias("mu"), F.lit(2).alias("rounds"),
        F.count(F.lit(1)).alias("train_rows"), F.struct(F.avg(price).alias("macro_f1")).alias("test_metrics"),
        F.array(
            F.struct(F.lit(1).alias("round"), F.min(price).alias("global_val_macro_f1")),
            F.struct(F.lit(2).alias("round"), F.max(price).alias("global_val_macro_f1"))).alias("history"),
    ).drop("o_orderpriority"))
    for (name,) in runs.select("run_name").collect():
        rp.run_detail(runs, name).coalesce(1).write.mode("append").json(path)
    spark.createDataFrame([('{"run_name": "broken", ',)], "value string").coalesce(1).write.mode("append").text(path)
    return rounded(read_run_documents(spark, path).select(
        "run_name", "method", "mu", "train_rows", F.col("test_metrics.macro_f1").alias("macro_f1"), "rounds",
        rp.last_round("global_val_macro_f1").alias("last_f1")))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'unknown') || ':' || p_name AS version FROM part")
def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") > 5, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", model_version(kind, "p_name").alias("version"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_name, o_orderstatus AS method, "
       "o_totalprice AS test_macro_f1, try_cast(o_orderpriority AS DOUBLE) AS alpha FROM orders")
def result_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_name"), F.col("o_orderstatus").alias("method"),
        F.col("o_totalprice").alias("test_macro_f1"), F.col("o_orderpriority").alias("alpha"),
    ).write.csv(path, header=True)
    return read_result_csv(spark, path, ["test_macro_f1", "alpha"])


@query("SELECT event_id, try_cast(trim(substr(props, 7, length(props) - 7)) AS DOUBLE) AS k, "
       "try_cast(event_type AS DOUBLE) AS nothing FROM events")
def numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.expr("substr(props, 7, length(props) - 7)")
    return table(spark, sf_dir, "events").select(
        "event_id", try_numeric(inner).alias("k"), try_numeric("event_type").alias("nothing"))


@query("SELECT l_returnflag AS label_8, count(*) AS n, round(sum(l_quantity), 4) AS quantity "
       "FROM lineitem GROUP BY 1")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "partitioned")
    write_partitioned(line_flows(spark, sf_dir), path, "label_8")
    return spark.read.parquet(path).groupBy("label_8").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query(f"""WITH {RANKED} SELECT label_8, count(*) AS n,
  CASE WHEN rank / class_rows <= 0.03 THEN 'stream'
       WHEN rank / class_rows <= 0.03 + 0.97 * 0.8 THEN 'train'
       WHEN rank / class_rows <= 0.03 + 0.97 * 0.8 + 0.97 * 0.1 THEN 'val' ELSE 'test' END AS split
  FROM ranked GROUP BY ALL""")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    write_splits(sp.stratified_split(
        line_flows(spark, sf_dir), "label_8", LINE_KEYS, portable=True), path)
    return spark.read.parquet(path).groupBy("label_8", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS method, count(*) * 2 AS n FROM orders GROUP BY 1")
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "appended")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("test_macro_f1"))
    append_results(rows, path)
    append_results(rows.select("test_macro_f1", "method"), path)
    return spark.read.parquet(path).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, (epoch_us(ts) // 1000) AS ts_event,
  'org-' || CAST(event_id % 8 + 1 AS VARCHAR) AS org_id,
  'org-' || CAST(event_id % 8 + 1 AS VARCHAR) || '-dev-' ||
    CAST(event_id % ([5, 3, 5, 5, 3, 3, 5, 4])[event_id % 8 + 1] + 1 AS VARCHAR) AS device_id,
  value, CAST(user_id AS DOUBLE) AS user_id, event_type AS true_label FROM events""")
def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ms", millis("ts"))
    flows = to_flow_events(rows, "event_id", ["value", "user_id"], "ms", "event_type")
    return flows.select(
        "*", F.col("features")["value"].alias("value"), F.col("features")["user_id"].alias("user_id")
    ).drop("features")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS event_id, value FROM events
  WHERE {CLASS_OF_EVENT} = 'Benign'""")
def benign_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl.map_labels(
        table(spark, sf_dir, "events").withColumn("ms", millis("ts"))
        .withColumnRenamed("event_type", "label"), EVENT_TAXONOMY)
    flows = to_flow_events(rows, "event_id", ["value"], "ms", "label_8", only_class="Benign")
    return flows.select("event_id", F.col("features")["value"].alias("value"))


@query("SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN "
       "(SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O' AND o_custkey % 3 <> 0)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are requested; those with a finished order, two thirds of them, are done."""
    requested = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O' AND o_custkey % 3 <> 0")
    return pending_keys(requested, done, ["o_custkey"])


# --- Cleaning ------------------------------------------------------------------------

@query(f"WITH {DIRTY} SELECT * FROM dirty WHERE {FINITE}")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.drop_non_finite(dirty_lines(spark, sf_dir))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("label"),
        F.concat(F.lit("file-"), F.col("l_linenumber").cast("string")).alias("source_file"),
    )


@query("SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, "
       "l_returnflag AS label, min('file-' || l_linenumber) AS source_file "
       "FROM lineitem GROUP BY ALL")
def dedup_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.deduplicate(_copies(spark, sf_dir), "global")


@query("SELECT DISTINCT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, "
       "l_returnflag AS label, 'file-' || l_linenumber AS source_file FROM lineitem")
def dedup_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.deduplicate(_copies(spark, sf_dir), "per_file")


@query(f"SELECT event_id, event_type AS label_34, {CLASS_OF_EVENT} AS label_8 FROM events")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"))
    return cl.map_labels(flows, EVENT_TAXONOMY)


LINE_TAXONOMY_SQL = "CASE label WHEN 'A' THEN 'Benign' WHEN 'N' THEN 'DDoS' ELSE 'Recon' END"


LINE_TAXONOMY = Taxonomy(
    ("Benign", "DDoS", "Recon"), {"A": "Benign", "N": "DDoS"}, (("R", "Recon"),))


@query(f"""WITH {DIRTY}, kept AS (SELECT DISTINCT * FROM dirty WHERE {FINITE})
  SELECT label AS label_34, {LINE_TAXONOMY_SQL} AS label_8, orderkey, linenumber, quantity, tax,
         discount FROM kept""")
def clean_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean(dirty_lines(spark, sf_dir), taxonomy=LINE_TAXONOMY)


@query(f"WITH {DIRTY} SELECT count(*) AS raw, count(*) FILTER ({FINITE}) AS clean FROM dirty")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = cl.StageCounter()
    rows = counter.watch(
        cl.drop_non_finite(counter.watch(dirty_lines(spark, sf_dir), "raw")), "clean")
    write_table(rows, scratch_path(spark, "stage"))
    counts = counter.counts()
    return spark.createDataFrame([(counts["raw"], counts["clean"])], "raw bigint, clean bigint")


@query(f"""WITH {DIRTY}, kept AS (SELECT DISTINCT * FROM dirty WHERE {FINITE}),
  counts AS (
    SELECT 'label_8' AS level, {LINE_TAXONOMY_SQL} AS label, count(*) AS n FROM kept GROUP BY ALL
    UNION ALL SELECT 'label_34', label, count(*) FROM kept GROUP BY ALL)
  SELECT level, label, n AS rows, round(n / sum(n) OVER (PARTITION BY level), 6) AS fraction
  FROM counts""")
def etl_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "etl")
    dirty_lines(spark, sf_dir).withColumnRenamed("label", "Label").write.csv(raw, header=True)
    run_stages(spark, raw, out, taxonomy=LINE_TAXONOMY)
    return rounded(spark.read.parquet(f"{out}/class_counts"))


@query(f"""WITH {DIRTY}, raw AS (SELECT *, orderkey % 10 = 0 AS broken FROM dirty)
  SELECT count(*) AS raw, count(*) FILTER (broken) AS malformed, count(*) FILTER (NOT broken) AS parsed
  FROM raw""")
def malformed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV folder, those that are no flows, and those that are."""
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "etl")
    broken = F.when(F.col("orderkey") % 10 == 0, F.lit("no number")).otherwise(
        F.col("orderkey").cast("string"))
    dirty_lines(spark, sf_dir).withColumn("orderkey", broken).withColumnRenamed(
        "label", "Label").write.csv(raw, header=True)
    run_stages(spark, raw, out, taxonomy=LINE_TAXONOMY)
    return spark.read.parquet(f"{out}/stage_counts").select("raw", "malformed", "parsed")


# --- Profile and features ------------------------------------------------------------

@query("""WITH counts AS (
    SELECT 'label_8' AS level, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'label_34', l_linestatus, count(*) FROM lineitem GROUP BY ALL)
  SELECT level, label, n AS rows, round(n / sum(n) OVER (PARTITION BY level), 6) AS fraction
  FROM counts""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.class_counts(line_flows(spark, sf_dir)))


@query("WITH " + DIRTY + " " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    f"count(*) FILTER ({c} IS NULL OR isnan({c})) AS nulls FROM dirty"
    for i, c in enumerate(["discount", "linenumber", "orderkey", "quantity", "tax"])))
def dirty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.feature_summary(dirty_lines(spark, sf_dir)).select(
        "pos", "feature", "min", "max", "nulls"), 4)


@query("WITH " + LINES + " " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    f"round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, 0::BIGINT AS nulls FROM lines"
    for i, c in enumerate(LINE_FEATURES)))
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.feature_summary(line_flows(spark, sf_dir), LINE_FEATURES), 4)


def _log(column: str) -> str:
    return f"sign({column}) * ln(1 + abs({column}))"


@query("WITH " + LINES + " " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, round(avg({_log(c)}), 6) AS mean, "
    f"round(stddev_pop({_log(c)}), 6) AS std FROM lines" for i, c in enumerate(LINE_FEATURES)))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.fit_feature_stats(line_flows(spark, sf_dir), LINE_FEATURES))


@query("WITH " + LINES + " " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, round(avg({_log(c)}), 6) AS mean, "
    f"round(stddev_pop({_log(c)}), 6) AS std FROM lines" for i, c in enumerate(LINE_FEATURES) if c != "tax"))
def stored_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature statistics written as a table and loaded without a dropped feature."""
    path = scratch_path(spark, "stats")
    write_table(pf.fit_feature_stats(line_flows(spark, sf_dir), LINE_FEATURES), path)
    return rounded(load_feature_stats(spark, path, ["tax"]))


@query("WITH " + LINES + " SELECT ["
       + ", ".join(f"'{c}'" for c in LINE_FEATURES) + "][i] AS feature, i - 1 AS place, "
       + "[" + ", ".join(f"round(avg({_log(c)}), 6)" for c in LINE_FEATURES) + "][i] AS mean, "
       + "[" + ", ".join(f"round(stddev_pop({_log(c)}), 6)" for c in LINE_FEATURES) + "][i] AS std "
       + f"FROM lines, (SELECT unnest(range(1, {len(LINE_FEATURES) + 1})) AS i) GROUP BY i")
def stats_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics as one document of parallel arrays, taken apart again."""
    document = pf.stats_document(pf.fit_feature_stats(line_flows(spark, sf_dir), LINE_FEATURES))
    parts = document.select(F.posexplode(F.arrays_zip("feature_names", "mean", "std")).alias("place", "f"))
    return rounded(parts.select(
        F.col("f.feature_names").alias("feature"), F.col("place").cast("long").alias("place"), "f.mean", "f.std"))


# Adding zero turns a rounded -0.0 into 0.0.
STANDARD = ", ".join(
    f"round(({_log(c)} - avg({_log(c)}) OVER ()) / stddev_pop({_log(c)}) OVER (), 4) + 0.0 AS {c}"
    for c in LINE_FEATURES)


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms, label_34, "
       f"label_8, {STANDARD} FROM lines")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = line_flows(spark, sf_dir)
    stats = pf.FeatureStats.collect(pf.fit_feature_stats(flows, LINE_FEATURES))
    return rounded(pf.standardize(flows, stats), 4)


@query(f"WITH {LINES}, scores AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms, "
       f"label_8, {STANDARD} FROM lines) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       "ship_ms, discount AS x0, extendedprice AS x1, quantity AS x2, "
       "CASE label_8 WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM scores")
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = line_flows(spark, sf_dir)
    stats = pf.FeatureStats.collect(pf.fit_feature_stats(flows, LINE_FEATURES))
    frame = pf.training_frame(
        flows, stats, classes=("A", "N", "R"), drop_features=["tax"], keep=LINE_KEYS)
    return rounded(frame.select(
        *LINE_KEYS, *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(3)], "label"), 4)


# --- Ranks, splits, samples ----------------------------------------------------------

@query(f"WITH {RANKED} SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms, "
       "rank FROM ranked")
def stable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.stable_rank(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), "label_8", LINE_KEYS,
        portable=True)


@query(f"""WITH {RANKED}, cut AS (
  SELECT *, CASE WHEN rank / class_rows <= 0.03 THEN 'stream'
       WHEN rank / class_rows <= 0.03 + 0.97 * 0.8 THEN 'train'
       WHEN rank / class_rows <= 0.03 + 0.97 * 0.8 + 0.97 * 0.1 THEN 'val' ELSE 'test' END AS split
  FROM ranked)
  SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms, split FROM cut""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_split(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), "label_8", LINE_KEYS,
        train_cap=None, val_test_cap=None, portable=True)


@query(f"""WITH {RANKED}, cut AS (
  SELECT *, CASE WHEN rank / class_rows <= 0.03 THEN 'stream'
       WHEN rank / class_rows <= 0.03 + 0.97 * 0.8 THEN 'train'
       WHEN rank / class_rows <= 0.03 + 0.97 * 0.8 + 0.97 * 0.1 THEN 'val' ELSE 'test' END AS split
  FROM ranked),
  placed AS (SELECT *, row_number() OVER (PARTITION BY label_8, split ORDER BY rank) AS place,
                    count(*) OVER (PARTITION BY label_8, split) AS part,
                    count(*) OVER (PARTITION BY split) AS total FROM cut)
  SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms, split FROM placed
  WHERE split = 'stream' OR (split = 'train' AND place <= 1000)
     OR (split IN ('val', 'test') AND (total <= 2000 OR place <= part * 2000 // total))""")
def capped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_split(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), "label_8", LINE_KEYS,
        train_cap=1000, val_test_cap=2000, portable=True)


@query(f"WITH {RANKED} SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms "
       "FROM ranked WHERE rank <= 500")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.cap_per_group(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), 500, "label_8", LINE_KEYS,
        portable=True)


@query(f"WITH {RANKED} SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms "
       "FROM ranked WHERE all_rows <= 5000 OR rank <= class_rows * 5000 // all_rows")
def cap_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.cap_total(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), 5000, "label_8", LINE_KEYS,
        portable=True)


@query(f"WITH {RANKED} SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms "
       "FROM ranked WHERE all_rows <= 5000 "
       "OR rank <= round_even(class_rows * (5000 / all_rows), 0)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_sample(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), 5000, "label_8", LINE_KEYS,
        portable=True)


@query(f"WITH {RANKED} SELECT label_8, l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_ms "
       "FROM ranked WHERE all_rows <= 5000 OR ('0x' || substr(h, 1, 15))::BIGINT "
       "< CAST(floor(5000 / all_rows * 1152921504606846976::DOUBLE) AS BIGINT)")
def bernoulli_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.bernoulli_cap(
        line_flows(spark, sf_dir).select("label_8", *LINE_KEYS), 5000, "label_8", LINE_KEYS,
        portable=True)


# --- Evaluation ----------------------------------------------------------------------

PREDICTED = f"""predicted AS (
  SELECT {CLASS_OF_EVENT} AS truth,
         (['Benign', 'DDoS', 'Recon', 'Spoofing'])[CAST(floor(value) AS BIGINT) % 4 + 1] AS prediction
  FROM events)"""
TALLY = PREDICTED + """, sides AS (
  SELECT truth AS cls, count(*) AS support, 0 AS predicted,
         count(*) FILTER (truth = prediction) AS tp FROM predicted GROUP BY 1
  UNION ALL SELECT prediction, 0, count(*), 0 FROM predicted GROUP BY 1),
tally AS (
  SELECT cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM sides
  GROUP BY 1),
scores AS (
  SELECT cls, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp,
         CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
         CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
  FROM tally)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in ("Benign", "DDoS", "Recon", "Spoofing")])
    return alerts(spark, sf_dir).select(
        F.col("pred_class").alias("truth"),
        F.get(names, (F.floor("latency_ms") % 4).cast("int")).alias("prediction"))


@query("""SELECT t.v AS truth, p.v AS prediction, count(l.doc_id) AS n
  FROM (VALUES (0), (1), (2)) t(v) CROSS JOIN (VALUES (0), (1), (2)) p(v)
  LEFT JOIN labels l ON l.quality = t.v AND l.toxic = p.v GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2])


@query(f"""WITH {PREDICTED} SELECT c.v AS truth,
  count(*) FILTER (prediction = 'Benign') AS "Benign", count(*) FILTER (prediction = 'DDoS') AS "DDoS",
  count(*) FILTER (prediction = 'Recon') AS "Recon", count(*) FILTER (prediction = 'Web') AS "Web"
  FROM (VALUES ('Benign'), ('DDoS'), ('Recon'), ('Web')) c(v)
  LEFT JOIN predicted ON truth = c.v GROUP BY 1""")
def confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_pivot(
        _predictions(spark, sf_dir), "truth", "prediction", EVENT_TAXONOMY.classes)


@query(f"""WITH {TALLY} SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS rows FROM scores""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.classification_metrics(
        _predictions(spark, sf_dir), "truth", "prediction"))


@query(f"""WITH {TALLY} SELECT c.v AS cls, coalesce(round(precision, 6), 0) AS precision,
  coalesce(round(recall, 6), 0) AS recall, coalesce(round(f1, 6), 0) AS f1,
  coalesce(support, 0) AS support
  FROM (VALUES ('Benign'), ('DDoS'), ('Recon'), ('Web'), ('Mirai')) c(v)
  LEFT JOIN scores ON cls = c.v""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.class_report(
        _predictions(spark, sf_dir), "truth", "prediction",
        [*EVENT_TAXONOMY.classes, "Mirai"]))


# --- Scoring -------------------------------------------------------------------------

def _linear_logits(vector: str, features: int, classes: int) -> str:
    """SQL list of the logits of ``linear_model``."""
    lines = []
    for c in range(classes):
        weights = ", ".join(f"{((c * 7 + j * 3) % 11 - 5) / 10.0}::DOUBLE" for j in range(features))
        lines.append(f"list_dot_product({vector}, [{weights}]) + {(c % 3) / 10.0}::DOUBLE")
    return "[" + ", ".join(lines) + "]"


VECTOR_SCORES = f"""logits AS (
  SELECT vec_id, label, {_linear_logits('CAST(embedding AS DOUBLE[])', 64, 10)} AS z FROM embeddings),
exps AS (SELECT vec_id, label, [exp(v - list_max(z)) for v in z] AS e FROM logits),
probs AS (SELECT vec_id, label, [v / list_sum(e) for v in e] AS p FROM exps)"""


@query(f"""WITH {VECTOR_SCORES} SELECT vec_id, list_position(p, list_max(p)) - 1 AS prediction,
  round(list_max(p), 6) AS confidence, round(p[1], 6) AS p_first, round(p[10], 6) AS p_last
  FROM probs""")
def score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    scored = rows.withColumn(
        "p", sc.class_probabilities("features", linear_model(64, TEN)))
    return rounded(scored.select(
        "vec_id", argmax_index("p").alias("prediction"), F.array_max("p").alias("confidence"),
        F.get("p", F.lit(0)).alias("p_first"), F.get("p", F.lit(9)).alias("p_last")))


@query(f"""WITH {VECTOR_SCORES} SELECT vec_id, round(list_max(p), 6) AS confidence FROM probs""")
def softmax_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same probabilities from column expressions alone."""
    probs = sc.linear_probabilities("features", linear_model(64, TEN))
    return rounded(vectors(spark, sf_dir).select("vec_id", F.array_max(probs).alias("confidence")))


EVENT_LOGITS = """inputs AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, (epoch_us(ts) // 1000) AS ts_event,
         'org-' || CAST(user_id % 8 + 1 AS VARCHAR) AS org_id, event_type AS true_label,
         [CAST(CAST((ln(1 + CAST(props ->> '$.k' AS DOUBLE)) - 3.0) / 1.5 AS FLOAT) AS DOUBLE),
          CAST(CAST((sign(value) * ln(1 + abs(value)) - 2.0) / 0.5 AS FLOAT) AS DOUBLE)] AS x
  FROM events),
logits AS (SELECT *, """ + _linear_logits("x", 2, 4) + """ AS z FROM inputs),
exps AS (SELECT *, [exp(v - list_max(z)) for v in z] AS e FROM logits),
probs AS (SELECT *, [v / list_sum(e) for v in e] AS p FROM exps),
scored AS (SELECT *, (['Benign', 'DDoS', 'Recon', 'Web'])[list_position(p, list_max(p))] AS pred_class,
                  list_max(p) AS confidence FROM probs)"""


def _event_model() -> sc.Model:
    return linear_model(2, EVENT_TAXONOMY.classes)


@query(f"""WITH {EVENT_LOGITS} SELECT event_id, ts_event, 1706745600000 AS ts_scored,
  CAST(1706745600000 - ts_event AS DOUBLE) AS latency_ms, org_id, pred_class,
  round(confidence, 6) AS confidence, round(p[2], 6) AS p_ddos, pred_class <> 'Benign' AS is_attack,
  true_label, 'test:linear' AS model_version FROM scored""")
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sc.score_events(
        flow_events(spark, sf_dir), _event_model(), EVENT_MODEL_STATS, ts_scored=1706745600000)
    return rounded(scored.withColumn("p_ddos", F.col("probs")["DDoS"]).drop("probs", "device_id"))


def _dense_sql() -> str:
    """Hidden layer, layer norm, GELU and output layer of ``dense_model`` as CTEs."""
    w = [f"{dense_weight(i)}::DOUBLE" for i in range(31)]
    hidden = ", ".join(f"x[1] * {w[2 * i]} + x[2] * {w[2 * i + 1]} + {w[6 + i]}" for i in range(3))
    shifted = ", ".join(
        f"(z[{i + 1}] - m) / sqrt(v + 1e-5::DOUBLE) * {w[9 + i]} + {w[12 + i]}" for i in range(3))
    out = ", ".join(
        " + ".join([f"a[{j + 1}] * {w[15 + 3 * c + j]}" for j in range(3)] + [w[27 + c]])
        for c in range(4))
    t = "(1 / (1 + 0.3275911::DOUBLE * abs(u) / sqrt(2::DOUBLE)))"
    erf = (
        f"sign(u) * (1 - {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * "
        f"(1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) "
        "* exp(-u * u / 2))")
    return f"""h AS (SELECT event_id, [{hidden}] AS z FROM inputs),
moments AS (SELECT *, list_avg(z) AS m FROM h),
spread AS (SELECT *, list_avg([(e - m) * (e - m) for e in z]) AS v FROM moments),
normed AS (SELECT event_id, [{shifted}] AS n FROM spread),
active AS (SELECT event_id, [u * 0.5 * (1 + {erf}) for u in n] AS a FROM normed),
outputs AS (SELECT event_id, [{out}] AS z FROM active),
dense_exps AS (SELECT event_id, [exp(e - list_max(z)) for e in z] AS e FROM outputs),
dense AS (SELECT event_id, [v / list_sum(e) for v in e] AS p FROM dense_exps)"""


@query(f"""WITH {EVENT_LOGITS}, {_dense_sql()} SELECT event_id, round(p[1], 6) AS p0,
  round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3 FROM dense""")
def score_dense_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer norm and GELU, checked against the same network written in SQL."""
    vector = features_to_vector("features", EVENT_MODEL_STATS.names)
    scored = flow_events(spark, sf_dir).select(
        "event_id", sc.class_probabilities(vector, dense_model(), EVENT_MODEL_STATS).alias("p"))
    return rounded(scored.select(
        "event_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(4)]))


@query()
def score_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = (64, 256, 128, 64, 10)
    model = sc.Model(dims, initial_weights(dims, 42), "test:mlp", TEN)
    return vectors(spark, sf_dir).select(
        "vec_id", argmax_index("features").alias("largest_feature"),
        sc.class_probabilities("features", model).alias("probs"))


@query(f"""WITH {VECTOR_SCORES} SELECT count(*) AS rows,
  0::BIGINT AS unmatched, 0::BIGINT AS mismatched,
  round(max(list_max([abs(v - round(v, 3)) for v in p])), 6) AS max_abs_diff,
  max(list_max([abs(v - round(v, 3)) for v in p])) <= 1e-4 AS within FROM probs""")
def score_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select(
        "vec_id", sc.class_probabilities("features", linear_model(64, TEN)).alias("probs"))
    coarse = scored.select(
        "vec_id", F.transform("probs", lambda v: F.round(v, 3)).alias("probs"))
    return rounded(sc.score_parity(scored, coarse, "vec_id"))


@query(f"""WITH {VECTOR_SCORES} SELECT count_if(vec_id % 5 <> 0 AND vec_id % 7 <> 0) AS rows,
  count_if((vec_id % 5 = 0) <> (vec_id % 7 = 0)) AS unmatched,
  count_if(vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 = 0) AS mismatched,
  0.0::DOUBLE AS max_abs_diff, false AS within FROM probs""")
def parity_of_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one side lacks and shorter vectors show, although nothing else differs."""
    scored = vectors(spark, sf_dir).select(
        "vec_id", sc.class_probabilities("features", linear_model(64, TEN)).alias("probs"))
    short = F.when(F.col("vec_id") % 11 == 0, F.slice("probs", 1, 2)).otherwise(F.col("probs"))
    return rounded(sc.score_parity(
        scored.filter("vec_id % 5 <> 0"),
        scored.filter("vec_id % 7 <> 0").withColumn("probs", short), "vec_id"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(props ->> '$.k' AS DOUBLE) AS k, value, "
       "0.0::DOUBLE AS absent FROM events")
def vector_from_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = features_to_vector("features", ["k", "value", "absent"])
    return flow_events(spark, sf_dir).select("event_id", vector.alias("v")).select(
        "event_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(["k", "value", "absent"])])


# --- Streams -------------------------------------------------------------------------

RAW_TEXT = """raw AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'malformed'
       WHEN event_id % 89 = 0 THEN 'missing event_id'
       WHEN event_id % 83 = 0 THEN 'missing features' END AS reason, value, user_id, event_type, ts
  FROM events)"""


def _raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FlowEvents as JSON texts, some of them broken, some without the optional fields."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id")
    whole = F.struct(
        F.when(number % 89 != 0, number.cast("string")).alias("event_id"),
        millis("ts").alias("ts_event"),
        F.when(number % 5 != 0, F.concat(
            F.lit("org-"), (F.col("user_id") % 8 + 1).cast("string"))).alias("org_id"),
        F.when(number % 83 != 0, F.create_map(F.lit("value"), F.col("value"))).alias("features"),
        F.col("event_type").alias("true_label"),
    )
    return events.select(
        F.when(number % 97 == 0, F.lit("nope")).otherwise(F.to_json(whole)).alias("value"))


@query(f"""WITH {RAW_TEXT} SELECT CAST(event_id AS VARCHAR) AS event_id, (epoch_us(ts) // 1000) AS ts_event,
  CASE WHEN event_id % 5 = 0 THEN 'default' ELSE 'org-' || CAST(user_id % 8 + 1 AS VARCHAR) END
    AS org_id, '' AS device_id, value, event_type AS true_label FROM raw WHERE reason IS NULL""")
def parse_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, _ = st.parse_flows(_raw_texts(spark, sf_dir))
    return flows.withColumn("value", F.col("features")["value"]).drop("features")


@query(f"WITH {RAW_TEXT} SELECT reason, count(*) AS n FROM raw WHERE reason IS NOT NULL GROUP BY 1")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dead = st.parse_flows(_raw_texts(spark, sf_dir))
    return dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ALERTS} SELECT event_id, 'default' AS org_id, device_id, pred_class,
  '' AS model_version, round(confidence, 6) AS confidence FROM alerts
  WHERE NOT (pred_class = 'Web' AND is_attack)""")
def validate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).drop("org_id").withColumn(
        "pred_class", F.when(F.col("pred_class") != "Web", F.col("pred_class"))
    ).withColumn("probs", F.create_map(F.lit("Benign"), F.col("confidence")))
    valid, _ = st.validate_events(rows, "alert")
    return rounded(valid.select(
        "event_id", "org_id", "device_id", "pred_class", "model_version", "confidence"))


@query(f"""WITH {ALERTS} SELECT event_id, org_id, pred_class, is_attack, ts_scored, true_label,
  round(confidence, 6) AS confidence, round(confidence, 6) AS benign FROM alerts""")
def alert_wire_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn(
        "probs", F.create_map(F.lit("Benign"), F.col("confidence")))
    decoded, _ = st.decode_alerts(st.encode_event(rows, "device_id"))
    return rounded(decoded.select(
        "event_id", "org_id", "pred_class", "is_attack", "ts_scored", "true_label", "confidence",
        F.col("probs")["Benign"].alias("benign")))


WINDOWS = f"""WITH {ALERTS} SELECT ts_event - ts_event % 10000 AS window_start,
  ts_event - ts_event % 10000 + 10000 AS window_end, org_id, count(*) AS total,
  count(*) FILTER (is_attack) AS attacks, count(*) FILTER (pred_class = 'Benign') AS n_benign,
  count(*) FILTER (pred_class = 'DDoS') AS n_ddos, count(*) FILTER (pred_class = 'Recon') AS n_recon,
  count(*) FILTER (pred_class = 'Web') AS n_web FROM alerts GROUP BY ALL"""


def _flat_windows(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "window_start", "window_end", "org_id", "total", "attacks",
        *[F.col("by_class")[c].alias(f"n_{c.lower()}") for c in EVENT_TAXONOMY.classes])


@query(WINDOWS)
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_windows(st.window_metrics(alerts(spark, sf_dir), EVENT_TAXONOMY.classes))


DAYS = WINDOWS.replace("10000", "86400000")


@query(DAYS)
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day: every class repeats in them."""
    return _flat_windows(st.window_metrics(
        alerts(spark, sf_dir), EVENT_TAXONOMY.classes, window="1 day"))


@query(DAYS)
def metrics_wire_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics sent as JSON, read back, broken messages set aside."""
    metrics = st.window_metrics(alerts(spark, sf_dir), EVENT_TAXONOMY.classes, window="1 day")
    sent = st.encode_event(metrics, "org_id").select("value")
    broken = sent.select(F.expr("substr(value, 1, 20)").alias("value"))
    return _flat_windows(st.decode_metrics(sent.unionByName(broken))[0])


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return st.flow_stream(spark, "parquet", f"{sf_dir}/events*.parquet", schema)


@query(WINDOWS)
def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed metrics computed by a streaming query in update mode."""
    log = scratch_path(spark, "metrics")
    metrics = st.window_metrics(
        labelled_events(_event_stream(spark, sf_dir)), EVENT_TAXONOMY.classes)
    lg.metrics_log_sink(
        metrics, log, scratch_path(spark, "metrics-state"), {"availableNow": True},
        EVENT_TAXONOMY.classes).awaitTermination()
    return _flat_windows(lg.read_metrics_log(spark, log, EVENT_TAXONOMY.classes))


# Stored bytes of ``events`` for each file that arrives.
ARRIVAL_BYTES = 2_000_000


def _arrivals(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """The alerts as a stream of ``parts`` batches; the n-th holds the event ids of remainder n.

    All batches have the same number of files, which follows the size of the table.
    """
    path = scratch_path(spark, "arrivals")
    rows = alerts(spark, sf_dir)
    files = math.ceil(stored_bytes(spark, f"{sf_dir}/events.parquet") / parts / ARRIVAL_BYTES)
    for k in range(parts):
        rows.filter(F.col("event_id").cast("bigint") % parts == k).repartition(files, "event_id").write.mode(
            "append").parquet(path)
    return st.flow_stream(spark, "parquet", path, rows.schema, maxFilesPerTrigger=str(files))


@query(WINDOWS)
def folded_metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from rows that arrive in six parts, the log folded after every second one."""
    log = scratch_path(spark, "metrics")
    metrics = st.window_metrics(
        _arrivals(spark, sf_dir, 6), EVENT_TAXONOMY.classes, watermark="60 days")
    lg.metrics_log_sink(
        metrics, log, scratch_path(spark, "metrics-state"), {"availableNow": True},
        EVENT_TAXONOMY.classes, compact_every=2).awaitTermination()
    return _flat_windows(lg.read_metrics_log(spark, log, EVENT_TAXONOMY.classes))


@query(f"""WITH {ALERTS}, arrived AS (SELECT *, CAST(event_id AS BIGINT) % 4 AS part FROM alerts),
clocks AS (SELECT part, max(max(ts_event)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM arrived GROUP BY part)
SELECT coalesce((ts_event // 10000 + 1) * 10000 <= newest - 30000, false) AS late, org_id, count(*) AS n
FROM arrived JOIN clocks USING (part) GROUP BY ALL""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in time and rows behind the watermark, of a stream that arrives in four parts."""
    kept, late = scratch_path(spark, "kept"), scratch_path(spark, "late")
    st.split_late_rows(
        _arrivals(spark, sf_dir, 4), kept, late, scratch_path(spark, "late-state"),
        trigger={"availableNow": True}).awaitTermination()
    both = spark.read.parquet(kept).withColumn("late", F.lit(False)).unionByName(
        spark.read.parquet(late).withColumn("late", F.lit(True)))
    return both.groupBy("late", "org_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENT_LOGITS} SELECT pred_class, org_id, count(*) AS n,
  round(sum(confidence), 4) AS confidence FROM scored GROUP BY ALL""")
def scoring_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts in, alerts table out, the model taken from the registry."""
    raw, base = scratch_path(spark, "flows"), scratch_path(spark, "scoring")
    flow_events(spark, sf_dir).select(
        F.to_json(F.struct("*")).alias("value")).write.text(raw)
    st.write_registry(
        spark, f"{base}/registry", _event_model(), EVENT_MODEL_STATS, "test", "linear", "2024-01-01")
    st.run_scoring_stream(
        st.flow_stream(spark, "text", raw), f"{base}/registry", f"{base}/alerts", f"{base}/dead",
        f"{base}/state", {"availableNow": True},
    ).awaitTermination()
    return rounded(spark.read.parquet(f"{base}/alerts").groupBy("pred_class", "org_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence")), 4)


@query(f"""WITH {EVENT_LOGITS} SELECT event_id, ts_event, org_id, pred_class, round(confidence, 6) AS confidence,
  pred_class <> 'Benign' AS is_attack, 'test:linear' AS model_version FROM scored""")
def alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as a stream, scored by a fixed model into a table of alerts; run twice on one checkpoint."""
    raw, out, state = (scratch_path(spark, n) for n in ("flows", "alerts", "alerts-state"))
    rows = flow_events(spark, sf_dir)
    rows.write.parquet(raw)
    for _ in range(2):
        st.alerts_query(
            st.flow_stream(spark, "parquet", raw, rows.schema), _event_model(), EVENT_MODEL_STATS, state,
            fmt="parquet", path=out, trigger={"availableNow": True}).awaitTermination()
    return rounded(spark.read.parquet(out).select(
        "event_id", "ts_event", "org_id", "pred_class", "confidence", "is_attack", "model_version"))


# --- Alerts --------------------------------------------------------------------------

AS_OF = 1706745600000


@query(f"WITH {ALERTS} SELECT event_id, ts_event, org_id, device_id, pred_class, "
       "round(confidence, 3) AS confidence, round(latency_ms, 1) AS latency_ms, is_attack, "
       "true_label FROM alerts WHERE is_attack AND org_id = 'org-3' "
       "ORDER BY ts_scored DESC, event_id DESC LIMIT 50")
def latest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.latest_alerts(
        alerts(spark, sf_dir), only_attacks=True, org_id="org-3", display=True)


@query(f"WITH {ALERTS} SELECT event_id, ts_scored, org_id FROM alerts "
       "ORDER BY ts_scored DESC, event_id DESC LIMIT 5000")
def retained_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.retained_alerts(alerts(spark, sf_dir)).select("event_id", "ts_scored", "org_id")


@query(f"WITH {ALERTS} SELECT org_id, count(*) AS alert_count FROM alerts GROUP BY 1")
def org_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.org_counts(alerts(spark, sf_dir))


def _live_sql(as_of: int) -> str:
    return f"""WITH {ALERTS}, seen AS (SELECT * FROM alerts WHERE ts_scored <= {as_of}),
recent AS (SELECT latency_ms FROM seen ORDER BY ts_scored DESC, event_id DESC LIMIT 500),
fast AS (SELECT * FROM seen WHERE ts_scored > {as_of} - 86400000)
SELECT 'rates' AS section, 'events_per_s' AS key, round(count(*) / 86400.0, 1) AS value FROM fast
UNION ALL SELECT 'rates', 'threats_in_window', count(*) FILTER (is_attack) FROM fast
UNION ALL SELECT 'totals', 'alerts', count(*) FROM seen
UNION ALL SELECT 'by_class', c.v, count(event_id)
  FROM (VALUES ('Benign'), ('DDoS'), ('Recon'), ('Web')) c(v) LEFT JOIN seen ON pred_class = c.v
  GROUP BY ALL
UNION ALL SELECT 'by_org', org_id, count(*) FROM seen GROUP BY ALL
UNION ALL SELECT 'latency', 'p50_ms', round(quantile_cont(latency_ms, 0.5), 1) FROM recent
UNION ALL SELECT 'latency', 'p95_ms', round(quantile_cont(latency_ms, 0.95), 1) FROM recent"""


@query(_live_sql(AS_OF))
def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.live_summary(
        alerts(spark, sf_dir), AS_OF, EVENT_TAXONOMY.classes, window_s=86400)


# After the last event of the table.
LIVE_AS_OF = 1706659260000


@query(_live_sql(LIVE_AS_OF))
def live_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live summary read from the state of a stream over the alerts."""
    state = scratch_path(spark, "live")
    lv.live_state_query(
        _arrivals(spark, sf_dir, 3), state, window_s=86400, trigger={"availableNow": True}).awaitTermination()
    return lv.live_view(spark, state, LIVE_AS_OF, EVENT_TAXONOMY.classes, window_s=86400)


@query(f"WITH {ALERTS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS statistic, round({e}, 1) AS value FROM alerts" for n, e in (
        ("p50", "quantile_cont(latency_ms, 0.5)"), ("p95", "quantile_cont(latency_ms, 0.95)"),
        ("p99", "quantile_cont(latency_ms, 0.99)"), ("mean", "avg(latency_ms)"),
        ("min", "min(latency_ms)"), ("max", "max(latency_ms)"))))
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.latency_report(alerts(spark, sf_dir))


@query(f"""WITH {ALERTS}, sent AS (SELECT event_id FROM alerts WHERE pred_class <> 'Web')
SELECT (SELECT count(*) FROM sent) AS events_sent, count(*) AS events_received,
  round(count(*) * 100.0 / (SELECT count(*) FROM sent), 1) AS receive_rate,
  round((SELECT count(*) FROM sent) / 60.0, 1) AS send_throughput_eps,
  round(count(*) / 120.0, 1) AS end_to_end_throughput_eps
FROM alerts WHERE is_attack AND event_id IN (SELECT event_id FROM sent)""")
def delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir)
    return al.delivery_report(
        rows.filter("is_attack"), rows.filter("pred_class <> 'Web'"), 60.0, 120.0)


# --- Federated -----------------------------------------------------------------------

@query("""WITH ranked AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat_ws('|', 42, vec_id))) AS rank,
         count(*) OVER () AS n FROM embeddings)
  SELECT vec_id, CAST(CASE WHEN rank <= (n // 4 + 1) * (n % 4) THEN (rank - 1) // (n // 4 + 1)
    ELSE (n % 4) + (rank - 1 - (n // 4 + 1) * (n % 4)) // (n // 4) END AS INTEGER) AS client_id
  FROM ranked""")
def iid_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.assign_clients(
        vectors(spark, sf_dir).select("vec_id", "label"), 4, "iid", keys=["vec_id"], portable=True
    ).drop("label")


# The plan of the skewed clients: fractions of every class, and the fewest rows of a client.
FRACTIONS = pt.dirichlet_fractions(range(10), 4, 0.5)
FEWEST = 100


def _skewed_sql() -> str:
    """CTEs up to ``skewed`` (vec_id, label, client_id): rounds of rows moved from the largest client."""
    values = ", ".join(
        f"({label}, {k}, {float(f)!r}::DOUBLE)" for label, row in FRACTIONS.items() for k, f in enumerate(row))
    steps = [f"""plan(label, client, fraction) AS (VALUES {values}),
exact AS (SELECT label, client, n, fraction * n AS part, floor(fraction * n) AS whole
  FROM plan JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)),
counted AS (SELECT label, client, whole + CASE WHEN
    row_number() OVER (PARTITION BY label ORDER BY whole - part, client) <=
    n - sum(whole) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS rows FROM exact),
ends AS (SELECT *, sum(rows) OVER (PARTITION BY label ORDER BY client) AS hi FROM counted),
drawn AS (SELECT vec_id, label, row_number() OVER (
    PARTITION BY label ORDER BY md5(concat_ws('|', 42, vec_id))) AS rank FROM embeddings),
m0 AS MATERIALIZED (SELECT vec_id, drawn.label, client, row_number() OVER (
    PARTITION BY client ORDER BY drawn.label, rank) AS place
  FROM drawn JOIN ends ON drawn.label = ends.label AND rank > hi - rows AND rank <= hi)"""]
    for k in range(pt.REPAIR_ROUNDS):
        steps.append(f"""t{k} AS MATERIALIZED (SELECT client, count(vec_id) AS n
  FROM (SELECT unnest(range(4)) AS client) LEFT JOIN m{k} USING (client) GROUP BY 1),
s{k} AS MATERIALIZED (SELECT arg_min(client, n * 4 + client) AS poor, arg_max(client, n * 4 - client) AS rich,
    min(n) AS low, max(n) AS high, greatest(0, least({FEWEST} - min(n), max(n) - {FEWEST})) AS need FROM t{k}),
m{k + 1} AS MATERIALIZED (SELECT vec_id, label,
    CASE WHEN client = rich AND place > high - need THEN poor ELSE client END AS client,
    CASE WHEN client = rich AND place > high - need THEN low + place - (high - need) ELSE place END AS place
  FROM m{k}, s{k})""")
    return ", ".join(steps) + f""", skewed AS (
  SELECT vec_id, label, CAST(client AS INTEGER) AS client_id FROM m{pt.REPAIR_ROUNDS})"""


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.assign_clients(
        vectors(spark, sf_dir), 4, 0.5, keys=["vec_id"], min_samples=FEWEST, portable=True, fractions=FRACTIONS)


@query(f"WITH {_skewed_sql()} SELECT * FROM skewed")
def skewed_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's client under label skew, poor clients raised from the largest one."""
    return _skewed(spark, sf_dir).select("vec_id", "label", "client_id")


@query(f"""WITH {_skewed_sql()} SELECT client_id, count(*) AS rows, """ + ", ".join(
    f"count(*) FILTER (label = {c}) AS class_{c}" for c in range(10)) + " FROM skewed GROUP BY 1")
def client_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.client_distribution(_skewed(spark, sf_dir), range(10))


@query("SELECT label, count(*) AS rows FROM embeddings GROUP BY 1")
def skewed_clients_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Dirichlet partition loses and repeats no row: its class totals are the table's."""
    clients = pt.assign_clients(vectors(spark, sf_dir), 4, 0.5, keys=["vec_id"], min_samples=50)
    by_client = clients.groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return by_client.groupBy("label").agg(F.sum("n").alias("rows"))


@query("""WITH ranked AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 42, vec_id)))
         AS rank, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
  SELECT vec_id, label AS client_id, rank <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))
         AS is_val FROM ranked""")
def client_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.col("label").alias("client_id"))
    return pt.client_holdout(rows, keys=["vec_id"], portable=True)


@query("""WITH parts AS (
  SELECT label + 1 AS n, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings)
  SELECT CAST(pos AS INTEGER) AS pos, round(sum(n * CAST(v AS DOUBLE)) / sum(n), 6) AS value
  FROM parts GROUP BY 1""")
def federated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = vectors(spark, sf_dir).select(
        F.col("features").alias("weights"), (F.col("label") + 1).alias("n"))
    return rounded(fd.federated_average(models))


@query("""SELECT round(avg(value), 4) AS mean_client_f1, round(stddev_pop(value), 4) AS std_client_f1,
  round(min(value), 4) AS worst_client_f1, round(avg(user_id), 4) AS mean_client_loss,
  round(54600 * 4.0 / 1048576 * (count(*) + 1), 2) AS mb_communicated FROM events""")
def round_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(
        F.col("value").alias("macro_f1"), F.col("user_id").cast("double").alias("loss"))
    return rounded(fd.round_summary(results, 54600), 4)


@query("""WITH ranked AS (
  SELECT vec_id, label, embedding, md5(concat_ws('|', 42, vec_id)) AS h,
         row_number() OVER (ORDER BY md5(concat_ws('|', 42, vec_id))) AS rank,
         count(*) OVER () AS n FROM embeddings),
clients AS (
  SELECT *, CASE WHEN rank <= (n // 4 + 1) * (n % 4) THEN (rank - 1) // (n // 4 + 1)
    ELSE (n % 4) + (rank - 1 - (n // 4 + 1) * (n % 4)) // (n // 4) END AS client FROM ranked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY h) AS place,
         count(*) OVER (PARTITION BY client) AS size FROM clients),
train AS (
  SELECT * FROM placed WHERE place > greatest(1, CAST(floor(size * 0.1::DOUBLE) AS BIGINT))),
cells AS (
  SELECT label, CAST(unnest(list_append(CAST(embedding AS DOUBLE[]), 1::DOUBLE)) AS DOUBLE) AS v,
         unnest(range(65)) AS j FROM train),
sums AS (SELECT label, j, sum(v) AS s FROM cells GROUP BY ALL),
totals AS (SELECT j, sum(s) AS t FROM sums GROUP BY ALL)
SELECT CAST(CASE WHEN j = 64 THEN 640 + c.v ELSE c.v * 64 + j END AS INTEGER) AS pos,
  round(-0.5::DOUBLE * (0.1::DOUBLE * t - coalesce(s, 0)) / (SELECT count(*) FROM train), 6) + 0.0
    AS value
FROM totals CROSS JOIN range(10) c(v) LEFT JOIN sums USING (j) WHERE sums.label = c.v
UNION ALL
SELECT CAST(CASE WHEN j = 64 THEN 640 + c.v ELSE c.v * 64 + j END AS INTEGER),
  round(-0.05::DOUBLE * t / (SELECT count(*) FROM train), 6) + 0.0
FROM totals CROSS JOIN range(10) c(v) WHERE c.v NOT IN (SELECT label FROM train)""")
def fedavg_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full-batch step per client from zero weights, averaged: a closed form in SQL."""
    settings = fd.LocalTraining((64, 10), epochs=1, rate=0.5, batch=10**9, dropout=0.0, block=16)
    # Shards of 32 rows: every client's one step is the sum of several tasks.
    trained = fd.train_clients(_equal_clients(spark, sf_dir, 32), np.zeros(650), settings, shard_rows=32)
    # Adding zero turns a rounded -0.0 into 0.0.
    return fd.federated_average(trained).select(
        "pos", (F.round("value", 6) + F.lit(0.0)).alias("value"))


# Four equal clients with their holdouts; a row's features end with the 1 of the bias.
CLIENT_ROWS = """ranked AS (
  SELECT vec_id, label, embedding, md5(concat_ws('|', 42, vec_id)) AS h,
         row_number() OVER (ORDER BY md5(concat_ws('|', 42, vec_id))) AS rank,
         count(*) OVER () AS n FROM embeddings),
clients AS (
  SELECT *, CAST(CASE WHEN rank <= (n // 4 + 1) * (n % 4) THEN (rank - 1) // (n // 4 + 1)
    ELSE (n % 4) + (rank - 1 - (n // 4 + 1) * (n % 4)) // (n // 4) END AS INTEGER) AS client FROM ranked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY h) AS place,
         count(*) OVER (PARTITION BY client) AS size FROM clients),
held AS MATERIALIZED (
  SELECT vec_id, client, CAST(label AS INTEGER) AS label, list_append(CAST(embedding AS DOUBLE[]), 1::DOUBLE) AS x,
         place <= greatest(1, CAST(floor(size * 0.1::DOUBLE) AS BIGINT)) AS is_val FROM placed),
train AS MATERIALIZED (SELECT * FROM held WHERE NOT is_val),
zeros AS (SELECT client, CAST(cls AS INTEGER) AS cls, list_resize([0::DOUBLE], 65, 0::DOUBLE) AS w
  FROM (SELECT DISTINCT client FROM held), range(10) c(cls))"""


def _linear_step(rows: str, before: str, after: str, rate: float, mu: float = 0.0) -> str:
    """CTEs: every client's linear softmax model after one step on all of its ``rows``.

    ``before`` and ``after`` hold (client, cls, w); ``mu`` pulls to zero weights.
    ``after_p`` has each row's probability of each class before the step.
    """
    return f"""{after}_z AS (
  SELECT client, vec_id, label, cls, x, exp(list_dot_product(x, w)) AS z FROM {rows} JOIN {before} USING (client)),
{after}_p AS MATERIALIZED (SELECT *, z / sum(z) OVER (PARTITION BY client, vec_id) AS p FROM {after}_z),
{after}_g AS (SELECT client, cls, j, sum(e * v) / count(*) AS g FROM (
    SELECT client, cls, p - CASE WHEN label = cls THEN 1 ELSE 0 END AS e, unnest(x) AS v, unnest(range(65)) AS j
    FROM {after}_p) GROUP BY ALL),
{after} AS MATERIALIZED (SELECT client, cls, list(w[j + 1] - {rate}::DOUBLE * (g + {mu}::DOUBLE * w[j + 1]) ORDER BY j) AS w
  FROM {after}_g JOIN {before} USING (client, cls) GROUP BY ALL)"""


def _model_scores(name: str, rows: str, weights: str) -> str:
    """CTEs: macro F1 and accuracy of every client's model on the rows of that client number."""
    return f"""{name}_r AS MATERIALIZED (SELECT client, vec_id, label AS truth, arg_max(cls, list_dot_product(x, w)) AS guess
  FROM {rows} JOIN {weights} USING (client) GROUP BY ALL),
{name}_c AS (SELECT client, cls, sum(hit) AS hits, sum(own) AS support, 2.0::DOUBLE * sum(hit) / count(*) AS f1 FROM (
    SELECT client, truth AS cls, CASE WHEN truth = guess THEN 1 ELSE 0 END AS hit, 1 AS own FROM {name}_r
    UNION ALL SELECT client, guess, 0, 0 FROM {name}_r) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT client, avg(f1) AS macro_f1, sum(hits) / CAST(sum(support) AS DOUBLE) AS accuracy
  FROM {name}_c GROUP BY 1)"""


def _equal_clients(spark: SparkSession, sf_dir: str, shard_rows: int) -> DataFrame:
    clients = pt.assign_clients(
        vectors(spark, sf_dir), 4, "iid", keys=["vec_id"], portable=True)
    rows = pt.client_holdout(clients, keys=["vec_id"], portable=True)
    return fd.lay_out(rows, "vec_id", group_sizes(rows, "client_id"), shard_rows, 42)


def _whole_batches(epochs: int, mu: float = 0.0) -> fd.LocalTraining:
    return fd.LocalTraining((64, 10), epochs=epochs, rate=0.5, batch=10**9, dropout=0.0, mu=mu, block=16)


@query(f"""WITH {CLIENT_ROWS}, {_linear_step("train", "zeros", "w1", 0.5, 0.2)}, {_linear_step("train", "w1", "w2", 0.5, 0.2)},
sizes AS (SELECT client, count(*) AS n FROM train GROUP BY 1),
cells AS (SELECT cls, n, unnest(w) AS v, unnest(range(65)) AS j FROM w2 JOIN sizes USING (client))
SELECT CAST(CASE WHEN j = 64 THEN 640 + cls ELSE cls * 64 + j END AS INTEGER) AS pos,
  round(sum(n * v) / sum(n), 6) + 0.0 AS value FROM cells GROUP BY 1, j, cls""")
def fedprox_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of every client from zero weights, the second pulled back to them, averaged.

    Shards of 32 rows: a step is the sum of several tasks.
    """
    trained = fd.train_clients(
        _equal_clients(spark, sf_dir, 32), np.zeros(650), _whole_batches(2, mu=0.2), shard_rows=32)
    return fd.federated_average(trained).select(
        "pos", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(f"""WITH {CLIENT_ROWS}, {_linear_step("train", "zeros", "w1", 0.5)}, {_linear_step("train", "w1", "w2", 0.5)},
tests AS (SELECT k.client, vec_id, label, x FROM held, (SELECT DISTINCT client FROM held) k WHERE is_val),
{_model_scores("scores", "tests", "w2")}
SELECT client AS client_id, round(macro_f1, 6) AS macro_f1, round(avg(macro_f1) OVER (), 6) AS mean_f1,
  round(min(macro_f1) OVER (), 6) AS worst_client_f1 FROM scores""")
def local_only_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client alone for two rounds from zero weights, scored on all holdouts; with the summary."""
    rows = _equal_clients(spark, sf_dir, fd.SHARD_ROWS)
    scores = fd.fit_local_only(rows, rows.filter("is_val"), _whole_batches(1), rounds=2, start=np.zeros(650))
    summary = fd.local_only_summary(durable(scores))
    return rounded(summary.select(
        F.col("macro_f1").alias("mean_f1"), "worst_client_f1",
        F.posexplode("per_client_test_f1").alias("client_id", "macro_f1")))


# The clients of rounds 1 to 3, half of four, drawn with seed 42.
SAMPLED = {1: (1, 3), 2: (0, 1), 3: (0, 2)}


def _sampled_rounds_sql() -> str:
    parts, rounds = [f"WITH {CLIENT_ROWS}, g0 AS (SELECT DISTINCT cls, w FROM zeros)"], []
    parts.append("val AS (SELECT -1 AS client, vec_id, label, x FROM held WHERE is_val)")
    for number, chosen in SAMPLED.items():
        k, before = number, number - 1
        parts.append(f"r{k} AS MATERIALIZED (SELECT * FROM train WHERE client IN {chosen})")
        parts.append(f"b{k} AS MATERIALIZED (SELECT client, cls, w FROM (SELECT DISTINCT client FROM r{k}), g{before})")
        parts.append(_linear_step(f"r{k}", f"b{k}", f"w{k}", 0.5))
        parts.append(f"""g{k} AS MATERIALIZED (SELECT cls, list(v ORDER BY j) AS w FROM (
    SELECT cls, j, sum(n * v) / sum(n) AS v FROM (SELECT cls, n, unnest(w) AS v, unnest(range(65)) AS j
      FROM w{k} JOIN (SELECT client, count(*) AS n FROM r{k} GROUP BY 1) USING (client)) GROUP BY ALL) GROUP BY 1),
  o{k} AS MATERIALIZED (SELECT -1 AS client, cls, w FROM g{k})""")
        parts.append(_model_scores(f"global{k}", "val", f"o{k}"))
        parts.append(_model_scores(f"local{k}", "(SELECT * FROM held WHERE is_val)", f"w{k}"))
        rounds.append(f"""SELECT {k} AS round, round(g.macro_f1, 6) AS global_val_macro_f1, round(g.accuracy, 6) AS global_val_accuracy,
  (SELECT round(avg(macro_f1), 6) FROM local{k}) AS mean_client_f1,
  (SELECT round(avg(loss), 6) FROM (SELECT client, avg(-ln(p)) AS loss FROM w{k}_p WHERE label = cls GROUP BY 1)) AS mean_client_loss,
  round(650 * 4.0::DOUBLE * {len(chosen) + 1} / 1048576, 2) AS mb_communicated FROM global{k} g""")
    return ", ".join(parts) + " " + " UNION ALL ".join(rounds)


@query(_sampled_rounds_sql())
def sampled_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of federated averaging from zero weights, two of four clients in each."""
    rows = _equal_clients(spark, sf_dir, fd.SHARD_ROWS)
    _, history = fd.fit_federated(
        rows, rows.filter("is_val"), _whole_batches(1), rounds=3, fraction_fit=0.5, start=np.zeros(650))
    return rounded(_history(spark, history))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with ``split``: train for the clients, val and test that no client trains on.

    Stored, as clients, validation and test are all read from it.
    """
    return durable(sp.stratified_split(
        vectors(spark, sf_dir).withColumn("cls", F.col("label").cast("string")), "cls", ["vec_id"],
        stream=0.0, train=0.7, val=0.15))


def _client_table(parts: DataFrame, shard_rows: int = fd.SHARD_ROWS) -> DataFrame:
    rows = _held_out(parts, "train")
    clients = durable(pt.assign_clients(rows, 4, 0.5, keys=["vec_id"], min_samples=50))
    return fd.lay_out_clients(clients, "vec_id", shard_rows=shard_rows)


def _held_out(parts: DataFrame, split: str) -> DataFrame:
    return parts.filter(F.col("split") == split).select("vec_id", "features", "label")


NET = (64, 256, 128, 64, 10)


def _history(spark: SparkSession, history: list[dict]) -> DataFrame:
    rows = [(h["round"], h["global_val_macro_f1"], h["global_val_accuracy"], h["mean_client_f1"],
             h["mean_client_loss"], h["mb_communicated"]) for h in history]
    return spark.createDataFrame(
        rows, "round int, global_val_macro_f1 double, global_val_accuracy double, "
        "mean_client_f1 double, mean_client_loss double, mb_communicated double")


@query()
def fedavg_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = fd.LocalTraining(NET, epochs=1, rate=0.1, batch=64, dropout=0.0)
    parts = _parts(spark, sf_dir)
    _, history = fd.fit_federated(
        _client_table(parts), _held_out(parts, "val"), settings, rounds=3)
    return _history(spark, history)


@query()
def fedprox_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = fd.LocalTraining(NET, epochs=1, rate=0.1, batch=64, dropout=0.0, mu=0.01)
    parts = _parts(spark, sf_dir)
    _, history = fd.fit_federated(
        _client_table(parts, 400), _held_out(parts, "val"), settings, rounds=3, fraction_fit=0.75,
        shard_rows=400)
    return _history(spark, history)


@query()
def local_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = fd.LocalTraining(NET, epochs=1, rate=0.1, batch=64, dropout=0.0)
    parts = _parts(spark, sf_dir)
    scores = fd.fit_local_only(
        _client_table(parts, 400), _held_out(parts, "test"), settings, rounds=3, shard_rows=400)
    return fd.local_only_summary(scores)


def _train_and_val(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    halves = durable(sp.stratified_split(
        vectors(spark, sf_dir).withColumn("cls", F.col("label").cast("string")), "cls", ["vec_id"],
        stream=0.0, train=0.8, val=0.2))
    return halves.filter("split = 'train'"), halves.filter("split = 'val'")


@query()
def mlp_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _train_and_val(spark, sf_dir)
    model, _ = bl.fit_mlp_baseline(train, val, NET, "vec_id", max_epochs=10)
    return ev.classification_metrics(bl.predict_mlp(model, val), "label", "prediction")


@query()
def tree_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _train_and_val(spark, sf_dir)
    model = bl.fit_tree_baseline(train, val, 10, 64, max_trees=500, max_depth=8)
    return ev.classification_metrics(model.predict(val), "label", "prediction")


# Fixed value: the edges of every feature in the query below.
EDGES = (-0.2, -0.1, 0.0, 0.1, 0.2)


@query(f"""WITH cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS feature,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
cuts AS (SELECT unnest(range({len(EDGES)})) AS cut, unnest({list(EDGES)}::DOUBLE[]) AS edge),
below AS (SELECT feature, cut, label, count(*) AS n FROM cells, cuts WHERE v < edge GROUP BY ALL),
sides AS (SELECT feature, cut, sum(n) AS n_left, k AS cls, coalesce(sum(n) FILTER (label = k), 0) AS hits
  FROM below, range(10) c(k) GROUP BY ALL),
totals AS (SELECT k AS cls, count(*) AS n_all, count(*) FILTER (label = k) AS all_hits FROM embeddings, range(10) c(k) GROUP BY ALL),
sums AS (SELECT *, 0.1::DOUBLE * n_left - hits AS gl, 0.18::DOUBLE * n_left AS hl,
    0.1::DOUBLE * n_all - all_hits AS g, 0.18::DOUBLE * n_all AS h FROM sides JOIN totals USING (cls)),
gains AS (SELECT *, round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 9) AS gain FROM sums
  WHERE hl >= 1 AND h - hl >= 1),
best AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY gain DESC, feature, cut) AS place FROM gains)
SELECT CAST(cls AS INTEGER) AS cls, CAST(feature AS INTEGER) AS feature, CAST(cut AS INTEGER) AS cut, round(gain, 6) AS gain,
  round(-0.1::DOUBLE * gl / (hl + 1), 6) + 0.0 AS low, round(-0.1::DOUBLE * (g - gl) / (h - hl + 1), 6) + 0.0 AS high
FROM best WHERE place = 1 AND gain > 0.000001""")
def first_tree_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of every class of a boosting run, grown by partial histograms."""
    rows = vectors(spark, sf_dir).select("features", "label")
    model = bs.fit_boosted_trees(
        rows, rows.limit(0), 10, 64, max_trees=1, max_depth=1, edges=[np.array(EDGES)] * 64, local_rows=0)
    found = [(k, int(t.feature[0]), int(t.cut[0]), float(t.gain[0]), float(t.value[1]), float(t.value[2]))
             for k, t in enumerate(model.rounds[0]) if t.feature[0] >= 0]
    return rounded(spark.createDataFrame(
        found, "cls int, feature int, cut int, gain double, low double, high double"))


@query()
def federated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A federated run with its document on disk, read back and set beside the other methods."""
    settings = fd.LocalTraining(NET, epochs=1, rate=0.1, batch=64, dropout=0.0)
    parts = _parts(spark, sf_dir)
    clients = _client_table(parts)
    weights, history = fd.fit_federated(clients, _held_out(parts, "val"), settings, rounds=2)
    path = scratch_path(spark, "runs")
    fd.run_document(
        spark, "fl_fedavg_a0.5_s42", "fedavg", 0.5, "laptop", clients, _held_out(parts, "test"), weights, history,
        settings, [str(i) for i in range(10)]).coalesce(1).write.json(path)
    runs = read_run_documents(spark, path)
    return rp.main_results(centralized_runs(spark, sf_dir).limit(1), runs).filter(F.col("method") == "FEDAVG")


# --- Reports -------------------------------------------------------------------------

@query(f"""WITH {RUNS} SELECT run_name, method, alpha, mu, seed, profile, 3 AS rounds,
  round(score, 6) AS macro_f1 FROM docs""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.run_summary(run_documents(spark, sf_dir)))


@query(f"""WITH {RUNS}, target AS (SELECT max(score) * 0.95::DOUBLE AS t FROM central),
per_run AS (
  SELECT run_name, method, alpha, mu, profile, score, mb,
         (SELECT min(r) FROM (VALUES (1, 1 / 3.0::DOUBLE), (2, 2 / 3.0::DOUBLE), (3, 1.0::DOUBLE))
          v(r, s) WHERE fed.score * s >= (SELECT t FROM target)) AS reached FROM fed)
SELECT upper(model_type) AS method, '-' AS alpha, 1::BIGINT AS runs, round(score, 6) AS macro_f1,
  NULL::DOUBLE AS std_macro_f1, round(score * 1.1::DOUBLE, 6) AS accuracy,
  NULL::DOUBLE AS client_f1_std, NULL::DOUBLE AS rounds_to_target,
  NULL::DOUBLE AS mb_communicated, profile FROM central
UNION ALL
SELECT CASE method WHEN 'fedprox' THEN 'FedProx (mu=0.01)' ELSE upper(method) END, alpha, count(*),
  round(avg(score), 6), CASE WHEN count(*) > 1 THEN round(stddev_pop(score), 6) END,
  round(avg(score * 1.1::DOUBLE), 6), round(avg(score * 0.1::DOUBLE), 6), round(avg(reached), 6),
  round(avg(3 * mb), 6), arg_min(profile, run_name) FROM per_run GROUP BY method, alpha""")
def main_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.main_results(
        centralized_runs(spark, sf_dir), federated_runs(spark, sf_dir)))


@query(f"""WITH {RUNS} SELECT method, alpha, round(avg(score), 6) AS mean_f1,
  round(stddev_pop(score), 6) AS std_f1, count(*) AS runs FROM fed GROUP BY ALL""")
def f1_by_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.f1_by_alpha(federated_runs(spark, sf_dir)))


@query(f"""WITH {RUNS} SELECT run_name, method, round(score, 6) AS final_val_f1 FROM fed
  WHERE profile = 'laptop' AND alpha = '5' ORDER BY score DESC, run_name LIMIT 1""")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rp.select_best(federated_runs(spark, sf_dir), "laptop", alpha="5")
    return rounded(best.select("run_name", "method", "final_val_f1"))


@query(f"""WITH {RUNS} SELECT run_name, method, alpha, mu, round, round(f1, 6) AS macro_f1,
  round(f1 * 0.9::DOUBLE, 6) AS mean_client_f1, round(f1 * 0.1::DOUBLE, 6) AS std_client_f1
  FROM rounds""")
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.convergence(federated_runs(spark, sf_dir)))


@query(f"""WITH {RUNS} SELECT run_name, method, alpha, 4::BIGINT AS clients,
  round(f1 * 0.5::DOUBLE, 6) AS min, round(f1 * 0.725::DOUBLE, 6) AS q1,
  round(f1 * 0.9::DOUBLE, 6) AS median, round(f1 * 1.05::DOUBLE, 6) AS q3,
  round(f1 * 1.2::DOUBLE, 6) AS max FROM rounds WHERE round = 3""")
def client_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.client_fairness(federated_runs(spark, sf_dir)))


@query(f"""WITH {RUNS} SELECT run_name, method, alpha, client, round(f1 * share, 6) AS f1
  FROM rounds, (VALUES (0, 0.5::DOUBLE), (1, 1.2::DOUBLE), (2, 0.8::DOUBLE), (3, 1.0::DOUBLE))
  c(client, share) WHERE round = 3""")
def client_f1_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.client_f1_series(federated_runs(spark, sf_dir)))


@query(f"""WITH {RUNS} SELECT round(sum(mb), 4) AS total_mb, count(*) AS rounds,
  round(sum(mb) / count(*), 4) AS mb_per_round FROM rounds""")
def communication_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.communication_summary(run_documents(spark, sf_dir)), 4)


@query(f"""WITH {RUNS} SELECT run_name, method, alpha, round(sum(mb), 4) AS total_mb,
  count(*) AS rounds, round(any_value(score), 4) AS macro_f1 FROM rounds GROUP BY ALL""")
def communication_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.communication_summary(federated_runs(spark, sf_dir), "run"), 4)


@query(f"""WITH {RUNS} SELECT run_name AS run, round(score * 1.5::DOUBLE, 6) AS "Benign",
  round(score * 0.5::DOUBLE, 6) AS "DDoS", 0.0::DOUBLE AS "Web" FROM docs""")
def per_class_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.per_class_matrix(
        run_documents(spark, sf_dir), ("Benign", "DDoS", "Web")))


@query(f"""WITH {RUNS}, pair AS (
  SELECT arg_min(score, run_name) FILTER (run_name NOT LIKE '%no_iat%') AS a,
         arg_min(score, run_name) FILTER (run_name LIKE '%no_iat%') AS b FROM central)
SELECT cls, round(a * share, 6) AS f1_with, round(b * share, 6) AS f1_without,
  round((a - b) * share, 6) AS difference
FROM pair, (VALUES ('Benign', 1.5::DOUBLE), ('DDoS', 0.5::DOUBLE), ('macro', 1.0::DOUBLE)) s(cls, share)""")
def ablation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.ablation_compare(
        centralized_runs(spark, sf_dir), classes=("Benign", "DDoS")))


@query(f"""WITH {RUNS} SELECT run_name, profile, false AS smoke_only FROM docs WHERE profile = 'lab'""")
def prefer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.prefer_profile(run_documents(spark, sf_dir), "lab").select(
        "run_name", "profile", "smoke_only")


@query(f"""WITH {RUNS} SELECT run_name, profile, true AS smoke_only FROM docs""")
def absent_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.prefer_profile(run_documents(spark, sf_dir), "cluster").select(
        "run_name", "profile", "smoke_only")


FLAT = """flat AS (
  SELECT CAST(p_partkey AS VARCHAR) AS run_name, p_brand AS method,
         p_retailprice / 100003.0::DOUBLE AS test_macro_f1, p_size AS num_clients FROM part)"""


def _flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("run_name"), F.col("p_brand").alias("method"),
        (F.col("p_retailprice") / 100_003.0).alias("test_macro_f1"),
        (F.col("p_retailprice") / 100_003.0 * 2).alias("test_accuracy"),
        F.col("p_size").alias("num_clients"))


@query(f"""WITH {RUNS}, {FLAT}
SELECT run_name, method, model_type, round(score, 6) AS nested_f1, NULL::DOUBLE AS flat_f1 FROM docs
UNION ALL SELECT run_name, method, NULL, NULL, round(test_macro_f1, 6) FROM flat""")
def experiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.experiment_rows(run_documents(spark, sf_dir), _flat_results(spark, sf_dir))
    return rounded(rows.select(
        "run_name", "method", "model_type", F.col("test_metrics.macro_f1").alias("nested_f1"),
        F.col("test_macro_f1").alias("flat_f1")))


@query(f"""WITH {RUNS}, {FLAT}
SELECT run_name AS run, coalesce(model_type, method) AS type, round(score, 6) AS macro_f1,
  round(score * 1.1::DOUBLE, 6) AS accuracy, train_rows AS rows, profile FROM docs
UNION ALL SELECT run_name, method, round(test_macro_f1, 6), round(test_macro_f1 * 2, 6),
  CAST(num_clients AS BIGINT), NULL FROM flat""")
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.experiment_rows(run_documents(spark, sf_dir), _flat_results(spark, sf_dir))
    return rounded(rp.results_table(rows))


# --- Expressions ---------------------------------------------------------------------

@query(f"WITH {DIRTY} SELECT orderkey, linenumber, quantity IS NOT NULL AS q, "
       "isfinite(tax) AS t, isfinite(discount) AS d FROM dirty")
def finite_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_lines(spark, sf_dir).select(
        "orderkey", "linenumber", is_finite("quantity").alias("q"), is_finite("tax").alias("t"),
        is_finite("discount").alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       "round(sign(l_quantity - 25) * ln(1 + abs(l_quantity - 25)), 6) AS log_quantity, "
       "l_tax AS tax FROM lineitem")
def signed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    features = columns_to_map(["l_tax", "l_quantity"])
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(signed_log1p(F.col("l_quantity") - 25), 6).alias("log_quantity"),
        features["l_tax"].alias("tax"))


@query(f"""SELECT event_id, CASE {CLASS_OF_EVENT} WHEN 'Benign' THEN 0 WHEN 'DDoS' THEN 1
  WHEN 'Recon' THEN 2 END AS idx, CASE WHEN {CLASS_OF_EVENT} <> 'Web' THEN {CLASS_OF_EVENT} END AS name
  FROM events""")
def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ("Benign", "DDoS", "Recon")
    index = class_index("pred_class", known)
    return alerts(spark, sf_dir).select(
        F.col("event_id").cast("bigint").alias("event_id"), index.alias("idx"),
        class_name(index, known).alias("name"))


FLAGSHIP: Query = window_metrics
