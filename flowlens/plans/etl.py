"""The staged batch job: clean table, profile, split, feature statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from flowlens.labels import DEFAULT_TAXONOMY, Taxonomy
from flowlens.operators.clean import StageCounter, clean
from flowlens.operators.profile import class_counts, feature_summary, fit_feature_stats
from flowlens.operators.ranking import with_row_key
from flowlens.operators.split import (
    STREAM_FRACTION, TRAIN_FRACTION, VAL_FRACTION, stratified_split,
)
from flowlens.session import held_settings, path_exists, wide_shuffle
from flowlens.sources.flows import SOURCE_FILE, flow_csv_bytes, parsed_flows, read_flow_csv
from flowlens.sources.sinks import write_partitioned, write_table

STAGES = ("ingest_clean", "profile", "split", "feature_stats")


def run_stages(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    force: Iterable[str] = (),
    scope: str = "global",
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    max_files: int | None = None,
    seed: int = 42,
    stream: float = STREAM_FRACTION,
    train: float = TRAIN_FRACTION,
    val: float = VAL_FRACTION,
    train_cap: int | None = None,
    val_test_cap: int | None = None,
    rebalance: bool = False,
) -> dict[str, str]:
    """Run the stages whose tables are missing or named in ``force``.

    Each stage reads stored tables and writes its own, so the CSV files are
    parsed once and a restart repeats only what did not finish. Returns ``done``
    or ``skipped`` per stage.
    """
    force = set(force)
    unknown = force - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    out_dir = out_dir.rstrip("/")
    cleaned, splits = f"{out_dir}/clean", f"{out_dir}/split"

    def ingest_clean() -> None:
        counter = StageCounter()
        raw = counter.watch(read_flow_csv(spark, raw_dir, max_files, keep_malformed=True), "raw")
        parsed = counter.watch(parsed_flows(raw), "parsed")
        rows = counter.watch(clean(parsed, scope, taxonomy), "clean")
        # The key spares the split stage reading every feature to rank the rows.
        # It hashes values only: moving the files must not reshuffle the splits.
        keyed = with_row_key(rows, of=[c for c in rows.columns if c != SOURCE_FILE])
        # Duplicates meet in as many tasks as the files have room for, however few a shuffle has.
        with held_settings(spark, wide_shuffle(spark, flow_csv_bytes(spark, raw_dir, max_files))):
            write_partitioned(keyed, cleaned, "label_8", rebalance)
        counts = counter.counts()
        loss = counter.loss("parsed", "clean")
        write_table(spark.createDataFrame(
            [(counts["raw"], counts["raw"] - counts["parsed"], counts["parsed"], counts["clean"],
              loss["dropped"], float(loss["dropped_pct"]))],
            "raw bigint, malformed bigint, parsed bigint, clean bigint, dropped bigint, "
            "dropped_pct double",
        ), f"{out_dir}/stage_counts")

    def profile() -> None:
        rows = spark.read.parquet(cleaned)
        write_table(class_counts(rows), f"{out_dir}/class_counts")
        write_table(feature_summary(rows), f"{out_dir}/feature_summary")

    def split() -> None:
        rows = spark.read.parquet(cleaned)
        write_partitioned(stratified_split(
            rows, keys=["row_key"], seed=seed, stream=stream, train=train, val=val,
            train_cap=train_cap, val_test_cap=val_test_cap), splits, "split")

    def feature_stats() -> None:
        # Partition pruning: only the train directory is read.
        rows = spark.read.parquet(splits).filter("split = 'train'").drop("split")
        write_table(fit_feature_stats(rows), f"{out_dir}/feature_stats")

    stages: Sequence[tuple[str, Callable[[], None], str]] = (
        ("ingest_clean", ingest_clean, f"{out_dir}/stage_counts"),
        ("profile", profile, f"{out_dir}/feature_summary"),
        ("split", split, splits),
        ("feature_stats", feature_stats, f"{out_dir}/feature_stats"),
    )
    outcome: dict[str, str] = {}
    for name, run, last_output in stages:
        if name not in force and path_exists(spark, f"{last_output}/_SUCCESS"):
            outcome[name] = "skipped"
            continue
        run()
        outcome[name] = "done"
    return outcome


def split_table(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """One split of a finished run."""
    return spark.read.parquet(f"{out_dir.rstrip('/')}/split").filter(f"split = '{name}'")
