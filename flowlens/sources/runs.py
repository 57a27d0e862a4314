"""Experiment results: nested run documents and flat result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalar import try_numeric
from flowlens.schemas import RUN_DOCUMENT


def read_run_documents(
    spark: SparkSession, path: str, schema: T.StructType = RUN_DOCUMENT
) -> DataFrame:
    """One JSON document per file; files that are not valid JSON are skipped.

    A document without ``run_name`` is named after its file.
    """
    corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    docs = (
        spark.read.schema(corrupt)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    columns = [
        F.coalesce(F.col(name), stem).alias(name) if name == "run_name" else F.col(name)
        for name in schema.names
    ]
    return docs.filter(F.col("_corrupt").isNull()).select(*columns)


def read_result_csv(
    spark: SparkSession, path: str, numeric: Sequence[str]
) -> DataFrame:
    """Flat results with a header; ``numeric`` columns become doubles, text in them NULL."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*[
        (try_numeric(name) if name in numeric else F.col(name)).alias(name)
        for name in raw.columns
    ])
