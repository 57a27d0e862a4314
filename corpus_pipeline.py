"""The corpus pipeline: language, quality, near-duplicates, packing; one operator a stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` writes every stage as Parquet in the shared folder and hands what it reads back to the
next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import doc_remainder, read, stored
from flowlens.llm.langid import accepted, identify, train
from flowlens.llm.packing import pack_documents
from flowlens.llm.quality import quality_rules
from flowlens.llm.simhash import drop_near_duplicates

SEQUENCE_TOKENS = 2048


def _with_row(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column can clash with a result."""
    return docs.select("text", F.struct("*").alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; texts that are null or have no letter go.

    So do texts whose best language has less than half of the probability of all, such as short
    ones shared by three close languages. Without any labelled document nothing is kept.

    The trees learn from the labelled documents whose crc32(doc_id) modulo 4 is not 2.
    """
    model = train(docs.filter(doc_remainder(4) != 2))
    return identify(_with_row(docs), model).filter(accepted()).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table of the quality rules."""
    return quality_rules(_with_row(docs)).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences; one row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("quality", quality), ("near_duplicates", near_duplicates),
    ("packing", packing),
]

# Byte trees and packing have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
