"""Importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import SLICE_BYTES, Shipped, runs, stored, text_slices, utf8
from flowlens.llm.crc import RunningCrc, part_crc

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
SPACE = 0x20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
# Digits, small letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[ord("0"):ord("9") + 1] = WORD[ord("a"):ord("z") + 1] = WORD[0x80:] = True


def word_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, end): the texts, long ones cut between words so that arrays stay bounded.

    A part reaches over the first word beyond its end, as the second word of a pair; words that
    begin at ``end`` or later belong to the next part.
    """
    if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
        yield data, offsets, len(data)
        return
    free = ~WORD[LOWER[data]]
    low = 0
    while low < len(data):
        high = min(low + SLICE_BYTES, len(data))
        # A cut stands before a byte that is in no word; a single word is never cut.
        gap = int(free[high:].argmax()) if high < len(data) else 0
        high = high + gap if high < len(data) and free[high + gap] else len(data)
        begin = high + int((~free[high:]).argmax()) if high < len(data) else high
        stop = begin + int(free[begin:].argmax()) if begin < len(data) else begin
        if begin < len(data) and not free[stop]:
            stop = len(data)
        yield data[low:stop], np.array([0, stop - low]), high - low
        low = high


def features(
    data: np.ndarray, offsets: np.ndarray, end: int, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every run of one or two words that begins before ``end``; and word counts.

    The words of all texts are written in a row with one space between them and scanned once. The
    CRC of any run follows from the registers at its two ends.
    """
    low = LOWER[data]
    inside = WORD[low]
    starts, ends, owner = runs(inside, offsets)
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths - 1
    row = np.full(int((lengths + 1).sum()), SPACE, np.uint8)
    row[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = low[inside]
    scan = RunningCrc(row)
    begin, after = scan.at(places), scan.at(places + lengths)
    own = int(np.searchsorted(starts, end))
    pair = np.flatnonzero(owner[:-1][:own] == owner[1:][:own])
    single = part_crc(begin[:own], after[:own], lengths[:own])
    double = part_crc(begin[pair], after[pair + 1], places[pair + 1] + lengths[pair + 1] - places[pair])
    crc = np.concatenate([single, double]).astype(np.int64)
    words = np.bincount(owner[:own], minlength=len(offsets) - 1)
    return crc % buckets, np.concatenate([owner[:own], owner[pair]]), words


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; a task sends one row each."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                for piece in word_parts(*utf8(part["text"])):
                    total += np.bincount(features(*piece, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class BucketGains:
    """Thousandths of the log ratio of target to raw frequency, by bucket."""

    gains: np.ndarray


def fit_gains(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS,
) -> BucketGains:
    """The gains of all ``docs`` against all ``target`` texts; the driver gets two rows a bucket."""
    def counts(rows: DataFrame, column: str) -> np.ndarray:
        table = np.zeros(buckets, np.int64)
        for row in bucket_counts(rows, column, buckets).collect():
            table[row["bucket"]] = row["n"]
        return table

    raw, wanted = counts(docs, text), counts(target, target_text)
    ratio = ((wanted + 1.0) * (raw.sum() + float(buckets))) / ((raw + 1.0) * (wanted.sum() + float(buckets)))
    return BucketGains(np.floor(1000.0 * np.log(ratio)).astype(np.int64))


def importance_weights(
    docs: DataFrame, model: BucketGains, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs``.

    ``weight`` is the floored mean of the gains of a text's features, 0 without one. A null text
    has no words. Rows with equal or null ids count each for itself; other columns are left out.
    The texts are read a second time here: storing their buckets would take as much room.
    """
    held = Shipped(docs.sparkSession, model)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = held.get().gains
        for batch in batches:
            for part in text_slices(batch):
                n_words, n_features, total = (np.zeros(len(part), np.int64) for _ in range(3))
                for piece in word_parts(*utf8(part["text"])):
                    bucket, owner, words = features(*piece, len(gains))
                    n_words += words
                    n_features += np.bincount(owner, minlength=len(part))
                    total += np.bincount(owner, gains[bucket], len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n_words), pa.array(n_features),
                     pa.array(total // np.maximum(n_features, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        weigh, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """Thousandths of a Gumbel variate that only depends on the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """Stored ``rows`` with ``rank`` 1, 2, … by falling score, then rising ``doc_id``.

    Rows are dealt out by ranges of (score, id, row), so that neither a frequent score nor a
    frequent id is one task, and numbered inside a range after the counts of those before.
    """
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    dealt = stored(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: ``parts`` rows.
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_number", F.row_number().over(inside)).join(
        F.broadcast(before), "_part").withColumn(
        "rank", (F.col("_number") + F.col("_before")).cast("long")).select(*rows.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``.

    Of the documents with ``min_words`` words ``percent`` in a hundred are drawn without
    replacement, the highest scores (weight plus noise) first, ties to the smaller id; a null id
    comes first and has the noise of an empty one, copies of an id are drawn in any order.
    ``rank`` is null for the others. An empty target or table is no special case. Other columns
    are left out.
    """
    spark = docs.sparkSession
    model = fit_gains(docs, target, text, target_text, buckets)
    scored = stored(
        importance_weights(docs, model, doc_id, text)
        .withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    eligible = F.col("n_words") >= min_words
    # Scores lie between the smallest and the largest gain plus noise of -3,200 to 22,900
    # thousandths, so that the driver gets some 100,000 rows at most, for any number of documents.
    sizes = scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")).orderBy(
        F.desc("score")).collect()
    wanted = percent * sum(r["n"] for r in sizes) // 100
    cutoff, seen = None, 0
    for row in sizes:
        if seen >= wanted:
            break
        cutoff, seen = row["score"], seen + row["n"]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = eligible & (F.col("score") >= cutoff)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = ranked(scored.filter(near), parts)
    return drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(
        scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))
