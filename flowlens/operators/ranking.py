"""Reproducible random ranks, and cuts by rank that never shuffle the rows.

A row's random position is a 128-bit hash of ``seed`` and its identifying
``keys``, so it depends neither on how the input is partitioned nor on retries.
Ranking a class means ordering it by that hash.

* ``stable_rank`` gives every row its exact rank. Rows are sorted in ranges of
  (class, hash, row), so neither a class nor a row copied into a third of the
  table is one task; the rows are shuffled once.
* ``assign_intervals`` answers the more common question "is this row's rank
  in ]lo, hi]?". It finds the hash at each boundary rank from a histogram and a
  look into the few boundary buckets, then labels rows by comparing hashes: two
  narrow scans and a map-side join, no shuffle of the rows at all.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from flowlens.session import MAX_BROADCAST_ROWS, broadcast_rows, durable

# Buckets per group of the table that intervals are joined by.
BUCKET_BITS = 12
# Distinct groups that the driver may hold.
MAX_GROUPS = 500_000
# Hash values stay within this many bits, so the bucket is a right shift.
HASH_BITS = 60
# Beyond every row number: an edge that takes in all copies of its row.
LAST_COPY = 2**63 - 1


def hash_pair(keys: Sequence[str], seed: int, portable: bool = False) -> tuple[Column, Column]:
    """Two 60-bit non-negative hashes of ``keys``.

    ``portable`` takes them from the md5 of ``seed|key|…`` (text that any SQL
    engine computes alike); otherwise from xxhash64, which is much cheaper.
    """
    if portable:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
        return tuple(
            F.coalesce(F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint"), F.lit(0))
            for start in (1, 16)
        )
    columns = [F.col(k) for k in keys]
    return tuple(
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *columns), 64 - HASH_BITS)
        for salt in (0, 1)
    )


def _keyed(
    df: DataFrame, by: str | None, keys: Sequence[str] | None, seed: int,
    portable: bool, bits: int,
) -> DataFrame:
    high, low = hash_pair(keys or df.columns, seed, portable)
    group = F.col(by) if by else F.lit(0)
    return df.select(
        "*", group.alias("_g"), high.alias("_h1"), low.alias("_h2")
    ).withColumn("_b", F.shiftright("_h1", HASH_BITS - bits))


def with_row_key(
    df: DataFrame, column: str = "row_key", of: Sequence[str] | None = None
) -> DataFrame:
    """Add one number that identifies a row by its contents, those of the columns ``of``.

    Stored with a wide table it lets every later rank, split, sample or client
    assignment read this column instead of all of them.
    """
    return df.withColumn(column, F.xxhash64(*(of or df.columns)))


def ordered_rows(df: DataFrame, by: str | None, order: Sequence[Column]) -> DataFrame:
    """``df`` with its group ``_g`` and place ``_at``, dealt out by ranges of (group, order, row).

    ``_at`` counts up along the rows of a task, its upper bits are the task. The row's own number
    ends the sort key, so that copies, however many, are cut into ranges like other rows.
    """
    group = F.col(by) if by else F.lit(0)
    names = [f"_o{i}" for i in range(len(order))]
    keys = ["_g", *names, "_copy"]
    rows = df.select(
        "*", group.alias("_g"), *[c.alias(n) for c, n in zip(order, names)],
        F.monotonically_increasing_id().alias("_copy"))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *df.columns, "_g", F.monotonically_increasing_id().alias("_at"))


def rank_in_order(
    df: DataFrame, by: str | None, order: Sequence[Column], column: str = "rank"
) -> DataFrame:
    """Add the 1-based rank of each row among those of its ``by`` value, in the given order.

    Rows that are equal in the order get different ranks in no particular order. The rows are
    sorted in ranges and stored; what each range holds of a group is counted, the counts before
    it are summed in Spark, and a row's rank is that sum and its place in the range. No task
    holds a group, nor all copies of a row.
    """
    placed = durable(ordered_rows(df, by, order))
    # Each range adds a row, and each further group in it: never more than ranges and groups.
    runs = durable(
        placed.groupBy("_g", F.shiftright("_at", 33).alias("_part"))
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("_g").alias("_rg"), F.col("_part").alias("_rp"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    match = F.col("_g").eqNullSafe(F.col("_rg")) & (F.shiftright("_at", 33) == F.col("_rp"))
    return placed.join(broadcast_rows(starts, runs.count()), match).select(
        *df.columns, (F.col("_at") + F.col("_shift") + 1).alias(column))


def stable_rank(
    df: DataFrame,
    by: str,
    keys: Sequence[str] | None = None,
    seed: int = 42,
    column: str = "rank",
    portable: bool = False,
) -> DataFrame:
    """Add the 1-based rank of each row in the random order of its ``by`` value.

    ``keys`` (default: all columns) should identify a row; copies get different
    ranks in no particular order. Runs jobs when called (``rank_in_order``).
    """
    return rank_in_order(df, by, hash_pair(keys or df.columns, seed, portable), column)


def group_sizes(df: DataFrame, by: str | None) -> dict[Any, int]:
    """Rows per ``by`` value, on the driver: ``by`` is a dictionary (classes, clients).

    A column with more than ``MAX_GROUPS`` values is refused.
    """
    group = F.col(by) if by else F.lit(0)
    counts = df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{by!r} has more than {MAX_GROUPS} values")
    return {r["_g"]: r["n"] for r in rows}


def histogram_bits(largest_rank: int) -> int:
    """Hash bits for a histogram with about 100 000 rows per bucket, of 64 buckets at least."""
    return min(HASH_BITS, max(6, (largest_rank // 100_000).bit_length()))


def boundary_hashes(
    keyed: DataFrame, cuts: dict[Any, Iterable[int]], bits: int
) -> dict[tuple[Any, int], Row]:
    """The row at each requested rank, by (group, rank).

    ``_h1, _h2`` is its hash pair; where copies share it, ``copies`` counts those
    up to the rank and ``after`` those beyond it.
    """
    spark = keyed.sparkSession
    wanted = [(g, int(r)) for g, ranks in cuts.items() for r in sorted(set(ranks))]
    if not wanted:
        return {}
    group_type = keyed.schema["_g"].dataType.simpleString()
    targets = broadcast_rows(
        spark.createDataFrame(wanted, f"_tg {group_type}, _r bigint"), len(wanted)
    )
    upto = Window.partitionBy("_g").orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    histogram = (
        keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
    )
    inside = (F.col("_r") > F.col("_end") - F.col("_n")) & (F.col("_r") <= F.col("_end"))
    buckets = (
        histogram.join(targets, F.col("_g").eqNullSafe(F.col("_tg")) & inside)
        .groupBy(F.col("_g").alias("_tg"), F.col("_b").alias("_tb"))
        .agg(
            F.min(F.col("_end") - F.col("_n")).alias("_start"),
            F.sort_array(F.collect_set("_r")).alias("_ranks"),
        )
    )
    in_bucket = F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_b") == F.col("_tb"))
    buckets = broadcast_rows(buckets, len(wanted))
    # One row per distinct hash of a boundary bucket: copies of a row are merged first.
    hashes = (
        keyed.select("_g", "_b", "_h1", "_h2")
        .join(buckets, in_bucket, "left_semi")
        .groupBy("_g", "_b", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
        .join(buckets, in_bucket)
    )
    within = Window.partitionBy("_g", "_b").orderBy("_h1", "_h2").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (
        hashes.withColumn("_end", F.col("_start") + F.sum("_n").over(within))
        .withColumn("_r", F.explode(F.filter(
            "_ranks", lambda r: (r > F.col("_end") - F.col("_n")) & (r <= F.col("_end")))))
        .select("_g", "_r", "_h1", "_h2", (F.col("_end") - F.col("_r")).alias("after"),
                (F.col("_r") - F.col("_end") + F.col("_n")).alias("copies"))
        .collect()
    )
    return {(row["_g"], row["_r"]): row for row in found}


def _copy_numbers(numbered: DataFrame, tied: list) -> dict[tuple[Any, int], int]:
    """For boundaries inside a group of copies: the number of the last copy before the boundary.

    Copies are counted per partition, so a group with a third of all rows is
    never brought together; only the partition of the boundary is looked into.
    """
    spark = numbered.sparkSession
    group_type = numbered.schema["_g"].dataType.simpleString()
    targets = broadcast_rows(spark.createDataFrame(
        [(r["_g"], r["_r"], r["_h1"], r["_h2"], r["copies"]) for r in tied],
        f"_tg {group_type}, _r bigint, _t1 bigint, _t2 bigint, _m bigint"), len(tied))
    same = (
        F.col("_g").eqNullSafe(F.col("_tg"))
        & (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2"))
    )
    copies = numbered.select(
        "_g", "_h1", "_h2", "_h3", F.shiftright("_h3", 33).alias("_part"))
    upto = Window.partitionBy("_g", "_h1", "_h2").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    places = (
        copies.join(targets, same, "left_semi")
        .groupBy("_g", "_h1", "_h2", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .join(targets, same & (F.col("_m") > F.col("_end") - F.col("_n"))
              & (F.col("_m") <= F.col("_end")))
        .select("_tg", "_r", "_t1", "_t2", F.col("_part").alias("_tp"),
                (F.col("_m") - F.col("_end") + F.col("_n")).alias("_place"))
    )
    places = broadcast_rows(places, len(tied))
    here = same & (F.col("_part") == F.col("_tp"))
    within = Window.partitionBy("_g", "_h1", "_h2", "_part").orderBy("_h3")
    rows = (
        copies.join(places, here, "left_semi")
        .withColumn("_rn", F.row_number().over(within))
        .join(places, here & (F.col("_rn") == F.col("_place")))
        .select("_tg", "_r", "_h3").collect()
    )
    return {(r["_tg"], r["_r"]): r["_h3"] for r in rows}


def assign_intervals(
    df: DataFrame,
    intervals: Sequence[tuple[Hashable, int, int, Any]],
    by: str | None,
    value_type: str,
    column: str,
    keys: Sequence[str] | None = None,
    seed: int = 42,
    portable: bool = False,
    keep_rest: bool = False,
    bits: int | None = None,
) -> DataFrame:
    """Label each row by the interval its random rank falls into.

    ``intervals`` holds ``(group, lo, hi, value)``: the rows of ``group`` with
    ``lo < rank <= hi`` get ``value`` in ``column``. Intervals of a group do not
    overlap. Rows in none are dropped, or kept with NULL when ``keep_rest``.

    Runs a job when called that reads ``df`` twice; ``df`` should be a stored
    table or otherwise cheap to read. Copies (rows with equal ``keys``) may
    straddle a boundary: then the rows are stored once with a number each, and
    the copies are divided by number, so that the counts stay exact.
    """
    spark = df.sparkSession
    intervals = [i for i in intervals if i[2] > i[1]]
    bits = bits or histogram_bits(max((hi for _, _, hi, _ in intervals), default=1))
    keyed = _keyed(df, by, keys, seed, portable, bits)
    cuts: dict[Any, set[int]] = {}
    for group, lo, hi, _ in intervals:
        cuts.setdefault(group, set()).update(r for r in (lo, hi) if r > 0)
    edges = boundary_hashes(keyed, cuts, bits)
    tied = [row for row in edges.values() if row["after"] > 0]
    numbers: dict[tuple[Any, int], int] = {}
    if tied:
        # The numbers of the copies have to survive retries, hence the stored copy.
        keyed = durable(keyed.withColumn("_h3", F.monotonically_increasing_id()))
        numbers = _copy_numbers(keyed, tied)

    def edge(group: Any, rank: int) -> tuple[int, int, int]:
        if rank == 0:
            return -1, -1, -1
        row = edges[(group, rank)]
        return row["_h1"], row["_h2"], numbers.get((group, rank), LAST_COPY)

    rows = [(g, *edge(g, lo), *edge(g, hi), value) for g, lo, hi, value in intervals]
    group_type = keyed.schema["_g"].dataType.simpleString()
    table = spark.createDataFrame(
        rows,
        f"_tg {group_type}, _lo1 bigint, _lo2 bigint, _lo3 bigint, "
        f"_hi1 bigint, _hi2 bigint, _hi3 bigint, {column} {value_type}",
    )
    # One row per bucket an interval touches: an equi-join, about one match per row. With
    # many groups the buckets get wider, so that the table stays small enough to broadcast.
    room = max(1, MAX_BROADCAST_ROWS // (2 * max(1, len(cuts))))
    join_bits = min(BUCKET_BITS, room.bit_length() - 1)
    shift = HASH_BITS - join_bits
    keyed = keyed.withColumn("_b", F.shiftright("_h1", shift).cast("int"))
    table = table.withColumn("_tb", F.explode(F.sequence(
        F.shiftright(F.greatest("_lo1", F.lit(0)), shift).cast("int"),
        F.shiftright("_hi1", shift).cast("int"),
    )))
    bound = len(cuts) * 2**join_bits + 2 * len(intervals)
    number = F.col("_h3") if tied else F.lit(LAST_COPY)

    def beyond(edge: str) -> Column:
        h1, h2, h3 = (F.col(f"_{edge}{i}") for i in (1, 2, 3))
        return (F.col("_h1") > h1) | ((F.col("_h1") == h1) & (
            (F.col("_h2") > h2) | ((F.col("_h2") == h2) & (number > h3))))

    above, below = beyond("lo"), ~beyond("hi")
    match = (
        F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_b") == F.col("_tb")) & above & below
    )
    return keyed.join(
        broadcast_rows(table, bound), match, "left" if keep_rest else "inner"
    ).select(*df.columns, column)
