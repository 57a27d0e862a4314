"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import stored

# Units that the differencing works on at most twice over: light groups share this many bundles.
BUNDLES = 4096
# Row numbers of a shard are dealt in this many ranges.
SLOT_RANGES = 1024


def differencing(sizes: Sequence[int], ways: int) -> list[int]:
    """The part of each unit, 0 to ``ways`` - 1.

    Every unit begins as a partial partition with one filled part. The two partitions with the
    largest spread are combined, the heaviest part of one with the lightest of the other, until
    one partition is left. Ties go by position, so equal input gives equal parts.
    """
    if not sizes:
        return []
    # A part is a node of a forest; a combination links the joined parts below a new node.
    children: list[tuple[int, ...]] = [()] * len(sizes)
    heap = []
    for unit, size in enumerate(sizes):
        parts = [(0, -1)] * (ways - 1) + [(int(size), unit)]
        heap.append((-int(size), unit, parts))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        merged = []
        for (a, x), (b, y) in zip(first, reversed(second)):
            kept = tuple(n for n in (x, y) if n >= 0)
            if len(kept) == 2:
                children.append(kept)
                kept = (len(children) - 1,)
            merged.append((a + b, kept[0] if kept else -1))
        merged.sort()
        base = merged[0][0]
        merged = [(size - base, node) for size, node in merged]
        heapq.heappush(heap, (-merged[-1][0], tie, merged))
        tie += 1
    part_of = [0] * len(sizes)
    for part, (_, node) in enumerate(heap[0][2]):
        todo = [node] if node >= 0 else []
        while todo:
            at = todo.pop()
            if at < len(sizes):
                part_of[at] = part
            todo += children[at]
    return part_of


def assign_shards(
    rows: DataFrame, group: Column | str, size: Column | str, shards: int, bundles: int = BUNDLES,
) -> DataFrame:
    """``rows`` with ``shard``; rows of one group share a shard, byte sums are near equal.

    A group with at least 1/``bundles`` of all bytes is a unit of its own, of which there can be
    ``bundles`` at most; the lighter groups are dealt by hash into ``bundles`` units. Spark sums
    the units, the driver combines that bounded list by differencing, and the shards come back by
    a join of bounded size. Rows with a null group form one group; null sizes count as 0. A column
    called shard is replaced, all others stay.
    """
    spark = rows.sparkSession
    group = F.col(group) if isinstance(group, str) else group
    size = F.col(size) if isinstance(size, str) else size
    # The row travels as one value, so that no column can clash with the work columns.
    keyed = rows.select(
        F.struct(*[c for c in rows.columns if c != "shard"]).alias("_row"),
        F.xxhash64(group.cast("string")).alias("_group"),
        F.md5(F.coalesce(group.cast("string"), F.lit(""))).alias("_check"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("_size"))
    bundle = F.pmod(F.col("_group"), F.lit(bundles))
    groups = stored(
        keyed.groupBy("_group", "_check").agg(F.sum("_size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = groups.filter((F.col("bytes") * bundles >= total) & (F.col("bytes") > 0))
    heavy_rows = sorted((r["bytes"], r["_group"], r["_check"]) for r in heavy.collect())
    light = groups.join(F.broadcast(heavy.select("_group", "_check")), ["_group", "_check"], "left_anti")
    light_rows = sorted((r["bytes"], r["bundle"]) for r in light.groupBy(bundle.alias("bundle")).agg(
        F.sum("bytes").alias("bytes")).collect())
    parts = differencing([b for b, *_ in heavy_rows] + [b for b, _ in light_rows], shards)
    heavy_map = spark.createDataFrame(
        [(g, c, part) for (_, g, c), part in zip(heavy_rows, parts)] or [],
        "_group bigint, _check string, _heavy int")
    light_map = spark.createDataFrame(
        [(b, part) for (_, b), part in zip(light_rows, parts[len(heavy_rows):])] or [],
        "_bundle bigint, _light int")
    return (
        keyed.withColumn("_bundle", bundle)
        .join(F.broadcast(heavy_map), ["_group", "_check"], "left")
        .join(F.broadcast(light_map), "_bundle", "left")
        .select("_row.*", F.coalesce("_heavy", "_light").alias("shard"))
    )


def number_slots(rows: DataFrame, order: Column | str, ranges: int = SLOT_RANGES) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, … inside each shard, without one task for a shard.

    Rows are numbered inside (shard, hash range of ``order``) and moved by the counts of the
    ranges before. Numbers of rows with equal ``order`` are arbitrary, so ``rows`` must be stored. A
    column called slot is replaced, all others stay.
    """
    from pyspark.sql import Window

    order = F.col(order) if isinstance(order, str) else order
    # The partition and position are fixed, as the rows are stored; they spread equal keys.
    placed = stored(rows.select(
        F.struct(*[c for c in rows.columns if c != "slot"]).alias("row"), F.col("shard").alias("part"),
        F.xxhash64(order).alias("place"),
        F.pmod(F.xxhash64(order, F.monotonically_increasing_id()), F.lit(ranges)).alias("range")), "slots")
    counts = placed.groupBy("part", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("part", "range").orderBy("place")
    return (
        placed.withColumn("number", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["part", "range"])
        .select("row.*", (F.col("number") + F.col("offset")).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 8, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The law is ``bytes``: sizes of the shards are near equal, as far as equal texts, which stay
    together, allow. Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one.
    ``slot`` runs from 0 without gaps in each shard. ``grown_shard`` is null under this law.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body).alias("_text")), "sizes")
    placed = assign_shards(rows, "_text", "size", shards, bundles).drop("_text")
    return number_slots(placed, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
