"""Sharding: differencing, groups that stay together, balance, slots."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowlens.llm.sharding import assign_shards, differencing, shard_documents


def sums(sizes, parts, ways):
    total = [0] * ways
    for size, part in zip(sizes, parts):
        total[part] += size
    return total


def test_differencing_of_known_sets():
    assert sorted(sums([8, 7, 6, 5, 4], differencing([8, 7, 6, 5, 4], 2), 2)) == [14, 16]
    assert differencing([], 3) == []
    assert sorted(differencing([5], 3)) == [2]
    assert sorted(sums([3, 3, 3], differencing([3, 3, 3], 3), 3)) == [3, 3, 3]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10_000, 2000).tolist()
    total = sums(sizes, differencing(sizes, 8), 8)
    assert max(total) - min(total) <= 8
    assert differencing(sizes, 8) == differencing(sizes, 8)


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_balanced_and_groups_whole(spark, hot):
    rng = np.random.default_rng(4)
    texts = ["x" * int(n) for n in rng.integers(0, 900, 700)] + [None, "", "é" * 50, "é" * 50]
    if hot:
        texts += ["hot copy " * 20] * 1500
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", "s"), (5, texts[5], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(5)
    got = shard_documents(docs, 8, bundles=256).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    shards, slots, sizes = defaultdict(set), defaultdict(list), [0] * 8
    for r in got:
        shards[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if hot:
        sizes.remove(max(sizes))
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)


def test_columns_named_like_work_columns_stay(spark):
    from flowlens.llm.common import stored
    from flowlens.llm.sharding import number_slots

    rows = spark.createDataFrame(
        [(i, f"g{i % 5}", i + 1, i * 10, "own", 7) for i in range(40)],
        "i int, g string, b int, _size int, _range string, _row int")
    placed = number_slots(stored(assign_shards(rows, "g", "b", 3), "rows"), "i")
    assert placed.columns == [*rows.columns, "shard", "slot"]
    assert sorted(tuple(r)[:6] for r in placed.collect()) == sorted(map(tuple, rows.collect()))


def test_null_groups_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None, None), (2, None, 5), (3, "a", 5)], "i int, g string, b int")
    got = {r.i: r.shard for r in assign_shards(rows, "g", "b", 2).collect()}
    assert got[1] == got[2] != got[3]
    assert shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
