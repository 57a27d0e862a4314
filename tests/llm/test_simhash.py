"""SimHash: fingerprints, the trie join and the components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from flowlens.llm.common import connected, local_forest
from flowlens.llm.simhash import (
    drop_near_duplicates, fingerprint_values, hex_fingerprint, link_fingerprints, masks_within,
    simhash_groups, trie_links,
)


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \n\t", "a", "A b", "a b", "The quick  brown fox\tjumps é Éa", "w x y " * 400,
         "b\x0bc\x0cd", "éa   b", "The quick brown fox jumps é Éa"]


def test_fingerprints_of_odd_texts():
    assert fingerprint_values(pa.array(TEXTS)).tolist() == [plain_fingerprint(t) for t in TEXTS]
    assert fingerprint_values(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("own", [True, False])
def test_trie_links_equal_all_pairs(own):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = [base ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, m)))
            for m in (1, 2, 3, 4) for _ in range(3)]
    values = np.unique(np.concatenate([base, *near, [np.uint64(0), np.uint64(2**64 - 1)]]))
    half = len(values) if own else len(values) // 2
    found = set()
    for x, y in trie_links(values[:half], None if own else values[half:], 3):
        found |= {(min(p), max(p)) for p in zip(x.tolist(), (y + (0 if own else half)).tolist())}
    expected = {
        (i, j) for i in range(len(values)) for j in range(i + 1, len(values))
        if (int(values[i]) ^ int(values[j])).bit_count() <= 3 and (own or i < half <= j)}
    assert found == expected


def test_masks():
    assert sorted(masks_within(5, 3)) == [m for m in range(32) if m.bit_count() <= 3]
    assert masks_within(0, 3) == [0]


@pytest.mark.parametrize("block", [4, 64])
def test_links_over_many_blocks(spark, block):
    """Small blocks give a deep top trie, with a dense part that is cut further."""
    rng = np.random.default_rng(5)
    dense = [int(x) for x in rng.integers(0, 2**12, 120)]
    wide = [int(x) for x in rng.integers(-2**63, 2**63, 200)]
    close = [x ^ (1 << int(rng.integers(0, 63))) for x in wide[:50]]
    values = sorted({*dense, *wide, *close, 0, -1, -2**63})
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    edges = [(r.a, r.b) for r in link_fingerprints(frame, block=block).collect()]
    mask = 2**64 - 1
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1:]
             if ((a ^ b) & mask).bit_count() <= 3]
    assert components(values, edges) == components(values, links)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)]
    edges += [(7, 7), (3, 2), (2, 3), (60, 149)]
    found = {r.node: r.component for r in connected(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert found == components(nodes, edges)
    node, low = local_forest(*np.array(edges).T)
    assert {n: found[n] for n in node.tolist()} == dict(zip(node.tolist(), low.tolist()))
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    bodies = [" ".join(rng.choice(words, 80)) for _ in range(40)]
    texts = TEXTS + bodies + bodies[:15] + [b + " tail" for b in bodies[:20]]
    rows = [(1000 - i, t, i) for i, t in enumerate(texts)] + [(None, bodies[0], 1), (500, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = simhash_groups(docs).withColumn("hex", hex_fingerprint()).collect()
    assert len(got) == len(rows)
    prints = {}
    for doc_id, text, _ in rows:
        prints.setdefault(plain_fingerprint(text), []).append(doc_id)
    values = sorted(prints)
    root = components(values, [(a, b) for a in values for b in values
                               if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for value, ids in prints.items():
        ids = [i for i in ids if i is not None] + least.get(root[value], [])
        least[root[value]] = [min(ids)] if ids else []
    expected = sorted(
        (repr(d), f"{plain_fingerprint(t):016x}", least[root[plain_fingerprint(t)]][0])
        for d, t, _ in rows)
    assert sorted((repr(r.doc_id), r.hex, r.component_id) for r in got) == expected


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "same text here today", "x"), (2, "same text here today", "y"), (3, "other words", "z"),
            (3, "other words", "z"), (None, "same text here today", "n"), (4, None, "e"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tied string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


def test_columns_named_like_work_columns_and_long_texts_stay(spark):
    rows = [(1, "long words " * 100_000, True, 5, "r"), (2, "long words " * 100_000, False, 6, "s"), (3, "x", None, 7, "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _tied boolean, _kept_id int, _row string")
    assert sorted(map(tuple, drop_near_duplicates(docs).collect())) == [rows[0], rows[2]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash_groups(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0
