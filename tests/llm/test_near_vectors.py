"""Near-duplicate vectors against brute force: links, components, probes, odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from flowlens.llm import near_vectors as nv
from flowlens.llm.near_vectors import Quantiser, linked_pairs, near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    def usable(i, v, label):
        return (i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(x != 0 for x in v))

    good = [k for k, r in enumerate(rows) if usable(*r[:3])]
    vectors = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    links = [(a, b) for p, a in enumerate(good) for b in good[p + 1:]
             if rows[a][2] == rows[b][2] and len(vectors[a]) == len(vectors[b])
             and vectors[a] @ vectors[b] / np.sqrt((vectors[a] @ vectors[a]) * (vectors[b] @ vectors[b])) >= threshold]
    degree, low = [0] * len(rows), [r[0] for r in rows]
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return sorted(repr((r[0], degree[k], low[k], r[0] is not None and r[0] == low[k])) for k, r in enumerate(rows))


def sample(rng, n, width=16, labels=3):
    rows, number = [], 0
    for _ in range(n):
        centre = rng.normal(size=width)
        for _ in range(int(rng.integers(1, 4))):
            vector = centre + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((number, vector.astype(np.float32).tolist(), int(rng.integers(0, labels)), "x"))
            number += 1
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nv, "BLOCK_ROWS", block)
    monkeypatch.setattr(nv, "LIST_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = sample(rng, 120)
    hot = rows[0][1]
    rows += [(1000 + i, hot, rows[0][2], "x") for i in range(30)]
    rows += [(2000 + i, (np.array(hot) * 3 + rng.normal(size=16) * 0.01).tolist(), rows[0][2], "x") for i in range(40)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(
        [(i, np.float32(v).tolist(), label, x) for i, v, label, x in rows])


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0, ""), (2, one, 0, ""), (2, one, 0, ""), (3, None, 0, ""), (4, [], 0, ""), (5, [0.0] * 3, 0, ""),
            (6, [1.0, None, 3.0], 0, ""), (7, [1.0, float("nan"), 3.0], 0, ""), (8, [float("inf"), 1.0, 1.0], 0, ""),
            (9, one, None, ""), (10, one, 1, ""), (None, one, 0, ""), (11, [1.0, 2.0], 0, ""), (12, [2e-30, 4e-30, 6e-30], 0, ""),
            (13, [-1.0, -2.0, -3.0], 0, ""), (14, [1e30, 2e30, 3e30], 0, "")]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None, None, "")], SCHEMA)).collect()[0].n_links == 0


def test_probes_and_table_distances_lose_no_partner():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 20))
    points = np.concatenate([base, base + rng.normal(size=base.shape) * 0.04])
    units = points / np.linalg.norm(points, axis=1)[:, None]
    quantiser = Quantiser.fit(units[::3], 12, codes=16)
    units = quantiser.pad(units)
    lists, codes, errors = quantiser.encode(units)
    probes = quantiser.probes(units, lists, math.sqrt(0.04))
    assert probes[np.arange(len(units)), lists].all() and not probes.all()
    near = units @ units.T >= 0.98
    assert all(probes[i, lists[j]] for i, j in zip(*np.nonzero(near)))
    for number in range(len(quantiser.centres)):
        own = lists == number
        assert (linked_pairs(quantiser, number, units, units[own], codes[own], errors[own], 0.98) == near[:, own]).all()


def test_pairs_at_the_threshold_link_whatever_their_block():
    rng = np.random.default_rng(5)
    for _ in range(40):
        left = rng.normal(size=(1, 24))
        right = left + rng.normal(size=(1, 24)) * 0.1
        cosine = float((left * right).sum() / (np.sqrt((left * left).sum(1)) * np.sqrt((right * right).sum(1)))[0])
        units = right / np.sqrt((right * right).sum(1))[:, None]
        quantiser = Quantiser.fit(units, 1)
        _, codes, errors = quantiser.encode(quantiser.pad(units))
        far = rng.normal(size=(200, 24)) * 5
        for others in (np.zeros((0, 24)), far):  # one candidate of one pair, and of many
            rows = np.concatenate([left, others])
            for threshold, linked in ((cosine, True), (np.nextafter(cosine, 2), False)):
                found = linked_pairs(quantiser, 0, rows, right, codes, errors, threshold)
                assert found[0, 0] == linked
