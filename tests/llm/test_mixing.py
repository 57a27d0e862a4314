"""Context mixing: code trees, a plain decision-by-decision coder, base scores, odd rows."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import block_counts, mixing
from flowlens.llm.mixing import (
    END, SYMBOLS, CodeTrees, context_hashes, decisions, language_scores, mixed_bits, pairs_of, symbols_of, train,
)


def test_every_symbol_has_a_prefix_free_code():
    counts = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    counts[97, 98] = 1000
    trees = CodeTrees.build(counts)
    lengths = trees.length.reshape(SYMBOLS, SYMBOLS)
    assert all(math.isclose(sum(2.0 ** -n for n in row.tolist()), 1.0) for row in lengths[95:99])
    assert lengths[97, 98] == 1
    codes = {tuple(trees.branch[f:f + n]) for f, n in zip(
        trees.first[97 * SYMBOLS:98 * SYMBOLS], trees.length[97 * SYMBOLS:98 * SYMBOLS])}
    assert len(codes) == SYMBOLS


def test_contexts_stay_inside_their_text():
    one, two = (symbols_of(pa.array(x)) for x in (["abc def", "abc"], ["abc"]))
    first, second = context_hashes(*one), context_hashes(*two)
    for a, b in zip(first, second):
        assert a[8:].tolist() == b.tolist()
    word = first[mixing.CONTEXTS.index(0)]
    assert word[5] != word[1] and word[0] == word[4]  # letters of the word so far: d, a; none, none
    assert pairs_of(*one)[8] == END * SYMBOLS + 97


def plain_bits(inputs, branch, batch):
    """The same mixing, one decision at a time."""
    weights = {}
    spots = np.linspace(-mixing.MAP_LIMIT, mixing.MAP_LIMIT, mixing.MAP_BINS)
    mapped = (1 / (1 + np.exp(-spots))).tolist()
    bits = 0.0
    for low in range(0, len(branch), batch):
        steps, hits, moves = {}, Counter(), Counter()
        for i in range(low, min(low + batch, len(branch))):
            x, y = [float(c[i]) for c in inputs], int(branch[i])
            gate = x[mixing.GATE] != 0
            own = weights.setdefault(gate, [mixing.START_WEIGHT] * len(x))
            s = max(-mixing.MAP_LIMIT, min(mixing.MAP_LIMIT, sum(a * b for a, b in zip(x, own))))
            p = 1 / (1 + math.exp(-s))
            spot = int((s + mixing.MAP_LIMIT) * (mixing.MAP_BINS - 1) / (2 * mixing.MAP_LIMIT) + 0.5)
            final = 0.5 * (p + mapped[spot])
            bits -= math.log2(final if y else 1 - final)
            steps.setdefault(gate, []).append([mixing.RATE * (y - p) * v for v in x])
            hits[spot] += 1
            moves[spot] += y - mapped[spot]
        for gate, moved in steps.items():
            weights[gate] = [w + sum(m) for w, m in zip(weights[gate], zip(*moved))]
        for spot, n in hits.items():
            mapped[spot] += moves[spot] * mixing.MAP_RATE / (1 + mixing.MAP_RATE * n)
    return bits


def test_mixing_equals_a_plain_coder():
    rng = np.random.default_rng(0)
    n = [0, 100, 131, 300, 301]
    inputs = [(rng.normal(size=301) * (rng.random(301) > 0.3)).astype(np.float32) for _ in mixing.CONTEXTS]
    branch = rng.integers(0, 2, 301).astype(np.int8)
    slots = [np.arange(301, dtype=np.uint32)] * len(inputs)
    got = mixed_bits(inputs, slots, branch, np.array(n[:-1]), np.array(n[1:]))
    for k, (a, b) in enumerate(zip(n[:-1], n[1:])):
        assert math.isclose(got[k], plain_bits([c[a:b] for c in inputs], branch[a:b], mixing.BATCH), rel_tol=1e-3)


def test_long_texts_and_neighbours_do_not_matter(spark, monkeypatch):
    texts = ["the river and the stone " * 120, "short", "", None, "ünder the bright 日 sky\n" * 90]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    together = model.bits(pa.array(texts))
    assert np.allclose(together, [model.bits(pa.array([t], pa.string()))[0] for t in texts], rtol=1e-6)
    monkeypatch.setattr(mixing, "SLICE", 2000)
    assert np.allclose(model.bits(pa.array(texts)), together, rtol=1e-5)
    again = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.array_equal(again.odds, model.odds)


def plain_base(rows, text):
    words = Counter()
    for _, t, training in rows:
        if training:
            words.update(tokens(t))
    total, kinds = sum(words.values()), len(words)
    own = tokens(text)
    return (len(own), sum(words[w] > 0 for w in own), total,
            sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own))


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


@pytest.mark.parametrize("block", [200, 16_000_000])
def test_base_scores_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(block_counts, "BLOCK_BYTES", block)
    texts = ["The river And the stone", "a river É é", None, "", " \n", "zz unknown Words", "the end", "x" * 9000,
             "hot copy of the river"] + ["hot copy of the river"] * 30
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(texts)] + [(1, "a river É é", False), (None, "null id", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, training boolean, bits string")
    got = language_scores(docs.repartition(3), train(docs.filter("training")), "training").collect()
    expected = []
    for doc_id, text, training in rows:
        n, known, total, base = plain_base(rows, text)
        expected.append(repr((doc_id, not training, n, known, total, round(base, 6))))
    assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == sorted(expected)
    assert all(r.score < 0 and math.isclose(r.score, -r.bits_per_byte * max(1, len((dict((a, b) for a, b, _ in rows)[r.doc_id] or "").encode())) * math.log10(2)) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", False), (2, None, False)], "doc_id bigint, text string, training boolean")
    got = language_scores(docs, train(docs.filter("training")), "training").collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert language_scores(docs.limit(0), train(docs.limit(0)), "training").count() == 0


def test_held_out_texts_are_coded_in_fewer_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr(
        "doc_id", "text", "doc_id % 7 <> 2 AS training")
    held = language_scores(docs, train(docs.filter("training")), "training").filter("held_out").collect()
    rate = sum(-r.score for r in held) / math.log10(2) / sum(-r.score / math.log10(2) / r.bits_per_byte for r in held)
    assert rate < 3.0


def test_both_gates_select_one_of_four_weight_sets():
    rng = np.random.default_rng(1)
    inputs = [(rng.normal(size=400) * (rng.random(400) > 0.4)).astype(np.float32) for _ in mixing.CONTEXTS]
    branch = rng.integers(0, 2, 400).astype(np.int8)
    # Four sets are one set per pair of known contexts.
    sets = (inputs[1] != 0) + 2 * (inputs[2] != 0)
    spots = np.linspace(-mixing.MAP_LIMIT, mixing.MAP_LIMIT, mixing.MAP_BINS)
    mapped, weights, bits = 1 / (1 + np.exp(-spots)), np.full((4, 4), mixing.START_WEIGHT), 0.0
    for low in range(0, 400, mixing.BATCH):
        moved, seen, hits = np.zeros((4, 4)), np.zeros(len(spots)), np.zeros(len(spots))
        for i in range(low, min(low + mixing.BATCH, 400)):
            x, y = np.array([float(c[i]) for c in inputs]), int(branch[i])
            s = min(max(float(x @ weights[sets[i]]), -mixing.MAP_LIMIT), mixing.MAP_LIMIT)
            p = 1 / (1 + math.exp(-s))
            spot = int((s + mixing.MAP_LIMIT) * (mixing.MAP_BINS - 1) / (2 * mixing.MAP_LIMIT) + 0.5)
            final = 0.5 * (p + mapped[spot])
            bits -= math.log2(final if y else 1 - final)
            moved[sets[i]] += mixing.RATE * (y - p) * x
            hits[spot] += 1
            seen[spot] += y - mapped[spot]
        weights += moved
        mapped = mapped + seen * mixing.MAP_RATE / (1 + mixing.MAP_RATE * hits)
    slots = [np.arange(400, dtype=np.uint32)] * len(inputs)
    got = mixed_bits(inputs, slots, branch, np.array([0]), np.array([400]), mixing.GATES)
    assert mixing.GATES == (1, 2) and math.isclose(got[0], bits, rel_tol=1e-4)
    assert not math.isclose(got[0], mixed_bits(inputs, slots, branch, np.array([0]), np.array([400]))[0], rel_tol=1e-5)


def letters(rng, n):
    return "".join(rng.choice(list("abcdefghijklmnop qrstuvwxyz,.ABCDEFGH\n"), n))


def test_counts_are_exact_and_grow_with_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [letters(rng, 30_000) for _ in range(5)] + ["a b", None]
    fresh = letters(rng, 20_000)
    model = train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    counts = Counter()
    ways = {}

    def walk(text):
        """(predictor, context, node), branch of every decision; contexts are plain strings."""
        body = [*(text or "").encode(), END]
        for i, symbol in enumerate(body):
            pair = (body[i - 1] if i else END) * SYMBOLS + symbol
            if pair not in ways:
                first, size = model.shared.tree.first[pair], model.shared.tree.length[pair]
                ways[pair] = [*zip(model.shared.tree.node[first:first + size].tolist(),
                                   model.shared.tree.branch[first:first + size].tolist())]
            history = bytes(body[max(0, i - 5):i])
            word = re.search(rb"[^\x20\x09-\x0D]*\Z", history)[0]
            contexts = [(i < w, history[-w:]) for w in (2, 3, 5)] + [(False, word)]
            for node, branch in ways[pair]:
                yield [(k, c, node) for k, c in enumerate(contexts)], branch

    for text in texts:
        for keys, branch in walk(text):
            counts.update((key, branch) for key in keys)
    seen = {}
    original = mixed_bits

    def watched(odds, slots, branch, *more):
        seen["inputs"] = [o[s] for o, s in zip(odds, slots)]
        return original(odds, slots, branch, *more)

    monkeypatch.setattr(mixing, "mixed_bits", watched)
    model.bits(pa.array([fresh]))
    expected = [[], [], [], []]
    for keys, _ in walk(fresh):
        for k, key in enumerate(keys):
            n0, n1 = counts[key, 0], counts[key, 1]
            expected[k].append((math.log((n1 + 0.3) / (n0 + 0.3)) or 1e-6) if n0 + n1 else 0)
    for got, wanted in zip(seen["inputs"], expected):
        assert np.allclose(got, wanted, rtol=1e-5, atol=1e-7)
    # Few of a fresh text's five-letter contexts were ever counted, however many others were.
    assert np.mean(seen["inputs"][2] != 0) < 0.05


@pytest.mark.parametrize("block, grams", [(3000, 500), (16_000_000, 2_000_000)])
def test_blocks_meet_the_whole_table(spark, monkeypatch, block, grams):
    monkeypatch.setattr(block_counts, "BLOCK_BYTES", block)
    monkeypatch.setattr(mixing, "GRAMS", grams)
    rng = np.random.default_rng(4)
    texts = [letters(rng, 700) for _ in range(12)] + ["", None, "the river " * 300]
    docs = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, training boolean").repartition(2)
    model = train(docs.filter("training"))
    got = {r.doc_id: -r.score / math.log10(2) for r in language_scores(docs, model, "training").collect()}
    assert np.allclose([got[i] for i in range(len(texts))], model.bits(pa.array(texts)), rtol=1e-5)


def test_long_texts_learn_in_larger_batches_across_windows(monkeypatch):
    monkeypatch.setattr(mixing, "STEADY", 128)
    rng = np.random.default_rng(5)
    inputs = [(rng.normal(size=1500) * (rng.random(1500) > 0.4)).astype(np.float32) for _ in mixing.CONTEXTS]
    branch = rng.integers(0, 2, 1500).astype(np.int8)
    sets = (inputs[1] != 0) + 2 * (inputs[2] != 0)
    spots = np.linspace(-mixing.MAP_LIMIT, mixing.MAP_LIMIT, mixing.MAP_BINS)
    mapped, weights, bits = 1 / (1 + np.exp(-spots)), np.full((4, 4), mixing.START_WEIGHT), 0.0
    sizes = dict(mixing.batches(0, 1500))
    assert [*sizes.items()][:7] == [(0, 32), (32, 32), (64, 32), (96, 32), (128, 64), (192, 64), (256, 128)]
    cuts = [*sizes, 1500]
    for low, high in zip(cuts, cuts[1:]):
        size = sizes[low]
        moved, seen, hits = np.zeros((4, 4)), np.zeros(len(spots)), np.zeros(len(spots))
        for i in range(low, high):
            x, y = np.array([float(c[i]) for c in inputs]), int(branch[i])
            s = min(max(float(x @ weights[sets[i]]), -mixing.MAP_LIMIT), mixing.MAP_LIMIT)
            p = 1 / (1 + math.exp(-s))
            spot = int((s + mixing.MAP_LIMIT) * (mixing.MAP_BINS - 1) / (2 * mixing.MAP_LIMIT) + 0.5)
            final = 0.5 * (p + mapped[spot])
            bits -= math.log2(final if y else 1 - final)
            moved[sets[i]] += mixing.RATE * mixing.BATCH / size * (y - p) * x
            hits[spot] += 1
            seen[spot] += y - mapped[spot]
        weights += moved
        mapped = mapped + seen * mixing.MAP_RATE / (1 + mixing.MAP_RATE * hits)
    rows, slot = np.ascontiguousarray(np.array(inputs).T), np.arange(1500, dtype=np.int32)
    got = mixed_bits(inputs, [slot] * 4, branch, np.array([0]), np.array([1500]), mixing.GATES)
    assert math.isclose(got[0], bits, rel_tol=1e-4)
    lane = mixing.Lanes(1, 4, mixing.GATES)
    parts = [lane.code_on(rows, slot[a:b], branch, b == 1500) for a, b in ((0, 10), (10, 700), (700, 1490), (1490, 1500))]
    assert math.isclose(sum(parts), got[0], rel_tol=1e-6)


def test_lookups_hold_parts_of_the_decisions(monkeypatch):
    monkeypatch.setattr(mixing, "PART", 5_000)
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 40, 10_000)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    grams, counts = np.unique(
        mixing.grams_of(rng.integers(97, 123, offsets[-1]).astype(np.int16), offsets), return_counts=True)
    pairs = np.bincount(mixing.gram_pairs(grams), weights=counts, minlength=mixing.SYMBOLS**2).astype(np.int64)
    tree = mixing.CodeTrees.build(pairs.reshape(mixing.SYMBOLS, mixing.SYMBOLS))
    shared = mixing.Shared(tree, np.zeros((2, mixing.SYMBOLS * 256), np.float32))
    counted = shared.counted(grams, counts)
    tracemalloc.start()
    odds = shared.odds_of(counted, grams)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert odds.any(axis=0).all() and peak < 2 * odds.nbytes
    monkeypatch.setattr(mixing, "PART", len(grams))
    assert np.array_equal(odds, shared.odds_of(counted, grams))
