"""Importance resampling: CRCs of parts, features against plain Python, drawing and its ties."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import resampling
from flowlens.llm.crc import RunningCrc, joined_crc, part_crc
from flowlens.llm.resampling import features, importance_weights, fit_gains, resample, word_parts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " .,\n", "One", "É é ß 東京 x1", "a b a b a b", "The END of the end; the_end", "w" * 5000,
         "\x00a\x7fb", "x " * 40, "to be or not to be that is the question " * 6]


def plain_features(text, buckets=10_000):
    words = WORD.findall((text or "").translate(SMALL))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def plain(rows, target, percent, min_words, buckets=10_000):
    """(id, features, weight, score, rank) of all rows, by the definition."""
    raw, wanted = Counter(), Counter()
    found = [(i, *plain_features(t, buckets)) for i, t in rows]
    for _, _, f in found:
        raw += f
    for text in target:
        wanted += plain_features(text, buckets)[1]
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    result = []
    for i, words, f in found:
        n = sum(f.values())
        gain = sum(k * math.floor(1000 * math.log(
            ((wanted[b] + 1.0) * (s_all + buckets)) / ((raw[b] + 1.0) * (t_all + buckets)))) for b, k in f.items())
        weight = gain // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        result.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words, None])
    fit = sorted((r for r in result if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[5] = rank
    return [(r[0], r[1], r[2], r[3], r[5]) for r in result]


def test_crc_of_parts_and_of_joined_strings():
    rng = np.random.default_rng(0)
    for size in (0, 1, 127, 128, 129, 5000):
        data = rng.integers(0, 256, size).astype(np.uint8)
        scan = RunningCrc(data)
        low = rng.integers(0, size + 1, 60)
        high = np.maximum(low, rng.integers(0, size + 1, 60))
        got = part_crc(scan.at(low), scan.at(high), high - low)
        assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(low, high)]
    pairs = [(b"", b"x"), (b"x", b""), (b"abc:", "é".encode() * 300)]
    got = joined_crc(*(np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)),
                     np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("step", [1, 7, 64, 2_000_000])
def test_long_texts_are_cut_between_words(monkeypatch, step):
    monkeypatch.setattr(resampling, "SLICE_BYTES", step)
    for text in [t or "" for t in TEXTS] + ["  lead " + "word " * 50 + " ", "a" * 200, "a" * 100 + " b"]:
        data = np.frombuffer(text.encode(), np.uint8)
        total, words = Counter(), 0
        for piece in word_parts(data, np.array([0, len(data)])):
            bucket, _, n = features(*piece, 10_000)
            total += Counter(bucket.tolist())
            words += int(n.sum())
        assert (words, total) == plain_features(text)


def test_draw_equals_the_definition(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(f"v{k}" for k in rng.zipf(1.5, rng.integers(5, 60)) % 50) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + i, "the hot copy of one text " * 5) for i in range(90)] + [(None, texts[-1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, rank string").repartition(5)
    target = spark.createDataFrame([("to be or not to be v1 v2 v3",), (None,), ("v7 " * 9,)], "text string")
    got = resample(docs, target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    found = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    wanted = plain(rows, ["to be or not to be v1 v2 v3", "v7 " * 9], 25, 20)
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
    assert sum(r[4] is not None for r in found) > 20


def test_copies_of_an_id_are_ranked_without_gaps(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text)] * 60 + [(None, text)] * 40, "doc_id bigint, text string")
    ranks = [r["rank"] for r in resample(docs, docs, percent=50).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 51)) and ranks.count(None) == 50


def test_empty_tables_and_other_names(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample(none, none).count() == 0
    docs = spark.createDataFrame([("x", "a b " * 15, 1)], "name string, body string, doc_id int")
    row = resample(docs, none, percent=100, doc_id="name", text="body").first()
    assert (row.doc_id, row.n_words, row.n_features, row["rank"]) == ("x", 30, 59, 1)
    model = fit_gains(docs, none, text="body")
    assert importance_weights(docs, model, "name", "body").first().weight == row.weight
