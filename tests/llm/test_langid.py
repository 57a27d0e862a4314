"""Language identification: code lengths against a plain tree, odd texts, held-out accuracy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import langid
from flowlens.llm.langid import ByteTrees, KeyIndex, accepted, identify, predictions, train

WORDS = {
    "aa": "the and of house river stone walking under bright".split(),
    "bb": "der und von haus fluss stein gehen unter heller straße".split(),
    "cc": "le et de maison rivière pierre marcher sous été".split(),
}


def sentence(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang], n))


def plain_bits(samples, text, order):
    """Code length of ``text`` by a context tree of dictionaries."""
    trees = [{} for _ in range(order + 1)]
    for sample in samples:
        body = bytes(order) + sample.encode()
        for i in range(order, len(body)):
            for k in range(order + 1):
                trees[k].setdefault(body[i - k:i], Counter())[body[i]] += 1
    body, bits = bytes(order) + text.encode(), 0.0
    for i in range(order, len(body)):
        for k in range(order, -1, -1):
            seen = trees[k].get(body[i - k:i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if seen[body[i]]:
                bits -= math.log2(seen[body[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_key_index():
    rng = np.random.default_rng(0)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(3000, dtype=np.uint64)]))
    held = keys[::2]
    index = KeyIndex(held)
    expected = {k: i for i, k in enumerate(held.tolist())}
    assert index.find(keys).tolist() == [expected.get(k, -1) for k in keys.tolist()]
    assert KeyIndex(np.zeros(0, np.uint64)).find(keys[:3]).tolist() == [-1] * 3


@pytest.mark.parametrize("window", [7, 1 << 19])
def test_code_lengths_equal_a_plain_tree(spark, monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    rng = np.random.default_rng(1)
    samples = {lang: [sentence(lang, rng) for _ in range(4)] for lang in WORDS}
    rows = [(t, lang) for lang, texts in samples.items() for t in texts]
    model = train(spark.createDataFrame(rows, "text string, lang string"), order=3)
    assert model.languages == sorted(WORDS)
    texts = [sentence("bb", rng), "x", "zzzz ÿ stone", "", "the" * 50, *samples["aa"]]
    got = model.code_lengths(pa.array(texts))
    expected = [[plain_bits(samples[lang], t, 3) for lang in model.languages] for t in texts]
    assert np.allclose(got, expected, rtol=1e-5)


def test_odd_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sentence(lang, rng), lang, 0.0) for i, lang in enumerate(list(WORDS) * 8)]
    rows += [(100, None, "aa", 1.0), (101, "", "aa", 1.0), (102, "12 34 -- !", None, 1.0),
             (103, "house " * 100_000, None, 1.0), (None, rows[0][1], "aa", 1.0), (0, rows[0][1], "aa", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = identify(docs, train(docs)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for odd in (100, 101, 102):
        assert (by_id[odd][0].lang_pred, by_id[odd][0].score, by_id[odd][0].bits_per_byte) == ("und", 0.0, None)
    assert by_id[103][0].lang_pred == "aa" and 0 <= by_id[103][0].score <= 1
    assert len(by_id[0]) == 2 and by_id[0][0].lang_pred == by_id[None][0].lang_pred == "aa"
    assert identify(docs, train(docs)).filter(accepted()).filter("text IS NULL").count() == 0


def test_columns_named_like_work_columns_stay(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sentence(lang, rng), lang, f"own{i}", i, True) for i, lang in enumerate(list(WORDS) * 3)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, _language string, row int, has_letter boolean")
    got = identify(docs, train(docs)).select(*docs.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in identify(docs, train(docs)).collect()} == {"und"}
    assert identify(docs.limit(0), train(docs.limit(0))).count() == 0


def test_ties_go_to_the_first_name():
    model = ByteTrees.build(["aa", "bb"], [(np.array([97], np.uint64), np.array([2]))] * 2, 1)
    assert predictions(model, pa.array(["aaaa"])).to_pylist()[0]["lang_pred"] == "aa"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter("doc_id % 4 <> 2"))
    held = identify(docs.filter("doc_id % 4 = 2"), model)
    right = held.filter("lang = lang_pred").count()
    assert right >= 0.97 * held.count()
