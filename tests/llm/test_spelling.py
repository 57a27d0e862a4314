"""Spelling variants: the suffix-rank search against all pairs, the vocabulary, forms and roots."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import spelling
from flowlens.llm.spelling import near_words, spelling_groups, vocabulary


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_near(counts):
    result = {}
    for word in counts:
        near = [v for v in counts if one_edit(word, v)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            result[word] = (len(near), counts[best], best)
    return result


def some_words(seed, size, letters, low, high):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(size)]
    words = set(base)
    for word in base:
        i, c = rng.integers(0, len(word)), rng.choice(list(letters))
        words |= {word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word + c}
    return {w: int(n) for w, n in zip(sorted(words), rng.integers(2, 60, len(words))) if w}


@pytest.mark.parametrize("symbols", [150, 200_000])
@pytest.mark.parametrize("letters,low,high", [("ab", 1, 9), ("abcdeé×ÿ", 7, 12), ("a", 1, 30)])
def test_near_words_equal_all_pairs(spark, letters, low, high, symbols):
    counts = some_words(5, 40, letters, low, high)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(words, symbols).collect()}
    assert got == plain_near(counts)


def test_wide_intervals_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NARROW", 2)
    monkeypatch.setattr(spelling, "QUERIES", 50)
    counts = some_words(6, 60, "abc", 5, 8)
    table = spelling.pa.table({
        "side": [0] * (4 * len(counts)), "word": [w for w in counts for _ in range(4)],
        "n": [n for n in counts.values() for _ in range(4)], "kind": [None, -1, 0, 1] * len(counts)})
    table = table.set_column(3, "kind", table["kind"].cast("int32"))
    found = {r["word"]: r["n_near"] for r in _summed(spelling.answer_shard(table), spelling.answer_shard(
        table.set_column(0, "side", spelling.pa.array([1] * len(table)))))}
    assert found == {w: n for w, (n, _, _) in plain_near(counts).items()}


def _summed(*tables):
    return spelling.pa.concat_tables(tables).group_by(["word", "kind"] if "kind" in tables[0].column_names else [
        "word"]).aggregate([("n_near", "sum")]).rename_columns(["word", "n_near"]).to_pylist()


def test_forms_lead_to_roots(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 5, "zzzzzzy": 49,
              "qqqqqqq": 10, "qqqqqqx": 100, "qqqqqqw": 100, "very" * 2000: 3, "very" * 2000 + "x": 30}
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 9, "y")],
                                  "word string, n bigint, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(words).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 2, 1, 20)
    assert got["aaaabbb"] == (None, "aaaabbb", 2000, 1, None)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 5, 1, None)
    assert got["qqqqqqq"] == ("qqqqqqw", "qqqqqqw", 10, 2, 100)
    assert got["very" * 2000][:2] == ("very" * 2000 + "x",) * 2 and len(got) == len(counts)
    assert spelling_groups(words.limit(0)).count() == 0


def plain_vocabulary(rows, erase):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if erase and h % erase == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("erase", [None, 3, 31])
def test_vocabulary_equals_plain_python(spark, erase):
    rng = np.random.default_rng(1)
    names = ["elephant", "Éléphant", "ELEPHANTS", "naïveté", "crème", "brûlées", "x×y÷zabc", "œuvres", "abcdefg", "Ã" * 9]
    texts = [None, "", "12 !", "a" * 300_000, "éàü" * 400 + " " + "éàü" * 400] + [
        " ".join(rng.choice(names, 40)) + "\n東京abcdefgh1abcdefg" for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, texts[-1]), (4, texts[4])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, word int").repartition(4)
    got = {r.word: r.n for r in vocabulary(docs, erase=erase).collect()}
    assert got == plain_vocabulary(rows, erase)
    assert vocabulary(docs.limit(0), erase=erase).count() == 0
