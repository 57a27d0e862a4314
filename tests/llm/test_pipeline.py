"""The pipeline against a plain version of every stage, odd rows, and the registered queries."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from flowlens.llm.queries import ORACLES, QUERIES
from tests.llm.test_packing import check_bins
from tests.llm.test_quality import plain as plain_quality
from tests.llm.test_simhash import components, plain_fingerprint
from tests.oracle import connect, difference

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score double"
COMMON = "the of and to in is that it was for with as on be at by this from or are".split()


def texts():
    rng = np.random.default_rng(3)
    words = COMMON * 3 + [f"word{i}" for i in range(300)]
    good = [" ".join(rng.choice(words, 120)) for _ in range(25)]
    swapped = [t + " tail" for t in good[:8]]
    junk = ["# * $ | " * 40, "same words " * 60, "short text", None, "", "12 34 56 " * 30]
    return good + good[:5] + swapped + junk


def rows():
    found = [(500 - i, t, "en", "s", 1, "x", 0.5) for i, t in enumerate(texts())]
    return found + [(500, found[0][1], "en", "s", 1, "x", 0.5), (None, found[1][1], None, None, None, None, None)]


def survivors(rows):
    """The (doc_id, text) rows that the first three stages keep."""
    spoken = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    fine = []
    for r in spoken:
        words, failed = r[1].split(), plain_quality(r[1])[-1]
        symbols = sum(c in "#*$%&|<>" for c in r[1])
        stop = sum(w in COMMON for w in words)
        if not failed and symbols <= 0.25 * len(words) and stop >= 0.01 * len(words):
            fine.append(r)
    prints = {plain_fingerprint(r[1]) for r in fine}
    root = components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for r in fine:
        if r[0] is not None:
            group = root[plain_fingerprint(r[1])]
            least[group] = min(r[0], least.get(group, r[0]))
    kept = {r[0] for r in fine if r[0] is not None and least[root[plain_fingerprint(r[1])]] == r[0]}
    once = {r[0]: r for r in fine if r[0] in kept}
    return list(once.values()) + [r for r in fine if r[0] is None]


def test_stages_equal_plain_versions(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.schema.simpleString() == docs.schema.simpleString(), name
    expected = survivors(rows())
    assert sorted(map(repr, map(tuple, at.collect()))) == sorted(map(repr, expected))
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(
        len(plain.encode(r[1], add_special_tokens=False).ids) + 1 for r in expected)
    check_bins([(r.sequence_id, r.offset, r.length) for r in packed], corpus_pipeline.SEQUENCE_TOKENS)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_empty_tables_and_nulls(spark, number):
    stage = corpus_pipeline.STAGES[number][1]
    docs = spark.createDataFrame([(None,) * 7, (1,) + (None,) * 6], SCHEMA)
    assert stage(spark, docs.limit(0), "").count() == 0
    stage(spark, docs, "").collect()


def test_run_over_a_table(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = packed.collect()
    check_bins([(r.sequence_id, r.offset, r.length) for r in rows], corpus_pipeline.SEQUENCE_TOKENS)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) > 50


def test_all_are_registered():
    names = queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_over_a_table(spark, name):
    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in ORACLES:
        assert difference(frame, connect("/root/testdata/sf0.001"), ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_language_stage_needs_half_of_the_probability_and_labels(spark):
    text = " ".join(COMMON)
    shared = [(i, text, lang, "s", 1, "x", 0.5) for i in range(12) for lang in ("aa", "bb", "cc")]
    docs = spark.createDataFrame(shared, SCHEMA)
    assert corpus_pipeline.language(spark, docs, "").count() == 0  # three equal trees: a third each
    alone = spark.createDataFrame([(*r[:2], "aa", *r[3:]) for r in shared], SCHEMA)
    assert corpus_pipeline.language(spark, alone, "").count() == len(shared)
    unlabelled = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in shared], SCHEMA)
    assert corpus_pipeline.language(spark, unlabelled, "").count() == 0
