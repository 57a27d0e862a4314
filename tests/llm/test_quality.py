"""Quality rules: counts against plain Python, odd texts, the rule table."""

from __future__ import annotations

import re
from collections import Counter

from flowlens.llm.quality import BASE_FAILED, Rule, quality_rules

TEXTS = [
    None, "", " \n\t", "one", "a b c a b c a b c", "a b\n\na b\n c \na b\x0b", "x # y $$ <tag> | é",
    "the same words " * 40, " ".join(f"w{i}" for i in range(60)), "The " + "of words and " * 5 + "zz " * 60,
    "a a a a", "a  b\tc\rd\x0ce", "é è ü", "w " * 30_000,
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts_equal_plain_python(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(TEXTS)] + [(None, "null id", "y", True), (3, "one", "x", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, kept boolean")
    got = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                 for r in quality_rules(docs).collect())
    assert got == sorted(repr((d, *plain(t))) for d, t, _, _ in rows)


def test_rules_decide_and_filters_stay_cheap(spark):
    fine = " ".join(f"word{i} of the" for i in range(40))
    docs = spark.createDataFrame([(1, fine), (2, fine.replace(" of", "###")), (3, "zz" * 60 + " of " + fine),
                                  (4, fine.upper())], "doc_id bigint, text string")
    assert [r.doc_id for r in quality_rules(docs).filter("kept").orderBy("doc_id").collect()] == [1, 3, 4]
    none = quality_rules(docs, [Rule("length", "n_words", "n_lines", high=10.0)])
    assert none.filter("kept").count() == 0
    plan = quality_rules(docs).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("split(") <= 2
    assert quality_rules(docs.limit(0)).count() == 0


def test_base_condition_text():
    assert BASE_FAILED == "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
