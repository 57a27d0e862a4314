"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages that the rules are meant for.
STOP_WORDS = (
    # English
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have",
    "he", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "were",
    "which", "with",
    # French
    "au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le",
    "les", "ne", "par", "pas", "pour", "que", "qui", "se", "sur", "un", "une",
    # German
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich",
    "sie", "sind", "und", "von", "war", "zu",
    # Spanish
    "como", "con", "del", "el", "es", "las", "lo", "los", "más", "no", "para", "por", "su", "y",
)

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low * of <= measure <= high * of``; both measures are columns of ``measures``."""

    name: str
    measure: str
    of: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=0.5),
)


# Small, capitalised and in capitals, so that words need no lower-casing.
STOP_FORMS = tuple(dict.fromkeys(
    form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())))


def _replaced(text: Column, characters: str, by: str) -> Column:
    """Plain replacements skip texts without the character, unlike a regular expression."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(by))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_replaced(text, BLANKS[1:], " "), " "), "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules compare.

    Words are runs without blanks; lines are parts between line feeds, and only lines with a word
    count as lines. A null text has no words, lines or symbols. ``n_repeat_words`` counts the
    words inside a window of three words that occurs twice or more in the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    count = F.size(F.col("_q_words"))
    windows = F.when(count < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), count - 3),
        lambda i: F.xxhash64(F.get("_q_words", i), F.get("_q_words", i + 1), F.get("_q_words", i + 2)),
    ))
    ordered = F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.filter(
        F.col("_q_ordered"),
        lambda x, k: (x["h"] == F.get("_q_ordered", k - 1)["h"])
        | (x["h"] == F.get("_q_ordered", k + 1)["h"]),
    )
    covered = F.array_distinct(F.flatten(F.transform(
        repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return (
        docs
        .withColumns({
            "_q_words": _words(body),
            "_q_lines": F.filter(
                F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0),
        })
        .withColumn("_q_windows", windows)
        .withColumn("_q_ordered", F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"), ordered))
        # A generator: filters on the counts must not move below the arrays and repeat them.
        .select(*docs.columns, F.inline(F.array(F.struct(*[c.alias(name) for name, c in {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(_replaced(body, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(_replaced(body, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_q_ordered").isNull(), 0)
            .otherwise(F.size(covered)).cast("long"),
            "n_stop_words": F.size(
                F.filter("_q_words", lambda w: w.isin(*STOP_FORMS))).cast("long"),
        }.items()]))))
    )


def verdict(rules: Sequence[Rule]) -> Column:
    """True where every rule of the table holds; compiled into one expression."""
    checks = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            checks = checks & (F.col(rule.measure) >= F.col(rule.of) * F.lit(float(rule.low)))
        if rule.high is not None:
            checks = checks & (F.col(rule.measure) <= F.col(rule.of) * F.lit(float(rule.high)))
    return checks


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    Every row comes back, repeated ones included. Null and empty texts have zero counts and fail.
    Other columns stay; one that is named like a result is replaced, one that begins with _q_ goes.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
             "n_stop_words", "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in names and not c.startswith("_q_")]
    return measures(docs.select(*rest), text).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))
