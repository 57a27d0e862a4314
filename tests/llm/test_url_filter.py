"""URL filter: parts, rules, canonical forms; the list exactly, whatever the filter lets through."""

from __future__ import annotations

import pytest

from flowlens.llm.queries import URL_RULES
from flowlens.llm.url_filter import (
    UrlRule, blocked_filter, canonical_url, filter_blocks, judge_urls, url_host, url_path,
)

CASES = [  # url, host, path, rule, verdict
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme.com/x", "", "", None, "allow"),
    ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("http://www.example.com/en/x?q=/#y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://example.com", "example.com", "", None, "allow"),
    ("https://example.com?x=/en/", "example.com", "", None, "allow"),
    ("https://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("https://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("https://x.net/de/1", "x.net", "/de/1", None, "block"),
    ("http://www.X.net:80/de/1/?utm_source=a#t", "www.x.net:80", "/de/1/", None, "block"),
    ("https://x.net/de/1?b=2&a=1", "x.net", "/de/1", None, "block"),
    ("https://x.net/de/12", "x.net", "/de/12", None, "allow"),
    ("a://b\nc/d\ne?f://g", "b\nc", "/d\ne", None, "allow"),
    ("://", "", "", None, "allow"),
    ("https://é.Éxample.org/É?ü", "é.Éxample.org", "/É", None, "allow"),
    ("https://y.org/" + "long/" * 50_000, "y.org", "/" + "long/" * 50_000, None, "allow"),
]
LISTED = ["https://x.net/de/1/", None, "nothing", "http://x.net/de/1", "ftp://x.net/de/1?a=1&utm_x=1&b=2"]


@pytest.mark.parametrize("most_blocks", [1, 1 << 18])
@pytest.mark.parametrize("more", [0, 3000])
def test_verdicts(spark, most_blocks, more):
    pages = spark.createDataFrame(
        [(i, u, "h", 1) for i, (u, *_) in enumerate(CASES)] + [(99, "https://x.net/de/1", "h", 2)] * 500,
        "page_id bigint, url string, host string, canonical int").repartition(4)
    listed = spark.createDataFrame([(u,) for u in LISTED + [f"https://l.org/{k}" for k in range(more)]], "url string")
    got = judge_urls(pages, URL_RULES, listed, most_blocks=most_blocks)
    assert got.columns == ["page_id", "url", "canonical", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(CASES) + 500
    found = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in rows}
    assert [found[i] for i in range(len(CASES))] == CASES
    assert all(r.verdict == "block" for r in rows if r.page_id == 99)


def test_no_rules_no_list_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id bigint, url string")
    none = spark.createDataFrame([], "url string")
    assert {(r.rule, r.verdict) for r in judge_urls(pages, (), none).collect()} == {(None, "allow")}
    assert judge_urls(pages.limit(0), URL_RULES, pages).count() == 0
    own = judge_urls(pages, [UrlRule("block", "a.com", ""), UrlRule("allow", "com", "/x/")], none)
    assert {r.page_id: r.rule for r in own.collect()} == {1: "a.com", 2: None}


def test_filter_is_small_and_lets_few_others_through(spark):
    from pyspark.sql import functions as F

    from flowlens.llm.url_filter import WORDS, _bits, _block

    names = spark.range(20_000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    blocks = filter_blocks(20_000)
    assert blocks == 625 and filter_blocks(10**12) == 1 << 18 and filter_blocks(0) == 1
    table = blocked_filter(names, blocks)
    assert table.count() <= blocks

    def hits(rows):
        joined = rows.withColumn("block", _block(F.col("canonical"), blocks)).join(table, "block")
        hit = F.lit(True)
        for k, bit in enumerate(_bits(F.col("canonical"))):
            hit = hit & (F.col(f"w{k}").bitwiseAND(bit) != 0)
        return joined.filter(hit).count()

    assert WORDS == 8 and hits(names) == 20_000
    assert hits(spark.range(50_000).select(F.concat(F.lit("o.org/"), "id").alias("canonical"))) < 500


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string")
    plan = judge_urls(pages, URL_RULES, pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_canonical_forms(spark):
    rows = spark.createDataFrame([("HTTP://WWW.A.org:443//p//?z=1&&utm_a=2&b=#f",), ("x",), ("s://h",)], "u string")
    got = [tuple(r) for r in rows.select(canonical_url(F_u()), url_host(F_u()), url_path(F_u())).collect()]
    assert got == [("a.org//p?b=&z=1", "www.a.org:443", "//p//"), (None, "", ""), ("h", "h", "")]


def F_u():
    from pyspark.sql import functions as F

    return F.col("u")
