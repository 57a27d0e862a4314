"""URL filter: host and path rules, then a list of URLs behind a blocked Bloom filter.

A URL that no rule decides is looked up in a list. A filter of bounded size, broadcast, lets nearly
all unlisted URLs pass by at once; an exact hash join decides the possible hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import stored

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"

# A block has eight words of 64 bits; a URL sets one bit in each.
WORDS = 8
BITS_PER_URL = 16
# Blocks of the filter at most, some 30 MB as a hash table; a longer list fills them more densely
# and sends more possible hits into the exact join.
MAX_BLOCKS = 1 << 18
# A confirmed URL meets its pages in this many tasks.
SALTS = 8
RESULTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, in small letters; or ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, SMALL), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' for a null URL or one without ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One spelling for URLs of the same page; null for a null URL or one without ://.

    Scheme, fragment, default ports, a leading ``www.``, slashes at the end of the path and
    parameters that begin with ``utm_`` go; the other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), ":(80|443)$", ""), r"^www\.", "")
    path = F.rtrim(url_path(url), F.lit("/"))
    kept = F.array_sort(F.filter(
        F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, query))


def _fitting(rules: Sequence[UrlRule], host: Column, path: Column, result) -> Column:
    """``result`` of the longest rule that fits, else null; rules of equal text go by the first."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(result(rule))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """The bit of a URL in each word of its block, as a mask."""
    places = F.xxhash64(F.lit(1), url)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(places, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(WORDS)]


def blocked_filter(urls: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 … w7) of the column ``canonical``: one row for each block that is not empty."""
    return urls.select(_block(F.col("canonical"), blocks).alias("block"), *[
        b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("canonical")))
    ]).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def filter_blocks(urls: int, most: int = MAX_BLOCKS) -> int:
    return min(most, max(1, -(-urls * BITS_PER_URL // (64 * WORDS))))


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], listed: DataFrame, url: str = "url",
    most_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    The longest rule that fits decides; ``rules`` is a short list that becomes part of the plan.
    Otherwise a URL is blocked if its canonical form is that of a ``url`` in ``listed``. Null URLs
    and those without :// are allowed, null ones in the list are ignored, copies on either side
    change nothing. Columns that are named like a result are replaced, all others stay.
    """
    row = F.struct(*[c for c in pages.columns if c not in RESULTS])
    cut = pages.select(row.alias("row"), F.col(url).alias("url")).select(
        "row", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = cut.select(
        "row", "host", "path",
        _fitting(rules, F.col("host"), F.col("path"), lambda r: r.name).alias("rule"),
        _fitting(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("verdict"), "url",
    ).withColumn("canonical", F.when(F.col("verdict").isNull(), canonical_url(F.col("url"))))
    names = stored(
        listed.select(canonical_url(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL")
        .distinct(), "listed")
    blocks = filter_blocks(names.count(), most_blocks)
    table = F.broadcast(stored(blocked_filter(names, blocks), "filter"))
    probed = ruled.withColumn("block", _block(F.col("canonical"), blocks)).join(table, "block", "left")
    hit = F.col("w0").isNotNull() & F.col("canonical").isNotNull()
    for k, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    probed = probed.select(
        "row", "host", "path", "rule", "verdict", "canonical", F.coalesce(hit, F.lit(False)).alias("hit"))
    possible = probed.filter("hit")
    confirmed = stored(
        possible.select("canonical").distinct().join(names, "canonical", "left_semi"), "confirmed")
    # A URL with a third of all pages is one row here; its pages are dealt out by salt.
    copies = confirmed.select(
        F.col("canonical").alias("_canonical"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = possible.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    decided = salted.join(
        copies, (F.col("canonical") == F.col("_canonical")) & (F.col("_deal") == F.col("_salt")), "left")
    passed = probed.filter("NOT hit").withColumn("_canonical", F.lit(None).cast("string"))
    both = decided.drop("_salt", "_deal").unionByName(passed)
    return both.select("row.*", "host", "path", "rule", F.coalesce(
        "verdict", F.when(F.col("_canonical").isNotNull(), "block").otherwise("allow")).alias("verdict"))
