"""The text operators as registered queries over the driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import doc_remainder, read, stored
from flowlens.llm.langid import identify, train
from flowlens.llm.mixing import language_scores
from flowlens.llm.mixing import train as train_mixer
from flowlens.llm.near_vectors import near_vectors
from flowlens.llm.packing import pack_documents
from flowlens.llm.quality import RULES, STOP_FORMS, quality_rules
from flowlens.llm.resampling import resample
from flowlens.llm.sentence_pieces import round_trip_digests
from flowlens.llm.sharding import shard_documents
from flowlens.llm.simhash import hex_fingerprint, simhash_groups
from flowlens.llm.spelling import ERASE, spelling_groups, vocabulary
from flowlens.llm.token_counts import token_counts
from flowlens.llm.url_filter import UrlRule, judge_urls, url_host
from flowlens.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


def quality_sql(source: str) -> str:
    """CTEs ending in ``judged``: the measures and verdicts of the rows of ``source``."""
    stop = ", ".join(f"'{word}'" for word in STOP_FORMS)
    checks = " AND ".join(
        [f"{r.measure} >= {r.of} * {float(r.low)!r}::DOUBLE" for r in RULES if r.low is not None]
        + [f"{r.measure} <= {r.of} * {float(r.high)!r}::DOUBLE" for r in RULES if r.high is not None])
    return f"""bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM {source}),
worded AS (SELECT doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM bodies),
windows AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded)),
twice AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
measured AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
  FROM worded w LEFT JOIN repeats r ON w.doc_id IS NOT DISTINCT FROM r.doc_id),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {checks} AS kept FROM measured)"""


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", doc_remainder(4) == 2)
    model = train(docs.filter("NOT held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


OP9_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "base_failed", "kept", "n_stop_words"]


@query(f"WITH {quality_sql('documents')} SELECT {', '.join(OP9_COLUMNS)} FROM judged")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(*OP9_COLUMNS)


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), 8)


# DuckDB has no base32; the digest is spelt out from the bits of the SHA-1.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0x' || substr(h, {5 * (k // 4) + 1}, 5))::BIGINT"
    f" // {32 ** (3 - k % 4)} % 32 + 1, 1)" for k in range(32))


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h,
    max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "n_pretokens")


COSINE = ("list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))"
          " / (a.norm * b.norm)")


@query(f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, w AS v, sqrt(list_sum(list_transform(w, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS w FROM embeddings)),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND {COSINE} >= 0.98::DOUBLE),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts ON vec_id = parts.x LEFT JOIN degrees ON vec_id = degrees.x""")
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


@query()
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("training", doc_remainder(7) != 2)
    model = train_mixer(docs.filter("training"))
    return language_scores(docs.select("doc_id", "text", "training"), model, "training")


# The remainders of the bytes in the CRC-32, by the rule of its polynomial; an expression over bytes.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(
    list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes; ``t`` is the table above."""
    body = f"hex(encode({text}))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), "
            f"lambda i: ('0x' || substr({body}, 2 * i + 1, 2))::BIGINT)), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


OP11_COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


@query(f"""WITH {CRC_TABLE},
bodies AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
worded AS (SELECT side, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM bodies),
spelt AS (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
counted AS (SELECT side, doc_id, f, count(*) AS n FROM spelt GROUP BY ALL),
coded AS (SELECT f, {crc_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
placed AS (SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN coded USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s_all, coalesce(sum(n) FILTER (side = 'b'), 0) AS t_all
  FROM placed),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sides, totals),
means AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT w.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score, len(w.w) >= 20 AS fit
  FROM worded w LEFT JOIN means m ON w.doc_id = m.doc_id WHERE side = 'd'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r,
    count(*) OVER (PARTITION BY fit) AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 25 * fits // 100 THEN r END AS rank FROM numbered""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read(spark, sf_dir, "benchmark")).select(*OP11_COLUMNS)


OP12_COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@query(f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
small AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, {crc_sql("doc_id || ':' || w")} AS h FROM small, crc_table WHERE length(w) >= 7),
written AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n
  FROM hashed),
vocab AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM
  (SELECT word, unnest(range(length(word))) AS i FROM vocab)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word FROM gaps g JOIN vocab v ON g.rest = v.word
  UNION SELECT v.word, g.word FROM gaps g JOIN vocab v ON g.rest = v.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, max(n) AS top FROM pairs JOIN (SELECT word AS other, n FROM vocab) USING (other)
  GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN top >= 10 * v.n THEN (SELECT min(p.other) FROM pairs p JOIN vocab o ON p.other = o.word
      WHERE p.word = v.word AND o.n = b.top) END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM vocab v LEFT JOIN best b ON v.word = b.word),
walk AS (SELECT word, word AS top FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.top = f.word
  WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.top AS root FROM walk w JOIN forms f ON w.top = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = stored(vocabulary(docs, erase=ERASE), "vocabulary")
    return spelling_groups(words).select(*OP12_COLUMNS)


# The rules of the query, and the words that name the hosts whose pages are listed.
URL_RULES = (
    UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
LISTED_HOSTS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def _cases(result: str) -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{getattr(r, result)}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name)))
    return f"CASE {fits} END"


LISTED = " OR ".join(f"'{h}' IN (SELECT unnest(string_split(host, '.')))" for h in LISTED_HOSTS)


@query(f"""WITH cut AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
named AS (SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '') || rtrim(path, '/')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT starts_with(p, 'utm_')) AS params FROM cut)),
listed AS (SELECT DISTINCT canonical AS name FROM named WHERE {LISTED})
SELECT page_id, host, path, {_cases('name')} AS rule,
  coalesce({_cases('verdict')}, CASE WHEN name IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM named LEFT JOIN listed ON canonical = name""")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs of the pages whose host has one of the listed names in it."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.split(url_host(F.col("url")), r"\.")
    listed = pages.filter(F.arrays_overlap(labels, F.array(*[F.lit(h) for h in LISTED_HOSTS]))).select("url")
    return judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")
