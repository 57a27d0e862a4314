"""Spelling variants: words one edit apart, found by search schemes over two suffix-rank indexes.

A word and its variant agree exactly in one half of the word. Each half is matched exactly from the
word's outer end and the match is extended across the other half with one error: the left half to
the right, the right half to the left. Words are therefore indexed twice, as they are and mirrored,
and every search runs in one direction of its index.

The vocabulary is dealt out by what a word must share with its partners: the partner's length and
the first letters, from either end, so that a word is one index entry and at most three queries on
each side. A task builds the index of some 200,000 symbols and answers its queries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ranges, runs, stored, strings_at, text_slices, utf8
from flowlens.llm.crc import joined_crc

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
ERASE = 31
# Symbols in the index of one task.
SHARD_SYMBOLS = 200_000
# Queries answered side by side.
QUERIES = 100_000
# Intervals up to this width are listed row by row, wider ones are asked for every symbol.
NARROW = 64

LETTER = np.zeros(256, bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True
# First byte of U+00C0 to U+00FF; the second byte may be any.
LETTER[0xC3] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

DELETED, REPLACED, INSERTED = -1, 0, 1


def slice_words(ids: pa.Array, texts: pa.Array, min_length: int, erase: int | None) -> tuple[pa.Array, np.ndarray]:
    """(words, counts) of some texts; equal words may stand twice.

    Runs of Latin letters, A-Z in small letters. With ``erase``, a run loses one letter where
    ``erase`` divides the CRC of "id:run"; the place is the CRC modulo the run's length.
    """
    data, offsets = utf8(texts)
    inside = LETTER[data]
    if len(data):
        inside[1:] |= data[:-1] == 0xC3
    starts, ends, owner = runs(inside, offsets)
    body = LOWER[data][inside]
    found = strings_at(body, np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
    names, codes = found.dictionary, found.indices.to_numpy()
    sizes = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    use = np.flatnonzero(sizes[codes] >= min_length)
    pairs, counts = np.unique(owner[use] * max(1, len(names)) + codes[use], return_counts=True)
    doc, word = pairs // max(1, len(names)), pairs % max(1, len(names))
    hit = np.zeros(len(pairs), bool)
    if erase:
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
        spelt = [w.encode() for w in names.to_pylist()]
        crcs = np.array([zlib.crc32(w) for w in spelt], np.uint32)
        width = np.array([len(w) for w in spelt], np.int64)
        h = joined_crc(heads[doc], crcs[word], width[word])
        hit = h % erase == 0
    whole = np.bincount(word[~hit], counts[~hit], len(names)).astype(np.int64)
    kept = np.flatnonzero(whole)
    texts, numbers = [names.take(pa.array(kept))], [whole[kept]]
    if hit.any():
        changed = names.take(pa.array(word[hit])).to_pylist()
        cut = (h[hit].astype(np.int64) % sizes[word[hit]]).tolist()
        shorter = [w[:i] + w[i + 1:] for w, i in zip(changed, cut)]
        long = np.array([len(w) >= min_length for w in shorter], bool)
        texts.append(pa.array(shorter, pa.large_string()).filter(pa.array(long)))
        numbers.append(counts[hit][long])
    return pa.chunked_array(texts).combine_chunks(), np.concatenate(numbers)


def vocabulary(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    erase: int | None = None, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n): the distinct words of all texts with their numbers of occurrences.

    Words shorter than ``min_length`` letters or rarer than ``min_count`` are left out. A null
    text has no words, a null id counts as an empty one. Tasks send each word of a slice once.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, n = slice_words(part["doc_id"], part["text"], min_length, erase)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])

    rows = docs.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).filter("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class SuffixRanks:
    """Backward search over the sorted rotations of a text of delimited words.

    Symbol 0 ends every word. ``keys`` holds symbol * n + row of each row's preceding symbol, in
    order: the place of a symbol and a row in it is at once the row that the symbol leads to.
    """

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = len(text)
        bits = max(1, int(symbols).bit_length())
        per = max(1, 62 // bits)
        packed = np.zeros(n, np.int64)
        for k in range(per):
            packed = (packed << bits) | np.roll(text, -k)
        # Prefix doubling: ranks by ``length`` symbols give ranks by twice as many.
        length = per
        while True:
            self.rows = np.argsort(packed, kind="stable")
            ordered = packed[self.rows]
            rank = np.empty(n, np.int64)
            rank[self.rows] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if rank[self.rows[-1]] == n - 1 or length >= n:
                break
            packed = rank * n + np.roll(rank, -length)
            length *= 2
        self.n, self.symbols = n, symbols
        self.before = text[self.rows - 1]
        self.keys = np.sort(self.before * n + np.arange(n))

    def extend(self, symbol, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + pattern from those of the pattern; empty where there is none."""
        base = symbol * self.n
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray):
        """(interval, symbol, low, high): every letter that precedes each of the intervals."""
        pairs, back = np.unique(low * (self.n + 1) + high, return_inverse=True)
        low, high = pairs // (self.n + 1), pairs % (self.n + 1)
        width = high - low
        slim = np.flatnonzero(width <= NARROW)
        owner = np.repeat(slim, width[slim])
        seen = np.unique(owner * (self.symbols + 1) + self.before[ranges(low[slim], width[slim])])
        at, symbol = [seen // (self.symbols + 1)], [seen % (self.symbols + 1)]
        wide = np.flatnonzero(width > NARROW)
        for s in range(1, self.symbols + 1) if len(wide) else ():
            a, b = self.extend(s, low[wide], high[wide])
            at.append(wide[a < b])
            symbol.append(np.full(int((a < b).sum()), s))
        at, symbol = np.concatenate(at), np.concatenate(symbol)
        order = np.argsort(at, kind="stable")
        order = order[symbol[order] > 0]
        at, symbol = at[order], symbol[order]
        a, b = self.extend(symbol, low[at], high[at])
        # Back from distinct intervals to the askers.
        first = np.searchsorted(at, np.arange(len(low) + 1))
        count = np.diff(first)[back]
        pick = ranges(first[:-1][back], count)
        return np.repeat(np.arange(len(back)), count), symbol[pick], a[pick], b[pick]


def one_error(
    index: SuffixRanks, words: int, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
    exact: np.ndarray, kind: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the indexed words that differ from a query by one edit of its kind.

    The first ``exact`` symbols must match; the error lies behind them. ``row`` is that of the
    delimiter before the word found. Every word is found once for a query: of the equivalent
    places of an error in a run of equal letters only the last counts.
    """
    query = np.arange(len(starts))
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), words)
    found_query, found_row = [], []

    def symbol(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The symbol of each query at a place; the delimiter behind its end."""
        inside = p < lengths[q]
        return np.where(inside, codes[np.where(inside, starts[q] + p, 0)], 0)

    def finish(q: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Match what is left of the queries and the delimiter exactly."""
        while len(q):
            a, b = index.extend(symbol(q, p), a, b)
            whole = (p == lengths[q]) & (a < b)
            found_query.append(q[whole])
            found_row.append(a[whole])
            more = (p < lengths[q]) & (a < b)
            q, p, a, b = q[more], p[more] + 1, a[more], b[more]

    for p in range(int(exact.max(initial=0))):
        on = exact[query] > p
        low[on], high[on] = index.extend(symbol(query[on], np.full(int(on.sum()), p)), low[on], high[on])
        left = low < high
        query, low, high = query[left], low[left], high[left]
    place = exact[query]
    while len(query):
        here, inner = symbol(query, place), place < lengths[query]
        gone = np.flatnonzero(inner & (kind[query] == DELETED) & (here != symbol(query, place + 1)))
        finish(query[gone], place[gone] + 1, low[gone], high[gone])
        other = np.flatnonzero((kind[query] == INSERTED) | (inner & (kind[query] == REPLACED)))
        if len(other):
            at, letter, a, b = index.branches(low[other], high[other])
            q = query[other][at]
            differs = letter != here[other][at]
            q, a, b, at = q[differs], a[differs], b[differs], at[differs]
            finish(q, place[other][at] + (kind[q] == REPLACED), a, b)
        go = np.flatnonzero(inner)
        a, b = index.extend(here[go], low[go], high[go])
        left = a < b
        query, place, low, high = query[go][left], place[go][left] + 1, a[left], b[left]
    if not found_query:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_query), np.concatenate(found_row)


def _points(words: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words in a row, and their lengths."""
    spelt = [w[::-1] for w in words] if mirrored else words
    points = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.array([len(w) for w in words], np.int64)


RESULT = "word string, n_near bigint, best_n bigint, best string"


def answer_shard(rows: pa.Table) -> pa.Table:
    """Near words of the queries of a shard: their number and the most frequent one.

    Rows are (side, word, n, kind); a null kind marks an entry of the index. A mirrored shard
    leaves out what the other side finds: words that agree in the left half.
    """
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    entries = rows.filter(pc.is_null(rows["kind"])).select(["word", "n"])
    # A word may ask for several salts of its key that came to lie in one shard.
    asked = rows.filter(pc.is_valid(rows["kind"])).select(["word", "kind"]).group_by(["word", "kind"]).aggregate([])
    if not len(entries) or not len(asked):
        return schema.empty_table()
    mirrored = bool(rows["side"][0].as_py())
    entries = entries.take(pc.sort_indices(entries, [("word", "ascending")]))
    words, counts = entries["word"].to_pylist(), entries["n"].to_numpy()
    points, sizes = _points(words, mirrored)
    letters = np.unique(points)
    # Each word backwards, then its delimiter: what is read forwards extends a match backwards.
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    text[np.repeat(ends - 2, sizes) - ranges(np.zeros(len(sizes), np.int64), sizes)] = (
        np.searchsorted(letters, points) + 1)
    index = SuffixRanks(text, len(letters))
    parts = []
    for begin in range(0, len(asked), QUERIES):
        group = asked.slice(begin, QUERIES)
        names = group["word"].to_pylist()
        spelt, lengths = _points(names, mirrored)
        place = np.minimum(np.searchsorted(letters, spelt), len(letters) - 1)
        # A letter that the index lacks leads to an empty interval.
        codes = np.where(letters[place] == spelt, place + 1, len(letters) + 1)
        starts = np.cumsum(lengths) - lengths
        half = lengths // 2
        exact = lengths - half if mirrored else half
        query, row = one_error(index, len(words), codes, starts, lengths, exact, group["kind"].to_numpy())
        # The delimiter found stands before the word, in cyclic order.
        word = np.searchsorted(ends, (index.rows[row] + 1) % index.n, side="right")
        fits = sizes[word] == lengths[query] + group["kind"].to_numpy()[query]
        if mirrored:
            a = points[ranges(ends[word] - word - 1 - half[query], half[query])]
            b = spelt[ranges(starts[query] + lengths[query] - half[query], half[query])]
            differ = np.concatenate([[0], np.cumsum(a != b)])
            edge = np.concatenate([[0], np.cumsum(half[query])])
            fits &= differ[edge[1:]] > differ[edge[:-1]]
        query, word = query[fits], word[fits]
        near = np.bincount(query, minlength=len(names))
        order = np.lexsort((word, -counts[word], query))
        best = word[order[np.searchsorted(query[order], np.flatnonzero(near))]]
        with_near = pa.array(np.flatnonzero(near))
        parts.append(pa.table([
            group["word"].take(with_near).cast(pa.string()), pa.array(near[near > 0].astype(np.int64)),
            pa.array(counts[best]), entries["word"].take(pa.array(best)).cast(pa.string())], schema=schema))
    return pa.concat_tables(parts).combine_chunks()


def dealt_words(words: DataFrame, symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(shard, side, word, n, kind): index entries and queries, each where its partners are.

    A key is a length and so many letters that a word of this length and all its partners have in
    common on one side. The entries of a key that is too large for a shard are dealt out by hash,
    and its queries go to all of their shards.
    """
    length = F.length("word")
    total = words.agg(F.sum(length + 1)).first()[0] or 0
    shards = max(1, -(-total // symbols))
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn(
        "spelt", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    kinds = F.array(F.lit(None).cast("int"), *[F.lit(k) for k in (DELETED, REPLACED, INSERTED)])
    keyed = sides.withColumn("kind", F.explode(kinds)).withColumn(
        "long", length + F.coalesce("kind", F.lit(0))
    ).withColumn("key", F.substring("spelt", F.lit(1), F.greatest(F.lit(0), F.floor((F.col("long") - 1) / 2)).cast("int")))
    entries = keyed.filter("kind IS NULL")
    # Keys that fill more than a shard: fewer than there are shards.
    big = stored(
        entries.groupBy("side", "long", "key").agg(F.sum(length + 1).alias("size"))
        .filter(F.col("size") > symbols)
        .select("side", "long", "key", F.ceil(F.col("size") / symbols).cast("int").alias("salts")), "big")
    salted = keyed.join(big, ["side", "long", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64(F.lit("entry"), "word"), F.col("salts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    spread = F.explode(F.when(F.col("kind").isNull(), own).otherwise(every))
    shard = F.col("side") * shards + F.pmod(F.xxhash64("long", "key", "salt"), F.lit(shards)).cast("int")
    return salted.withColumn("salt", spread).select(
        shard.cast("int").alias("shard"), "side", "word", "n", "kind")


def near_words(words: DataFrame, symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, n_near, best_n, best) for the words of (word, n) with a word one edit away.

    ``best`` is the near word of the largest ``n``, of several the first in code-point order.
    Words must be distinct and not null.
    """
    answers = dealt_words(words, symbols).groupBy("shard").applyInArrow(answer_shard, RESULT)
    return answers.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")
    ).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def spelling_groups(words: DataFrame, ratio: int = RATIO, symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n).

    ``form`` is the most frequent near word if it is ``ratio`` times as frequent, else null. Forms
    lead to ever more frequent words, so following them ends; ``root`` is the end, the word itself
    without a form. Null words are left out, and an empty table gives no rows.
    """
    words = words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL")
    near = near_words(words, symbols)
    better = F.col("best_n") >= ratio * F.col("n")
    table = stored(
        words.join(near, "word", "left").select(
            "word", F.when(better, F.col("best")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("best_n")).alias("form_n")), "forms")
    links = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Pointer doubling: each round doubles the steps that every link takes.
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(links.join(ahead, "root", "left"), "roots")
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next IS NOT NULL").isEmpty():
            break
    return table.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
