"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Shipped, slices, utf8

# Bytes of context; a context and its next byte fit into one 64-bit key.
ORDER = 4
# Bounds of the training sample: bytes expected per language, and for all of them together.
SAMPLE_BYTES = 1_500_000
TOTAL_BYTES = 24_000_000
MAX_LANGUAGES = 256
# Positions scored at once.
WINDOW = 1 << 19
UNKNOWN = "und"


class KeyIndex:
    """Positions of distinct 64-bit keys, by open addressing; looks up whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(self.keys[left])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is absent."""
        slot = self._slot(keys)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[slot[wrong]]
            again = (found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])
            wrong = wrong[again]
        return found


@dataclass
class Level:
    """One depth of all languages' trees: code lengths of context+byte, escapes of contexts."""

    grams: KeyIndex = field(repr=False)
    bits: np.ndarray = field(repr=False)  # gram x language
    contexts: KeyIndex = field(repr=False)
    escapes: np.ndarray = field(repr=False)  # context x language


@dataclass
class ByteTrees:
    """Per language a tree of byte contexts with frozen counts, method C escapes."""

    languages: list[str]
    order: int
    levels: list[Level] = field(repr=False)

    @staticmethod
    def build(languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]], order: int) -> ByteTrees:
        """``grams[l]``: distinct (order+1)-byte keys of language l and their counts.

        With n of T bytes after a context and U different ones, a byte costs -log2 n/(T+U), the
        escape to the next shorter context -log2 U/(T+U); below depth 0 a byte costs 8 bits.
        """
        levels: list[Level] = []
        for depth in range(order + 1):
            mask = np.uint64((1 << (8 * (depth + 1))) - 1)
            seen = []
            for keys, counts in grams:
                short, at = np.unique(keys & mask, return_inverse=True)
                seen.append((short, np.bincount(at, weights=counts, minlength=len(short))))
            union = np.unique(np.concatenate([s for s, _ in seen] or [np.zeros(0, np.uint64)]))
            above = np.unique(union >> np.uint64(8))
            escapes = np.zeros((len(above), len(languages)))
            bits = np.full((len(union), len(languages)), 8.0)
            if depth:
                shorter = levels[-1].grams.find(union & np.uint64((1 << (8 * depth)) - 1))
                bits = levels[-1].bits[shorter].astype(np.float64)
            for number, (keys, counts) in enumerate(seen):
                parent, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                total = np.bincount(at, weights=counts, minlength=len(parent))
                kinds = np.bincount(at, minlength=len(parent))
                escapes[np.searchsorted(above, parent), number] = -np.log2(kinds / (total + kinds))
                bits[:, number] += escapes[np.searchsorted(above, union >> np.uint64(8)), number]
                bits[np.searchsorted(union, keys), number] = -np.log2(counts / (total + kinds)[at])
            levels.append(Level(KeyIndex(union), bits.astype(np.float32),
                                KeyIndex(above), escapes.astype(np.float32)))
        return ByteTrees(languages, order, levels)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of every text under every language (text x language)."""
        data, offsets = utf8(texts)
        result = np.zeros((len(offsets) - 1, len(self.languages)))
        for start, stop in slices(np.diff(offsets), WINDOW):
            begin, end = int(offsets[start]), int(offsets[stop])
            for low in range(begin, end, WINDOW):  # a longer text in windows
                high = min(low + WINDOW, end)
                owner = np.repeat(np.arange(start, stop), np.diff(np.clip(offsets[start:stop + 1], low, high)))
                bits = self._bits(keys_of(data, offsets, owner, low, high, self.order))
                for number in range(len(self.languages)):
                    result[start:stop, number] += np.bincount(
                        owner - start, weights=bits[:, number], minlength=stop - start)
        return result

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(keys), len(self.languages)), np.float32)
        rows = np.arange(len(keys))
        for depth in range(self.order, -1, -1):
            level = self.levels[depth]
            short = keys & np.uint64((1 << (8 * (depth + 1))) - 1)
            found = level.grams.find(short)
            good = found >= 0
            if len(rows) == len(bits):  # the deepest contexts, where most bytes are known
                bits[good] = level.bits[found[good]]
            else:
                bits[rows[good]] += level.bits[found[good]]
            rows, keys = rows[~good], keys[~good]
            if not len(rows):
                return bits
            context = level.contexts.find(short[~good] >> np.uint64(8))
            known = context >= 0
            bits[rows[known]] += level.escapes[context[known]]
        bits[rows] += 8.0
        return bits


def keys_of(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, low: int, high: int, order: int) -> np.ndarray:
    """Of the bytes ``low .. high``: the byte and the ``order`` before it in its text, as a key."""
    keys = data[low:high].astype(np.uint64)
    at = np.arange(low, high) - offsets[owner]
    for back in range(1, order + 1):
        earlier = np.zeros(high - low, np.uint64)
        shift = max(0, back - low)
        earlier[shift:] = data[low + shift - back:high - back]
        earlier[at < back] = 0
        keys |= earlier << np.uint64(8 * back)
    return keys


def train(
    docs: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES,
    total_bytes: int = TOTAL_BYTES, text: str = "text", lang: str = "lang",
) -> ByteTrees:
    """Byte trees of the languages in ``docs``, from rows with text and language.

    The trees are fitted on a sample: rows are drawn by hash so that ``sample_bytes`` of text per
    language are expected, ``total_bytes`` for all. That bounds the model too. Context counts are
    summed in Spark; the driver gets the distinct contexts of the sample.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("lang").limit(
        MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = [r for r in sizes if r["size"]]
    languages = [r["lang"] for r in sizes]
    if not languages:
        return ByteTrees([], order, [])
    allowed = min(sample_bytes, total_bytes // len(languages))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, allowed / r["size"]))])
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "text", F.monotonically_increasing_id()),
                  F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(draw < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["lang"].to_numpy()
            for code in np.unique(codes):
                data, offsets = utf8(batch["text"].filter(pa.array(codes == code)))
                for start, stop in slices(np.diff(offsets), WINDOW):
                    for low in range(int(offsets[start]), int(offsets[stop]), WINDOW):
                        high = min(low + WINDOW, int(offsets[stop]))
                        owner = np.repeat(np.arange(start, stop), np.diff(
                            np.clip(offsets[start:stop + 1], low, high)))
                        keys, n = np.unique(
                            keys_of(data, offsets, owner, low, high, order), return_counts=True)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(keys), code, np.int32)),
                            pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)),
                        ], ["lang", "key", "n"])

    table = sample.mapInArrow(count, "lang int, key bigint, n bigint").groupBy("lang", "key").agg(
        F.sum("n").alias("n")).toArrow()
    codes = table["lang"].to_numpy()
    keys, counts = table["key"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy()
    return ByteTrees.build(
        languages, [(keys[codes == i], counts[codes == i]) for i in range(len(languages))], order)


def predictions(model: ByteTrees, texts: pa.Array) -> pa.StructArray:
    """Language, posterior and bits per byte of the best tree, for texts with a letter."""
    lengths = np.diff(utf8(texts)[1])
    if not model.languages:
        best = np.zeros(len(texts), np.int64)
        score, rate, names = np.zeros(len(texts)), np.full(len(texts), 8.0), [UNKNOWN]
    else:
        bits = model.code_lengths(texts)
        best = bits.argmin(axis=1)
        least = bits.min(axis=1, keepdims=True)
        score = 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
        rate, names = least[:, 0] / np.maximum(lengths, 1), model.languages
    return pa.StructArray.from_arrays(
        [pa.array(names).take(pa.array(best)), pa.array(score), pa.array(rate)],
        ["lang_pred", "score", "bits_per_byte"])


def identify(docs: DataFrame, model: ByteTrees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    The language whose tree gives the whole text the shortest code; ties go to the first name.
    ``score`` is its share of the probability of all trees. A null text, an empty one or one
    without a letter is ``und`` with score 0 and null bits. Columns of these names are replaced, all others stay.
    """
    held = Shipped(docs.sparkSession, model)

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = held.get()
        for batch in batches:
            yield predictions(trees, batch)

    named = docs.drop("lang_pred", "score", "bits_per_byte")
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        has_letter = F.lit(False)
    # The row travels as one value, so that no column can clash with the work columns.
    rows = named.select(
        F.struct("*").alias("row"), has_letter.alias("has_letter"),
        F.when(has_letter, F.col(text)).otherwise("").alias("text"))
    found = rows.select("row", "has_letter", predict("text").alias("language"))
    return found.select(
        "row.*",
        F.when(F.col("has_letter"), F.col("language.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("has_letter"), F.col("language.score")).otherwise(0.0).alias("score"),
        F.when(F.col("has_letter"), F.col("language.bits_per_byte")).alias("bits_per_byte"),
    )


def accepted(min_score: float = 0.5) -> str:
    """The condition under which a document of ``identify`` has a language."""
    return f"lang_pred <> '{UNKNOWN}' AND score >= {min_score}"
