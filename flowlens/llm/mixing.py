"""Language-model scores by online logistic mixing of context bit predictors.

A text is coded byte by byte, each byte as the decisions on its way through a code tree. Several
predictors look the decision up under different contexts. Their counts are exact and grow with the
training corpus: a stored table that meets the contexts of each block of texts. A gate picks a
weight set, the weighted predictions become one probability, and an adaptive map refines it.
Weights and map learn all through a text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.block_counts import (
    bucket_count, count_blocks, expand, squeeze, sum_values, unpack_strings, value_words,
)
from flowlens.llm.common import Shipped, ranges, slices, stored, strings_at, utf8

END = 256  # the symbol that closes a text
SYMBOLS = 257
# Context bytes of the predictors; 0 stands for the letters of the word so far.
CONTEXTS = (2, 3, 5, 0)
# The predictors of these numbers, known or not, select the weights.
GATES = (1, 2)
GATE = 2  # the longest; alone where ``mixed_bits`` is asked for one gate
SLICE = 2_000_000  # bytes coded at once in a task
GRAMS = 2_000_000  # grams that a task holds before it hands them on
ASKED = 500_000  # grams of blocks that are looked up together
PART = 200_000  # grams or symbols whose intermediate arrays a task holds
# Decisions between two updates, at first and later in a long text.
BATCH, STEADY, LARGEST = 32, 2048, 2048
START_WEIGHT, RATE = 0.4, 0.015
MAP_BINS, MAP_RATE, MAP_LIMIT = 24, 0.02, 8.0


@dataclass
class CodeTrees:
    """For each byte before, a Huffman tree over bytes and END: nodes and branches to each symbol.

    Frequent bytes take few decisions, about as many as the byte has bits of information.
    """

    first: np.ndarray = field(repr=False)
    length: np.ndarray = field(repr=False)
    node: np.ndarray = field(repr=False)
    branch: np.ndarray = field(repr=False)

    @staticmethod
    def build(counts: np.ndarray) -> CodeTrees:
        """From counts (symbol before x symbol); every pair counts once more, so that all have a code."""
        nodes, branches, lengths = [], [], []
        for before, row in enumerate(counts.tolist()):
            heap = [(n * 256 + 1, s, s) for s, n in enumerate(row)]
            heapq.heapify(heap)
            above: dict[int, tuple[int, int]] = {}
            for inner in range(SYMBOLS, 2 * SYMBOLS - 1):
                n0, _, a = heapq.heappop(heap)
                n1, _, b = heapq.heappop(heap)
                above[a], above[b] = (inner, 0), (inner, 1)
                heapq.heappush(heap, (n0 + n1, inner, inner))
            for symbol in range(SYMBOLS):
                way, at = [], symbol
                while at in above:
                    way.append(above[at])
                    at = above[at][0]
                lengths.append(len(way))
                nodes += [before * 256 + inner - SYMBOLS for inner, _ in reversed(way)]
                branches += [branch for _, branch in reversed(way)]
        length = np.array(lengths)
        return CodeTrees(np.cumsum(length) - length, length, np.array(nodes, np.uint32), np.array(branches, np.int8))


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, END after each, and the offsets of the texts."""
    data, offsets = utf8(texts)
    return np.insert(data.astype(np.int16), offsets[1:], END), offsets + np.arange(len(offsets))


def grams_of(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every symbol below the five before it in its text, the last one uppermost; 9 bits each.

    0 stands for "before the text", other earlier symbols are one higher.
    """
    grams = symbols.astype(np.uint64)
    for low in range(0, len(symbols), PART):
        high = min(low + PART, len(symbols))
        for back in range(1, 6):
            begin = max(low, back)
            if begin < high:
                grams[begin:high] |= (symbols[begin - back:high - back] + 1).astype(np.uint64) << np.uint64(54 - 9 * back)
    # The symbol at place n of a text has n symbols before it.
    for place in range(5):
        at = offsets[:-1] + place
        grams[at[at < len(symbols)]] &= np.uint64(511 | (2**64 - 2**(54 - 9 * place)))
    return grams


def contexts_of(grams: np.ndarray) -> list[np.ndarray]:
    """Each predictor's context, exact, as a number whose upper bits are those of the gram."""
    letters = np.zeros(len(grams), np.uint64)
    inside = np.ones(len(grams), bool)
    for back in range(1, 6):
        symbol = (grams >> np.uint64(54 - 9 * back)).astype(np.int64) & 511
        inside &= (symbol > 0) & (symbol != 33) & ((symbol < 10) | (symbol > 14))
        letters += inside
    found = []
    for width in CONTEXTS:
        known = np.uint64(width) if width else letters
        low = np.uint64(54) - np.uint64(9) * known
        found.append((grams >> low << low) | (np.uint64(0) if width else letters))
    return found


def context_hashes(symbols: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The contexts of every position, from the bytes before it in its text."""
    return contexts_of(grams_of(symbols, offsets))


def gram_pairs(grams: np.ndarray) -> np.ndarray:
    """The pairs (symbol before, symbol) of grams, numbered as by ``pairs_of``."""
    before = (grams >> np.uint64(45)).astype(np.int64) - 1
    return np.where(before < 0, END, before) * SYMBOLS + (grams & np.uint64(511)).astype(np.int64)


def pairs_of(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every symbol together with the one before it in its text; END stands before a text."""
    before = np.empty(len(symbols), np.int64)
    before[1:] = symbols[:-1]
    before[offsets[:-1]] = END
    return before * SYMBOLS + symbols


def decisions(tree: CodeTrees, pairs: np.ndarray):
    """Branches and nodes of all symbols one after the other, and how many each symbol has."""
    steps = tree.length[pairs]
    way = ranges(tree.first[pairs], steps)
    return tree.branch[way], tree.node[way], steps


def log_odds(misses: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Of branch 1; 0 only where nothing was counted."""
    odds = np.log((hits + 0.3) / (misses + 0.3))
    return np.where(misses + hits > 0, np.where(odds == 0, 1e-6, odds), 0).astype(np.float32)


def distinct(grams: np.ndarray) -> np.ndarray:
    """The distinct grams in order; sorting numbers takes less time than hashing them."""
    grams = np.sort(grams)
    return grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams in order and their summed counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def squeeze_grams(grams: np.ndarray) -> bytes:
    """Grams in order, as the byte planes of their steps."""
    steps = np.diff(grams, prepend=np.uint64(0)).astype("<u8")
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def expand_grams(blob: bytes) -> np.ndarray:
    planes = expand(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the grams, and the edges of the buckets in it; the last two symbols decide."""
    last = grams >> np.uint64(36)
    bucket = ((last * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


@dataclass
class Shared:
    """What all tasks need, of a size fixed by the symbols.

    ``short`` holds the log odds of each node for words of no letter and of one letter.
    """

    tree: CodeTrees
    short: np.ndarray = field(repr=False)

    def counted(self, table: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per predictor, the decisions that ``table`` has under their contexts, in order, and their log odds."""
        found = []
        for context, width in zip(contexts_of(table), CONTEXTS):
            # A context's symbols first, then its decisions: far fewer than the table's grams have.
            ends = np.uint64(9)
            if width == 5:
                kinds, weights = table, counts
            else:
                kinds, weights = summed((context << ends) | (table & np.uint64(511)), counts)
                context = kinds >> ends
            before = (context >> np.uint64(45)).astype(np.int64) - 1
            own = np.where(before < 0, END, before) * SYMBOLS + (kinds & np.uint64(511)).astype(np.int64)
            branch, at, steps = decisions(self.tree, own)
            keys = np.repeat(context, steps) << np.uint64(8) | (at % np.uint32(256))
            order = np.argsort(keys, kind="stable")
            keys, branch = keys[order], branch[order]
            weights = np.repeat(weights, steps)[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(weights, first) if len(first) else weights
            hits = np.add.reduceat(weights * branch, first) if len(first) else weights
            found.append((keys[first], log_odds(total - hits, hits)))
        return found

    def odds_of(self, counted: list[tuple[np.ndarray, np.ndarray]], grams: np.ndarray) -> np.ndarray:
        """Per predictor, the log odds at each decision of ``grams``, those of ``PART`` grams at a time."""
        ends = np.concatenate([[0], np.cumsum(self.tree.length[gram_pairs(grams)])])
        result = np.zeros((len(CONTEXTS), int(ends[-1])), np.float32)
        for low in range(0, len(grams), PART):
            part = grams[low:low + PART]
            own = result[:, ends[low]:ends[min(low + PART, len(grams))]]
            _, node, steps = decisions(self.tree, gram_pairs(part))
            for k, context in enumerate(contexts_of(part)):
                known, odds = counted[k]
                if len(known):
                    wanted = np.repeat(context, steps) << np.uint64(8) | (node % np.uint32(256))
                    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    own[k] = np.where(known[place] == wanted, odds[place], 0)
                if CONTEXTS[k] == 0:
                    letters = np.repeat(context & np.uint64(511), steps)
                    few = letters < 2
                    own[k, few] = self.short[letters[few].astype(np.int64), node[few]]
        return result

    def odds(self, table: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Per predictor, the log odds at each decision of ``grams``, counted over all of ``table``.

        ``table`` must hold every training gram whose last two symbols are those of one of ``grams``.
        """
        return self.odds_of(self.counted(table, counts), grams)


def coded_bits(tree: CodeTrees, grams: np.ndarray, odds: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Total code length in bits of every text, its end included.

    ``odds``, a column per decision, are those of the decisions of ``grams``, among which are all
    grams of the texts. They are read by rows: best given as the transpose of an array of rows.
    """
    pairs = gram_pairs(grams)
    steps = tree.length[pairs].astype(np.int32)
    begin, known = (np.cumsum(steps) - steps).astype(np.int32), pa.array(grams)
    branch = np.concatenate([np.zeros(0, np.int8), *(
        tree.branch[ranges(tree.first[pairs[low:low + PART]], steps[low:low + PART])]
        for low in range(0, len(pairs), PART))])
    del pairs
    odds = np.ascontiguousarray(odds.T).T

    def way(symbols: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each decision of the symbols low .. high; the ends of each symbol's decisions."""
        before = max(0, low - 8)
        edges = np.unique(np.clip(offsets, before, high)) - before
        which = pc.index_in(pa.array(grams_of(symbols[before:high], edges)[low - before:]), value_set=known).to_numpy()
        ends = np.zeros(len(which) + 1, np.int32)
        np.cumsum(steps.take(which), out=ends[1:])
        slot = np.arange(ends[-1], dtype=np.int32)
        for at in range(0, len(which), PART):
            part = which[at:at + PART]
            slot[ends[at]:ends[at + len(part)]] += np.repeat(begin.take(part) - ends[at:at + len(part)], steps.take(part))
        return slot, ends

    result = np.zeros(len(texts))
    lengths = np.diff(utf8(texts)[1])
    for start, stop in slices(lengths, SLICE):
        symbols, offsets = symbols_of(texts.slice(start, stop - start))
        if int(lengths[start]) <= SLICE:
            slot, ends = way(symbols, offsets, 0, len(symbols))
            ends = ends[offsets]
            result[start:stop] = mixed_bits(odds, [slot] * len(odds), branch, ends[:-1], ends[1:], GATES)
        else:  # one long text, a window at a time; its state goes on
            lane = Lanes(1, len(odds), GATES)
            for low in range(0, len(symbols), SLICE):
                high = min(low + SLICE, len(symbols))
                slot, _ = way(symbols, offsets, low, high)
                result[start] += lane.code_on(odds.T, slot, branch, high == len(symbols))
    return result


def gram_slices(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The grams of all positions of ``texts``, a part of about ``size`` symbols at a time."""
    for start, stop in slices(np.diff(utf8(texts)[1]), size):
        symbols, offsets = symbols_of(texts.slice(start, stop - start))
        for low in range(0, len(symbols), size):  # a long text in windows
            high = min(low + size, len(symbols))
            before = max(0, low - 8)
            edges = np.unique(np.clip(offsets, before, high)) - before
            yield grams_of(symbols[before:high], edges)[low - before:]


@dataclass
class Mixer:
    """The code tree and the training texts' grams: rows (bucket, grams, counts), stored.

    The table grows with the distinct grams of the corpus; contexts of up to five symbols are kept
    exactly, so no two share their counts.
    """

    shared: Shared
    table: DataFrame = field(repr=False)
    buckets: int

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code lengths of a few texts, looked up here; ``block_bits`` does it for a table."""
        grams, odds = np.unique(np.concatenate([np.zeros(0, np.uint64), *gram_slices(texts, SLICE)])), []
        order, edges = dealt(grams, self.buckets)
        grams = grams[order]
        held = {r["bucket"]: r for r in self.table.collect()}
        for b in range(self.buckets):
            own = (expand_grams(held[b]["grams"]), expand(held[b]["counts"], np.int64)) if b in held else (
                np.zeros(0, np.uint64), np.zeros(0, np.int64))
            odds.append(self.shared.odds(*own, grams[edges[b]:edges[b + 1]]))
        return coded_bits(self.shared.tree, grams, np.concatenate(odds, axis=1), texts)

    @property
    def odds(self) -> np.ndarray:
        """The log odds at the decisions of all grams by bucket, collected; for small models."""
        rows = sorted(self.table.collect(), key=lambda r: r["bucket"])
        return np.concatenate([np.zeros((len(CONTEXTS), 0), np.float32), *(
            self.shared.odds(expand_grams(r["grams"]), expand(r["counts"], np.int64), expand_grams(r["grams"]))
            for r in rows)], axis=1)


def batches(begin: int, end: int) -> Iterator[tuple[int, int]]:
    """(first decision, decisions) of a text's batches from ``begin`` up to ``end``.

    ``BATCH`` decisions each; beyond ``STEADY`` decisions twice as many, beyond twice ``STEADY``
    four times as many, and so on up to ``LARGEST``.
    """
    while begin < end:
        size = BATCH
        while size < LARGEST and begin >= STEADY * (size // BATCH):
            size *= 2
        yield begin, size
        begin += size


class Lanes:
    """Texts coded side by side, a batch of decisions of each at a time; each learns by itself.

    Which of the ``gates`` predictors know their context selects one of the weight sets. Weights
    follow the gradient of the code length, the map follows the branches, both after each batch
    and all through a text. A larger batch takes smaller steps, as many decisions teach alike.
    """

    def __init__(self, lanes: int, predictors: int, gates: tuple[int, ...]):
        self.gates = gates
        self.weights = np.full((1 << len(gates), predictors, lanes), START_WEIGHT, np.float32)
        # A predictor that does not know its context adds nothing to a set.
        self.terms = [[k for k in range(predictors) if k not in gates or number >> gates.index(k) & 1]
                      for number in range(1 << len(gates))]
        spots = np.linspace(-MAP_LIMIT, MAP_LIMIT, MAP_BINS, dtype=np.float32)
        self.refined = np.tile(1 / (1 + np.exp(-spots)), lanes).astype(np.float32)
        self.done = 0
        self.rest = np.zeros(0, np.int32)

    def code_on(self, odds: np.ndarray, slot: np.ndarray, branch: np.ndarray, last: bool) -> float:
        """Code length of the next decisions of the only lane; an unfilled batch waits unless ``last``."""
        slot = np.concatenate([self.rest, slot])
        end = self.done + len(slot)
        whole = self.done
        for begin, size in batches(self.done, end):
            if begin + size <= end or last:
                whole = min(begin + size, end)
        stop = whole - self.done
        bits = self.code(odds, slot, branch, np.array([0]), np.array([stop]))
        self.done, self.rest = whole, slot[stop:]
        return float(bits[0])

    def code(self, odds: np.ndarray, slot: np.ndarray, branch: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Code length of the decisions ``first .. stop`` of every lane, the longest lane first.

        A decision's row of ``odds`` and its ``branch`` are those of its ``slot``.
        """
        length = stop - first
        cost = np.zeros(len(length))
        scale = np.float32((MAP_BINS - 1) / (2 * MAP_LIMIT))
        middle = np.float32(MAP_LIMIT) * scale + np.float32(0.5)
        bins = np.arange(len(length)) * MAP_BINS
        for begin, size in batches(self.done, self.done + int(length.max(initial=0))):
            at = begin - self.done
            n = int(np.searchsorted(-length, -at, side="left"))
            index = at + np.arange(size)[:, None]
            real = None
            if length[n - 1] < at + size:  # a batch shorter than the others repeats its last decision
                real = index < length[:n]
                index = np.minimum(index, length[:n] - 1)
            index = index + first[:n]
            index = slot.take(index)
            rows = odds.take(index, axis=0)
            x = [np.ascontiguousarray(rows[:, :, k]) for k in range(rows.shape[2])]
            y = branch.take(index).astype(np.float32)
            known = np.zeros(y.shape, np.int8)
            for bit, k in enumerate(self.gates):
                known |= (x[k] != 0).view(np.int8) << bit
            stretched, sets = None, []
            for number, own in enumerate(self.weights):
                chosen = known == number
                if chosen.any():
                    sets.append((number, chosen))
                    head, *others = self.terms[number]
                    total = x[head] * own[head, :n]
                    for k in others:
                        total += x[k] * own[k, :n]
                    if stretched is None:
                        stretched = total
                    else:
                        np.copyto(stretched, total, where=chosen)
            np.clip(stretched, -MAP_LIMIT, MAP_LIMIT, out=stretched)
            mixed = np.exp(-stretched)
            mixed += 1
            np.reciprocal(mixed, out=mixed)
            spot = (stretched * scale + middle).astype(np.int64)
            spot += bins[:n]
            error, off = y - mixed, y - self.refined.take(spot)
            # The probability of the branch taken, half by the weights, half by the map.
            taken = 1 - np.abs(np.float32(0.5) * (error + off))
            np.maximum(taken, np.float32(1e-5), out=taken)
            off += 1024
            if real is not None:
                taken[~real] = 1
                error *= real
                off *= real
            # Four probabilities of at least 1e-5 have a product that single precision holds.
            cost[:n] -= np.log2(np.multiply.reduce(taken.reshape(-1, 4, n), axis=1)).sum(axis=0, dtype=np.float64)
            error *= np.float32(RATE * BATCH / size)
            for number, chosen in sets:
                gated = error * chosen
                for k in self.terms[number]:
                    self.weights[number, k, :n] += np.einsum("ij,ij->j", gated, x[k])
            # Hits and misses of the map's bins in one sum: 1,024 for a hit, the miss beside it.
            seen = np.bincount(spot.ravel(), weights=off.ravel(), minlength=n * MAP_BINS)
            hits = np.rint(seen / 1024)
            # At most a full step towards the mean of what was seen.
            self.refined[:n * MAP_BINS] += ((seen - 1024 * hits) * (MAP_RATE / (1 + MAP_RATE * hits))).astype(np.float32)
        return cost


def mixed_bits(
    odds: np.ndarray | list[np.ndarray], slots: list[np.ndarray], branch: np.ndarray,
    first: np.ndarray, stop: np.ndarray, gates: tuple[int, ...] = (GATE,),
) -> np.ndarray:
    """Code length of every text, whose decisions are ``first .. stop``; texts learn independently.

    ``odds`` are those of each predictor by slot, ``branch`` those of the slots; ``slots`` tell the
    slot of each decision, the same for all predictors.
    """
    rows = np.ascontiguousarray(np.asarray(odds).T)
    order = np.argsort(first - stop, kind="stable")
    result = np.zeros(len(first))
    result[order] = Lanes(len(first), len(odds), gates).code(rows, slots[0], branch, first[order], stop[order])
    return result


def train(docs: DataFrame, text: str = "text") -> Mixer:
    """Code tree and counts of grams from every text of ``docs``; a null text is an empty one.

    Tasks count distinct grams, which are summed by bucket in Spark and stored. The driver gets
    pairs of symbols only, for the tree and for words of fewer than two letters.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"))
    buckets = bucket_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            grams, counts = summed(*(np.concatenate(c) for c in zip(*held)))
            order, edges = dealt(grams, buckets)
            grams, counts = grams[order], counts[order]
            full = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([
                pa.array(full.astype(np.int32)),
                pa.array([squeeze_grams(grams[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
                pa.array([squeeze(counts[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
            ], ["bucket", "grams", "counts"])

        for batch in batches:
            for grams in gram_slices(batch["text"], SLICE):
                held.append(np.unique(grams, return_counts=True))
                rows += len(held[-1][0])
                if rows >= GRAMS:
                    held = [summed(*(np.concatenate(c) for c in zip(*held)))]
                    rows = len(held[0][0])
                    if rows >= GRAMS // 2:
                        yield flush()
                        held, rows = [], 0
        if rows:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        grams, counts = summed(
            np.concatenate([expand_grams(b) for b in table["grams"].to_pylist()]),
            np.concatenate([expand(b, np.int64) for b in table["counts"].to_pylist()]))
        return pa.table({"bucket": table["bucket"].slice(0, 1), "grams": pa.array([squeeze_grams(grams)], pa.binary()),
                         "counts": pa.array([squeeze(counts)], pa.binary())})

    schema = "bucket int, grams binary, counts binary"
    table = stored(rows.mapInArrow(count, schema).groupBy("bucket").applyInArrow(add, schema), "grams")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for g, c in zip(batch["grams"].to_pylist(), batch["counts"].to_pylist()):
                grams, counts = expand_grams(g), expand(c, np.int64)
                letters = np.minimum(contexts_of(grams)[CONTEXTS.index(0)] & np.uint64(511), 2).astype(np.int64)
                total += np.bincount(letters * (SYMBOLS * SYMBOLS) + gram_pairs(grams), weights=counts,
                                     minlength=len(total)).astype(np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["pair", "n"])

    counts = np.zeros(3 * SYMBOLS * SYMBOLS, np.int64)
    for r in table.mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    counts = counts.reshape(3, -1)
    tree = CodeTrees.build(counts.sum(axis=0).reshape(SYMBOLS, SYMBOLS))
    short = []
    for own in counts[:2]:
        branch, node, steps = decisions(tree, np.arange(SYMBOLS * SYMBOLS))
        weights = np.repeat(own, steps)
        total = np.bincount(node, weights=weights, minlength=SYMBOLS * 256)
        hits = np.bincount(node, weights=weights * branch, minlength=SYMBOLS * 256)
        short.append(log_odds(total - hits, hits))
    return Mixer(Shared(tree, np.array(short)), table, buckets)


def block_bits(blocks: DataFrame, model: Mixer) -> DataFrame:
    """(block, bits): the code lengths of the texts kept in ``blocks``, in their order.

    A block asks for its distinct grams, cut into the buckets of the model's table; the odds of
    their decisions travel back to it.
    """
    held = Shipped(blocks.sparkSession, model.shared)
    buckets = model.buckets
    heads = blocks.filter("bucket IS NULL").select("block", "text_sizes", "text_data")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(*(batch[c] for c in ("block", "text_sizes", "text_data"))):
                texts = unpack_strings(sizes.as_py(), data.as_py())
                parts = [distinct(g) for g in gram_slices(texts, SLICE // 4)]
                grams = distinct(np.concatenate([np.zeros(0, np.uint64), *parts]))
                order, edges = dealt(grams, buckets)
                grams = grams[order]
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(full), block.as_py(), np.int64)), pa.array(full.astype(np.int32)),
                    pa.array([squeeze_grams(grams[edges[b]:edges[b + 1]]) for b in full], pa.binary()),
                ], ["block", "bucket", "grams"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left["grams"].to_pylist()
        table, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(right):
            table, counts = expand_grams(right["grams"][0].as_py()), expand(right["counts"][0].as_py(), np.int64)
        shared, blobs = held.get(), []
        counted = shared.counted(table, counts)
        parts: list[np.ndarray] = []

        def look_up() -> None:
            grams, which = np.unique(np.concatenate(parts), return_inverse=True)
            odds = shared.odds_of(counted, grams)
            steps = shared.tree.length[gram_pairs(grams)]
            begin, ends = np.cumsum(steps) - steps, np.cumsum([len(p) for p in parts])
            for a, b in zip([0, *ends[:-1]], ends):
                blobs.append(squeeze(odds[:, ranges(begin[which[a:b]], steps[which[a:b]])]))

        for blob in asked:
            parts.append(expand_grams(blob))
            if sum(len(p) for p in parts) >= ASKED:
                look_up()
                parts = []
        if parts:
            look_up()
        return pa.table({"block": left["block"], "grams": left["grams"], "odds": pa.array(blobs, pa.binary())})

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = unpack_strings(left["text_sizes"][0].as_py(), left["text_data"][0].as_py())
        grams = np.concatenate([np.zeros(0, np.uint64), *(expand_grams(b) for b in right["grams"].to_pylist())])
        tree = held.get().tree
        rows, at = np.empty((int(tree.length[gram_pairs(grams)].sum()), len(CONTEXTS)), np.float32), 0
        for blob in right["odds"]:
            part = expand(blob.as_py(), np.float32).reshape(len(CONTEXTS), -1)
            rows[at:at + part.shape[1]] = part.T
            at += part.shape[1]
        bits = coded_bits(tree, grams, rows.T, texts)
        return pa.table({"block": left["block"].slice(0, 1), "bits": pa.array([bits.tolist()], pa.list_(pa.float64()))})

    asked = heads.mapInArrow(ask, "block bigint, bucket int, grams binary")
    values = asked.groupBy("bucket").cogroup(model.table.groupBy("bucket")).applyInArrow(
        answer, "block bigint, grams binary, odds binary")
    return stored(heads.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        code, "block bigint, bits array<double>"), "bits")


def _words():
    solid = np.ones(256, bool)
    solid[[0x20, *range(0x09, 0x0E)]] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        data, offsets = utf8(texts)
        inside = solid[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[firsts] = inside[firsts]
        letters = lower[data[inside]]
        words = strings_at(letters, np.append(np.flatnonzero(begins[inside]), len(letters))).dictionary_encode()
        number = np.concatenate([[0], np.cumsum(begins)])
        return words, np.diff(number[offsets])

    return split


def _counts():
    return lambda words, totals: totals


def language_scores(docs: DataFrame, model: Mixer, training: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``training`` is a boolean column; the others are held out. ``score`` is the log10 probability
    of the whole text, its end included. The base adds log10((c + 1) / (N + V + 1)) over the
    lower-cased words and one end, with counts of the training texts. A null or empty text is its
    end alone; rows with equal or null ids count each for itself.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(training), F.lit(False)).alias("training"),
                       F.col(text).alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    blocks = count_blocks(
        rows, _words, bucket_count(docs), ["doc_id", "training", "size"], weight="training", texts=True)
    heads = blocks.filter("bucket IS NULL").join(block_bits(blocks, model), "block")
    columns = ["doc_id", "training", "size", "bits"]
    values = value_words(blocks, _counts)
    values = stored(values, "word-counts")
    sums = sum_values(heads, values, columns, _measures, ["log", "known"])
    ends = blocks.filter("bucket IS NULL").agg(F.sum(F.aggregate(
        "training", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))).alias("n")).first()["n"] or 0
    totals = values.filter("block IS NULL").agg(F.sum("n").alias("v"), F.sum("total").alias("n")).first()
    tokens = (totals["n"] or 0) + ends
    kinds = (totals["v"] or 0) + (1 if ends else 0)
    n_tokens = F.col("n_words") + 1
    return sums.select(
        "doc_id", (~F.col("training")).alias("held_out"), n_tokens.cast("long").alias("n_tokens"),
        (F.col("known") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log") + F.log10(F.lit(float(ends + 1))) - n_tokens * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"),
        (-F.col("bits") * F.log10(F.lit(2.0))).alias("score"),
        (F.col("bits") / F.greatest("size", F.lit(1))).alias("bits_per_byte"))


def _measures(value: np.ndarray) -> dict[str, np.ndarray]:
    return {"log": np.log10(value + 1.0), "known": (value > 0).astype(np.int64)}
