"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import connected, local_forest, ranges, stored, text_slices, utf8

MAX_BITS = 3
SHINGLE_WORDS = 3
SEED = 42
# Fingerprints of one trie block, and node pairs that a task expands at once.
BLOCK = 8192
FRONTIER = 1 << 18
LINKS = 1 << 20


def fingerprint_values(texts: pa.Array, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprints of the texts; null and blank texts have fingerprint 0."""
    data, offsets = utf8(texts)
    result = np.zeros(len(offsets) - 1, np.uint64)
    if not len(data):
        return result
    solid = np.ones(256, bool)
    solid[[0x20, *range(0x09, 0x0E)]] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = solid[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    number = np.cumsum(begins)
    # Words one after the other with single spaces between: every shingle is one slice.
    letters = lower[data[inside]]
    packed = np.full(len(letters) + int(number[-1]), 32, np.uint8)
    packed[np.arange(len(letters)) + number[inside] - 1] = letters
    starts = np.flatnonzero(begins[inside]) + np.arange(int(number[-1]))
    ends = np.append(starts[1:] - 1, len(packed) - 1)
    before = np.concatenate([[0], number])
    first, stop = before[offsets[:-1]], before[offsets[1:]]
    total = stop - first
    count = np.where(total == 0, 0, np.maximum(total - words + 1, 1))
    left = ranges(first, count)
    right = np.minimum(left + words - 1, np.repeat(stop - 1, count))
    body, digest = packed.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(body[a:b], SEED) for a, b in zip(starts[left].tolist(), ends[right].tolist())],
        dtype=np.uint64)
    # Count the values of each of the 8 bytes per text; the bits follow from those counts.
    owner = np.repeat(np.arange(len(count)), count)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    place = np.arange(8) * 256
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    ends_at = np.cumsum(count)
    for begin in range(0, len(count), 512):
        stop_at = min(begin + 512, len(count))
        low, high = int(ends_at[begin] - count[begin]), int(ends_at[stop_at - 1])
        keys = (octets[low:high] + (place + ((owner[low:high] - begin) * 2048)[:, None])).ravel()
        table = np.bincount(keys, minlength=(stop_at - begin) * 2048).reshape(-1, 256)
        ones = (table @ bits.astype(np.float64)).reshape(stop_at - begin, 64)
        majority = 2 * ones > count[begin:stop_at, None]
        result[begin:stop_at] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the 64 bits as a signed long."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                values = fingerprint_values(part["text"]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(values)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        of, f"doc_id {kind}, fp bigint")


class Trie:
    """A binary trie over sorted values; a node is a range, split by the bit at its depth."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self._ones: dict[int, np.ndarray] = {}

    def split(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the values with a set bit begin inside the nodes."""
        if depth not in self._ones:
            bit = (self.values >> np.uint64(63 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))]).astype(np.int32)
        ones = self._ones[depth]
        return high - (ones[high] - ones[low])


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values that differ in ``budget`` bits at most; ``right`` None: of one set.

    Node pairs of both tries are traversed together. A pair carries the bits that differ on the
    way to it; a pair beyond the budget is dropped, two single values compare what is left.
    """
    own = right is None
    a = Trie(left)
    b = a if own else Trie(right)
    one = np.ones(1, np.int32)
    stack = [(0, one * 0, one * len(a.values), one * 0, one * len(b.values), one * 0)]
    while stack:
        depth, a0, a2, b0, b2, cost = stack.pop()
        if len(cost) > FRONTIER:
            half = len(cost) // 2
            stack.append((depth, *(x[half:] for x in (a0, a2, b0, b2, cost))))
            stack.append((depth, *(x[:half] for x in (a0, a2, b0, b2, cost))))
            continue
        single = (a2 - a0 == 1) & (b2 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            if own:
                x, y = x[x != y], y[x != y]
            near = np.bitwise_count(a.values[x] ^ b.values[y]) <= budget
            if near.any():
                yield x[near], y[near]
            rest = ~single
            a0, a2, b0, b2, cost = a0[rest], a2[rest], b0[rest], b2[rest], cost[rest]
        if not len(cost) or depth == 64:
            continue
        a1, b1 = a.split(depth, a0, a2), b.split(depth, b0, b2)
        twin = (a0 == b0) & (a2 == b2) if own else np.zeros(len(cost), bool)
        parts = []
        for low_a, high_a, low_b, high_b, step, allowed in (
            (a0, a1, b0, b1, 0, True), (a1, a2, b1, b2, 0, True),
            (a0, a1, b1, b2, 1, True), (a1, a2, b0, b1, 1, ~twin),
        ):
            good = (high_a > low_a) & (high_b > low_b) & (cost + step <= budget) & allowed
            parts.append((low_a[good], high_a[good], low_b[good], high_b[good], cost[good] + step))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def block_edges(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks, as (value, smallest linked value)."""
    flip = np.int64(-2**63)
    a = (left ^ flip).view(np.uint64)
    b = None if right is None else (right ^ flip).view(np.uint64)
    xs: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    held = 0
    for x, y in trie_links(a, b, budget):
        xs.append(left[x])
        ys.append((left if right is None else right)[y])
        held += len(x)
        if held > LINKS:
            node, low = local_forest(np.concatenate(xs), np.concatenate(ys))
            xs, ys, held = [node], [low], 0
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_forest(np.concatenate(xs), np.concatenate(ys))


def masks_within(bits: int, budget: int) -> list[int]:
    """All ``bits``-bit numbers with ``budget`` set bits at most."""
    return [sum(1 << i for i in chosen) for k in range(min(bits, budget) + 1)
            for chosen in combinations(range(bits), k)]


def trie_blocks(values: DataFrame, depth: int, block: int = BLOCK) -> DataFrame:
    """(base, prefix, bits, id, fps): subtries of ``block`` values at most, from distinct ``fp``.

    Values are dealt out by range, so a dense part of the trie spreads over tasks; each task cuts
    its sorted stream at the nodes of ``depth`` and then deeper, until a node is small enough.
    ``base`` are the first ``depth`` bits, ``prefix`` the ``bits`` bits that a block has in common.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            keys = (fps ^ np.int64(-2**63)).view(np.uint64)
            rows = []
            todo = [(0, len(fps), 0)]
            while todo:
                low, high, at = todo.pop()
                if low == high:
                    continue
                if at >= depth and (high - low <= block or at == 64):
                    top = int(keys[low]) >> (64 - at) if at else 0
                    prefix = top << (64 - at) if at else 0
                    rows.append((int(keys[low]) >> (64 - depth) if depth else 0, prefix - 2**63, at,
                                 f"{int(keys[low]):016x}", fps[low:high].tobytes()))
                    continue
                bit = (keys[low:high] >> np.uint64(63 - at)) & np.uint64(1)
                middle = high - int(bit.sum())
                todo += [(low, middle, at + 1), (middle, high, at + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows)], ["base", "prefix", "bits", "id", "fps"])

    tasks = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return values.select("fp").repartitionByRange(tasks, "fp").sortWithinPartitions("fp").mapInArrow(
        cut, "base bigint, prefix bigint, bits bigint, id string, fps binary")


def link_fingerprints(values: DataFrame, budget: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` within ``budget`` bits of each other.

    The top of the trie is joined in Spark: a block meets the blocks whose first bits differ in
    ``budget`` places at most. Its depth follows from the number of values, so that a block, and
    with it the work of a task, has the same size for any input. Inside a task the rest of the two
    tries is traversed. A task returns a spanning forest, never all pairs.
    """
    total = values.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / block)))
    blocks = stored(trie_blocks(values, depth, block), "trie")
    flips = F.array(*[F.lit(m).cast("bigint") for m in masks_within(depth, budget)])
    partner = blocks.select("*", F.explode(flips).alias("flip")).withColumn(
        "partner", F.col("base").bitwiseXOR(F.col("flip")))

    def side(name: str, condition: str, one: str, two: str) -> DataFrame:
        return partner.filter(condition).select(
            F.col(one).alias("x"), F.col(two).alias("y"), F.col("prefix").alias(f"{name}_prefix"),
            F.col("bits").alias(f"{name}_bits"), F.col("id").alias(f"{name}_id"),
            F.col("fps").alias(f"{name}_fps"))

    differing = F.expr(
        "CASE WHEN least(a_bits, b_bits) = 0 THEN 0 ELSE bit_count(shiftrightunsigned("
        "a_prefix ^ b_prefix, CAST(64 - least(a_bits, b_bits) AS INT))) END")
    pairs = (
        side("a", "base <= partner", "base", "partner")
        .join(side("b", "base >= partner", "partner", "base"), ["x", "y"])
        .filter("x < y OR a_id <= b_id").filter(differing <= budget)
        .select("a_fps", "b_fps", (F.col("a_id") == F.col("b_id")).alias("own"))
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                left = np.frombuffer(batch["a_fps"][i].as_py(), np.int64)
                right = np.frombuffer(batch["b_fps"][i].as_py(), np.int64)
                node, low = block_edges(left, None if batch["own"][i].as_py() else right, budget)
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["a", "b"])

    return pairs.mapInArrow(join, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame, budget: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id, tied) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in ``budget`` bits
    at most, the row's own id included; rows with a null id count for nobody's component. Null and
    blank texts have fingerprint 0 and link like others. ``tied`` marks groups whose smallest id
    stands in several rows. Other columns are ignored.
    """
    found = stored(fingerprints(docs, doc_id, text), "fingerprints")
    holders = found.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    copies = stored(
        holders.groupBy("fp").agg(F.min(F.when(
            F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")), "copies")
    joined = connected(link_fingerprints(copies, budget))
    rooted = copies.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    lowest = stored(
        rooted.groupBy("root", "least.doc_id").agg(F.sum("least.n").alias("n"))
        .groupBy("root").agg(F.min(F.when(
            F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low")), "lowest")
    labels = stored(
        rooted.join(lowest, "root").select(
            "fp", F.col("low.doc_id").alias("component_id"),
            F.coalesce(F.col("low.n") > 1, F.lit(False)).alias("tied")), "labels")
    return found.join(labels, "fp").select("doc_id", "fp", "component_id", "tied")


def hex_fingerprint(fp: str = "fp"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id.

    Of several rows with that id one stays. Rows with a null id all stay. All columns stay.
    """
    kept = simhash_groups(docs, budget).filter("doc_id = component_id").select(
        F.col("doc_id").alias("_kept_id"), F.col("tied").alias("_tied")).distinct()
    kept = stored(kept, "kept")
    # A merge join at any size: what is kept grows with the documents, so it is never broadcast.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id")).join(
        kept.hint("merge"), F.col("_id") == F.col("_kept_id"))
    single = rows.filter(~F.col("_tied")).select("_row.*")
    several = rows.filter("_tied").dropDuplicates(["_id"]).select("_row.*")
    return single.unionByName(several).unionByName(docs.filter(F.col("doc_id").isNull()))
