"""Best-fit packing of token sequences: local best-fit rounds, merged as a tree."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ranges, stored, strings_at, text_slices, utf8

# A bin that misses this share of the capacity at most counts as nearly full and is emitted.
SLACK = 1 / 256
# Items that one best-fit task takes on; bounds its memory.
TASK_ITEMS = 100_000


class TokenIds:
    """Token ids by a word-end BPE file that lower-cases and whose pre-tokens never cross a blank.

    Texts are cut at blanks, and before a full stop or comma that follows an ASCII letter; neither
    cut runs through a pre-token. ASCII letters are lowered first, except where a mark may still
    compose with them. Distinct parts are encoded once while they are remembered. Parts that are
    a single pre-token each go through the tokenizer many at a time, divided at its word ends.
    """

    WORDS_AT_ONCE = 20_000
    REMEMBERED = 1_000_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = [np.zeros(0, np.uint32)]
        self.sizes = [np.zeros(0, np.int64)]

    def _learn(self, words: list[str]) -> None:
        def add(group: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
            self.known.update(zip(group, range(len(self.known), len(self.known) + len(group))))
            self.sizes.append(sizes)
            self.pool.append(ids)

        others = [w for w in words if not w.isalpha()]
        plain = [w for w in words if w.isalpha()]
        encode = self.tokenizer.encode_batch_fast
        for begin in range(0, len(plain), self.WORDS_AT_ONCE):
            group = plain[begin:begin + self.WORDS_AT_ONCE]
            ids = np.array(encode([" ".join(group)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                add(group, np.diff(ends, prepend=0), ids)
            else:
                others += group
        for begin in range(0, len(others), self.WORDS_AT_ONCE):
            group = others[begin:begin + self.WORDS_AT_ONCE]
            lists = [e.ids for e in encode(group, add_special_tokens=False)]
            add(group, np.array([len(x) for x in lists], np.int64),
                np.fromiter(chain.from_iterable(lists), np.uint32))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        data, offsets = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        blank = (data == 32) | (data == 10)
        cut = np.zeros(len(data), bool)
        cut[1:] = (blank[:-1] & ~blank[1:]) | (
            ((data[1:] == 44) | (data[1:] == 46)) & self.letter[data[:-1]])
        cut[0] = True
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        if b"<|" not in data.tobytes():  # else the text may spell a special token
            data = np.where(np.append(data[1:], 0) < 128, self.lower[data], data)
        parts = strings_at(data, np.append(starts, len(data))).dictionary_encode()
        words = [w.rstrip(" \n") for w in parts.dictionary.to_pylist()]
        if len(self.known) > self.REMEMBERED:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self._learn(new)
            self.pool, self.sizes = [np.concatenate(self.pool)], [np.concatenate(self.sizes)]
        known = self.known
        which = np.array([known[w] for w in words])[parts.indices.to_numpy()]
        sizes = self.sizes[0]
        counts = sizes[which]
        ids = self.pool[0][ranges((np.cumsum(sizes) - sizes)[which], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(starts, offsets)
        return ids, total[edges[1:]] - total[edges[:-1]]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): texts' ids and ``end_id``, cut at ``capacity``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers; ``ids`` themselves
    only come along ``with_ids``. A null or empty text is the single id ``end_id``. Only texts longer than ``capacity`` are cut.
    Every row of ``docs`` counts, rows with equal or null ids too.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenIds(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch):
                ids, counts = encoder(part["text"])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                lengths = counts + 1
                pieces = -(-lengths // capacity)
                number = ranges(np.zeros(len(pieces), np.int64), pieces)
                owner = np.repeat(np.arange(len(pieces)), pieces)
                start = number * capacity
                size = np.minimum(lengths[owner] - start, capacity)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                body = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(body[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [
                    part["doc_id"].take(pa.array(owner)), pa.array(number.astype(np.int32)),
                    pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
        + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still has room."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r left
    count = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, count
            count += 1
        bins[item] = bin_
        room -= size
        if room:
            if not open_bins[room]:
                rooms |= 1 << room
            open_bins[room].append(bin_)
    return bins


def pack(
    items: DataFrame, capacity: int, length: str = "length", slack: float = SLACK,
    task_items: int = TASK_ITEMS,
) -> DataFrame:
    """(item, bin, offset) for the rows of ``items`` (item, length): few bins of ``capacity``.

    Partitions pack their items best-fit and give out the nearly full bins. The others are items
    of the next round, merged into fewer partitions, until one partition has seen all that is
    left or a round frees less than one bin in a hundred; bins of different tasks are then left
    apart though some may fit each other. A task takes ``task_items`` items at most. ``item``
    must be unique and lengths from 1 to ``capacity``; bin numbers are arbitrary.
    """
    limit = int(capacity * (1 - slack))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table["fill"].to_numpy()
            bins = best_fit(sizes, capacity)
            order = np.lexsort((-sizes, bins))
            table, bins, sizes = table.take(pa.array(order)), bins[order], sizes[order]
            first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            fills = np.add.reduceat(sizes, first)
            members = table["members"].combine_chunks()
            counts = np.diff(members.offsets.to_numpy())
            counts = np.add.reduceat(counts, first)
            merged = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), members.flatten())
            yield pa.RecordBatch.from_arrays([pa.array(fills), merged], ["fill", "members"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= task_items:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    member = f"struct<item:{items.schema['item'].dataType.simpleString()},length:bigint>"
    schema = f"fill bigint, members array<{member}>"
    size = F.col(length).cast("long")
    checked = F.when((size >= 1) & (size <= capacity), size).otherwise(F.raise_error(F.concat(
        F.lit("item length out of range: "), F.coalesce(size.cast("string"), F.lit("null")))))
    left = items.select(checked.alias("fill"), F.array(F.struct(
        "item", size.alias("length"))).alias("members"))
    full: list[DataFrame] = []
    before = None
    while True:
        packed = stored(left.mapInArrow(local, schema), "bins")
        full.append(packed.filter(F.col("fill") >= limit))
        rest = packed.filter(F.col("fill") < limit)
        count = rest.count()
        if count <= 1 or (before is not None and (before[0] == 1 or count > 0.99 * before[1])):
            full.append(rest)
            break
        tasks = max(1, -(-count // task_items))
        if before is not None:
            tasks = min(tasks, max(1, before[0] // 2))
        before = (tasks, count)
        # By content, so that a repeated task deals its rows alike.
        left = rest.repartition(tasks, F.xxhash64("members"))
    bins = full[0]
    for other in full[1:]:
        bins = bins.unionByName(other)
    numbered = stored(bins.withColumn("bin", F.monotonically_increasing_id()), "packed")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch["members"]
            counts = np.diff(members.offsets.to_numpy())
            flat = members.flatten()
            sizes = pc.struct_field(flat, "length").to_numpy()
            ends = np.cumsum(sizes)
            first = np.cumsum(counts) - counts
            base = (ends - sizes)[first]
            yield pa.RecordBatch.from_arrays([
                pc.struct_field(flat, "item"),
                pa.array(np.repeat(batch["bin"].to_numpy(), counts)),
                pa.array(ends - sizes - np.repeat(base, counts)),
            ], ["item", "bin", "offset"])

    return numbered.select("bin", "members").mapInArrow(
        places, f"item {items.schema['item'].dataType.simpleString()}, bin bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of ``token_pieces`` with ``sequence_id`` and ``offset``, packed best-fit.

    Rows with equal texts or ids are packed like others; an empty table gives no rows. Columns of
    ``docs`` besides ``doc_id`` and ``text`` are left out.
    """
    pieces = stored(
        token_pieces(docs, tokenizer_path, capacity, end_id, with_ids=with_ids)
        .withColumn("item", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.select("item", "length"), capacity)
    return pieces.join(places, "item").drop("item").withColumnRenamed("bin", "sequence_id")
