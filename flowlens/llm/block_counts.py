"""Counts of words per document, joined with values per distinct word, in compact blocks.

A table of (document, word, count) rows would be several times as large as the texts. So a block
of documents keeps its counts by word number, and only its dictionary travels: cut by the words'
hash, it meets all other blocks' words of that hash, where a value is found once per distinct
word; the values travel back to the block. Words never meet their documents' texts in a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import slices, stored, strings_at, utf8

# Text bytes whose counts are kept together in a task.
BLOCK_BYTES = 16_000_000

# (words as a dictionary array, occurrences per text) of an array of texts.
Splitter = Callable[[pa.Array], tuple[pa.DictionaryArray, np.ndarray]]


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def squeeze_counts(values: np.ndarray) -> bytes:
    """Small 32-bit numbers by byte planes, the upper of which are nearly empty."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def expand_counts(blob: bytes) -> np.ndarray:
    planes = expand(blob, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def pack_strings(words: pa.Array) -> tuple[bytes, bytes]:
    data, offsets = utf8(words)
    return squeeze_counts(np.diff(offsets)), zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def unpack_strings(sizes: bytes, data: bytes) -> pa.Array:
    ends = np.cumsum(expand_counts(sizes), dtype=np.int64)
    return strings_at(expand(data, np.uint8), np.concatenate([[0], ends]))


def count_blocks(
    docs: DataFrame, make_splitter: Callable[[], Splitter], buckets: int,
    columns: list[str], weight: str | None = None, text: str = "text",
    texts: bool = False,
) -> DataFrame:
    """Blocks of ``docs`` as two kinds of stored rows.

    ``bucket`` null: the block's documents (``columns`` as arrays) and their counts by word number.
    Else the words of that bucket in word order and, with ``weight``, their occurrences in the
    documents where that boolean column is true. ``texts`` keeps the block's texts, compressed.
    """
    fields = [docs.schema[c] for c in columns]
    schema = "block bigint, bucket int, " + ", ".join(
        f"`{f.name}` array<{f.dataType.simpleString()}>" for f in fields)
    schema += (", n_words array<bigint>, firsts binary, steps binary, counts binary"
               ", sizes binary, words binary, weights binary"
               ", text_sizes binary, text_data binary")
    names = ["block", "bucket", *columns, "n_words", "firsts", "steps", "counts", "sizes", "words", "weights",
             "text_sizes", "text_data"]

    def block_rows(batch: pa.Table, number: int, split: Splitter) -> pa.RecordBatch:
        found, occurrences = split(batch["text"].combine_chunks())
        words = found.dictionary
        plain = words.to_pylist()
        hashed = np.fromiter((zlib.crc32(w.encode()) for w in plain), np.uint32, len(plain)) % buckets
        order = pc.sort_indices(
            pa.table({"bucket": hashed, "word": words}),
            sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[found.indices.to_numpy()] if plain else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(batch)), occurrences)
        pairs, counts = np.unique(owner * max(1, len(order)) + which, return_counts=True)
        numbers = pairs % max(1, len(order))
        owners = pairs // max(1, len(order))
        weighs = np.zeros(len(batch)) if weight is None else np.array(batch["_weighs"].to_pylist(), float)
        totals = np.bincount(numbers, weights=counts * weighs[owners], minlength=len(order)).astype(np.int64)
        firsts = np.searchsorted(owners, np.arange(len(batch) + 1))
        # A document's word numbers rise; their steps are small.
        steps = np.diff(numbers, prepend=0)
        begins = firsts[:-1][firsts[:-1] < firsts[1:]]
        steps[begins] = numbers[begins]
        sorted_words, sorted_buckets = words.take(pa.array(order)), hashed[order]
        edges = np.searchsorted(sorted_buckets, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        parts = [pack_strings(sorted_words[edges[b]:edges[b + 1]]) for b in full]
        empty = [None] * len(full)
        data = {
            "block": [number] * (1 + len(full)), "bucket": [None, *full.tolist()],
            **{c: [batch[c].to_pylist(), *empty] for c in columns},
            "n_words": [occurrences.tolist(), *empty], "firsts": [squeeze(firsts.astype(np.int64)), *empty],
            "steps": [squeeze_counts(steps), *empty],
            "counts": [squeeze_counts(counts), *empty],
            "sizes": [None, *(p[0] for p in parts)], "words": [None, *(p[1] for p in parts)],
            "weights": [None, *(
                None if weight is None else squeeze(totals[edges[b]:edges[b + 1]]) for b in full)],
        }
        kept = pack_strings(batch["text"].combine_chunks()) if texts else (None, None)
        data |= {"text_sizes": [kept[0], *empty], "text_data": [kept[1], *empty]}
        kinds = {c: pa.list_(batch[c].type) for c in columns} | {
            "block": pa.int64(), "bucket": pa.int32(), "n_words": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays(
            [pa.array(data[n], kinds.get(n, pa.binary())) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = make_splitter(), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            lengths = np.diff(utf8(batch["text"])[1])
            for start, stop in slices(lengths, BLOCK_BYTES // 4):
                held.append(batch.slice(start, stop - start))
                size += int(lengths[start:stop].sum()) + 100 * (stop - start)
                if size >= BLOCK_BYTES:
                    yield block_rows(pa.Table.from_batches(held), number, split)
                    number, held, size = number + 1, [], 0
        if held:
            yield block_rows(pa.Table.from_batches(held), number, split)

    source = docs.select(F.col(text).alias("text"), *columns, *(
        [F.coalesce(F.col(weight), F.lit(False)).alias("_weighs")] if weight else []))
    return stored(source.mapInArrow(run, schema), "blocks")


def value_words(blocks: DataFrame, make_value: Callable[[], Callable[[pa.Array, np.ndarray], np.ndarray]]) -> DataFrame:
    """(block, bucket, values, n, total): a long per word, found once for each distinct word.

    ``make_value()`` gets the distinct words of a bucket and their summed weights. Rows with a
    null block carry the number of words with weight and the sum of weights of each bucket.
    """
    def run(table: pa.Table) -> pa.Table:
        blocks_, buckets_ = table["block"].to_pylist(), table["bucket"].to_pylist()
        parts = [unpack_strings(s, w) for s, w in zip(table["sizes"].to_pylist(), table["words"].to_pylist())]
        weights = np.concatenate([
            np.zeros(len(p), np.int64) if w is None else expand(w, np.int64)
            for p, w in zip(parts, table["weights"].to_pylist())])
        found = pa.concat_arrays(parts).dictionary_encode()
        which = found.indices.to_numpy()
        totals = np.bincount(which, weights=weights, minlength=len(found.dictionary)).astype(np.int64)
        values = make_value()(found.dictionary, totals)[which].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        blobs = [squeeze(values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({
            "block": pa.array([*blocks_, None], pa.int64()),
            "bucket": pa.array([*buckets_, buckets_[0]], pa.int32()),
            "values": pa.array([*blobs, None], pa.binary()),
            "n": pa.array([*[0] * len(parts), int((totals > 0).sum())], pa.int64()),
            "total": pa.array([*[0] * len(parts), int(totals.sum())], pa.int64()),
        })

    words = blocks.filter("bucket IS NOT NULL").select("block", "bucket", "sizes", "words", "weights")
    return words.groupBy("bucket").applyInArrow(
        run, "block bigint, bucket int, values binary, n bigint, total bigint")


def sum_values(
    blocks: DataFrame, values: DataFrame, columns: list[str],
    measures: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str],
) -> DataFrame:
    """Per document ``columns``, n_words and the sums, over its words, of each measure of a value."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["bucket"].to_numpy(), kind="stable")
        blobs = right["values"].to_pylist()
        value = np.concatenate([np.zeros(0, np.int64), *(expand(blobs[i], np.int64) for i in order)])
        counts = expand_counts(left["counts"][0].as_py())
        firsts = expand(left["firsts"][0].as_py(), np.int64)
        steps = np.cumsum(expand_counts(left["steps"][0].as_py()), dtype=np.int64)
        numbers = steps - np.repeat(np.concatenate([[0], steps])[firsts[:-1]], np.diff(firsts))
        out = {c: left[c].combine_chunks().flatten() for c in columns}
        out["n_words"] = left["n_words"].combine_chunks().flatten()
        for name, measure in measures(value).items():
            sums = np.concatenate([[0.0], np.cumsum(counts * measure[numbers])])
            exact = np.array([np.sum(counts[a:b] * measure[numbers[a:b]]) for a, b in zip(firsts[:-1], firsts[1:])]) \
                if measure.dtype.kind == "f" else sums[firsts[1:]] - sums[firsts[:-1]]
            out[name] = pa.array(np.asarray(exact, float))
        return pa.table(out)

    heads = blocks.filter("bucket IS NULL").select("block", *columns, "n_words", "firsts", "steps", "counts")
    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.elementType.simpleString()}" for c in columns)
    schema = f"{kinds}, n_words bigint, " + ", ".join(f"{n} double" for n in names)
    return heads.groupBy("block").cogroup(
        values.filter("block IS NOT NULL").select("block", "bucket", "values").groupBy("block")
    ).applyInArrow(run, schema)


def bucket_count(docs: DataFrame) -> int:
    """Buckets to cut dictionaries into: as many as shuffles have partitions."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
