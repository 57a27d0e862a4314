"""Helpers shared by the text operators: stored tables, Arrow text buffers, components."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import scratch_path

# Text handled at once inside a task; bounds the temporary arrays.
SLICE_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: survives lost executors, runs once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shipped:
    """An object of bounded size broadcast by value, so that workers need no installed package."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self) -> Any:
        return pickle.loads(self.held.value)


def doc_remainder(modulus: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None))
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to ``limit`` at most; a larger element stands alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array as one array, and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if large else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings_at(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings that lie one after the other in ``data``, without copying."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)),
        pa.py_buffer(data),
    )


def text_slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A record batch cut so that each part holds about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    for start, stop in slices(sizes):
        yield batch.slice(start, stop - start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated integer ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the given edges, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while len(left):
        x, y = label[left], label[right]
        low = np.minimum(x, y)
        merged = label.copy()
        np.minimum.at(merged, x, low)
        np.minimum.at(merged, y, low)
        while True:
            jumped = merged[merged]
            if np.array_equal(jumped, merged):
                break
            merged = jumped
        label = merged
        open_edges = label[left] != label[right]
        left, right = left[open_edges], right[open_edges]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), component being the smallest node.

    Large-star and small-star rounds: every round links the larger neighbours of each node, then
    the node with its smaller ones, to the smallest of them, until only stars are left. The work
    of a round is a minimum with partial aggregation and a join that adaptive execution can split,
    so a node with very many neighbours is no single task. Every round is stored.
    """
    spark = edges.sparkSession

    def toward_minimum(pairs: DataFrame) -> DataFrame:
        """Rows (node, other, low): ``low`` is the smallest of a node and its others."""
        low = pairs.groupBy("node").agg(F.min("other").alias("low"))
        low = stored(low.select("node", F.least("node", "low").alias("low")), "lowest")
        return pairs.join(low, "node")

    links = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct(),
        "links",
    )
    while True:
        upper = links.select("node", "other").filter(F.col("node") > F.col("other"))
        roots = upper.select(F.col("other").alias("node")).distinct()
        if upper.join(roots, "node", "left_semi").isEmpty():
            break
        both = upper.unionByName(upper.select(F.col("other").alias("node"),
                                              F.col("node").alias("other")))
        large = stored(
            toward_minimum(both).filter("other > node")
            .select(F.col("other").alias("node"), F.col("low").alias("other")).distinct(), "large",
        )
        small = toward_minimum(large).select(
            F.explode(F.array(
                F.struct("node", F.col("low").alias("other")),
                F.struct(F.col("other").alias("node"), F.col("low").alias("other")),
            )).alias("edge")).select("edge.*").filter("node <> other").distinct()
        links = stored(small, "links")
    tops = links.select(F.col("other").alias("node")).distinct()
    return links.select("node", F.col("other").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component")))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of marked bytes; no run crosses the end of a text."""
    none = np.zeros(0, np.int64)
    if not len(inside):
        return none, none, none
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")
