"""Near-duplicate vectors by product quantisation: inverted lists, table distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Shipped, connected, local_forest, stored

THRESHOLD = 0.98
# Vectors the quantisers are fitted on (expected), vectors per inverted list and per block.
SAMPLE = 8192
LIST_ROWS = 2048
BLOCK_ROWS = 1024
SUBSPACES = 8
CODES = 128
# Slack of comparisons in single or double precision, on distances of unit vectors.
EPSILON = 1e-4
# Two ways to sum a cosine in double precision differ by far less.
ROUNDING = 1e-9


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centres of the points, by Lloyd's rounds from evenly spaced points."""
    points = np.asarray(points, np.float64)
    centres = np.unique(points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)], axis=0)
    for _ in range(rounds):
        nearest = closest(points, centres)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(
        (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1), 0.0)


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(points, centres).argmin(1)


@dataclass
class Quantiser:
    """Coarse centres of the unit vectors and codebooks of their residuals' subspaces."""

    width: int
    centres: np.ndarray = field(repr=False)
    books: list[np.ndarray] = field(repr=False)

    @staticmethod
    def fit(units: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
        width = -(-units.shape[1] // subspaces)
        padded = np.zeros((len(units), width * subspaces))
        padded[:, :units.shape[1]] = units
        centres = k_means(padded, lists)
        rest = padded - centres[closest(padded, centres)]
        return Quantiser(width, centres, [k_means(part, codes) for part in np.split(rest, subspaces, axis=1)])

    def pad(self, units: np.ndarray) -> np.ndarray:
        result = np.zeros((len(units), self.centres.shape[1]))
        result[:, :units.shape[1]] = units
        return result

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, subspace codes and exact distance from its reconstruction of every vector."""
        lists = closest(units, self.centres)
        rest = units - self.centres[lists]
        parts = np.split(rest, len(self.books), axis=1)
        codes = np.stack([closest(part, book) for part, book in zip(parts, self.books)], 1).astype(np.uint8)
        left = [part - book[codes[:, m]] for m, (part, book) in enumerate(zip(parts, self.books))]
        return lists, codes, np.sqrt(sum((x * x).sum(1) for x in left))

    def probes(self, units: np.ndarray, lists: np.ndarray, radius: float) -> np.ndarray:
        """Which lists may hold a vector within ``radius`` (vector x list).

        A vector of another list lies on that centre's side of the plane between both centres, so
        a vector farther than ``radius`` from the plane has no partner there.
        """
        far = squared(units, self.centres)
        between = np.sqrt(squared(self.centres, self.centres))[lists]
        own = far[np.arange(len(units)), lists][:, None]
        return far - own <= 2 * between * (radius + EPSILON) + EPSILON

    def table_distances(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Distances of whole queries from coded vectors of one list, by summed table look-ups."""
        parts = np.split(queries - self.centres[list_], len(self.books), axis=1)
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, (part, book) in enumerate(zip(parts, self.books)):
            total += squared(part, book).astype(np.float32)[:, codes[:, m]]
        return np.sqrt(total)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Packed doubles, one vector a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)


def linked_pairs(
    quantiser: Quantiser, list_: int, left: np.ndarray, right: np.ndarray, codes: np.ndarray,
    errors: np.ndarray, threshold: float,
) -> np.ndarray:
    """Which pairs have cosine ``threshold`` or more (left x right), ``right`` being of one list.

    Table distances leave the candidates: a partner is within the radius, hence its
    reconstruction within radius plus its known error. The cosine of candidates is exact, and
    that of a pair near the threshold is summed in one way whatever block the pair stands in.
    """
    radius = np.sqrt(max(0.0, 2 - 2 * threshold))
    norms_l, norms_r = np.sqrt((left * left).sum(1)), np.sqrt((right * right).sum(1))
    near = quantiser.table_distances(
        quantiser.pad(left / norms_l[:, None]), list_, codes) <= radius + errors + EPSILON
    rows, columns = np.nonzero(near)
    result = np.zeros(near.shape, bool)
    if len(rows) > 0.02 * near.size:
        # Many candidates: a matrix product decides all but those that rounding may turn.
        product = left @ right.T / norms_l[:, None] / norms_r
        result = near & (product >= threshold + ROUNDING)
        rows, columns = np.nonzero(near & (np.abs(product - threshold) <= ROUNDING))
    for begin in range(0, len(rows), 1 << 16):
        i, j = rows[begin:begin + (1 << 16)], columns[begin:begin + (1 << 16)]
        cosine = (left[i] * right[j]).sum(1) / (norms_l[i] * norms_r[j])
        result[i, j] = cosine >= threshold
    return result


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id",
    vector: str = "embedding", label: str = "label", sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of equal label and length link at cosine ``threshold`` or more. Vectors that are null,
    zero or hold null or non-finite components, and rows with a null label or id, link with
    nothing. Equal vectors are compared once and count as often as they occur; all links are
    found, the quantisers only save comparisons. A row with a null id has a null component and is
    not kept; rows that share an id share its links' component.
    """
    spark = rows.sparkSession
    values = F.col("vector")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"))
    base = base.withColumn("usable", F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(values) > 0) & finite
        & F.exists(values, lambda x: x != 0), F.lit(False)))
    base = base.withColumns({
        "h1": F.when(F.col("usable"), F.xxhash64(values)),
        "h2": F.when(F.col("usable"), F.xxhash64(F.lit("second"), values)),
    })
    classes = base.filter("usable").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("min_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    # Scaled by the largest component, so that squares neither overflow nor vanish.
    peak = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    classes = stored(classes.withColumn("vector", F.transform(
        "vector", lambda x: x / peak)).withColumn("class_id", F.monotonically_increasing_id()), "classes")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not shape["n"]:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    draw = F.pmod(F.xxhash64("h1", "label"), F.lit(1 << 30))
    drawn = classes.filter(draw < F.lit(min(1.0, sample / shape["n"]) * (1 << 30))).select(
        "class_id", "vector").toArrow().sort_by("class_id")
    # Labels divide the lists further, so the largest label sets their number.
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    lists = max(1, min(sample // 16, -(-largest // LIST_ROWS)))
    points = np.zeros((max(1, len(drawn)), shape["width"]))
    for i, x in enumerate(drawn["vector"].to_pylist()):
        points[i, :len(x)] = np.array(x) / np.linalg.norm(x)
    held = Shipped(spark, Quantiser.fit(points, lists))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = held.get()
        width = quantiser.centres.shape[1]
        for batch in batches:
            for begin in range(0, len(batch), 2048):
                part = batch.slice(begin, 2048)
                raw = part["vector"]
                sizes = np.diff(raw.offsets.to_numpy())
                vectors = np.zeros((len(part), width))
                vectors[np.repeat(np.arange(len(part)), sizes),
                        np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = raw.flatten().to_numpy()
                units = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
                home, codes, errors = quantiser.encode(units)
                near = quantiser.probes(units, home, radius)
                # A pair of lists is searched from the lower one; the own list is a block pair.
                near &= np.arange(near.shape[1]) > home[:, None]
                others = [np.flatnonzero(r).tolist() for r in near]
                yield pa.RecordBatch.from_arrays([
                    part["class_id"], part["label"], pa.array(sizes.astype(np.int32)), part["n"],
                    pa.array(home.astype(np.int32)), pa.array([v.tobytes() for v in vectors]),
                    pa.array([c.tobytes() for c in codes]), pa.array(errors),
                    pa.array(others, pa.list_(pa.int32())),
                ], ["class_id", "label", "width", "n", "list", "vector", "codes", "error", "others"])

    kind = rows.schema[label].dataType.simpleString()
    placed = stored(classes.select("class_id", "label", "n", "vector").mapInArrow(
        place, f"class_id bigint, label {kind}, width int, n bigint, list int, vector binary, "
               "codes binary, error double, others array<int>"), "placed")
    key = ["label", "width", "list"]

    def blocks(entries: DataFrame, name: str) -> DataFrame:
        """Entries of a list in blocks of about ``BLOCK_ROWS``, one row a block."""
        sizes = stored(entries.groupBy(*key).agg(
            F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), f"{name}-sizes")
        dealt = entries.join(sizes, key).withColumn(
            "block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("class_id")
            return pa.table({
                **{c: table[c].slice(0, 1) for c in [*key, "blocks", "block"]},
                "ids": [table["class_id"].to_numpy().tobytes()], "ns": [table["n"].to_numpy().tobytes()],
                "vectors": [b"".join(table["vector"].to_pylist())],
                "codes": [b"".join(table["codes"].to_pylist())],
                "errors": [table["error"].to_numpy().tobytes()],
            })

        return stored(dealt.groupBy(*key, "blocks", "block").applyInArrow(
            pack, f"label {kind}, width int, list int, blocks int, block int, ids binary, ns binary, "
                  "vectors binary, codes binary, errors binary"), name)

    columns = ["class_id", *key, "n", "vector", "codes", "error"]
    members = blocks(placed.select(*columns), "members")
    visitors = blocks(placed.select(
        "class_id", "label", "width", F.explode("others").alias("list"), "n", "vector", "codes", "error"),
        "visitors")
    counts = members.select(*key, "blocks").distinct()

    def named(frame: DataFrame, prefix: str, mine: str, theirs: str) -> DataFrame:
        """Blocks repeated for every block they meet, keyed by both numbers."""
        return frame.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("met") - 1))).select(
            *key, F.col("block").alias(mine), theirs,
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("ids", "ns", "vectors", "codes", "errors")])

    same = named(members.withColumn("met", F.col("blocks")), "a", "x", "y").filter("x <= y").join(
        named(members.withColumn("met", F.col("blocks")), "b", "y", "x").filter("x <= y"), [*key, "x", "y"]
    ).withColumn("own", F.col("x") == F.col("y"))
    cross = named(visitors.join(counts.withColumnRenamed("blocks", "met"), key), "a", "x", "y").join(
        named(members.join(visitors.groupBy(*key).agg(F.max("blocks").alias("met")), key), "b", "y", "x"),
        [*key, "x", "y"]).withColumn("own", F.lit(False))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = held.get()
        width, subspaces = quantiser.centres.shape[1], len(quantiser.books)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                a_ids, b_ids = (np.frombuffer(row[x], np.int64) for x in ("a_ids", "b_ids"))
                a_ns, b_ns = (np.frombuffer(row[x], np.int64) for x in ("a_ns", "b_ns"))
                left, right = (np.frombuffer(row[x], np.float64).reshape(-1, width) for x in ("a_vectors", "b_vectors"))
                codes = np.frombuffer(row["b_codes"], np.uint8).reshape(-1, subspaces)
                linked = linked_pairs(quantiser, row["list"], left, right, codes,
                                      np.frombuffer(row["b_errors"], np.float64), threshold)
                if row["own"]:
                    # Rounding must not make a link one-sided; a vector is no partner of itself.
                    linked = np.triu(linked, 1)
                x, y = np.nonzero(linked)
                if not len(x):
                    continue
                ids = np.concatenate([a_ids, b_ids])
                links = np.concatenate([linked @ b_ns, a_ns @ linked])
                some = links > 0
                node, low = local_forest(a_ids[x], b_ids[y])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([ids[some], node])),
                    pa.array(np.concatenate([links[some], np.zeros(len(node), np.int64)])),
                    pa.array([*[None] * int(some.sum()), *low.tolist()], pa.int64()),
                ], ["class_id", "links", "low"])

    wanted = ["list", "own", *[f"{p}_{c}" for p in "ab" for c in ("ids", "ns", "vectors", "codes", "errors")]]
    found = stored(same.select(*wanted).unionByName(cross.select(*wanted)).mapInArrow(
        compare, "class_id bigint, links bigint, low bigint"), "links")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = connected(found.filter("low IS NOT NULL").select(
        F.col("class_id").alias("a"), F.col("low").alias("b")))
    rooted = stored(
        classes.select("class_id", "label", "h1", "h2", "min_id", "n").join(links, "class_id", "left")
        .join(joined, F.col("class_id") == F.col("node"), "left")
        .select("label", "h1", "h2", "min_id", F.coalesce("component", "class_id").alias("root"),
                (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "rooted")
    lowest = stored(rooted.groupBy("root").agg(F.min("min_id").alias("component_id")), "lowest")
    result = stored(rooted.join(lowest, "root").select("label", "h1", "h2", "n_links", "component_id"), "result")
    component = F.coalesce("component_id", "vec_id")
    return base.join(result, ["label", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
