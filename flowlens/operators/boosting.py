"""Multiclass gradient-boosted trees on Spark: one tree per class and round, softmax objective.

Features are cut into bins once. A level of all trees of a round is one aggregate: tasks sum
gradients and second derivatives by (class, node, feature, bin), the partial sums of a node meet in
one group, which returns the node's best split. A table of at most ``local_rows`` rows is grown
whole, a class in a task, in one job a round; both ways give the same trees. There the bins are
held once per class, and only a probability per row and class travels in a round. Of two sibling
nodes only the smaller one's rows are summed: sums are exact, so the other's are the difference.

Rows are stored in blocks of an Arrow batch, with their margins, which are renewed every few rounds; trees
younger than that are applied on the fly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.network import softmax_rows
from flowlens.functions.scalar import argmax_index
from flowlens.operators.scoring import list_rows, matrix_of
from flowlens.session import durable, partition_keys

BINS = 64
# Rows whose bins one task holds. Below some 20 million a round of partial histograms, up to 2 GB,
# would be more than the rows' probabilities.
LOCAL_ROWS = 1_000_000
STORE_ROUNDS = 10
# Cells of sums, and rows at a time, that stay in a core's cache.
PAIR_CELLS = 2**17
BLOCK_ROWS = 2**15
# The usual defaults of boosted trees.
LAMBDA = 1.0
MIN_CHILD = 1.0
MIN_GAIN = 1e-6


@dataclass(frozen=True)
class Tree:
    """A binary tree as a heap: the children of node i are 2i + 1 and 2i + 2.

    ``feature`` is -1 at a leaf; rows whose bin is at most ``cut`` go left.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size))

    def leaves(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row of bins ends in."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 1 if levels is None else levels):
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    @cached_property
    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, cuts and last level's values of the tree whose leaves lead on, to the left, to the last level."""
        inner, value = self.feature >= 0, self.value.copy()
        for first in 2 ** np.arange(len(value).bit_length() - 1) - 1:
            ends = first + np.flatnonzero(~inner[first:2 * first + 1])
            value[2 * ends + 1] = value[ends]
        # No bin is above 255.
        return np.where(inner, self.feature, 0).astype(np.int64), np.where(inner, self.cut, 255), value[len(value) // 2:]

    def values(self, bins: np.ndarray) -> np.ndarray:
        """The value of the leaf that each row of bins ends in."""
        feature, cut, value = self.whole
        place, flat, start = np.zeros(len(bins), np.int64), bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
        for level in range(len(feature).bit_length() - 1):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            right = flat.take(feature[nodes].take(place) + start) > cut[nodes].take(place)
            place = 2 * place + right
        return value.take(place)


def _sums(
    columns: np.ndarray, rows: np.ndarray | None, place: np.ndarray, cells: int, nodes: int, g: np.ndarray, h: np.ndarray,
) -> np.ndarray:
    """Sums of g and h by (column, node, value of the column); ``rows`` are the places' own."""
    size = nodes * cells
    out, block = np.zeros((len(columns), 2, size)), max(BLOCK_ROWS, 4 * size)
    for start in range(0, len(place), block):
        part = slice(start, start + block)
        base, own = place[part] * cells, part if rows is None else rows[part]
        for f, column in enumerate(columns):
            at = base + column[own]
            out[f, 0] += np.bincount(at, g[part], size)
            out[f, 1] += np.bincount(at, h[part], size)
    return out.reshape(len(columns), 2, nodes, cells)


class Columns:
    """Bins feature by feature, and two features' bins as one number: where cells are few, a pass serves both."""

    def __init__(self, bins: np.ndarray, width: int) -> None:
        self.width, self.bins = width, np.ascontiguousarray(bins.T)
        self.pairs = self.bins[0::2] * np.uint16(width)
        self.pairs[:len(self.bins) // 2] += self.bins[1::2]

    def histograms(
        self, place: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None = None,
    ) -> np.ndarray:
        """Sums of g and h by (node, feature, bin), over all rows or some."""
        features, width = len(self.bins), self.width
        if nodes * width**2 <= min(PAIR_CELLS, len(place)):
            both = _sums(self.pairs, rows, place, width**2, nodes, g, h).reshape(-1, 2, nodes, width, width)
            out = np.stack([both.sum(axis=4), both.sum(axis=3)], axis=1).reshape(-1, 2, nodes, width)[:features]
        else:
            out = _sums(self.bins, rows, place, width, nodes, g, h)
        return np.ascontiguousarray(out.transpose(2, 0, 3, 1))


def histograms(bins: np.ndarray, place: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Sums of g and h by (node, feature, bin); a negative place is in no node."""
    own = np.flatnonzero(place >= 0)
    return np.ascontiguousarray(
        _sums(np.ascontiguousarray(bins[own].T), None, place[own], width, nodes, g[own], h[own]).transpose(2, 0, 3, 1))


def best_splits(sums: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of each node, and the sums of the node and of its left side.

    Ties go to the first feature, then the first bin. Feature -1: no split gains anything.
    """
    total = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)[:, :, :-1]
    g, h = total[:, 0, None, None], total[:, 1, None, None]
    gl, hl = left[..., 0], left[..., 1]
    gr, hr = g - gl, h - hl
    gain = gl**2 / (hl + LAMBDA) + gr**2 / (hr + LAMBDA) - g**2 / (h + LAMBDA)
    gain[(hl < MIN_CHILD) | (hr < MIN_CHILD)] = -np.inf
    # Rounding of sums must not choose between equal splits.
    flat = np.round(gain.reshape(len(sums), -1), 9)
    at, nodes = flat.argmax(axis=1), np.arange(len(sums))
    feature, cut = np.divmod(at, gain.shape[2])
    best = flat[nodes, at]
    return {
        "feature": np.where(best > MIN_GAIN, feature, -1).astype(np.int32), "cut": cut.astype(np.int32),
        "gain": best, "g": total[:, 0], "h": total[:, 1],
        "gl": gl.reshape(len(sums), -1)[nodes, at], "hl": hl.reshape(len(sums), -1)[nodes, at],
    }


def set_splits(tree: Tree, nodes: np.ndarray, found: dict[str, np.ndarray], rate: float) -> None:
    """Write the splits of some nodes and the values of their children."""
    split = found["feature"] >= 0
    at = nodes[split]
    tree.feature[at], tree.cut[at], tree.gain[at] = (found[k][split] for k in ("feature", "cut", "gain"))
    if 0 in nodes:
        tree.value[0] = -rate * found["g"][0] / (found["h"][0] + LAMBDA)
    g, h, gl, hl = (found[k][split] for k in ("g", "h", "gl", "hl"))
    tree.value[2 * at + 1] = -rate * gl / (hl + LAMBDA)
    tree.value[2 * at + 2] = -rate * (g - gl) / (h - hl + LAMBDA)


def summable(values: np.ndarray) -> np.ndarray:
    """Values rounded so far, by 2**-52 of their largest possible sum, that sums in any order are exact."""
    unit = 2.0 ** (int(np.frexp(np.abs(values).max(initial=0.0) * len(values))[1]) - 52)
    return np.round(values / unit) * unit


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, width: int) -> Tree:
    """A tree grown level by level over rows held in memory."""
    tree, node, own = Tree.empty(depth), np.zeros(len(bins), np.int64), np.arange(len(bins))
    columns, g, h = Columns(bins, width), summable(g), summable(h)
    flat, nodes = columns.bins.reshape(-1), np.zeros(min(len(bins), 1), np.int64)
    sums = columns.histograms(node, 1, g, h)[:len(nodes)]
    for level in range(depth):
        if not len(nodes):
            break
        found = best_splits(sums)
        set_splits(tree, nodes, found, rate)
        split = found["feature"] >= 0
        parents, sums = nodes[split], sums[split]
        if not len(parents) or level == depth - 1:
            break
        inner = np.zeros(len(tree.feature), bool)
        inner[parents] = True
        right = flat[np.maximum(tree.feature, 0).astype(np.int64)[node] * len(bins) + own] > tree.cut[node]
        node = np.where(inner[node], 2 * node + 1 + right, node)
        left = 2 * parents + 1
        count = np.bincount(node, minlength=len(tree.feature))
        on_left = count[left] <= count[left + 1]
        smaller = np.full(len(tree.feature), -1)
        smaller[np.where(on_left, left, left + 1)] = np.arange(len(parents))
        place = smaller[node]
        rows = np.flatnonzero(place >= 0)
        few = columns.histograms(place[rows], len(parents), g[rows], h[rows], rows)
        many, on_left = sums - few, on_left[:, None, None, None]
        nodes = np.stack([left, left + 1], axis=1).reshape(-1)
        sums = np.stack([np.where(on_left, few, many), np.where(on_left, many, few)], axis=1).reshape(-1, *few.shape[1:])
    return tree


@dataclass(frozen=True)
class BoostedTrees:
    """Rounds of one tree per class over binned features."""

    edges: list[np.ndarray]
    rounds: list[list[Tree]]
    classes: int
    losses: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers: how many edges a value reaches. NULL counts as 0, NaN reaches none."""
        out = np.empty(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, np.nan_to_num(x[:, f], nan=-np.inf), side="right")
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``probs``; columns of these names are replaced."""
        model = self

        @F.arrow_udf("array<double>")
        def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                bins = model.binned(matrix_of(batch, len(model.edges)))
                yield list_rows(softmax_rows(margins_of(model.rounds, bins, model.classes)))

        return df.withColumn("probs", probabilities("features")).withColumn("prediction", argmax_index("probs"))


def margins_of(rounds: list[list[Tree]], bins: np.ndarray, classes: int) -> np.ndarray:
    margins = np.zeros((len(bins), classes))
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.values(bins)
    return margins


def feature_edges(train: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature: one pass, ``width * bins`` numbers."""
    shares = [i / bins for i in range(1, bins)]
    row = train.agg(*[
        F.percentile_approx(F.get("features", F.lit(f)).cast("double"), shares, 10_000).alias(f"f{f}")
        for f in range(width)
    ]).first()
    return [np.unique(np.array(row[f] or [], float)) for f in range(width)]


def _gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gradients_of(softmax_rows(margins), labels[:, None] == np.arange(margins.shape[1]))


def gradients_of(p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives from probabilities, and where the class is the row's own."""
    return p - hit, np.maximum(2.0 * p * (1.0 - p), 1e-16)


def cross_entropy(p: np.ndarray, labels: np.ndarray) -> float:
    """Sum over the rows."""
    return -float(np.log(np.maximum(p[np.arange(len(p)), labels], 1e-16)).sum())


SPLITS = ("cls int, node int, feature int, cut int, gain double, g double, h double, gl double, hl double")


BLOCKS = "is_val boolean, row bigint, n int, labels binary, bins binary, margins binary"


@dataclass(frozen=True)
class Block:
    """Rows of a training run: ``row`` is the first one's number."""

    is_val: bool
    row: int
    labels: np.ndarray
    bins: np.ndarray
    margins: np.ndarray

    @staticmethod
    def all_of(batches: Iterator[pa.RecordBatch], features: int, classes: int) -> Iterator[Block]:
        for batch in batches:
            for i in range(len(batch)):
                labels, bins, margins = (
                    np.frombuffer(batch[name][i].as_buffer(), kind)
                    for name, kind in (("labels", np.int32), ("bins", np.uint8), ("margins", np.float64)))
                yield Block(
                    batch["is_val"][i].as_py(), batch["row"][i].as_py(), labels,
                    bins.reshape(-1, features), margins.reshape(-1, classes))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([self.is_val]), pa.array([self.row]), pa.array([len(self.labels)], pa.int32()),
            *(pa.array([v.tobytes()]) for v in (self.labels, self.bins, self.margins)),
        ], ["is_val", "row", "n", "labels", "bins", "margins"])


class Booster:
    """The stored rows of a training run, and the trees that their margins do not hold yet."""

    def __init__(self, train: DataFrame, val: DataFrame, model: BoostedTrees, depth: int, rate: float) -> None:
        self.model, self.depth, self.rate = model, depth, rate
        self.width = max([len(e) for e in model.edges], default=0) + 1
        self.pending: list[list[Tree]] = []
        classes, features = model.classes, len(model.edges)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, labels = model.binned(matrix_of(batch["features"], features)), batch["label"].to_numpy()
                held, rows = batch["is_val"].to_numpy(zero_copy_only=False), batch["row"].to_numpy()
                for side in (False, True):
                    own = held == side
                    if own.any():
                        yield Block(side, int(rows[own][0]), labels[own], bins[own],
                                    np.zeros((own.sum(), classes))).batch()

        both = train.select("features", F.col("label").cast("int"), F.lit(False).alias("is_val")).unionByName(
            val.select("features", F.col("label").cast("int"), F.lit(True).alias("is_val")))
        self.table = durable(both.withColumn("row", F.monotonically_increasing_id()).mapInArrow(start, BLOCKS))
        self.by_class: DataFrame | None = None
        # A class, and last the validation loss, to each hash partition.
        self.keys = partition_keys(self.table.sparkSession, classes + 1)
        self.loss = float("inf")

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        """Blocks with their current margins."""
        features, classes = len(self.model.edges), self.model.classes
        for block in Block.all_of(batches, features, classes):
            yield replace(block, margins=block.margins + margins_of(self.pending, block.bins, classes))

    def shippable(self) -> Booster:
        """Without DataFrames and the trees that margins hold, for use in tasks."""
        twin = object.__new__(Booster)
        twin.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("table", "by_class")})
        twin.model = BoostedTrees(self.model.edges, [], self.model.classes)
        return twin

    def absorb(self) -> None:
        """Store the margins with all trees so far."""
        own = self.shippable()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in own.scored(batches):
                yield block.batch()

        self.table = durable(self.table.mapInArrow(add, BLOCKS))
        self.pending = []

    def validation_loss(self) -> float:
        """Mean cross-entropy of the validation rows."""
        own = self.shippable()

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in own.scored(batches):
                loss = cross_entropy(softmax_rows(block.margins), block.labels)
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([len(block.labels)])], ["loss", "n"])

        row = self.table.filter("is_val").mapInArrow(losses, "loss double, n bigint").agg(
            F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        return row["loss"] / row["n"] if row["n"] else float("inf")

    def release(self) -> None:
        if self.by_class is not None:
            self.by_class.unpersist()

    def class_bins(self) -> DataFrame:
        """Bins of the training rows, and which are of the class, once per class, a class to a partition; held."""
        if self.by_class is None:
            features, classes, keys = len(self.model.edges), self.model.classes, self.keys

            def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for block in Block.all_of(batches, features, classes):
                    bins = np.ascontiguousarray(block.bins.T).tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[:classes], pa.int32()), pa.array([block.row] * classes),
                        pa.array([bins] * classes, pa.binary()),
                        pa.array([(block.labels == k).tobytes() for k in range(classes)], pa.binary()),
                    ], ["cls", "row", "bins", "hits"])

            rows = self.table.filter("NOT is_val").mapInArrow(copy, "cls int, row bigint, bins binary, hits binary")
            self.by_class = rows.repartition(len(keys), "cls").sortWithinPartitions("cls").persist()
            # A plan made before they are held would shuffle them again.
            self.by_class.count()
        return self.by_class

    def class_probabilities(self) -> DataFrame:
        """The probabilities that the training rows have each class, by class and run of rows.

        Under the last key come the loss and number of the validation rows.
        """
        own = self.shippable()

        def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in own.scored(batches):
                p, keys = softmax_rows(block.margins), own.keys[:-1]
                sent = [p[:, k].tobytes() for k in range(len(keys))]
                if block.is_val:
                    keys = own.keys[-1:]
                    sent = [np.array([cross_entropy(p, block.labels), len(p)]).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int32()), pa.array([block.row] * len(keys)), pa.array(sent)],
                    ["p_cls", "p_row", "p"])

        return self.table.mapInArrow(derive, "p_cls int, p_row bigint, p binary")

    def local_round(self) -> list[Tree]:
        """All trees of a round in one job: the probabilities of a class come to the task of its bins.

        ``loss`` then is the validation loss before these trees.
        """
        own, features = self.shippable(), len(self.model.edges)

        def joined(table: pa.Table, by: str, column: str, kind: type) -> list[np.ndarray]:
            values = table[column]
            return [np.frombuffer(values[int(i)].as_buffer(), kind) for i in np.argsort(table[by].to_numpy())]

        def build(key: tuple, rows: pa.Table, sent: pa.Table) -> pa.Table:
            p = joined(sent, "p_row", "p", np.float64)
            if not len(rows):
                return pa.table([sent["p_cls"][:1], *[
                    pa.array([v]) for v in (np.zeros(0, np.int32), np.zeros(0, np.int32), sum(p), np.zeros(0))
                ]], ["cls", "feature", "cut", "value", "gain"])
            bins = np.concatenate([v.reshape(features, -1) for v in joined(rows, "row", "bins", np.uint8)], axis=1)
            g, h = gradients_of(np.concatenate(p), np.concatenate(joined(rows, "row", "hits", np.bool_)))
            tree = grow(bins.T, g, h, own.depth, own.rate, own.width)
            return pa.table([rows["cls"][:1], *[
                pa.array([v]) for v in (tree.feature, tree.cut, tree.value, tree.gain)
            ]], ["cls", "feature", "cut", "value", "gain"])

        found = self.class_bins().groupBy("cls").cogroup(self.class_probabilities().groupBy("p_cls")).applyInArrow(
            build, "cls int, feature array<int>, cut array<int>, value array<double>, gain array<double>").collect()
        trees, self.loss = [Tree.empty(self.depth) for _ in range(self.model.classes)], float("inf")
        for row in found:
            if row["cls"] == self.keys[-1]:
                self.loss = row["value"][0] / row["value"][1]
            else:
                trees[self.keys.index(row["cls"])] = Tree(
                    np.array(row["feature"], np.int32), np.array(row["cut"], np.int32), np.array(row["value"]),
                    np.array(row["gain"]))
        return trees

    def level(self, trees: list[Tree], level: int) -> DataFrame:
        """The best splits of all open nodes of a level: one aggregate of partial histograms."""
        own, first = self.shippable(), 2**level - 1
        features, width = len(self.model.edges), self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for block in own.scored(batches):
                bins, (g, h) = block.bins, _gradients(block.margins, block.labels)
                for k, tree in enumerate(trees):
                    node = tree.leaves(bins, level)
                    open_nodes, place = np.unique(node[node >= first], return_inverse=True)
                    at = np.full(len(bins), -1)
                    at[node >= first] = place
                    if len(open_nodes):
                        found = histograms(bins, at, len(open_nodes), g[:, k], h[:, k], width)
                        for i, n in enumerate(open_nodes.tolist()):
                            sums[k, n] = sums[k, n] + found[i] if (k, n) in sums else found[i]
            for (k, n), table in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([table.tobytes()])],
                    ["cls", "node", "sums"])

        def choose(key: tuple, rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()).reshape(features, width, 2)
                        for v in rows.sort_by("sums")["sums"])
            found = best_splits(total[None])
            return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [
                pa.array(found[name]) for name in ("feature", "cut", "gain", "g", "h", "gl", "hl")
            ], ["cls", "node", "feature", "cut", "gain", "g", "h", "gl", "hl"])

        return self.table.filter("NOT is_val").mapInArrow(
            partial, "cls int, node int, sums binary").groupBy("cls", "node").applyInArrow(choose, SPLITS)

    def spread_round(self) -> list[Tree]:
        """All trees of a round, a job per level; the driver gets one row per node."""
        trees = [Tree.empty(self.depth) for _ in range(self.model.classes)]
        for level in range(self.depth):
            table = self.level(trees, level).toArrow()
            cls = table["cls"].to_numpy()
            for k in np.unique(cls):
                mine = table.filter(pa.array(cls == k)).sort_by("node")
                found = {name: mine[name].to_numpy() for name in ("feature", "cut", "gain", "g", "h", "gl", "hl")}
                set_splits(trees[k], mine["node"].to_numpy().astype(np.int64), found, self.rate)
            if not len(table) or not (table["feature"].to_numpy() >= 0).any():
                break
        return trees


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """A byte matrix as an Arrow array of binary values, one per row."""
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, max(width, 1), dtype=np.int32)[:rows + 1]
    return pa.BinaryArray.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def matrix_of_binary(values: pa.Array, width: int) -> np.ndarray:
    if not len(values):
        return np.zeros((0, width), np.uint8)
    _, ends, data = values.buffers()
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    first = int(np.frombuffer(ends, kind)[values.offset])
    return np.frombuffer(data, np.uint8)[first:first + len(values) * width].reshape(len(values), width)


def fit_boosted_trees(
    train: DataFrame,
    val: DataFrame,
    classes: int,
    width: int,
    max_trees: int = 500,
    max_depth: int = 8,
    rate: float = 0.1,
    patience: int = 20,
    bins: int = BINS,
    edges: list[np.ndarray] | None = None,
    local_rows: int = LOCAL_ROWS,
) -> BoostedTrees:
    """Boosted trees on ``features, label`` (0 to ``classes`` - 1).

    Stops ``patience`` rounds after the best validation loss and keeps the rounds up to it; without
    validation rows all rounds are trained. ``edges`` (at most 255 per feature) replace quantiles.
    """
    edges = feature_edges(train, width, bins) if edges is None else edges
    if max([len(e) for e in edges], default=0) > 255:
        raise ValueError("more than 255 edges of a feature")
    model = BoostedTrees(edges, [], classes)
    booster = Booster(train, val, model, max_depth, rate)
    rows = {r["is_val"]: r["n"] for r in booster.table.groupBy("is_val").agg(F.sum("n").alias("n")).collect()}
    local, stops = rows.get(False, 0) <= local_rows, rows.get(True, 0) > 0
    best, best_loss = 0, float("inf")
    for number in range(max_trees + 1):
        # A local round scores all rows once: it also tells the loss of the rounds before it.
        ahead = booster.local_round() if local and number < max_trees else None
        if stops and number:
            model.losses.append(booster.loss if ahead else booster.validation_loss())
            if model.losses[-1] < best_loss:
                best, best_loss = number, model.losses[-1]
            elif number - best >= patience:
                break
        if number == max_trees:
            break
        trees = ahead or booster.spread_round()
        model.rounds.append(trees)
        booster.pending.append(trees)
        if len(booster.pending) >= STORE_ROUNDS:
            booster.absorb()
    booster.release()
    return BoostedTrees(edges, model.rounds[:best] if stops else model.rounds, classes, model.losses)
