"""Label-skewed client partitions: a small plan of counts, then one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ranking import assign_intervals, group_sizes

# Defaults of the partition.
MIN_SAMPLES = 50
REPAIR_ROUNDS = 10
LOCAL_VAL_FRACTION = 0.1

# A client's share as (class, lo, hi): the rows of a class with lo < rank <= hi.
Share = list[tuple[Any, int, int]]


def dirichlet_counts(
    sizes: dict[Any, int], num_clients: int, alpha: float, seed: int = 42,
    legacy_rng: bool = False,
) -> dict[Any, np.ndarray]:
    """Rows of each class per client, drawn from Dirichlet(alpha).

    ``legacy_rng`` also spends the random numbers of an in-memory shuffle of
    each class, which reproduces published plans for small classes.
    """
    rng = np.random.RandomState(seed)
    plan = {}
    for label, size in sizes.items():
        if legacy_rng:
            rng.shuffle(np.arange(size))
        share = rng.dirichlet(np.full(num_clients, float(alpha)))
        counts = np.floor(share * size).astype(np.int64)
        for _ in range(size - int(counts.sum())):
            counts[rng.randint(num_clients)] += 1
        plan[label] = counts
    return plan


def dirichlet_fractions(
    classes: Sequence, num_clients: int, alpha: float, seed: int = 42
) -> dict[Any, np.ndarray]:
    """Each client's fraction of every class; a class's draw depends on seed and place only."""
    return {
        label: np.random.RandomState([seed, at]).dirichlet(np.full(num_clients, float(alpha)))
        for at, label in enumerate(classes)
    }


def counts_from_fractions(
    sizes: dict[Any, int], fractions: dict[Any, np.ndarray]
) -> dict[Any, np.ndarray]:
    """Whole rows by largest remainder, ties to the lower client.

    The fractions are a plan that outlives the table: as a class grows, every client's rows grow
    in proportion, and other classes stay as they are.
    """
    plan = {}
    for label, share in fractions.items():
        exact = share * sizes.get(label, 0)
        counts = np.floor(exact).astype(np.int64)
        left = sizes.get(label, 0) - int(counts.sum())
        counts[np.argsort(counts - exact, kind="stable")[:left]] += 1
        plan[label] = counts
    return plan


def shares_from_counts(counts: dict[Any, np.ndarray], num_clients: int) -> list[Share]:
    """Contiguous rank intervals per client, classes in the order of the plan."""
    shares: list[Share] = [[] for _ in range(num_clients)]
    for label, row in counts.items():
        ends = np.cumsum(row)
        for k in range(num_clients):
            if row[k]:
                shares[k].append((label, int(ends[k] - row[k]), int(ends[k])))
    return shares


def share_size(share: Share) -> int:
    return sum(hi - lo for _, lo, hi in share)


def rebalance_plan(shares: list[Share], min_samples: int = MIN_SAMPLES) -> list[Share]:
    """Raise the smallest client to ``min_samples`` from the tail of the largest, repeatedly."""
    shares = [list(share) for share in shares]
    for _ in range(REPAIR_ROUNDS):
        totals = [share_size(share) for share in shares]
        poor, rich = int(np.argmin(totals)), int(np.argmax(totals))
        need = min(min_samples - totals[poor], totals[rich] - min_samples)
        if totals[poor] >= min_samples or need <= 0:
            break
        taken: Share = []
        while need > 0:
            label, lo, hi = shares[rich].pop()
            cut = max(lo, hi - need)
            if cut > lo:
                shares[rich].append((label, lo, cut))
            taken.insert(0, (label, cut, hi))
            need -= hi - cut
        shares[poor] += taken
    return shares


def dirichlet_plan(
    sizes: dict[Any, int], num_clients: int, alpha: float, seed: int = 42,
    min_samples: int = MIN_SAMPLES, legacy_rng: bool = False,
) -> list[Share]:
    """Client shares by Dirichlet label skew, every client repaired to ``min_samples``."""
    counts = dirichlet_counts(sizes, num_clients, alpha, seed, legacy_rng)
    return rebalance_plan(shares_from_counts(counts, num_clients), min_samples)


def iid_plan(total: int, num_clients: int) -> list[Share]:
    """Equal shares of all rows; sizes differ by at most one."""
    base, extra = divmod(total, num_clients)
    edges = np.cumsum([0] + [base + (k < extra) for k in range(num_clients)])
    return [[(0, int(lo), int(hi))] for lo, hi in zip(edges, edges[1:])]


def assign_clients(
    df: DataFrame,
    num_clients: int,
    alpha: float | str,
    label: str = "label",
    keys: Sequence[str] | None = None,
    seed: int = 42,
    min_samples: int = MIN_SAMPLES,
    classes: Sequence | None = None,
    portable: bool = False,
    fractions: dict[Any, np.ndarray] | None = None,
) -> DataFrame:
    """Add ``client_id``: each row goes to exactly one of ``num_clients`` clients.

    ``alpha`` is the Dirichlet concentration or ``"iid"``. ``classes`` fixes the
    order in which the plan draws (default: the labels present, sorted).
    ``fractions`` (class to one fraction per client) replaces the draw; a class that the plan
    does not name is an error.
    """
    if alpha == "iid":
        shares = iid_plan(group_sizes(df, None).get(0, 0), num_clients)
        by = None
    else:
        found = group_sizes(df, label)
        sizes = {c: found.get(c, 0) for c in (classes or sorted(found))}
        if fractions is None:
            shares = dirichlet_plan(sizes, num_clients, float(alpha), seed, min_samples)
        else:
            if unplanned := sorted(set(found) - set(fractions)):
                raise ValueError(f"classes without a plan: {unplanned}")
            counts = counts_from_fractions(sizes, fractions)
            shares = rebalance_plan(shares_from_counts(counts, num_clients), min_samples)
        by = label
    intervals = [(g, lo, hi, k) for k, share in enumerate(shares) for g, lo, hi in share]
    return assign_intervals(df, intervals, by, "int", "client_id", keys, seed, portable)


def client_holdout(
    df: DataFrame,
    fraction: float = LOCAL_VAL_FRACTION,
    client: str = "client_id",
    keys: Sequence[str] | None = None,
    seed: int = 42,
    portable: bool = False,
    sizes: dict[Any, int] | None = None,
) -> DataFrame:
    """Add ``is_val``: ``max(1, int(n * fraction))`` random rows of each client.

    ``sizes`` are the clients' row counts where they are known already.
    """
    plan = []
    for k, n in (sizes or group_sizes(df, client)).items():
        held = max(1, int(n * fraction))
        plan += [(k, 0, held, True), (k, held, n, False)]
    return assign_intervals(df, plan, client, "boolean", "is_val", keys, seed, portable)


def client_distribution(
    df: DataFrame, classes: Sequence, label: str = "label", client: str = "client_id"
) -> DataFrame:
    """One row per client: its size and its rows per class (column ``class_NAME``)."""
    return df.groupBy(client).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(label) == F.lit(c)).alias(f"class_{c}") for c in classes],
    )


def partition_info(
    df: DataFrame, name: str, alpha: float | str, seed: int, classes: Sequence,
    label: str = "label", min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """The partition as one document: client sizes and the client by class matrix."""
    table = client_distribution(df, classes, label)
    ordered = F.sort_array(F.collect_list(F.struct(
        "client_id", "rows", F.array(*[F.col(f"class_{c}") for c in classes]).alias("by_class")
    )))
    return table.agg(ordered.alias("_c")).select(
        F.lit(name).alias("name"),
        F.lit(str(alpha)).alias("alpha"),
        F.size("_c").alias("num_clients"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(min_samples).cast("bigint").alias("min_samples"),
        F.aggregate("_c.rows", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total_samples"),
        F.col("_c.rows").alias("client_sizes"),
        F.col("_c.by_class").alias("class_distribution"),
    )
