"""Stratified splits, caps and samples, all exact and reproducible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowlens.operators.ranking import HASH_BITS, assign_intervals, group_sizes, hash_pair

# Default fractions.
STREAM_FRACTION = 0.03
TRAIN_FRACTION = 0.8
VAL_FRACTION = 0.1


def last_rank(size: int, fraction: float) -> int:
    """The largest rank with ``rank / size <= fraction``."""
    rank = min(size, int(fraction * size))
    if rank < size and (rank + 1) / size <= fraction:
        return rank + 1
    if rank > 0 and rank / size > fraction:
        return rank - 1
    return rank


def split_plan(
    sizes: dict[str, int],
    stream: float = STREAM_FRACTION,
    train: float = TRAIN_FRACTION,
    val: float = VAL_FRACTION,
    train_cap: int | None = None,
    val_test_cap: int | None = None,
) -> list[tuple[str, int, int, str]]:
    """Rank intervals ``(class, lo, hi, split)``.

    ``stream`` is taken off first, ``train`` and ``val`` divide the rest, test
    gets the remainder. ``train_cap`` keeps the lowest ranks of each class;
    ``val_test_cap`` bounds the val and the test total by one common fraction.
    """
    train_end = stream + (1 - stream) * train
    val_end = train_end + (1 - stream) * val
    plan = []
    for label, size in sizes.items():
        edges = [0, *(last_rank(size, f) for f in (stream, train_end, val_end)), size]
        for name, lo, hi in zip(("stream", "train", "val", "test"), edges, edges[1:]):
            hi = min(hi, lo + train_cap) if name == "train" and train_cap is not None else hi
            plan.append((label, lo, hi, name))
    return plan if val_test_cap is None else [
        row for name in ("stream", "train", "val", "test")
        for row in _cap_split([r for r in plan if r[3] == name],
                              val_test_cap if name in ("val", "test") else None)
    ]


def _cap_split(rows: list[tuple[str, int, int, str]], cap: int | None):
    total = sum(hi - lo for _, lo, hi, _ in rows)
    if cap is None or total <= cap:
        return rows
    return [(c, lo, lo + (hi - lo) * cap // total, name) for c, lo, hi, name in rows]


def stratified_split(
    df: DataFrame,
    by: str = "label_8",
    keys: Sequence[str] | None = None,
    seed: int = 42,
    stream: float = STREAM_FRACTION,
    train: float = TRAIN_FRACTION,
    val: float = VAL_FRACTION,
    train_cap: int | None = None,
    val_test_cap: int | None = None,
    portable: bool = False,
) -> DataFrame:
    """Add ``split`` (stream, train, val, test).

    Every row is in a split, unless the caller sets a cap: ``train_cap`` bounds the
    training rows of a class, ``val_test_cap`` the val and the test total. Rows
    beyond a cap are left out.
    """
    plan = split_plan(group_sizes(df, by), stream, train, val, train_cap, val_test_cap)
    return assign_intervals(df, plan, by, "string", "split", keys, seed, portable)


def cap_per_group(
    df: DataFrame, cap: int, by: str, keys: Sequence[str] | None = None,
    seed: int = 42, portable: bool = False,
) -> DataFrame:
    """At most ``cap`` random rows of each ``by`` value."""
    plan = [(g, 0, min(n, cap), 1) for g, n in group_sizes(df, by).items()]
    return assign_intervals(df, plan, by, "int", "_kept", keys, seed, portable).drop("_kept")


def cap_total(
    df: DataFrame, cap: int, by: str, keys: Sequence[str] | None = None,
    seed: int = 42, portable: bool = False,
) -> DataFrame:
    """At most ``cap`` rows in all, the same fraction of each ``by`` value."""
    sizes = group_sizes(df, by)
    if sum(sizes.values()) <= cap:
        return df
    plan = _cap_split([(g, 0, n, 1) for g, n in sizes.items()], cap)
    return assign_intervals(df, plan, by, "int", "_kept", keys, seed, portable).drop("_kept")


def stratified_sample(
    df: DataFrame, max_rows: int, by: str = "label_8", keys: Sequence[str] | None = None,
    seed: int = 42, portable: bool = False,
) -> DataFrame:
    """About ``max_rows`` rows: the fraction ``max_rows / rows`` of each class, rounded."""
    sizes = group_sizes(df, by)
    total = sum(sizes.values())
    if total <= max_rows:
        return df
    plan = [(g, 0, round(n * (max_rows / total)), 1) for g, n in sizes.items()]
    return assign_intervals(df, plan, by, "int", "_kept", keys, seed, portable).drop("_kept")


def bernoulli_cap(
    df: DataFrame, cap: int, by: str, keys: Sequence[str] | None = None, seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Sample to about ``cap`` rows with one independent draw per row.

    The draw is the row's hash against a threshold, so it depends on seed and ``keys`` (default:
    all columns) only, not on partitions or retries; copies of a row share their draw. All ``by``
    values have the same chance.
    """
    total = sum(group_sizes(df, by).values())
    if total <= cap:
        return df
    return df.filter(hash_pair(keys or df.columns, seed, portable)[0] < int(cap / total * 2**HASH_BITS))
