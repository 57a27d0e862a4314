"""Exact percentiles of a column of any length, by radix selection.

Doubles are mapped to whole numbers of the same order. Passes of partial counts then follow the
number at each wanted rank digit by digit: a pass counts the next digit of the rows that share
what is known of it, until what is left is few enough to be counted number by number. No pass
sorts or holds the values of a task, and equal values are one count.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a digit; a pass sends at most this power of two of counts per wanted rank.
DIGIT_BITS = 12
# A number is counted out once at most so many rows share its known digits.
LAST_ROWS = 20_000

TINY = 2.0**-1022
HALF_STEP = 2.0**537


def order_key(value: Column) -> Column:
    """A whole number for a double, NULL and NaN apart, that is ordered like the doubles.

    It holds sign, exponent and fraction like the number's own bits; -0.0 equals 0.0. Powers of
    two scale exactly, so nothing is rounded. NaN gives NULL, as a constant may be folded before
    a filter drops it.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    low = F.pow(F.lit(2.0), guess)
    exponent = F.when(size < low, guess - 1).when(size >= low * 2, guess + 1).otherwise(guess)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * 2.0**52).try_cast("bigint")
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction
    key = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size < TINY, (size * HALF_STEP * HALF_STEP).cast("bigint")).otherwise(normal))
    return F.when(value < 0, -key).otherwise(key)


def value_of_key(key: int) -> float:
    """The double of a number from ``order_key``."""
    return struct.unpack(">d", struct.pack(">q", abs(key)))[0] * (-1.0 if key < 0 else 1.0)


def select_ranks(
    keys: DataFrame, ranks: Sequence[int], digit_bits: int = DIGIT_BITS, last_rows: int = LAST_ROWS
) -> dict[int, int]:
    """The number at each 0-based rank of the column ``_k``; ranks beyond the rows are left out.

    Runs one job a digit, and reads ``keys`` each time. The driver gets ``2**digit_bits`` or
    ``last_rows`` counts per rank and job.
    """
    return dict(_descend(keys, sorted(set(ranks)), digit_bits, last_rows))


def _descend(keys, ranks, digit_bits, last_rows):
    shift = 64 - digit_bits
    rows = keys.groupBy(F.shiftright("_k", shift).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # (shift, prefix) -> (rows before it, counts of its next digits)
    open_nodes = {None: (0, [(r["d"], r["n"]) for r in rows.collect()])}
    while open_nodes:
        wanted = {}
        for before, counts in open_nodes.values():
            for prefix, n in sorted(counts):
                inside = [r for r in ranks if before <= r < before + n]
                if inside and shift == 0:
                    yield from ((r, prefix) for r in inside)
                elif inside:
                    wanted[prefix] = (before, n)
                before += n
        if not wanted:
            return
        last = max(n for _, n in wanted.values()) <= last_rows
        below = 0 if last else max(0, shift - digit_bits)
        known = F.shiftright("_k", shift)
        found = keys.filter(known.isin(list(wanted))).groupBy(
            known.alias("p"), F.shiftright("_k", below).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        open_nodes = {p: (before, [(r["d"], r["n"]) for r in found if r["p"] == p])
                      for p, (before, _) in wanted.items()}
        shift = below


def exact_percentiles(
    df: DataFrame, value: str, fractions: Sequence[float], digit_bits: int = DIGIT_BITS,
    last_rows: int = LAST_ROWS,
) -> DataFrame:
    """``fraction, value`` with linear interpolation between neighbours.

    NULL and NaN are ignored, infinities are ordered like numbers. No rows gives no result rows.
    Runs the counting jobs when called; ``df`` should be cheap to read.
    """
    number = F.col(value).cast("double")
    usable = df.filter(number.isNotNull() & ~F.isnan(number))
    keys = usable.select(order_key(number).alias("_k"))
    n = usable.count()
    plan = []
    for f in fractions if n else ():
        low = min(n - 1, int((n - 1) * f))
        plan.append((float(f), low, (n - 1) * f - low))
    found = select_ranks(
        keys, [r for _, low, share in plan for r in (low, low + (share > 0.0))], digit_bits, last_rows)
    rows = []
    for f, low, share in plan:
        a = value_of_key(found[low])
        b = value_of_key(found[low + 1]) if share > 0.0 else a
        rows.append((f, a if a == b else a + (b - a) * share))
    return df.sparkSession.createDataFrame(rows, "fraction double, value double")
