"""Compare a registered query with its SQL twin."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return repr(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_cell(row[i]) for i in order) for row in rows
    )


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_columns, expected = as_rows(names, cursor.fetchall())
    columns, actual = as_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if actual != expected:
        extra, lost = actual - expected, expected - actual
        return (f"rows {sum(actual.values())} vs {sum(expected.values())}; "
                f"only here {list(extra.items())[:3]}; only in SQL {list(lost.items())[:3]}")
    return None
