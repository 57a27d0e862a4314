"""Run the registered queries once and report time and agreement: run_queries.py SF [NAME…]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402


def main() -> None:
    sf_dir, names = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        begun = time.monotonic()
        try:
            frame = run(spark, sf_dir)
            if name in oracles:
                problem = difference(frame, con, oracles[name])
            else:
                rows = len(frame.collect())
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{time.monotonic() - begun:7.2f}s {kind} {name}: {problem or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
