"""The live view as the state of a stream.

Alerts are dealt by event id into a fixed number of slots, so that no organisation is one key. A
slot's state holds the totals by organisation and class, counts per second of the last window, and
its newest latencies: bounded by dictionaries and settings, whatever the rate. The view reads the
state with Spark's ``statestore`` source and adds the slots up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from flowlens.labels import CLASSES
from flowlens.operators.alerts import RECENT_LATENCIES, WINDOW_SECONDS, recent_latency, summary_rows

SLOTS = 16
SECOND = 1000


def merge_alerts(body: dict, rows: pd.DataFrame, window_s: int, recent: int) -> dict:
    """A slot's state after some more alerts; alerts without ``ts_scored`` are left out."""
    rows = rows[rows["ts_scored"].notna()]
    if rows.empty:
        return body
    text = {c: rows[c].astype(object).where(rows[c].notna(), None) for c in ("org_id", "pred_class", "event_id")}
    times = rows["ts_scored"].astype("int64")
    # Second s holds the alerts of ](s - 1) * 1000, s * 1000], like the window's edges.
    seconds = -(-times // SECOND)
    threats = rows["is_attack"].fillna(False).astype(bool)
    totals = {(o, c): n for o, c, n in body["totals"]}
    counts = {(s, o, c): [n, t] for s, o, c, n, t in body["seconds"]}
    for org, cls, second, threat in zip(text["org_id"], text["pred_class"], seconds.tolist(), threats.tolist()):
        totals[org, cls] = totals.get((org, cls), 0) + 1
        own = counts.setdefault((second, org, cls), [0, 0])
        own[0] += 1
        own[1] += threat
    clock = max(body["clock"], int(times.max()))
    first = -(-clock // SECOND) - window_s
    latencies = [None if pd.isna(v) else float(v) for v in rows["latency_ms"]]
    newest = body["newest"] + [list(r) for r in zip(times.tolist(), text["event_id"], latencies)]
    newest.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""), reverse=True)
    return {
        "totals": [[*k, n] for k, n in totals.items()],
        "seconds": [[*k, *v] for k, v in counts.items() if k[0] > first],
        "newest": newest[:recent], "clock": clock,
    }


def live_state_query(
    alerts: DataFrame, checkpoint: str, window_s: int = WINDOW_SECONDS, recent: int = RECENT_LATENCIES,
    slots: int = SLOTS, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the live state of a stream of alerts in the state store below ``checkpoint``."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        body = {"totals": [], "seconds": [], "newest": [], "clock": 0}
        if state.exists:
            body = json.loads(state.get[0])
        for rows in frames:
            body = merge_alerts(body, rows, window_s, recent)
        state.update((json.dumps(body),))
        yield pd.DataFrame({"slot": [key[0]], "clock": [body["clock"]]})

    dealt = alerts.select(
        F.pmod(F.xxhash64("event_id"), F.lit(slots)).cast("int").alias("slot"), "event_id", "org_id", "pred_class",
        "is_attack", F.col("ts_scored").cast("double").alias("ts_scored"), "latency_ms")
    clocks = dealt.groupBy("slot").applyInPandasWithState(
        update, "slot int, clock bigint", "body string", "update", GroupStateTimeout.NoTimeout)
    return (
        clocks.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def _state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per slot: the state as it stood after the last batch."""
    stored = spark.read.format("statestore").load(checkpoint)
    lists = ", ".join(f"{name} array<array<string>>" for name in ("totals", "seconds", "newest"))
    body = F.from_json("value.groupState.body", f"{lists}, clock bigint")
    return stored.select(body.alias("s")).select("s.*")


def live_view(
    spark: SparkSession, checkpoint: str, as_of: int | None = None, classes: Sequence[str] = CLASSES,
    window_s: int = WINDOW_SECONDS, recent: int = RECENT_LATENCIES,
) -> DataFrame:
    """``live_summary`` from the state: rows ``section, key, value``.

    ``as_of`` (epoch ms, default: the newest alert) is moved up to a whole second; it cannot lie
    before the newest alert, as the state keeps no earlier totals.
    """
    slots = _state_rows(spark, checkpoint)
    clock = slots.agg(F.max("clock")).first()[0] or 0
    as_of = clock if as_of is None else as_of
    if as_of < clock:
        raise ValueError(f"the state has gone on to {clock}")
    last = -(-as_of // SECOND)

    def cell(row: Column, i: int, kind: str) -> Column:
        return F.get(row, F.lit(i)).cast(kind)

    totals = slots.select(F.explode("totals").alias("r")).select(
        cell(F.col("r"), 0, "string").alias("org_id"), cell(F.col("r"), 1, "string").alias("pred_class"),
        cell(F.col("r"), 2, "bigint").alias("n"), F.lit(0).cast("bigint").alias("n_recent"),
        F.lit(0).cast("bigint").alias("n_threats"))
    second = cell(F.col("r"), 0, "bigint")
    recents = slots.select(F.explode("seconds").alias("r")).filter(
        (second > last - window_s) & (second <= last)
    ).select(
        cell(F.col("r"), 1, "string").alias("org_id"), cell(F.col("r"), 2, "string").alias("pred_class"),
        F.lit(0).cast("bigint").alias("n"), cell(F.col("r"), 3, "bigint").alias("n_recent"),
        cell(F.col("r"), 4, "bigint").alias("n_threats"))
    cube = totals.unionByName(recents).groupBy("org_id", "pred_class").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_recent", "n_threats")])
    newest = slots.select(F.explode("newest").alias("r")).select(
        cell(F.col("r"), 0, "bigint").alias("ts_scored"), cell(F.col("r"), 1, "string").alias("event_id"),
        cell(F.col("r"), 2, "double").alias("latency_ms"))
    return summary_rows(cube, recent_latency(newest, recent), classes, window_s)
