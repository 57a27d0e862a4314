"""Queries over a table of alerts: newest rows, live summary, delivery and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.labels import CLASSES
from flowlens.operators.quantiles import exact_percentiles

# Fixed values of the live view.
WINDOW_SECONDS = 60
RECENT_LATENCIES = 500
RETAINED_ALERTS = 5000
DEFAULT_LIMIT = 50
MAX_LIMIT = 500


def newest_first(time: str = "ts_scored") -> list[Column]:
    return [F.col(time).desc(), F.col("event_id").desc()]


def latest_alerts(
    alerts: DataFrame,
    limit: int = DEFAULT_LIMIT,
    only_attacks: bool = False,
    org_id: str | None = None,
    display: bool = False,
) -> DataFrame:
    """The newest alerts that match; ``display`` rounds them for reading."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be within 1..{MAX_LIMIT}")
    if only_attacks:
        alerts = alerts.filter("is_attack")
    if org_id:
        alerts = alerts.filter(F.col("org_id") == org_id)
    newest = alerts.orderBy(*newest_first()).limit(limit)
    if not display:
        return newest
    return newest.select(
        "event_id", "ts_event", "org_id", "device_id", "pred_class",
        F.round("confidence", 3).alias("confidence"),
        F.round("latency_ms", 1).alias("latency_ms"),
        "is_attack", "true_label",
    )


def retained_alerts(alerts: DataFrame, size: int = RETAINED_ALERTS) -> DataFrame:
    """The newest ``size`` alerts: what a bounded history of that length would hold."""
    return alerts.orderBy(*newest_first()).limit(size)


def org_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per organisation, in order."""
    return (
        alerts.groupBy("org_id").agg(F.count(F.lit(1)).alias("alert_count")).orderBy("org_id")
    )


def recent_latency(alerts: DataFrame, recent: int = RECENT_LATENCIES) -> DataFrame:
    """Median and 95th percentile of the newest latencies, as one row; 0.0 without alerts."""
    newest = alerts.select("ts_scored", "event_id", "latency_ms").orderBy(
        *newest_first()).limit(recent)
    at = F.percentile("latency_ms", [0.5, 0.95])
    return newest.agg(at.alias("_at")).select(
        F.coalesce(F.round(F.get("_at", F.lit(0)), 1), F.lit(0.0)).alias("latency_p50_ms"),
        F.coalesce(F.round(F.get("_at", F.lit(1)), 1), F.lit(0.0)).alias("latency_p95_ms"),
    )


def live_summary(
    alerts: DataFrame,
    as_of: int,
    classes: Sequence[str] = CLASSES,
    window_s: int = WINDOW_SECONDS,
    recent: int = RECENT_LATENCIES,
) -> DataFrame:
    """State at ``as_of`` (epoch ms) as rows ``section, key, value``.

    ``rates`` cover the last ``window_s`` seconds, ``totals``, ``by_class`` (all
    classes) and ``by_org`` everything up to ``as_of``, ``latency`` the newest
    ``recent`` alerts. All counts come from one aggregate of the rows.
    """
    seen = alerts.filter(F.col("ts_scored") <= as_of)
    in_window = F.col("ts_scored") > F.lit(as_of - window_s * 1000)
    cube = seen.groupBy("org_id", "pred_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(in_window).alias("n_recent"),
        F.count_if(in_window & F.col("is_attack")).alias("n_threats"),
    )
    return summary_rows(cube, recent_latency(seen, recent), classes, window_s)


def summary_rows(cube: DataFrame, latency: DataFrame, classes: Sequence[str], window_s: int) -> DataFrame:
    """The rows of a live summary from counts per organisation and class, and one row of latencies."""
    def entry(section: str, key: Column | str, value: Column | str) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        value = F.col(value) if isinstance(value, str) else value
        return F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))

    known = F.col("pred_class").isin(list(classes))
    shares = F.array_compact(F.array(
        entry("rates", "events_per_s", "n_recent"),
        entry("rates", "threats_in_window", "n_threats"),
        entry("totals", "alerts", "n"),
        entry("by_org", F.col("org_id"), "n"),
        F.when(known, entry("by_class", F.col("pred_class"), "n")),
    ))
    # Every fixed line exists even when nothing was seen.
    fixed = [("rates", "events_per_s"), ("rates", "threats_in_window"), ("totals", "alerts")]
    zeros = cube.sparkSession.createDataFrame(
        [(s, k, 0) for s, k in fixed + [("by_class", c) for c in classes]],
        "section string, key string, value bigint")
    per_second = F.round(F.sum("value") / F.lit(float(window_s or 1)), 1)
    counts = (
        cube.select(F.inline(shares)).unionByName(zeros).groupBy("section", "key")
        .agg(F.when(F.col("key") == "events_per_s", per_second)
             .otherwise(F.sum("value").cast("double")).alias("value"))
    )
    rows = latency.select(F.inline(F.array(
        entry("latency", "p50_ms", "latency_p50_ms"),
        entry("latency", "p95_ms", "latency_p95_ms"),
    )))
    return counts.unionByName(rows)


def delivered_alerts(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose event was sent; an event alerted twice counts twice."""
    return alerts.join(sent.select("event_id").distinct(), "event_id", "left_semi")


def latency_report(alerts: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """p50, p95, p99, mean, min and max latency as rows ``statistic, value`` (1 decimal).

    All six ignore NULL and NaN.
    """
    alerts = alerts.filter(F.col(latency).isNotNull() & ~F.isnan(latency))
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    points = exact_percentiles(alerts, latency, list(names))
    named = F.element_at(
        F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.col("fraction")
    )
    moments = alerts.agg(*[
        f(latency).cast("double").alias(name)
        for name, f in (("mean", F.mean), ("min", F.min), ("max", F.max))
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("statistic"), F.col(name).alias("value"))
        for name in ("mean", "min", "max")
    ]))).filter(F.col("value").isNotNull())
    rows = points.select(named.alias("statistic"), "value").unionByName(moments)
    return rows.select("statistic", F.round("value", 1).alias("value"))


def delivery_report(
    alerts: DataFrame, sent: DataFrame, send_seconds: float, consume_seconds: float
) -> DataFrame:
    """Sent and received events, receive rate (%) and throughput, as one row."""
    received = delivered_alerts(alerts, sent).agg(F.count(F.lit(1)).alias("events_received"))
    counted = sent.agg(F.count(F.lit(1)).alias("events_sent"))
    sides = counted.select(F.col("events_sent"), F.lit(0).cast("bigint").alias("events_received"))
    sides = sides.unionByName(
        received.select(F.lit(0).cast("bigint").alias("events_sent"), "events_received"))
    totals = sides.agg(
        F.sum("events_sent").alias("events_sent"), F.sum("events_received").alias("events_received")
    )
    share = F.try_divide(F.col("events_received") * 100.0, F.col("events_sent"))
    return totals.select(
        "events_sent", "events_received",
        F.round(F.coalesce(share, F.lit(0.0)), 1).alias("receive_rate"),
        F.round(F.col("events_sent") / F.lit(max(send_seconds, 0.001)), 1)
        .alias("send_throughput_eps"),
        F.round(F.col("events_received") / F.lit(max(consume_seconds, 0.001)), 1)
        .alias("end_to_end_throughput_eps"),
    )
