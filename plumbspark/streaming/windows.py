"""Windowed quality metrics, anomaly rates and silence alerts under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.columns import clean_double, quoted

LATENESS = "1 hour"
MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def tumbling_metrics(
    stream: DataFrame, ts: str, by: str, value: str, length: str = "1 day", lateness: str = LATENESS
) -> DataFrame:
    """Rows, nulls, min, max and mean per window and group, once the window is closed."""
    v = clean_double(stream, value)
    return (
        stream.select(ts, by, v.alias("__v"))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, length).alias("w"), by)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("__v").isNull()).alias("null_count"),
            F.min("__v").alias("min_value"),
            F.max("__v").alias("max_value"),
            F.avg("__v").alias("mean_value"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by,
                "row_count", "null_count", "min_value", "max_value", "mean_value")
    )


def sliding_anomaly_rate(
    stream: DataFrame,
    limits: DataFrame,
    ts: str,
    value: str,
    length: str = "2 days",
    slide: str = "1 day",
    lateness: str = LATENESS,
) -> DataFrame:
    """Share of values outside static bounds per sliding window.

    ``limits`` is the one-row output of ``iqr_thresholds`` over a reference table. It is computed once, here:
    the batches see two literals.
    """
    bounds = limits.select(F.col("lower_bound").cast("double"), F.col("upper_bound").cast("double")).first()
    v = clean_double(stream, value)
    outside = (F.col("__v") < F.lit(bounds.lower_bound)) | (F.col("__v") > F.lit(bounds.upper_bound))
    return (
        stream.select(ts, v.alias("__v"))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, length, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(outside).alias("anomalies"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "total",
            "anomalies",
            F.round(F.try_divide("anomalies", "total") * 100, 2).alias("anomaly_rate"),
        )
    )


def flagged_rate(stream: DataFrame, ts: str, length: str = "2 days", slide: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Share of flagged rows (``is_anomaly``, see ``batches.flag_stream``) per sliding window."""
    return (
        stream.select(ts, "is_anomaly")
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, length, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "total",
            "anomalies",
            F.round(F.try_divide("anomalies", "total") * 100, 2).alias("anomaly_rate"),
        )
    )


def silence_alerts(
    stream: DataFrame, entity: str, ts: str, hours: int, lateness: str = LATENESS
) -> DataFrame:
    """One row whenever an entity sent nothing for ``hours``: last event and alert time.

    A silent stretch is the end of a session with that gap, so Spark's own
    session state does the tracking. With the session's setting MERGE_SESSIONS at true when the
    query starts, sessions are merged before the shuffle, and a very active entity sends a few rows per
    task, not all of them.
    """
    return (
        stream.select(entity, ts)
        .withWatermark(ts, lateness)
        .groupBy(entity, F.session_window(ts, f"{hours} hours").alias("s"))
        .agg(F.max(ts).alias("last_event"), F.count(F.lit(1)).alias("events"))
        .select(entity, "last_event", F.col("s.end").alias("alert_at"), "events")
    )


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str = LATENESS) -> DataFrame:
    """First row per key; keys are remembered as long as the watermark demands."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys])


def late_watch(stream: DataFrame, ts: str, by: str, length: str, lateness: str) -> DataFrame:
    """Counts per window; the query's progress tells how many rows came too late."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, length).alias("w"), quoted(by))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.col("w.start").alias("window_start"), by, "row_count")
    )
