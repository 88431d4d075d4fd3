"""Health, performance, quality and list reports over the check and anomaly history.

Each report is one conditional aggregate per history table; counts of a second
table come in as a scalar subquery.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.functions.columns import moment, naive, percent
from plumbspark.operators.relational import page

HEALTHY_SCORE = 80.0
SEVERITIES = ("low", "medium", "high", "critical")
GAUGE_LOW, GAUGE_HIGH = 70.0, 90.0


def since(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on."""
    cut = moment(as_of - timedelta(days=days)).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) >= cut)


def newest(df: DataFrame, ts: str) -> list[Column]:
    return [F.col(ts).desc(), F.col("id").asc()]


def _is(status: str) -> Column:
    return F.col("status") == status


def _score(passed: Column, total: Column) -> Column:
    """Share of passed checks in percent; 100 when nothing ran."""
    return F.coalesce(percent(passed, total), F.lit(100.0))


def system_health(checks: DataFrame, anomalies: DataFrame) -> DataFrame:
    found = anomalies.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "critical").alias("critical")
        ).alias("a")
    ).scalar()
    score = _score(F.col("passed_checks"), F.col("total_checks"))
    return checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(_is("passed")).alias("passed_checks"),
        F.count_if(_is("failed")).alias("failed_checks"),
    ).select(
        F.round(score, 1).alias("overall_score"),
        "total_checks",
        "passed_checks",
        "failed_checks",
        found["total"].alias("total_anomalies"),
        found["critical"].alias("critical_anomalies"),
        F.when(score >= HEALTHY_SCORE, "healthy").otherwise("degraded").alias("status"),
    )


def performance_metrics(checks: DataFrame, recent: int = 10) -> DataFrame:
    last = page(checks.select("id", "timestamp", "status"), newest(checks, "timestamp"), 0, recent)
    seen = last.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if(_is("passed")).alias("ok")).alias("r")
    ).scalar()
    return checks.agg(F.avg("execution_time").alias("avg_time")).select(
        F.round(F.coalesce(F.col("avg_time") * 1000, F.lit(0.0)), 2).alias("average_execution_time_ms"),
        F.round(_score(seen["ok"], seen["n"]), 1).alias("recent_success_rate"),
        seen["n"].alias("recent_checks_count"),
        F.lit("stable").alias("performance_trend"),
    )


def _long_counts(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Counts per value of several columns in one scan: ``(dimension, value, count)``."""
    named = df.select(*[F.col(c).cast("string").alias(name) for name, c in dimensions.items()])
    return (
        named.unpivot([], list(dimensions), "dimension", "value")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def anomaly_metrics(anomalies: DataFrame) -> DataFrame:
    return _long_counts(
        anomalies,
        {"by_severity": "severity", "by_type": "anomaly_type", "by_resolution": "resolution_status"},
    )


def summary_counts(staves: DataFrame, clefs: DataFrame, checks: DataFrame) -> DataFrame:
    """Active sources, active rule sets and all checks."""
    active_staves = staves.agg(F.count_if("is_active").alias("n")).scalar()
    active_clefs = clefs.agg(F.count_if("is_active").alias("n")).scalar()
    return checks.agg(F.count(F.lit(1)).alias("total_checks")).select(
        active_staves.alias("total_staves"), active_clefs.alias("total_clefs"), "total_checks"
    )


def latest(df: DataFrame, ts: str, n: int) -> DataFrame:
    return page(df, newest(df, ts), 0, n)


def summary_report(staves: DataFrame, clefs: DataFrame, checks: DataFrame, recent: int = 5) -> DataFrame:
    """The three counts beside each of the latest checks."""
    counts = summary_counts(staves, clefs, checks).select(F.struct("*").alias("c")).scalar()
    return latest(checks, "timestamp", recent).select(
        counts["total_staves"].alias("total_staves"),
        counts["total_clefs"].alias("total_clefs"),
        counts["total_checks"].alias("total_checks"),
        *checks.columns,
    )


def quality_report(checks: DataFrame, anomalies: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Score of a period; everything that did not pass counts as failed here."""
    found = (
        since(anomalies, "detected_at", as_of, days)
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("total"),
                *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
            ).alias("a")
        )
        .scalar()
    )
    total, passed = F.col("total_checks"), F.col("passed_checks")
    return (
        since(checks, "timestamp", as_of, days)
        .agg(F.count(F.lit(1)).alias("total_checks"), F.count_if(_is("passed")).alias("passed_checks"))
        .select(
            F.lit(days).alias("period_days"),
            F.round(_score(passed, total), 1).alias("quality_score"),
            "total_checks",
            "passed_checks",
            (total - passed).alias("failed_checks"),
            found["total"].alias("total_anomalies"),
            *[found[s].alias(f"anomalies_{s}") for s in SEVERITIES],
        )
    )


def performance_report(checks: DataFrame, as_of, days: int = 7) -> DataFrame:
    def ms(c: Column) -> Column:
        return F.round(F.coalesce(c * 1000, F.lit(0.0)), 2)

    t = F.col("execution_time")
    return (
        since(checks, "timestamp", as_of, days)
        .agg(F.avg(t).alias("a"), F.min(t).alias("b"), F.max(t).alias("c"), F.count(t).alias("total_checks"))
        .select(
            F.lit(days).alias("period_days"),
            ms(F.col("a")).alias("average_ms"),
            ms(F.col("b")).alias("minimum_ms"),
            ms(F.col("c")).alias("maximum_ms"),
            "total_checks",
            F.lit("stable").alias("performance_trend"),
        )
    )


def group_report(checks: DataFrame, anomalies: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Checks per status, anomalies per severity and per table of a period."""
    a = _long_counts(since(checks, "timestamp", as_of, days), {"checks_by_status": "status"})
    b = _long_counts(
        since(anomalies, "detected_at", as_of, days),
        {"anomalies_by_severity": "severity", "anomalies_by_table": "table_name"},
    )
    return a.unionByName(b)


def latest_of_period(checks: DataFrame, anomalies: DataFrame, as_of, days: int = 7, n: int = 10) -> DataFrame:
    """Newest checks and newest anomalies of a period in one list."""
    a = latest(since(checks, "timestamp", as_of, days), "timestamp", n).select(
        F.lit("check").alias("type"), "id", F.col("check_type").alias("kind"), F.col("status").alias("state"), F.col("timestamp").alias("at")
    )
    b = latest(since(anomalies, "detected_at", as_of, days), "detected_at", n).select(
        F.lit("anomaly").alias("type"), "id", F.col("anomaly_type").alias("kind"), F.col("severity").alias("state"), F.col("detected_at").alias("at")
    )
    return a.unionByName(b)


def checks_of_period(checks: DataFrame, clefs: DataFrame, staves: DataFrame, as_of, days: int, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of the period's checks, newest first, with rule-set and source names.

    The page is cut before the names are joined, so the joins see ``limit`` rows.
    """
    rows = page(since(checks, "timestamp", as_of, days), newest(checks, "timestamp"), skip, limit)
    c = clefs.select(F.col("id").alias("clef_id"), F.col("name").alias("clef_name"))
    s = staves.select(F.col("id").alias("stave_id"), F.col("name").alias("stave_name"))
    named = rows.join(c, "clef_id", "left").join(s, "stave_id", "left").select(*checks.columns, "clef_name", "stave_name")
    return named.orderBy(*newest(named, "timestamp"))


def anomalies_of_period(anomalies: DataFrame, as_of, days: int, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(since(anomalies, "detected_at", as_of, days), newest(anomalies, "detected_at"), skip, limit)


def gauge_band(score: Column) -> Column:
    return F.when(score >= GAUGE_HIGH, "good").when(score >= GAUGE_LOW, "fair").otherwise("poor")


def dashboard(staves: DataFrame, clefs: DataFrame, checks: DataFrame, as_of) -> DataFrame:
    """Source and rule counts, today's checks and success rate, overall score and its band."""
    today = F.to_date(naive(F.col("timestamp"))) == F.to_date(moment(as_of))
    n_staves = staves.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_clefs = clefs.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("active")).alias("c")).scalar()
    score = _score(F.col("passed"), F.col("total"))
    return checks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("passed")).alias("passed"),
        F.count_if(today).alias("checks_today"),
        F.count_if(today & _is("passed")).alias("passed_today"),
    ).select(
        n_staves.alias("total_staves"),
        n_clefs["n"].alias("total_clefs"),
        "checks_today",
        F.round(_score(F.col("passed_today"), F.col("checks_today")), 1).alias("success_rate"),
        n_clefs["active"].alias("active_checks"),
        F.round(score, 1).alias("data_quality_score"),
        gauge_band(score).alias("band"),
    )


def top_issues(checks: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent messages among checks that did not pass."""
    return (
        checks.filter(_is("passed") == F.lit(False))
        .groupBy("message")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("message").asc())
        .limit(k)
    )


def quality_trend(checks: DataFrame) -> DataFrame:
    """Score per day and its change from the previous day that had checks."""
    daily = checks.groupBy(F.to_date(naive(F.col("timestamp"))).alias("day")).agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if(_is("passed")).alias("passed_checks")
    )
    # One row per calendar day: small enough for a single ordered window.
    before = F.lag("score").over(Window.orderBy("day"))
    return (
        daily.withColumn("score", _score(F.col("passed_checks"), F.col("total_checks")))
        .withColumn("delta", F.col("score") - before)
        .select(
            "day",
            "total_checks",
            "passed_checks",
            F.round("score", 1).alias("score"),
            F.round("delta", 1).alias("delta"),
        )
    )
