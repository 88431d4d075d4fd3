"""Daily aggregates of the check and anomaly history, kept by run; reports are answered from them.

A rollup lies in folders by day and run. A run that comes late or again replaces its own folders and no others, and
a report reads the folders of its window's days. Where a window begins within a day, that day's rows alone are read
from the history.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbspark.functions.columns import moment, naive, percent, quoted
from plumbspark.functions.shared_dir import names_in, remove
from plumbspark.plans.reports import HEALTHY_SCORE, SEVERITIES

#: Time column and dimensions of each history table.
KINDS = {
    "checks": ("timestamp", ("status", "check_type")),
    "anomalies": ("detected_at", ("severity", "anomaly_type", "resolution_status", "table_name")),
}


def daily(rows: DataFrame, kind: str) -> DataFrame:
    """(day, dimensions, n, timed, time_sum, time_min, time_max): a row for each day and combination. Rows without a
    time are under a NULL day: in no window, but in counts over everything."""
    ts, dimensions = KINDS[kind]
    t = F.col("execution_time") if kind == "checks" else F.lit(None).cast("double")
    day = F.to_date(naive(F.col(quoted(ts)))).alias("day")
    return rows.groupBy(day, *dimensions).agg(
        F.count(F.lit(1)).alias("n"), F.count(t).alias("timed"), F.sum(t).alias("time_sum"), F.min(t).alias("time_min"), F.max(t).alias("time_max")
    )


def _schema(kind: str) -> str:
    names = ", ".join(f"{d} string" for d in KINDS[kind][1])
    return f"{names}, n bigint, timed bigint, time_sum double, time_min double, time_max double, day date, run_id string"


def update_rollup(rows: DataFrame, kind: str, run_id: str, folder: str) -> None:
    """The rollup of one run's rows takes the place of what the run had before, also on days it has no more."""
    spark, path = rows.sparkSession, f"{folder.rstrip('/')}/{kind}"
    new = daily(rows, kind).withColumn("run_id", F.lit(run_id))
    out = new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("day", "run_id").parquet(path)
    days = new.select(F.coalesce(F.col("day").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("day")).distinct()
    held = {f"day={r.day}" for r in days.collect()}  # days of one run
    for name in names_in(spark, path):
        if name.startswith("day=") and name not in held and f"run_id={run_id}" in names_in(spark, f"{path}/{name}"):
            remove(spark, f"{path}/{name}/run_id={run_id}")


def rolled(spark: SparkSession, folder: str, kind: str, since: date | None = None) -> DataFrame:
    path = f"{folder.rstrip('/')}/{kind}"
    if not [n for n in names_in(spark, path) if n.startswith("day=")]:
        return spark.createDataFrame([], _schema(kind))
    out = spark.read.schema(_schema(kind)).parquet(path)
    return out if since is None else out.where(F.col("day") >= F.lit(since))


def window(spark: SparkSession, folder: str, kind: str, as_of: datetime, days: int, history: DataFrame | None = None) -> DataFrame:
    """Rollup rows from ``days`` before ``as_of`` on. A cut within a day needs the ``history`` table for that day."""
    cut = as_of - timedelta(days=days)
    midnight = datetime(cut.year, cut.month, cut.day)
    if cut == midnight:
        return rolled(spark, folder, kind, cut.date())
    if history is None:
        raise ValueError(f"a window from {cut} needs the history of that day")
    ts, after = F.col(quoted(KINDS[kind][0])), midnight + timedelta(days=1)
    own = history.schema[KINDS[kind][0]].dataType
    border = daily(history.where((ts >= moment(cut).cast(own)) & (ts < moment(after).cast(own))), kind).withColumn("run_id", F.lit(None).cast("string"))
    return rolled(spark, folder, kind, after.date()).unionByName(border)


def _n(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.col("n") if condition is None else F.when(condition, F.col("n"))), F.lit(0))


def _score(passed: Column, total: Column) -> Column:
    return F.coalesce(percent(passed, total), F.lit(100.0))


def _passed() -> Column:
    return F.col("status") == "passed"


def system_health(checks: DataFrame, anomalies: DataFrame) -> DataFrame:
    found = anomalies.agg(F.struct(_n().alias("total"), _n(F.col("severity") == "critical").alias("critical")).alias("a")).scalar()
    score = _score(F.col("passed_checks"), F.col("total_checks"))
    return checks.agg(
        _n().alias("total_checks"), _n(_passed()).alias("passed_checks"), _n(F.col("status") == "failed").alias("failed_checks")
    ).select(
        F.round(score, 1).alias("overall_score"), "total_checks", "passed_checks", "failed_checks",
        found["total"].alias("total_anomalies"), found["critical"].alias("critical_anomalies"),
        F.when(score >= HEALTHY_SCORE, "healthy").otherwise("degraded").alias("status"),
    )


def quality_report(checks: DataFrame, anomalies: DataFrame, days: int) -> DataFrame:
    found = anomalies.agg(
        F.struct(_n().alias("total"), *[_n(F.col("severity") == s).alias(s) for s in SEVERITIES]).alias("a")
    ).scalar()
    total, passed = F.col("total_checks"), F.col("passed_checks")
    return checks.agg(_n().alias("total_checks"), _n(_passed()).alias("passed_checks")).select(
        F.lit(days).alias("period_days"), F.round(_score(passed, total), 1).alias("quality_score"), "total_checks", "passed_checks",
        (total - passed).alias("failed_checks"), found["total"].alias("total_anomalies"),
        *[found[s].alias(f"anomalies_{s}") for s in SEVERITIES],
    )


def performance_report(checks: DataFrame, days: int) -> DataFrame:
    def ms(c: Column) -> Column:
        return F.round(F.coalesce(c * 1000, F.lit(0.0)), 2)

    timed = F.coalesce(F.sum("timed"), F.lit(0))
    return checks.agg(
        F.try_divide(F.sum("time_sum"), timed).alias("a"), F.min("time_min").alias("b"), F.max("time_max").alias("c"), timed.alias("total_checks")
    ).select(
        F.lit(days).alias("period_days"), ms(F.col("a")).alias("average_ms"), ms(F.col("b")).alias("minimum_ms"),
        ms(F.col("c")).alias("maximum_ms"), "total_checks", F.lit("stable").alias("performance_trend"),
    )


def _long_counts(rows: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    named = rows.select("n", *[F.col(c).alias(name) for name, c in dimensions.items()])
    return named.unpivot(["n"], list(dimensions), "dimension", "value").groupBy("dimension", "value").agg(F.sum("n").alias("count"))


def group_report(checks: DataFrame, anomalies: DataFrame) -> DataFrame:
    found = _long_counts(anomalies, {"anomalies_by_severity": "severity", "anomalies_by_table": "table_name"})
    return _long_counts(checks, {"checks_by_status": "status"}).unionByName(found)


def quality_trend(checks: DataFrame) -> DataFrame:
    by_day = checks.groupBy("day").agg(_n().alias("total_checks"), _n(_passed()).alias("passed_checks"))
    before = F.lag("score").over(Window.orderBy("day"))  # one row a calendar day
    scored = by_day.withColumn("score", _score(F.col("passed_checks"), F.col("total_checks"))).withColumn("delta", F.col("score") - before)
    return scored.select("day", "total_checks", "passed_checks", F.round("score", 1).alias("score"), F.round("delta", 1).alias("delta"))
