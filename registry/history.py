"""Reports over the check and anomaly history (one history row per event)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbspark.functions.shared_dir import shared_folder
from plumbspark.operators.relational import page
from plumbspark.plans import export as X
from plumbspark.plans import reports as R
from plumbspark.plans import rollups as U
from registry.common import (
    AS_OF,
    HISTORY_SQL,
    ORACLE,
    WEEK_SQL,
    anomalies,
    checks,
    clefs,
    query,
    rounded,
    staves,
    time_text,
    time_text_sql,
)

_PASSED = "COUNT(*) FILTER (WHERE status = 'passed')"
_SCORE = f"COALESCE(100.0 * {_PASSED} / NULLIF(COUNT(*), 0), 100.0)"


def _timed(df, column):
    return df.withColumn(column, time_text(F.col(column)))


@query(
    "metrics_health",
    f"""{HISTORY_SQL} SELECT ROUND({_SCORE}, 1) AS overall_score, COUNT(*) AS total_checks, {_PASSED} AS passed_checks,
        COUNT(*) FILTER (WHERE status = 'failed') AS failed_checks, (SELECT COUNT(*) FROM anomalies) AS total_anomalies,
        (SELECT COUNT(*) FROM anomalies WHERE severity = 'critical') AS critical_anomalies,
        CASE WHEN {_SCORE} >= 80 THEN 'healthy' ELSE 'degraded' END AS status FROM checks""",
)
def metrics_health(spark, folder):
    return R.system_health(checks(spark, folder), anomalies(spark, folder))


_LAST = 'SELECT status FROM checks ORDER BY "timestamp" DESC, id LIMIT 10'


@query(
    "metrics_performance",
    f"""{HISTORY_SQL} SELECT ROUND(COALESCE(AVG(execution_time) * 1000, 0), 2) AS average_execution_time_ms,
        (SELECT ROUND({_SCORE}, 1) FROM ({_LAST})) AS recent_success_rate,
        (SELECT COUNT(*) FROM ({_LAST})) AS recent_checks_count, 'stable' AS performance_trend FROM checks""",
)
def metrics_performance(spark, folder):
    return R.performance_metrics(checks(spark, folder))


@query(
    "metrics_anomalies",
    f"""{HISTORY_SQL} SELECT 'by_severity' AS dimension, severity AS value, COUNT(*) AS count FROM anomalies GROUP BY severity
    UNION ALL SELECT 'by_type', anomaly_type, COUNT(*) FROM anomalies GROUP BY anomaly_type
    UNION ALL SELECT 'by_resolution', resolution_status, COUNT(*) FROM anomalies GROUP BY resolution_status""",
)
def metrics_anomalies(spark, folder):
    return R.anomaly_metrics(anomalies(spark, folder))


@query(
    "report_summary",
    f"""{HISTORY_SQL} SELECT (SELECT COUNT(*) FROM staves WHERE is_active) AS total_staves,
        (SELECT COUNT(*) FROM clefs WHERE is_active) AS total_clefs, (SELECT COUNT(*) FROM checks) AS total_checks,
        id, check_type, status, message, {time_text_sql('"timestamp"')} AS "timestamp"
        FROM checks c ORDER BY c."timestamp" DESC, id LIMIT 5""",
)
def report_summary(spark, folder):
    out = R.summary_report(staves(spark, folder), clefs(spark, folder), checks(spark, folder))
    keep = ["total_staves", "total_clefs", "total_checks", "id", "check_type", "status", "message", "timestamp"]
    return _timed(out.select(*keep), "timestamp")


_WEEK_A = f"(SELECT * FROM anomalies WHERE detected_at >= {WEEK_SQL})"


@query(
    "report_quality",
    f"""{HISTORY_SQL} SELECT CAST(7 AS INTEGER) AS period_days, ROUND({_SCORE}, 1) AS quality_score, COUNT(*) AS total_checks,
        {_PASSED} AS passed_checks, COUNT(*) - {_PASSED} AS failed_checks, (SELECT COUNT(*) FROM {_WEEK_A}) AS total_anomalies,
        """
    + ", ".join(f"(SELECT COUNT(*) FROM {_WEEK_A} WHERE severity = '{s}') AS anomalies_{s}" for s in R.SEVERITIES)
    + f""" FROM checks WHERE "timestamp" >= {WEEK_SQL}""",
)
def report_quality(spark, folder):
    return R.quality_report(checks(spark, folder), anomalies(spark, folder), AS_OF)


@query(
    "report_performance",
    f"""{HISTORY_SQL} SELECT CAST(7 AS INTEGER) AS period_days, ROUND(COALESCE(AVG(execution_time) * 1000, 0), 2) AS average_ms,
        ROUND(COALESCE(MIN(execution_time) * 1000, 0), 2) AS minimum_ms, ROUND(COALESCE(MAX(execution_time) * 1000, 0), 2) AS maximum_ms,
        COUNT(execution_time) AS total_checks, 'stable' AS performance_trend FROM checks WHERE "timestamp" >= {WEEK_SQL}""",
)
def report_performance(spark, folder):
    return R.performance_report(checks(spark, folder), AS_OF)


@query(
    "report_group_counts",
    f"""{HISTORY_SQL} SELECT 'checks_by_status' AS dimension, status AS value, COUNT(*) AS count FROM checks WHERE "timestamp" >= {WEEK_SQL} GROUP BY status
    UNION ALL SELECT 'anomalies_by_severity', severity, COUNT(*) FROM {_WEEK_A} GROUP BY severity
    UNION ALL SELECT 'anomalies_by_table', table_name, COUNT(*) FROM {_WEEK_A} GROUP BY table_name""",
)
def report_group_counts(spark, folder):
    return R.group_report(checks(spark, folder), anomalies(spark, folder), AS_OF)


@query(
    "report_latest",
    f"""{HISTORY_SQL} SELECT * FROM (SELECT 'check' AS type, id, check_type AS kind, status AS state, {time_text_sql('"timestamp"')} AS at
        FROM checks c WHERE c."timestamp" >= {WEEK_SQL} ORDER BY c."timestamp" DESC, id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'anomaly', id, anomaly_type, severity, {time_text_sql('detected_at')}
        FROM {_WEEK_A} ORDER BY detected_at DESC, id LIMIT 10)""",
)
def report_latest(spark, folder):
    return _timed(R.latest_of_period(checks(spark, folder), anomalies(spark, folder), AS_OF), "at")


@query(
    "checks_page",
    f"""{HISTORY_SQL} SELECT id, check_type, status, {time_text_sql('"timestamp"')} AS "timestamp" FROM checks c
        ORDER BY c."timestamp" DESC, id LIMIT 100 OFFSET 200""",
)
def checks_page(spark, folder):
    c = checks(spark, folder).select("id", "check_type", "status", "timestamp")
    return _timed(page(c, R.newest(c, "timestamp"), 200, 100), "timestamp")


_TODAY = "CAST(\"timestamp\" AS DATE) = DATE '2024-01-30'"


@query(
    "dashboard_metrics",
    f"""{HISTORY_SQL} SELECT (SELECT COUNT(*) FROM staves) AS total_staves, (SELECT COUNT(*) FROM clefs) AS total_clefs,
        COUNT(*) FILTER (WHERE {_TODAY}) AS checks_today,
        ROUND(COALESCE(100.0 * COUNT(*) FILTER (WHERE {_TODAY} AND status = 'passed') / NULLIF(COUNT(*) FILTER (WHERE {_TODAY}), 0), 100.0), 1) AS success_rate,
        (SELECT COUNT(*) FROM clefs WHERE is_active) AS active_checks, ROUND({_SCORE}, 1) AS data_quality_score,
        CASE WHEN {_SCORE} >= 90 THEN 'good' WHEN {_SCORE} >= 70 THEN 'fair' ELSE 'poor' END AS band FROM checks""",
)
def dashboard_metrics(spark, folder):
    day = AS_OF.replace(day=30)
    return R.dashboard(staves(spark, folder), clefs(spark, folder), checks(spark, folder), day)


@query(
    "dashboard_top_issues",
    f"""{HISTORY_SQL} SELECT message, COUNT(*) AS count FROM checks WHERE status <> 'passed'
        GROUP BY message ORDER BY count DESC, message LIMIT 5""",
)
def dashboard_top_issues(spark, folder):
    return R.top_issues(checks(spark, folder))


@query(
    "quality_trend",
    f"""{HISTORY_SQL}, d AS (SELECT CAST("timestamp" AS DATE) AS day, COUNT(*) AS total_checks, {_PASSED} AS passed_checks,
        {_SCORE} AS score FROM checks GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, total_checks, passed_checks, ROUND(score, 1) AS score,
           ROUND(score - lag(score) OVER (ORDER BY day), 1) AS delta FROM d""",
)
def quality_trend(spark, folder):
    return R.quality_trend(checks(spark, folder)).withColumn("day", F.col("day").cast("string"))


@query(
    "report_checks_window",
    f"""{HISTORY_SQL} SELECT c.id, c.check_type, c.status, cl.name AS clef_name, s.name AS stave_name, {time_text_sql('c."timestamp"')} AS "timestamp"
    FROM checks c LEFT JOIN clefs cl ON c.clef_id = cl.id LEFT JOIN staves s ON c.stave_id = s.id
    WHERE c."timestamp" >= {WEEK_SQL} ORDER BY c."timestamp" DESC, c.id LIMIT 100""",
)
def report_checks_window(spark, folder):
    out = R.checks_of_period(checks(spark, folder), clefs(spark, folder), staves(spark, folder), AS_OF, 7)
    return _timed(out.select("id", "check_type", "status", "clef_name", "stave_name", "timestamp"), "timestamp")


@query(
    "report_anomalies_window",
    f"""{HISTORY_SQL} SELECT id, check_id, table_name, anomaly_type, severity, {time_text_sql('detected_at')} AS detected_at
    FROM anomalies a WHERE a.detected_at >= {WEEK_SQL} ORDER BY a.detected_at DESC, id LIMIT 100""",
)
def report_anomalies_window(spark, folder):
    out = R.anomalies_of_period(anomalies(spark, folder), AS_OF, 7)
    return _timed(out.select("id", "check_id", "table_name", "anomaly_type", "severity", "detected_at"), "detected_at")


@query(
    "report_export_rows",
    f"""{HISTORY_SQL} SELECT 'check' AS type, id, check_type, status, message, 't' || CAST(CAST(clef_id AS INTEGER) % 7 AS VARCHAR) AS table_name,
        anomalies_count, severity, ROUND(execution_time, 6) AS execution_time, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
        NULL AS anomaly_type, NULL AS column_name, NULL AS description, NULL AS resolution_status, NULL AS detected_at, NULL AS data_sample
        FROM checks c WHERE c."timestamp" >= {WEEK_SQL}
    UNION ALL SELECT 'anomaly', id, NULL, NULL, NULL, table_name, NULL, severity, NULL, NULL, anomaly_type, column_name, description,
        resolution_status, strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%f'), data_sample FROM {_WEEK_A}""",
)
def report_export_rows(spark, folder):
    return rounded(X.export_rows(checks(spark, folder), anomalies(spark, folder), AS_OF))


@query(
    "report_export_json",
    f"""{HISTORY_SQL} SELECT 'report_metadata' AS section, CAST(1 AS BIGINT) AS records UNION ALL SELECT 'system_health', 1
    UNION ALL SELECT 'checks', COUNT(*) FROM checks WHERE "timestamp" >= {WEEK_SQL}
    UNION ALL SELECT 'anomalies', COUNT(*) FROM {_WEEK_A}""",
)
def report_export_json(spark, folder):
    records = X.json_records(checks(spark, folder), anomalies(spark, folder), AS_OF)
    return records.groupBy("section").agg(F.count("record").alias("records"))


# --- the same reports from daily rollups by run ----------------------------------------

_ROLLUPS: dict[tuple, str] = {}


def _rollups(spark, folder):
    """The history came in three runs; the second was wrong at first and came again after the third."""
    key = spark.sparkContext.applicationId, folder
    if key not in _ROLLUPS:
        out = shared_folder(spark, "rollups")
        for kind, rows, number in (("checks", checks(spark, folder), F.col("id")), ("anomalies", anomalies(spark, folder), F.col("check_id"))):
            run = number.cast("bigint") % 3
            U.update_rollup(rows.where(run == 0), kind, "a", out)
            U.update_rollup(rows, kind, "b", out)
            U.update_rollup(rows.where(run == 2), kind, "c", out)
            U.update_rollup(rows.where(run == 1), kind, "b", out)
        _ROLLUPS[key] = out
    return _ROLLUPS[key]


def _both_rolled(spark, folder, days=None):
    out = _rollups(spark, folder)
    return [U.rolled(spark, out, k) if days is None else U.window(spark, out, k, AS_OF, days) for k in ("checks", "anomalies")]


@query("rollup_health", ORACLE["metrics_health"])
def rollup_health(spark, folder):
    return U.system_health(*_both_rolled(spark, folder))


@query("rollup_quality", ORACLE["report_quality"])
def rollup_quality(spark, folder):
    return U.quality_report(*_both_rolled(spark, folder, 7), days=7)


@query("rollup_performance", ORACLE["report_performance"])
def rollup_performance(spark, folder):
    return U.performance_report(_both_rolled(spark, folder, 7)[0], days=7)


@query("rollup_group_counts", ORACLE["report_group_counts"])
def rollup_group_counts(spark, folder):
    return U.group_report(*_both_rolled(spark, folder, 7))


@query("rollup_trend", ORACLE["quality_trend"])
def rollup_trend(spark, folder):
    return U.quality_trend(_both_rolled(spark, folder)[0]).withColumn("day", F.col("day").cast("string"))
