from datetime import datetime

from plumbspark.plans import export as X
from plumbspark.plans import reports as R
from plumbspark.sources.history import ANOMALIES, CHECKS, CLEFS, STAVES, empty_history

AS_OF = datetime(2024, 2, 1)


def check(i, status, day, seconds=1.0, kind="row_count"):
    return (f"c{i}", "s1", "r1", kind, status, f"{kind} {status}", '{"table_name":"users"}', datetime(2024, 1, day), seconds, 0, "medium")


def history(spark):
    checks = spark.createDataFrame(
        [check(1, "passed", 31, 2.3), check(2, "failed", 31, 5.1), check(3, "warning", 30, None), check(4, "passed", 2, 9.0)], CHECKS
    )
    anomalies = spark.createDataFrame(
        [
            ("a1", "c2", "users", "age", "outlier", "age 150", "high", datetime(2024, 1, 31), '{"age":150}', "investigating"),
            ("a2", "c2", "orders", "amount", "outlier", "amount 99999", "critical", datetime(2024, 1, 1), '{"amount":99999}', "resolved"),
        ],
        ANOMALIES,
    )
    return checks, anomalies


def test_health(spark):
    checks, anomalies = history(spark)
    assert tuple(R.system_health(checks, anomalies).first()) == (50.0, 4, 2, 1, 2, 1, "degraded")
    empty = R.system_health(empty_history(spark, "checks"), empty_history(spark, "anomalies")).first()
    assert tuple(empty) == (100.0, 0, 0, 0, 0, 0, "healthy")


def test_health_judges_the_unrounded_score(spark):
    rows = [check(i, "passed" if i < 7997 else "warning", 1) for i in range(10_000)]
    r = R.system_health(spark.createDataFrame(rows, CHECKS), empty_history(spark, "anomalies")).first()
    assert (r.overall_score, r.status) == (80.0, "degraded")


def test_quality_counts_everything_else_as_failed(spark):
    checks, anomalies = history(spark)
    r = R.quality_report(checks, anomalies, AS_OF, 7).first()
    assert (r.quality_score, r.total_checks, r.passed_checks, r.failed_checks) == (33.3, 3, 1, 2)
    assert (r.total_anomalies, r.anomalies_low, r.anomalies_high, r.anomalies_critical) == (1, 0, 1, 0)


def test_performance(spark):
    checks, _ = history(spark)
    r = R.performance_report(checks, AS_OF, 7).first()
    assert (r.average_ms, r.minimum_ms, r.maximum_ms, r.total_checks) == (3700.0, 2300.0, 5100.0, 2)
    m = R.performance_metrics(checks, recent=2).first()
    assert (m.average_execution_time_ms, m.recent_success_rate, m.recent_checks_count) == (5466.67, 50.0, 2)
    e = R.performance_metrics(empty_history(spark, "checks")).first()
    assert (e.average_execution_time_ms, e.recent_success_rate, e.recent_checks_count) == (0.0, 100.0, 0)


def test_summary_and_lists(spark, rows):
    checks, anomalies = history(spark)
    now = datetime(2024, 1, 1)
    staves = spark.createDataFrame([("s1", "warehouse", "", "postgres", "{}", True, now, now), ("s2", "old", "", "sqlite", "{}", False, now, now)], STAVES)
    clefs = spark.createDataFrame([("r1", "s1", "counts", "", "row_count", "{}", None, True, now, now)], CLEFS)
    assert tuple(R.summary_counts(staves, clefs, checks).first()) == (1, 1, 4)
    s = R.summary_report(staves, clefs, checks, 2).collect()
    assert [r.id for r in s] == ["c1", "c2"]
    page = R.checks_of_period(checks, clefs, staves, AS_OF, 7, skip=1, limit=1).collect()
    assert [(r.id, r.clef_name, r.stave_name) for r in page] == [("c2", "counts", "warehouse")]
    assert [r.id for r in R.anomalies_of_period(anomalies, AS_OF, 7).collect()] == ["a1"]
    d = R.dashboard(staves, clefs, checks, datetime(2024, 1, 31)).first()
    assert (d.total_staves, d.checks_today, d.success_rate, d.active_checks, d.band) == (2, 2, 50.0, 1, "poor")


def test_export(spark, tmp_path):
    checks, anomalies = history(spark)
    X.write_csv(checks, anomalies, AS_OF, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 4
    a = back.filter("type = 'anomaly'").first()
    assert (a.check_type, a.column_name, a.detected_at) == (None, "age", "2024-01-31T00:00:00.000000")
    assert back.filter("id = 'c1'").first().table_name == "users"
    X.write_json(checks, anomalies, AS_OF, str(tmp_path / "json"))
    sections = spark.read.text(str(tmp_path / "json")).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in sections} == {"report_metadata": 1, "system_health": 1, "checks": 3, "anomalies": 1}
