"""Reports from daily rollups against reports over the whole history."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbspark.plans import reports as R
from plumbspark.plans import rollups as U
from plumbspark.sources.history import ANOMALIES, CHECKS

AS_OF = datetime(2024, 3, 10)


@pytest.fixture(scope="module")
def history(spark):
    draw = random.Random(2)

    def when():
        return None if draw.random() < 0.05 else datetime(2024, 3, 1) + timedelta(minutes=draw.randrange(10 * 24 * 60))

    checks = [
        (str(i), "s", "c", draw.choice(["rows", "nulls", None]), draw.choice(["passed", "failed", "warning", None]), "m", None, when(),
         draw.choice([None, draw.random()]), 0, "low")
        for i in range(300)
    ]
    found = [
        (str(i), "1", draw.choice(["t", "u", None]), "v", draw.choice(["large", "none"]), "d", draw.choice(["low", "high", "critical", None]), when(), None, "ignored")
        for i in range(200)
    ]
    return spark.createDataFrame(checks, CHECKS), spark.createDataFrame(found, ANOMALIES)


@pytest.fixture
def folder(spark, history, tmp_path):
    out = str(tmp_path / "rollups")
    for kind, rows in zip(("checks", "anomalies"), history):
        for run in range(4):
            U.update_rollup(rows.where(F.col("id").cast("int") % 4 == run), kind, f"r{run}", out)
    return out


@pytest.mark.parametrize("as_of", [AS_OF, AS_OF + timedelta(hours=7, minutes=30)])
def test_reports_equal_those_of_the_history(spark, history, folder, rows, as_of):
    checks, found = history
    a, b = (U.window(spark, folder, k, as_of, 7, h) for k, h in zip(("checks", "anomalies"), history))
    assert rows(U.quality_report(a, b, 7)) == rows(R.quality_report(checks, found, as_of, 7))
    assert rows(U.performance_report(a, 7)) == rows(R.performance_report(checks, as_of, 7))
    assert rows(U.group_report(a, b)) == rows(R.group_report(checks, found, as_of, 7))
    whole = [U.rolled(spark, folder, k) for k in ("checks", "anomalies")]
    assert rows(U.system_health(*whole)) == rows(R.system_health(checks, found))
    assert rows(U.quality_trend(whole[0])) == rows(R.quality_trend(checks))


def test_a_run_replaces_its_days_and_no_other(spark, history, folder, rows):
    checks = history[0]
    other = checks.where("id % 4 <> 1")
    late = checks.where("id % 4 = 1 AND timestamp < '2024-03-03'")  # fewer days than before
    for _ in range(2):
        U.update_rollup(late, "checks", "r1", folder)
    want = other.unionByName(late)
    assert rows(U.quality_trend(U.rolled(spark, folder, "checks"))) == rows(R.quality_trend(want))
    U.update_rollup(checks.limit(0), "checks", "r1", folder)
    assert rows(U.quality_trend(U.rolled(spark, folder, "checks"))) == rows(R.quality_trend(other))


def test_a_window_reads_its_days_alone(spark, folder, plan):
    window = U.window(spark, folder, "checks", AS_OF, 2)
    assert "PartitionFilters: [isnotnull(day" in plan(window)
    days = {f.split("day=")[1][:10] for f in (r[0] for r in window.select(F.input_file_name()).distinct().collect())}
    assert days == {"2024-03-08", "2024-03-09", "2024-03-10"} & days and "2024-03-08" in days
    with pytest.raises(ValueError):
        U.window(spark, folder, "checks", AS_OF + timedelta(hours=1), 2)


def test_no_runs(spark, tmp_path, rows):
    none = [U.rolled(spark, str(tmp_path), k) for k in ("checks", "anomalies")]
    assert rows(U.system_health(*none)) == [(100.0, 0, 0, 0, 0, 0, "healthy")]
    assert rows(U.performance_report(none[0], 7)) == [(7, 0.0, 0.0, 0.0, 0, "stable")]
