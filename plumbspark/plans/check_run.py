"""A check run over several tables: results, table status, run summary, history rows."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.functions.columns import moment
from plumbspark.operators.checks import STATUS_RANK, TableCheck, error_rows, table_checks

Source = DataFrame | Callable[[], DataFrame]


def _open(source: Source) -> DataFrame:
    return source if isinstance(source, DataFrame) else source()


def _single_checks(check: TableCheck) -> list[tuple[str, TableCheck]]:
    """The same configuration cut into one piece per check."""
    bare = TableCheck(check.table_name)
    parts = []
    if check.row_count_min is not None:
        parts.append(("row_count", dataclasses.replace(bare, row_count_min=check.row_count_min)))
    if check.row_count_range is not None:
        parts.append(("row_count_range", dataclasses.replace(bare, row_count_range=check.row_count_range)))
    if check.freshness:
        parts.append(("freshness", dataclasses.replace(bare, freshness=check.freshness)))
    if check.anomaly_rules:
        parts.append(("anomalies", dataclasses.replace(bare, anomaly_rules=check.anomaly_rules)))
    for limit in check.null_limits:
        parts.append((f"nulls:{limit.column}", dataclasses.replace(bare, null_limits=(limit,))))
    if check.expected_columns is not None:
        parts.append(("schema", dataclasses.replace(bare, expected_columns=check.expected_columns)))
    return parts


def check_results(
    spark: SparkSession, tables: Mapping[str, Source], checks: Sequence[TableCheck], as_of
) -> DataFrame:
    """All check rows as one lazy frame; one scan per table.

    A table that cannot be opened or a check that cannot be planned gives an
    ``error`` row and leaves the other checks alone.
    """
    parts = []
    for check in checks:
        try:
            df = _open(tables[check.table_name])
        except Exception as e:
            parts += [error_rows(spark, check.table_name, name, str(e)) for name, _ in _single_checks(check)]
            continue
        try:
            parts.append(table_checks(df, check, as_of))
        except Exception:
            for name, single in _single_checks(check):
                try:
                    parts.append(table_checks(df, single, as_of))
                except Exception as e:
                    parts.append(error_rows(spark, check.table_name, name, str(e)))
    return reduce(DataFrame.unionByName, parts)


def _run_one(spark: SparkSession, tables: Mapping[str, Source], check: TableCheck, as_of) -> list:
    """One table's rows; if they fail together, check by check."""
    try:
        return check_results(spark, tables, [check], as_of).collect()
    except Exception:
        rows = []
        for name, single in _single_checks(check):
            try:
                rows += check_results(spark, tables, [single], as_of).collect()
            except Exception as e:
                rows += error_rows(spark, check.table_name, name, str(e)).collect()
        return rows


def run_checks(
    spark: SparkSession, tables: Mapping[str, Source], checks: Sequence[TableCheck], as_of
) -> tuple[DataFrame, dict]:
    """Execute a run now, all tables in one job.

    If that job fails, tables and then single checks run on their own, so a failure
    stays inside its check. Returns the check rows (a handful per table) and timing.
    """
    started = time.time()
    try:
        rows = check_results(spark, tables, checks, as_of).collect()
    except Exception:
        rows = []
        for check in checks:
            rows += _run_one(spark, tables, check, as_of)
    ended = time.time()
    schema = "table_name STRING, check_name STRING, status STRING, metric DOUBLE, threshold DOUBLE, message STRING"
    timing = {"started_at": started, "completed_at": ended, "duration_seconds": ended - started}
    return spark.createDataFrame(rows, schema), timing


def _rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, F.lit(rank)).otherwise(out)
    return out


def _status(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in STATUS_RANK.items():
        out = F.when(rank == value, F.lit(name)).otherwise(out)
    return out


def table_status(results: DataFrame) -> DataFrame:
    """Worst status per table: critical, warning, error, pass."""
    return results.groupBy("table_name").agg(
        _status(F.max(_rank(F.col("status")))).alias("status"),
        F.count(F.lit(1)).alias("checks"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Tables per status and the worst status overall."""
    per_table = table_status(results)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warning", "critical", "error")]
    return per_table.agg(
        F.coalesce(_status(F.max(_rank(F.col("status")))), F.lit("pass")).alias("overall_status"),
        F.count(F.lit(1)).alias("tables_checked"),
        *counts,
    )


def history_checks(results: DataFrame, run_id: str, as_of, stave_id: str | None = None) -> DataFrame:
    """Check rows in the shape of the ``checks`` history table (status words passed/failed)."""
    status = F.when(F.col("status") == "pass", "passed").when(F.col("status") == "warning", "warning").otherwise("failed")
    severity = (
        F.when(F.col("status") == "critical", "critical").when(F.col("status") == "error", "high").otherwise("medium")
    )
    return results.select(
        F.concat_ws(":", F.lit(run_id), "table_name", "check_name").alias("id"),
        F.lit(stave_id).cast("string").alias("stave_id"),
        F.lit(None).cast("string").alias("clef_id"),
        F.col("check_name").alias("check_type"),
        status.alias("status"),
        "message",
        F.to_json(F.struct("table_name", "metric", "threshold")).alias("details"),
        moment(as_of).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("double").alias("execution_time"),
        F.when(F.col("check_name") == "anomalies", F.col("metric").cast("int")).otherwise(0).alias("anomalies_count"),
        severity.alias("severity"),
    )


def history_anomalies(samples: DataFrame, run_id: str, as_of, severity: str = "medium") -> DataFrame:
    """Rule samples in the shape of the ``anomalies`` history table."""
    return samples.select(
        F.concat_ws(":", F.lit(run_id), "table_name", "anomaly_type", F.col("sample_no").cast("string")).alias("id"),
        F.concat_ws(":", F.lit(run_id), "table_name", F.lit("anomalies")).alias("check_id"),
        "table_name",
        F.lit(None).cast("string").alias("column_name"),
        "anomaly_type",
        F.concat(F.lit("row matches rule "), F.col("anomaly_type")).alias("description"),
        F.lit(severity).alias("severity"),
        moment(as_of).cast("timestamp").alias("detected_at"),
        "data_sample",
        F.lit("investigating").alias("resolution_status"),
    )


def append_run(rows: DataFrame, folder: str, run_id: str) -> None:
    """Store the rows of one run; writing the same run again replaces it."""
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(folder)
    )
