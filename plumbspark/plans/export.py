"""Report export: stacked CSV rows and one JSON document per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.columns import naive
from plumbspark.plans.reports import since, system_health

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_rows(checks: DataFrame, anomalies: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Checks and anomalies of a period in one table; columns a kind lacks are NULL."""
    a = since(checks, "timestamp", as_of, days).select(
        F.lit("check").alias("type"),
        "id",
        "check_type",
        "status",
        "message",
        F.coalesce(F.get_json_object("details", "$.table_name"), F.lit("")).alias("table_name"),
        "anomalies_count",
        "severity",
        "execution_time",
        F.date_format(naive(F.col("timestamp")), _ISO).alias("timestamp"),
    )
    b = since(anomalies, "detected_at", as_of, days).select(
        F.lit("anomaly").alias("type"),
        "id",
        "anomaly_type",
        "table_name",
        "column_name",
        "description",
        "severity",
        "resolution_status",
        F.date_format(naive(F.col("detected_at")), _ISO).alias("detected_at"),
        "data_sample",
    )
    return a.unionByName(b, allowMissingColumns=True)


def write_csv(checks: DataFrame, anomalies: DataFrame, as_of, folder: str, days: int = 7) -> None:
    export_rows(checks, anomalies, as_of, days).write.mode("overwrite").option("header", True).csv(folder)


def json_records(checks: DataFrame, anomalies: DataFrame, as_of, days: int = 7) -> DataFrame:
    """One JSON text per record, tagged with its section of the report."""

    def section(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("record"))

    spark = checks.sparkSession
    meta = spark.range(1).select(
        F.lit(as_of.isoformat()).alias("generated_at"), F.lit(days).alias("period_days"), F.lit("1.0").alias("version")
    )
    return (
        section("report_metadata", meta)
        .unionByName(section("system_health", system_health(checks, anomalies)))
        .unionByName(section("checks", since(checks, "timestamp", as_of, days)))
        .unionByName(section("anomalies", since(anomalies, "detected_at", as_of, days)))
    )


def write_json(checks: DataFrame, anomalies: DataFrame, as_of, folder: str, days: int = 7) -> None:
    """A folder per section, JSON lines inside: large periods are written in parallel."""
    json_records(checks, anomalies, as_of, days).write.mode("overwrite").partitionBy("section").text(folder)
