"""Schemas of the check and anomaly history tables and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAVES = (
    "id STRING, name STRING, description STRING, data_source_type STRING, "
    "connection_config STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CLEFS = (
    "id STRING, stave_id STRING, name STRING, description STRING, check_type STRING, "
    "config STRING, schedule STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CHECKS = (
    "id STRING, stave_id STRING, clef_id STRING, check_type STRING, status STRING, message STRING, "
    "details STRING, timestamp TIMESTAMP, execution_time DOUBLE, anomalies_count INT, severity STRING"
)
ANOMALIES = (
    "id STRING, check_id STRING, table_name STRING, column_name STRING, anomaly_type STRING, "
    "description STRING, severity STRING, detected_at TIMESTAMP, data_sample STRING, "
    "resolution_status STRING"
)
SCHEMAS = {"staves": STAVES, "clefs": CLEFS, "checks": CHECKS, "anomalies": ANOMALIES}


def read_history(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A history table kept as parquet below one folder."""
    if table not in SCHEMAS:
        raise ValueError(f"unknown history table: {table}")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def empty_history(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
