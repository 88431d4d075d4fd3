"""Shared pieces: the registry, table access and derived inputs in both languages.

The derived inputs map every row of a given table; none of them drops rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
WEEK_SQL = "TIMESTAMP '2024-01-24 00:00:00'"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle SQL if there is one."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load(spark, folder, name)


def time_text(c: Column) -> Column:
    """Timestamps leave the queries as text, equal in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def time_text_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: engines sum in different orders."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- events with missing values: NULLs and NaNs in value, NULL in event_type -------------

DIRTY_EVENTS_SQL = """
SELECT event_id, ts,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN NULL ELSE value END AS value, props
FROM events
"""


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    key = F.col("event_id")
    return e.select(
        "event_id",
        "ts",
        F.when(key % 13 != 0, F.col("user_id")).alias("user_id"),
        F.when(key % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 17 == 0, F.lit(None))
        .when(key % 19 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
        "props",
    )


# --- check and anomaly history: one row per event ---------------------------------------

CHECKS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS id,
       CAST(user_id % 25 AS VARCHAR) AS stave_id,
       CAST(user_id AS VARCHAR) AS clef_id,
       event_type AS check_type,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'warning' ELSE 'passed' END AS status,
       event_type || ' check on source ' || CAST(user_id % 25 AS VARCHAR) AS message,
       '{"table_name":"t' || CAST(user_id % 7 AS VARCHAR) || '"}' AS details,
       ts AS "timestamp",
       value / 1000 AS execution_time,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS anomalies_count,
       CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS severity
FROM events
"""

ANOMALIES_SQL = """
SELECT 'a' || CAST(event_id AS VARCHAR) AS id,
       CAST(event_id AS VARCHAR) AS check_id,
       't' || CAST(user_id % 7 AS VARCHAR) AS table_name,
       'value' AS column_name,
       event_type AS anomaly_type,
       'value of ' || event_type AS description,
       CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END AS severity,
       ts AS detected_at,
       props AS data_sample,
       CASE event_id % 3 WHEN 0 THEN 'investigating' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS resolution_status
FROM events
"""

STAVES_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_nationkey % 4 <> 0 AS is_active FROM nation"
CLEFS_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size > 10 AS is_active FROM part"

HISTORY_SQL = (
    f"WITH checks AS ({CHECKS_SQL}), anomalies AS ({ANOMALIES_SQL}), "
    f"staves AS ({STAVES_SQL}), clefs AS ({CLEFS_SQL})\n"
)


def checks(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    source = (F.col("user_id") % 25).cast("string")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        source.alias("stave_id"),
        F.col("user_id").cast("string").alias("clef_id"),
        kind.alias("check_type"),
        F.when(kind == "error", "failed").when(kind == "signup", "warning").otherwise("passed").alias("status"),
        F.concat(kind, F.lit(" check on source "), source).alias("message"),
        F.concat(F.lit('{"table_name":"t'), (F.col("user_id") % 7).cast("string"), F.lit('"}')).alias("details"),
        F.col("ts").alias("timestamp"),
        (F.col("value") / 1000).alias("execution_time"),
        F.when(kind == "error", 1).otherwise(0).alias("anomalies_count"),
        F.when(kind == "error", "high").otherwise("medium").alias("severity"),
    )


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("value")
    key = F.col("event_id") % 3
    return table(spark, folder, "events").select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").cast("string").alias("check_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("table_name"),
        F.lit("value").alias("column_name"),
        F.col("event_type").alias("anomaly_type"),
        F.concat(F.lit("value of "), F.col("event_type")).alias("description"),
        F.when(v < 20, "low").when(v < 60, "medium").when(v < 150, "high").otherwise("critical").alias("severity"),
        F.col("ts").alias("detected_at"),
        F.col("props").alias("data_sample"),
        F.when(key == 0, "investigating").when(key == 1, "resolved").otherwise("ignored").alias("resolution_status"),
    )


def staves(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 4 != 0).alias("is_active"),
    )


def clefs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        (F.col("p_size") > 10).alias("is_active"),
    )


# --- keyed writes: target = all orders; batch = all orders under other keys ---------------
# Doubled keys: half of the batch meets a target row, half is new. Every ninth key is NULL.

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

TARGET_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
BATCH_SQL = """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * 2 END AS o_orderkey,
       o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
FROM orders
"""
# Halved keys: every key of the batch occurs about twice; position = row number of the batch.
TWICE_SQL = """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey // 2 END AS o_orderkey,
       o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority,
       o_orderkey AS position
FROM orders
"""
WRITE_SQL = f"WITH target AS ({TARGET_SQL}), batch AS ({BATCH_SQL}), twice AS ({TWICE_SQL})\n"


def target(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(*ORDER_COLUMNS)


def _batch(spark: SparkSession, folder: str, key: Column) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 9 != 0, key).alias("o_orderkey"),
        "o_custkey",
        F.lit("X").alias("o_orderstatus"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
        F.col("o_orderkey").alias("position"),
    )


def batch(spark: SparkSession, folder: str) -> DataFrame:
    return _batch(spark, folder, F.col("o_orderkey") * 2).drop("position")


def twice(spark: SparkSession, folder: str) -> DataFrame:
    return _batch(spark, folder, F.floor(F.col("o_orderkey") / 2))


def rounded_price(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.round("o_totalprice", 2)).withColumn("o_orderdate", time_text(F.col("o_orderdate")))
