"""Histograms, series, correlation and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbspark.operators import anomaly as A
from plumbspark.operators import trends as T
from registry.anomalies import _bin_sql
from registry.common import query, rounded, table


@query(
    "histogram",
    f"""WITH span AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
    counts AS (SELECT {_bin_sql('value', 'lo', 'hi', 30)} AS bin, COUNT(*) AS n FROM events, span GROUP BY 1)
    SELECT CAST(r.bin AS INTEGER) AS bin, ROUND(lo + (hi - lo) / 30 * r.bin, 6) AS bin_start,
           ROUND(lo + (hi - lo) / 30 * (r.bin + 1), 6) AS bin_end, COALESCE(n, 0) AS count
    FROM range(30) r(bin) LEFT JOIN counts ON r.bin = counts.bin, span""",
)
def histogram(spark, folder):
    return rounded(T.histogram(table(spark, folder, "events"), "value"))


@query(
    "histogram_by_flag",
    f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, MIN(value) AS lo, MAX(value) AS hi FROM events)
    SELECT {_bin_sql('value', 'lo', 'hi', 30)} AS bin,
           CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'Anomaly' ELSE 'Normal' END AS label,
           COUNT(*) AS count FROM events, q GROUP BY 1, 2""",
)
def histogram_by_flag(spark, folder):
    return T.histogram_by_flag(A.flag_anomalies(table(spark, folder, "events"), "value", "iqr"))


@query(
    "daily_series",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1),
    days AS (SELECT CAST(unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
    SELECT strftime(days.day, '%Y-%m-%d') AS day, COALESCE(n, 0) AS count FROM days LEFT JOIN d ON days.day = d.day""",
)
def daily_series(spark, folder):
    return T.daily_series(table(spark, folder, "orders"), "o_orderdate").withColumn("day", F.col("day").cast("string"))


@query("correlation", "SELECT ROUND(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem")
def correlation(spark, folder):
    return rounded(T.correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "linear_trend",
    """SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       ROUND(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem""",
)
def linear_trend(spark, folder):
    return rounded(T.linear_trend(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


_PATTERN = """WITH z AS (SELECT AVG(value) AS mean, stddev_samp(value) AS std FROM events),
    p AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS total, COUNT(*) FILTER (WHERE ABS((value - mean) / std) > 3) AS anomalies
          FROM events, z GROUP BY 1)"""


@query(
    "anomaly_pattern_daily",
    f"""{_PATTERN} SELECT strftime(day, '%Y-%m-%d') AS day, total, anomalies, CAST(anomalies > 0 AS INTEGER) AS has_anomaly,
        ROUND(100.0 * anomalies / total, 1) AS anomaly_rate FROM p""",
)
def anomaly_pattern_daily(spark, folder):
    flagged = A.flag_anomalies(table(spark, folder, "events"), "value", "zscore")
    return T.daily_anomaly_pattern(flagged, "ts").withColumn("day", F.col("day").cast("string"))


@query(
    "anomaly_pattern_rate",
    f"""{_PATTERN} SELECT COUNT(*) AS days, COUNT(*) FILTER (WHERE anomalies > 0) AS anomalous_days,
        ROUND(100.0 * COUNT(*) FILTER (WHERE anomalies > 0) / COUNT(*), 1) AS rate FROM p""",
)
def anomaly_pattern_rate(spark, folder):
    flagged = A.flag_anomalies(table(spark, folder, "events"), "value", "zscore")
    return T.anomalous_day_rate(T.daily_anomaly_pattern(flagged, "ts"))
