"""Histograms, daily series, correlation and trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.buckets import equal_width_bin
from plumbspark.functions.columns import clean_double, percent, quoted
from plumbspark.functions.groups import attach_one

BINS = 30


def _binned(values: DataFrame, bins: int) -> DataFrame:
    """Rows of ``values`` (column ``v`` and others) with ``lo``, ``hi`` and their ``bin``."""
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    present = attach_one(values.filter("v IS NOT NULL"), span, ["lo", "hi"])
    return present.withColumn("bin", equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``bins`` equal-width bins with edges and counts; empty bins count 0."""
    values = df.select(clean_double(df, column).alias("v"))
    counts = _binned(values, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return attach_one(every.join(counts, "bin", "left"), span, ["lo", "hi"]).select(
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def histogram_by_flag(flagged: DataFrame, bins: int = BINS) -> DataFrame:
    """Bin counts of flagged rows (see ``flag_anomalies``) split into normal and anomaly."""
    label = F.when(F.col("is_anomaly"), "Anomaly").otherwise("Normal")
    values = flagged.select(F.col("__value").alias("v"), label.alias("label"))
    return _binned(values, bins).groupBy("bin", "label").agg(F.count(F.lit(1)).alias("count"))


def _dense_days(daily: DataFrame) -> DataFrame:
    """Every day between the first and the last one present."""
    return daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")
    )


def daily_series(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day over a gapless day range."""
    daily = (
        df.groupBy(F.to_date(quoted(ts)).alias("day"))
        .agg(F.count(F.lit(1)).alias("count"))
        .filter("day IS NOT NULL")
    )
    return _dense_days(daily).join(daily, "day", "left").select(
        "day", F.coalesce("count", F.lit(0).cast("bigint")).alias("count")
    )


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(clean_double(df, x), clean_double(df, y)).alias("correlation"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y = slope * x + intercept."""
    a, b = clean_double(df, y), clean_double(df, x)
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"))


def daily_anomaly_pattern(flagged: DataFrame, ts: str) -> DataFrame:
    """Per day: rows, anomalies, a 0/1 mark and the share of anomalies in percent."""
    return (
        flagged.groupBy(F.to_date(quoted(ts)).alias("day"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"))
        .select(
            "day",
            "total",
            "anomalies",
            F.when(F.col("anomalies") > 0, 1).otherwise(0).alias("has_anomaly"),
            F.round(percent(F.col("anomalies"), F.col("total")), 1).alias("anomaly_rate"),
        )
    )


def anomalous_day_rate(pattern: DataFrame) -> DataFrame:
    """Days with an anomaly, and their share of all days in percent."""
    return pattern.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("has_anomaly") == 1).alias("anomalous_days"),
        F.round(percent(F.count_if(F.col("has_anomaly") == 1), F.count(F.lit(1))), 1).alias("rate"),
    )
