"""Named partitions: layout, statistics, retention and bounds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.functions.columns import moment, naive, quoted


def partition_counts(df: DataFrame, label: Column) -> DataFrame:
    """Rows per partition; rows no partition takes are under NULL."""
    return df.groupBy(label.alias("partition_name")).agg(F.count(F.lit(1)).alias("row_count"))


def partition_stats(df: DataFrame, label: Column, ts: str) -> DataFrame:
    c = F.col(quoted(ts))
    return df.groupBy(label.alias("partition_name")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(c).alias("min_ts"), F.max(c).alias("max_ts")
    )


def partition_sizes(spark: SparkSession, path: str, partition_column: str) -> DataFrame:
    """Rows, files and bytes per stored partition, from file metadata columns."""
    per_file = (
        spark.read.parquet(path)
        .groupBy(quoted(partition_column), "_metadata.file_path")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes"))
    )
    return per_file.groupBy(quoted(partition_column)).agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def write_partitioned(df: DataFrame, path: str, name: str, label: Column) -> None:
    """Lay a table out by a derived partition column.

    Rebalancing on the column groups a partition's rows into few files; a very
    large partition is split over several tasks instead of landing in one.
    """
    df.withColumn(name, label).hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def within(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows of a half-open range ``[low, high)``; prunes partitions or parquet row groups."""
    c = F.col(quoted(column))
    return df.filter((c >= low) & (c < high))


def prune_older(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Drop rows older than ``days`` before ``as_of``; rows without a time stay."""
    c = F.col(quoted(ts))
    return df.filter((c >= moment(as_of - timedelta(days=days)).cast(df.schema[ts].dataType)) | c.isNull())


def split_by_bounds(df: DataFrame, ts: str, low, high) -> tuple[DataFrame, DataFrame]:
    """Rows a partition ``[low, high)`` accepts, and the rejected rest (NULL included)."""
    c = naive(F.col(quoted(ts)))
    inside = F.coalesce((c >= moment(low)) & (c < moment(high)), F.lit(False))
    return df.filter(inside), df.filter(~inside)
