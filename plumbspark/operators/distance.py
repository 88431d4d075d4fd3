"""Exact two-sample distances: Kolmogorov-Smirnov and Wasserstein, by prefix sums over ranges of values."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.functions.columns import clean_double, quoted
from plumbspark.functions.shared_dir import shared_folder


def two_sample_distances(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_baseline, n_current, ks, ks_at, wasserstein) for each numeric column.

    ``ks`` is the largest difference of the two distribution functions, ``ks_at`` the smallest value where it is
    reached, ``wasserstein`` the area between them. NULL and NaN are no values; infinite ones make the area infinite or
    undefined. Distances are NULL if a side has no value.

    Values are counted, dealt out by range and summed up inside each range; one row a range and column gives every
    range what came before it and the first value behind it. No task holds more than its range.
    """
    spark = baseline.sparkSession

    def counted(df: DataFrame, side: str):
        doubles = df.select(*[clean_double(df, c).alias(c) for c in columns])
        pairs = doubles.unpivot([], [F.col(quoted(c)) for c in columns], "column_name", "value").where("value IS NOT NULL")
        return pairs.select("column_name", (F.col("value") + 0.0).alias("value"), *[F.lit(int(side == s)).alias(s) for s in ("a", "b")])

    both = counted(baseline, "a").unionByName(counted(current, "b"))
    counts = both.groupBy("column_name", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    path = shared_folder(spark, "distances")
    ranged = counts.repartitionByRange("column_name", "value")
    ranged.select("*", F.spark_partition_id().alias("range")).write.parquet(path)
    stored = spark.read.parquet(path)
    sums = stored.groupBy("column_name", "range").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("value").alias("first")).collect()

    starts = []  # ranges and columns: bounded by the number of shuffle partitions
    for column, own in groupby(sorted(sums, key=lambda r: (r.column_name, r.range)), key=lambda r: r.column_name):
        own, a, b = list(own), 0, 0
        total = sum(r.a for r in own), sum(r.b for r in own)
        for r, after in zip(own, [*own[1:], None]):
            starts.append((column, r.range, a, b, *total, after.first if after else None))
            a, b = a + r.a, b + r.b
    schema = "column_name string, range int, a0 bigint, b0 bigint, n_a bigint, n_b bigint, behind double"
    inside = Window.partitionBy("column_name", "range").orderBy("value")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = stored.join(F.broadcast(spark.createDataFrame(starts, schema)), ["column_name", "range"])
    gap = F.abs(
        F.try_divide(F.col("a0") + F.sum("a").over(so_far), F.col("n_a")) - F.try_divide(F.col("b0") + F.sum("b").over(so_far), F.col("n_b"))
    )
    steps = joined.select("column_name", "value", "n_a", "n_b", gap.alias("gap"), F.coalesce(F.lead("value").over(inside), "behind").alias("next"))
    area = F.when(F.col("gap") > 0, F.col("gap") * (F.col("next") - F.col("value"))).otherwise(F.when(F.col("gap").isNotNull(), 0.0))
    found = steps.groupBy("column_name").agg(
        F.first("n_a").alias("n_baseline"), F.first("n_b").alias("n_current"), F.max("gap").alias("ks"),
        F.min_by("value", F.struct(-F.col("gap"), "value")).alias("at"), F.sum(area).alias("wasserstein"),
    )
    named = spark.createDataFrame([(c,) for c in columns], "column_name string")
    zero = F.lit(0).cast("bigint")
    return named.join(F.broadcast(found), "column_name", "left").select(
        "column_name", F.coalesce("n_baseline", zero).alias("n_baseline"), F.coalesce("n_current", zero).alias("n_current"), "ks",
        F.when(F.col("ks").isNotNull(), F.col("at")).alias("ks_at"), "wasserstein",
    )
