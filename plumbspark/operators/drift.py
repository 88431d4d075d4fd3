"""Change between two periods of a table: profile deltas and population stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.functions.buckets import equal_width_bin
from plumbspark.functions.columns import clean_double
from plumbspark.functions.groups import attach_one
from plumbspark.operators.profile import base_profile, numeric_profile

SMOOTHING = 1e-4

_COMPARED = (
    "null_percentage",
    "unique_percentage",
    "mean_value",
    "std_value",
    "q25_value",
    "median_value",
    "q75_value",
)


def drift_profile(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str], exact: bool = True
) -> DataFrame:
    """Per numeric column: current minus baseline of every compared statistic."""

    def stats(df: DataFrame) -> DataFrame:
        left = base_profile(df, columns, exact).select("column_name", "total_count", "null_percentage", "unique_percentage")
        return left.join(numeric_profile(df, columns, exact), "column_name")

    a, b = stats(baseline).alias("a"), stats(current).alias("b")
    return a.join(b, F.col("a.column_name") == F.col("b.column_name")).select(
        F.col("a.column_name").alias("column_name"),
        F.col("a.total_count").alias("baseline_count"),
        F.col("b.total_count").alias("current_count"),
        *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_delta") for c in _COMPARED],
    )


def psi_bins(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Per bin of the baseline's range: both shares and the bin's part of the index."""
    old = baseline.select(clean_double(baseline, column).alias("v"), F.lit(0).alias("side"))
    new = current.select(clean_double(current, column).alias("v"), F.lit(1).alias("side"))
    span = old.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counts = (
        attach_one(old.unionByName(new).filter("v IS NOT NULL"), span, ["lo", "hi"])
        .select("side", equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count_if(F.col("side") == 0).alias("n_old"), F.count_if(F.col("side") == 1).alias("n_new"))
    )
    every = baseline.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    all_bins = Window.partitionBy(F.lit(0))  # one row per bin
    dense = every.join(counts, "bin", "left").select(
        "bin",
        F.coalesce("n_old", F.lit(0)).alias("n_old"),
        F.coalesce("n_new", F.lit(0)).alias("n_new"),
    )

    def share(c: str):
        part = F.try_divide(F.col(c), F.sum(c).over(all_bins))
        return F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(SMOOTHING))

    filled = dense.select("bin", share("n_old").alias("p"), share("n_new").alias("q"))
    return filled.withColumn("psi", (F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q")))


def population_stability(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the population stability index of a column between two periods."""
    return psi_bins(baseline, current, column, bins).agg(
        F.lit(column).alias("column_name"), F.sum("psi").alias("psi")
    )
