"""Sample-corrected higher moments on top of Spark's population versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """G1 = g1 * sqrt(n(n-1)) / (n-2); NULL below 3 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected)


def sample_kurtosis(c: Column) -> Column:
    """G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); NULL below 4 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected)
