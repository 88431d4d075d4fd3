"""Equal-width bins and named partitions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number 0..bins-1; values outside fall into the edge bins, zero width into bin 0."""
    position = F.floor(F.try_divide((value - low) * bins, high - low))
    inside = F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0))
    return (
        F.when(value.isNull(), F.lit(None)).when(high <= low, F.lit(0)).otherwise(inside).cast("int")
    )


def daily_partition(ts: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMdd"))


def monthly_partition(ts: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMM"))


def range_partition(value: Column, bounds: Sequence[tuple[str, object, object]]) -> Column:
    """Name of the ``[from, to)`` range that holds the value; NULL when none does."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(list(bounds)):
        out = F.when((value >= F.lit(low)) & (value < F.lit(high)), F.lit(name)).otherwise(out)
    return out


def list_partition(value: Column, lists: Mapping[str, Sequence]) -> Column:
    """Name of the partition whose value list holds the value; NULL when none does."""
    out = F.lit(None).cast("string")
    for name, values in reversed(list(lists.items())):
        out = F.when(value.isin(list(values)), F.lit(name)).otherwise(out)
    return out


def hash_partition(key: Column, modulus: int) -> Column:
    return F.pmod(key, F.lit(modulus)).cast("int")
