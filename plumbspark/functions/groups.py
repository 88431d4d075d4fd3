"""Attach one aggregate row to all rows, or one row per group to the rows of that group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.columns import quoted
from plumbspark.functions.sizes import is_small

#: Bytes that a group's aggregates may add to its key, with room to spare.
_AGGREGATES = 512


def attach_one(df: DataFrame, one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """All rows with the named columns of a one-row aggregate, through one scalar subquery."""
    packed = one_row.select(F.struct(*names)).scalar()
    return df.select("*", packed.alias("__one")).select(
        *[F.col(quoted(c)) for c in df.columns], *[F.col("__one")[n].alias(n) for n in names]
    )


def few_groups(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether one row for each group, measured in bytes with its key, is small enough to broadcast.

    Reads the group columns only. The answer changes the plan of a join, never its rows."""
    return is_small(df.select(*by).distinct(), row_overhead=_AGGREGATES)


def same_group(by: Sequence[str], left: str, right: str) -> Column:
    """NULL is a group of its own."""
    out = F.lit(True)
    for b in by:
        out = out & F.col(f"{left}.{quoted(b)}").eqNullSafe(F.col(f"{right}.{quoted(b)}"))
    return out


def attach(
    df: DataFrame, per_group: DataFrame, by: Sequence[str], names: Sequence[str], few: bool | None = None
) -> DataFrame:
    """Rows of ``df`` with the named columns of their group.

    ``few`` is an earlier answer of ``few_groups`` for the same rows. Few groups are broadcast, so the rows
    stay where they are. Many groups take a join on the group, whose hot partitions Spark splits at run time.
    """
    side = F.broadcast(per_group) if (few_groups(df, by) if few is None else few) else per_group
    return df.alias("d").join(side.alias("g"), same_group(by, "d", "g"), "left").select(
        "d.*", *[F.col(f"g.{quoted(n)}") for n in names]
    )
