"""Query shapes a monitoring client sends: filters, group statistics, joins, pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.columns import quoted


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page under a full order."""
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out.limit(limit)


def search_page(
    df: DataFrame, column: str, text: str, sort_by: str, tie: str, descending: bool = False, number: int = 1, size: int = 100
) -> DataFrame:
    """Page ``number`` (from 1) of the rows whose column contains a text."""
    c = F.col(quoted(sort_by))
    order = [c.desc() if descending else c.asc(), F.col(quoted(tie)).asc()]
    return page(df.filter(F.col(quoted(column)).contains(text)), order, (number - 1) * size, size)


def group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    c = F.col(quoted(value))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(c).alias("avg_value"), F.min(c).alias("min_value"), F.max(c).alias("max_value")
    )


def group_concat(df: DataFrame, by: Sequence[str], value: str, separator: str = ",") -> DataFrame:
    """Rows and joined values per group, values in order.

    Equal values are counted first, so a repeated value crosses the shuffle once.
    """
    counted = df.groupBy(*by, F.col(quoted(value)).cast("string").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    text = F.when(
        F.col("__v").isNotNull(), F.array_join(F.array_repeat(F.col("__v"), F.col("__n").cast("int")), separator)
    )
    literal = separator.replace("\\", "\\\\").replace("'", "\\'")
    joined = F.expr(f"listagg(__t, '{literal}') WITHIN GROUP (ORDER BY __v)")
    return (
        counted.withColumn("__t", text)
        .groupBy(*by)
        .agg(F.sum("__n").alias("count"), joined.alias("joined"))
    )


def activity(df: DataFrame, by: str, kind: str, ts: str) -> DataFrame:
    """Rows, distinct kinds, first and last time per key."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct(kind).alias("event_types"),
        F.min(ts).alias("first_event"),
        F.max(ts).alias("last_event"),
    )


def child_counts(parent: DataFrame, child: DataFrame, key: str, child_key: str, counted: str) -> DataFrame:
    """Every parent row with its number of child rows (0 kept).

    Children are counted before the join: at most one row per key crosses it.
    """
    n = child.groupBy(F.col(quoted(child_key)).alias("__k")).agg(F.count(quoted(counted)).alias("child_count"))
    joined = parent.join(n, parent[key] == n["__k"], "left")
    return joined.select(*[parent[c] for c in parent.columns], F.coalesce("child_count", F.lit(0).cast("bigint")).alias("child_count"))


def exists(df: DataFrame, condition: Column | str) -> DataFrame:
    """One row telling whether any row matches; stops at the first hit per task."""
    hit = df.filter(condition).select(F.lit(1).alias("x")).limit(1)
    return hit.agg((F.count("x") > 0).alias("found"))


def matching(df: DataFrame, other: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """EXISTS: rows with at least one match (pairs of left and right columns)."""
    keys = other.select(*[F.col(quoted(r)).alias(f"__r{i}") for i, r in enumerate(on.values())])
    same = F.lit(True)
    for i, left in enumerate(on):
        same = same & (F.col(quoted(left)) == F.col(f"__r{i}"))
    return df.join(keys, same, "left_semi")
