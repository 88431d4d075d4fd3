"""Column and table profiles.

Everything that is an algebraic aggregate runs in one scan of the table.
Distinct counts and value counts are group-bys on (column, value), so their
state is spread over the shuffle instead of sitting in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbspark.functions.columns import (
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    clean,
    columns_of_kind,
    kind_of,
    naive,
    percent,
    quoted,
)
from plumbspark.functions.moments import sample_kurtosis, sample_skewness
from plumbspark.functions.quantiles import approx_quantiles, exact_quantiles
from plumbspark.functions.ranking import top_k
from plumbspark.functions.sizes import row_bytes

HIGH_CARDINALITY_PERCENT = 80.0
HIGH_NULL_PERCENT = 20.0
TOP_VALUES = 10

_LONG_TEXT = 64  # longer values travel through the distinct-count shuffle as a digest


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    return [f for f in df.schema.fields if columns is None or f.name in columns]


def _long(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    """One aggregate row with a struct per column -> one row per column."""
    return one_row.select(F.inline(F.array(*rows)))


def _base_aggregates(fields: list[T.StructField], exact: bool) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(clean(f).isNull()).alias(f"nulls{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(clean(f), 0.02).alias(f"distinct{i}"))
    return aggs


def _base_values(i: int, f: T.StructField, exact: bool) -> list[Column]:
    return [
        F.lit(f.name).alias("column_name"),
        F.lit(f.dataType.simpleString()).alias("data_type"),
        F.lit(kind_of(f.dataType)).alias("kind"),
        F.col("__n").alias("total_count"),
        F.col(f"nulls{i}").alias("null_count"),
        (F.lit(None).cast("bigint") if exact else F.col(f"distinct{i}")).alias("unique_count"),
    ]


def _with_distinct(out: DataFrame, df: DataFrame, fields: list[T.StructField], exact: bool) -> DataFrame:
    if not exact:
        return out
    counted = distinct_counts(df, [f.name for f in fields])
    return (
        out.drop("unique_count")
        .join(counted, "column_name", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))
    )


def _base_columns() -> list[Column]:
    return [
        F.col("column_name"),
        F.col("data_type"),
        F.col("kind"),
        F.col("total_count"),
        F.col("null_count"),
        percent(F.col("null_count"), F.col("total_count")).alias("null_percentage"),
        F.col("unique_count"),
        percent(F.col("unique_count"), F.col("total_count")).alias("unique_percentage"),
    ]


def base_profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Rows, nulls, distinct values per column; both percentages are over all rows."""
    fields = _fields(df, columns)
    one = df.agg(*_base_aggregates(fields, exact))
    out = _long(one, [F.struct(*_base_values(i, f, exact)) for i, f in enumerate(fields)])
    return _with_distinct(out, df, fields, exact).select(*_base_columns())


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _distinct_key(field: T.StructField) -> tuple[str, Column]:
    """Type family a column is counted in, and the value as that type."""
    c, dtype = clean(field), field.dataType
    if isinstance(dtype, _INTEGRAL):
        return "bigint", c.cast("bigint")
    if isinstance(dtype, T.DateType):
        return "bigint", F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "bigint", F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        return "bigint", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double", c.cast("double")  # grouping takes -0.0 and 0.0 as one value
    if isinstance(dtype, T.StringType):
        # a marked digest is longer than any text that stands for itself, so the two never meet
        return "string", F.when(F.length(c) > _LONG_TEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "string", F.when(c.isNotNull(), F.sha2(F.to_json(c), 256))
    return "string", c.cast("string")


_FAMILIES = ("bigint", "double", "string")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column through one scan and a shuffle on (column, value).

    A value lies in the key of its type family, so numbers are grouped as numbers; long texts are
    represented by a digest.
    """
    keys = []
    for f in _fields(df, columns):
        family, key = _distinct_key(f)
        own = [(key if x == family else F.lit(None)).cast(x).alias(f"__{x}") for x in _FAMILIES]
        keys.append(F.struct(F.lit(f.name).alias("column_name"), *own))
    pairs = df.select(F.inline(F.array(*keys)))
    values = [F.col(f"__{x}") for x in _FAMILIES]
    return (
        pairs.filter(reduce(Column.__or__, [v.isNotNull() for v in values]))
        .groupBy("column_name", *values)
        .agg(F.lit(1).alias("__one"))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


def _moments(f: T.StructField) -> list[Column]:
    c = clean(f).cast("double")
    return [
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
        F.avg(c).alias("mean_value"),
        F.stddev_samp(c).alias("std_value"),
        sample_skewness(c).alias("skewness"),
        sample_kurtosis(c).alias("kurtosis"),
    ]


_MOMENTS = ("min_value", "max_value", "mean_value", "std_value", "skewness", "kurtosis")
_NUMERIC_COLUMNS = (
    "min_value", "max_value", "mean_value", "median_value", "std_value", "q25_value", "q75_value", "iqr_value",
    "skewness", "kurtosis",
)


def _quartiles(df: DataFrame, fields: list[T.StructField], exact: bool, rows: int | None) -> DataFrame:
    values = df.select(*[clean(f).cast("double").alias(f.name) for f in fields]).unpivot(
        [], [F.col(quoted(f.name)) for f in fields], "column_name", "value"
    )
    if exact and rows is None:
        rows = df.count()
    pick = exact_quantiles if exact else approx_quantiles
    extra = {"rows": rows * len(fields), "few": True, "largest": rows} if exact else {}  # a group for each column
    names = ["q25_value", "median_value", "q75_value"]
    out = pick(values, F.col("value"), [0.25, 0.5, 0.75], names, by=["column_name"], **extra)
    return out.select("column_name", *names, (F.col("q75_value") - F.col("q25_value")).alias("iqr_value"))


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Moments and quartiles of every numeric column over its non-null values."""
    wanted = columns if columns is not None else columns_of_kind(df, NUMERIC)
    fields = [f for f in _fields(df, wanted) if kind_of(f.dataType) == NUMERIC]
    if not fields:
        raise ValueError("no numeric column to profile")
    aggs = [F.struct(F.lit(f.name).alias("column_name"), *_moments(f)).alias(f"c{i}") for i, f in enumerate(fields)]
    moments = _long(df.agg(*aggs), [F.col(f"c{i}") for i in range(len(fields))])
    quartiles = _quartiles(df, fields, exact, rows)
    return moments.join(quartiles, "column_name", "left").select("column_name", *_NUMERIC_COLUMNS)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, count)`` of text columns, NULLs left out."""
    pairs = df.select(*[F.col(quoted(c)) for c in columns]).unpivot(
        [], [F.col(quoted(c)) for c in columns], "column_name", "value"
    )
    return (
        pairs.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = TOP_VALUES,
    long_text: Sequence[str] = (),
) -> DataFrame:
    """``(column_name, rank, value, count)``: the most frequent values per text column.

    Equal counts go by value. Columns named in ``long_text`` are counted by the
    SHA-256 of the value, equal counts go by that digest, and only the texts of
    the k winners are fetched in a second scan: whole texts never cross the shuffle.
    """
    columns = columns if columns is not None else columns_of_kind(df, CATEGORICAL)
    short = [c for c in columns if c not in long_text]
    parts = []
    if short:
        order = [F.col("count").desc(), F.col("value").asc()]
        parts.append(top_k(value_counts(df, short), ["column_name"], order, k))
    if long_text:
        parts.append(_top_texts(df, [c for c in columns if c in long_text], k))
    return reduce(DataFrame.unionByName, parts)


def _top_texts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    keyed = df.select(*[F.sha2(quoted(c), 256).alias(c) for c in columns])
    order = [F.col("count").desc(), F.col("value").asc()]
    best = top_k(value_counts(keyed, columns), ["column_name"], order, k).withColumnRenamed("value", "__key")
    texts = df.select(*[F.col(quoted(c)) for c in columns]).unpivot(
        [], [F.col(quoted(c)) for c in columns], "column_name", "value"
    )
    found = texts.withColumn("__key", F.sha2("value", 256)).join(
        F.broadcast(best), ["column_name", "__key"]  # k rows per column
    )
    return found.groupBy("column_name", "rank", "count").agg(F.any_value("value").alias("value"))


def categorical_profile(
    df: DataFrame, columns: Sequence[str] | None = None, long_text: Sequence[str] = ()
) -> DataFrame:
    """Top value, its count and its share of the non-null rows, and the top ten."""
    columns = columns if columns is not None else columns_of_kind(df, CATEGORICAL)
    present = _long(
        df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]),
        [
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null"))
            for i, c in enumerate(columns)
        ],
    )
    return present.join(_packed_top(df, columns, long_text), "column_name", "left").select("column_name", *_top_columns())


def _packed_top(df: DataFrame, columns: Sequence[str], long_text: Sequence[str]) -> DataFrame:
    return (
        top_values(df, columns, long_text=long_text)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("__top"))
        .select(
            "column_name",
            F.transform("__top", lambda t: F.struct(t["value"], t["count"])).alias("top_values"),
        )
    )


def _top_columns() -> list[Column]:
    first = F.get("top_values", F.lit(0))
    return [
        F.col("top_values"),
        first["value"].alias("top_value"),
        first["count"].alias("top_value_count"),
        percent(first["count"], F.col("non_null")).alias("top_value_percentage"),
    ]


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Range, whole days spanned, most common year, month and weekday (Monday = 0)."""
    wanted = columns if columns is not None else columns_of_kind(df, DATETIME)
    fields = [f for f in _fields(df, wanted) if kind_of(f.dataType) == DATETIME]
    if not fields:
        raise ValueError("no date or timestamp column to profile")
    rows = [F.struct(F.lit(f.name).alias("column_name"), *_dates(f)).alias(f"c{i}") for i, f in enumerate(fields)]
    return _long(df.agg(*rows), [F.col(f"c{i}") for i in range(len(fields))])


_DATES = {
    "min_date": "timestamp_ntz",
    "max_date": "timestamp_ntz",
    "date_range_days": "bigint",
    "most_common_year": "int",
    "most_common_month": "int",
    "most_common_day_of_week": "int",
}


def _dates(f: T.StructField) -> list[Column]:
    c = naive(F.col(quoted(f.name)))
    low, high = F.min(c), F.max(c)
    values = [
        low,
        high,
        F.floor(F.timestamp_diff("SECOND", low, high) / F.lit(86400)),
        F.mode(F.year(c), True),
        F.mode(F.month(c), True),
        F.mode(F.weekday(c), True),
    ]
    return [v.cast(kind).alias(name) for v, (name, kind) in zip(values, _DATES.items(), strict=True)]


def column_profile(
    df: DataFrame,
    table_name: str,
    exact: bool = True,
    rows: int | None = None,
    long_text: Sequence[str] = (),
) -> DataFrame:
    """All statistics of all columns in one long frame.

    One scan holds every aggregate of every column, one counts distinct values, one the values of texts;
    exact quartiles take theirs.
    """
    fields = _fields(df, None)
    kinds = {k: [f for f in fields if kind_of(f.dataType) == k] for k in (NUMERIC, CATEGORICAL, DATETIME)}
    aggs, rows_ = _base_aggregates(fields, exact), []
    for i, f in enumerate(fields):
        kind = kind_of(f.dataType)
        values = _base_values(i, f, exact)
        for own, made, types in (
            (NUMERIC, _moments, dict.fromkeys(_MOMENTS, "double")),
            (CATEGORICAL, lambda f: [F.count(quoted(f.name)).alias("non_null")], {"non_null": "bigint"}),
            (DATETIME, _dates, _DATES),
        ):
            if kind == own:
                aggs.append(F.struct(*made(f)).alias(f"{own}{i}"))
            if kinds[own]:
                part = F.col(f"{own}{i}") if kind == own else None
                values += [(F.lit(None) if part is None else part[x]).cast(t).alias(x) for x, t in types.items()]
        rows_.append(F.struct(*values))
    out = _with_distinct(_long(df.agg(*aggs), rows_), df, fields, exact)
    columns = [*_base_columns()]
    if kinds[NUMERIC]:
        out = out.join(_quartiles(df, kinds[NUMERIC], exact, rows), "column_name", "left")
        columns += [F.col(x) for x in _NUMERIC_COLUMNS]
    if kinds[CATEGORICAL]:
        out = out.join(_packed_top(df, [f.name for f in kinds[CATEGORICAL]], long_text), "column_name", "left")
        columns += _top_columns()
    if kinds[DATETIME]:
        columns += [F.col(x) for x in _DATES]
    return out.select(F.lit(table_name).alias("table_name"), *columns)


def table_profile(df: DataFrame, table_name: str) -> DataFrame:
    """Rows, columns and estimated size: fixed widths per type, bytes of text values."""
    size = F.coalesce(F.sum(row_bytes(df)), F.lit(0))
    return df.agg(
        F.lit(table_name).alias("table_name"),
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        (size / F.lit(1048576.0)).alias("memory_usage_mb"),
    )


def table_summary(base: DataFrame) -> DataFrame:
    """Column lists by kind, high-cardinality and high-null lists, from base profiles.

    Takes the output of ``base_profile`` (optionally with ``table_name``).
    """
    if "table_name" not in base.columns:
        base = base.withColumn("table_name", F.lit("unknown"))

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("column_name"))))

    return base.groupBy("table_name").agg(
        names(F.col("kind") == NUMERIC).alias("numeric_columns"),
        names(F.col("kind") == CATEGORICAL).alias("categorical_columns"),
        names(F.col("kind") == DATETIME).alias("datetime_columns"),
        names(F.col("unique_percentage") > HIGH_CARDINALITY_PERCENT).alias("high_cardinality_columns"),
        names(F.col("null_percentage") > HIGH_NULL_PERCENT).alias("high_null_columns"),
    )


def profile_all(tables: dict[str, DataFrame], exact: bool = True, long_text: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The column profile of several tables, one branch per table under a union; what a kind of column doesn't have
    is NULL. ``long_text``: by table, text columns that are counted by their digest."""
    parts = [column_profile(df, name, exact, long_text=(long_text or {}).get(name, ())) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_text(top: Column) -> Column:
    """``top_values`` as one text, ``value:count`` joined by commas."""
    return F.array_join(F.transform(top, lambda t: F.concat(t["value"], F.lit(":"), t["count"].cast("string"))), ",")
