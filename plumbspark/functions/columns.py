"""Null cleaning, column kinds and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
OTHER = "other"

_FLOATING = (T.FloatType, T.DoubleType)


def kind_of(dtype: T.DataType) -> str:
    """Profile family of a type; booleans and nested types have base statistics only."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.StringType):
        return CATEGORICAL
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean(field: T.StructField) -> Column:
    """The column with NaN read as NULL, so that a missing float counts as missing."""
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, _FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def cleaned(df: DataFrame) -> DataFrame:
    """The frame with NaN read as NULL in every floating column."""
    return df.select(*[clean(f).alias(f.name) for f in df.schema.fields])


def clean_column(df: DataFrame, name: str) -> Column:
    return clean(df.schema[name])


def clean_double(df: DataFrame, name: str) -> Column:
    return clean_column(df, name).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL for an empty whole (ANSI division would raise)."""
    return F.try_divide(part, whole) * 100


def all_set(names: list[str]) -> Column:
    """True where no key column is NULL: only such rows can match in a keyed write."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(quoted(name)).isNotNull()
    return out


def naive(c: Column) -> Column:
    """Any date or timestamp as a zone-less timestamp (session zone for zoned ones)."""
    return c.cast("timestamp_ntz")


def moment(value) -> Column:
    """A Python datetime/date or ISO text as a zone-less timestamp literal."""
    text = value if isinstance(value, str) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)
