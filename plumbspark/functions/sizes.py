"""Estimated row sizes; broadcast a side of a join, or gather a table, only after its size was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbspark.functions.columns import quoted

BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 32
#: Rows up to which a narrow table is better off in one partition.
FEW_ROWS = 1 << 18

_FIXED_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
}


def _value_bytes(field: T.StructField) -> Column:
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("bigint")
    return F.lit(_FIXED_WIDTH.get(type(field.dataType), 8)).cast("bigint")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of one row: a fixed width per type, the text's own bytes, JSON for nested values."""
    return reduce(lambda a, b: a + b, [_value_bytes(f) for f in df.schema.fields])


def measured_bytes(df: DataFrame, row_overhead: int = _ROW_OVERHEAD) -> int:
    """Estimated bytes of all rows with an overhead for each: one aggregate job."""
    return df.agg(F.sum(row_bytes(df) + row_overhead).alias("bytes")).first().bytes or 0


def is_small(df: DataFrame, row_overhead: int = _ROW_OVERHEAD) -> bool:
    return measured_bytes(df, row_overhead) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is measured small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df) else df


def gathered(df: DataFrame) -> DataFrame:
    """A written table of FEW_ROWS rows at most, as counted, in one partition: its joins and groups need no exchange,
    and what is made of it no more files than one. A longer table as it is. For narrow rows only."""
    return df.coalesce(1) if df.count() <= FEW_ROWS else df
