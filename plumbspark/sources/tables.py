"""Parquet datasets, temp views, SQL with binds, schema and row-count metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def register(spark: SparkSession, folder: str, tables: Iterable[str]) -> None:
    """Expose tables of a dataset folder as temp views for SQL text."""
    for table in tables:
        load(spark, folder, table).createOrReplaceTempView(table)


def read_file(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """Parquet, ORC, CSV or JSON; text formats need a schema so no pass infers one."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} input needs a schema")
    if fmt not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"unknown file format: {fmt}")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv" and "header" not in options:
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def query(
    spark: SparkSession,
    request: str | Mapping,
    params: Sequence | Mapping | None = None,
) -> DataFrame:
    """SQL text, or ``{"type", "sql", "params"}``; binds are positional ``?`` or named ``:x``.

    Types: ``custom`` (default), ``parameterized`` and ``table_info`` (``table_name``).
    """
    if isinstance(request, str):
        return _run_sql(spark, request, params)
    kind = request.get("type", "custom")
    if kind == "table_info":
        return table_info(spark.table(request["table_name"]))
    if kind not in ("custom", "parameterized"):
        raise ValueError(f"unknown query type: {kind}")
    if not request.get("sql"):
        raise ValueError("a query needs its sql text")
    return _run_sql(spark, request["sql"], request.get("params", params))


def _run_sql(spark: SparkSession, sql: str, params) -> DataFrame:
    if params is None or len(params) == 0:
        return spark.sql(sql)
    return spark.sql(sql, args=dict(params) if isinstance(params, Mapping) else list(params))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame plus row and column counts that fill in when an action runs it."""
    watch = Observation(name)
    out = df.observe(
        watch,
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )
    return out, watch


TABLE_INFO_SCHEMA = "ordinal INT, column_name STRING, data_type STRING, is_nullable BOOLEAN"


def table_info(df: DataFrame) -> DataFrame:
    """One row per column, in column order."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, TABLE_INFO_SCHEMA)


def table_info_or_empty(spark: SparkSession, table: str) -> DataFrame:
    """Like ``table_info`` by name; a table that does not exist has no rows."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], TABLE_INFO_SCHEMA)
    return table_info(spark.table(table))


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name STRING, is_temporary BOOLEAN")


def row_counts(tables: Mapping[str, DataFrame | Callable[[], DataFrame] | None]) -> DataFrame:
    """``(table_name, row_count)``; a table that cannot be opened counts 0.

    Tables come as frames or as functions that open them; None marks a lost one.
    """
    parts, lost, spark = [], [], None
    for name, source in tables.items():
        try:
            df = source() if callable(source) and not isinstance(source, DataFrame) else source
        except Exception:
            df = None
        if df is None:
            lost.append(name)
            continue
        spark = df.sparkSession
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        )
    if spark is None:
        raise ValueError("no readable table")
    for name in lost:
        parts.append(
            spark.range(0, 1, 1, 1).select(F.lit(name).alias("table_name"), F.lit(0).cast("bigint").alias("row_count"))
        )
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """First rows under a stated order, so that the answer is stable."""
    return df.orderBy(*keys).limit(n)


def latest_timestamp(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("latest_timestamp"))
