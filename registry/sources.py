"""Scans, SQL text, binds and metadata."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from plumbspark.functions.shared_dir import shared_folder
from plumbspark.sources import tables as S
from registry.common import TABLES, query, table

_REVENUE = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS order_lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""


@query("sql_query", _REVENUE)
def sql_query(spark, folder):
    S.register(spark, folder, ["lineitem"])
    return S.query(spark, _REVENUE)


_BY_BIND = """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_acctbal > {0} AND c_mktsegment LIKE {1}
"""


@query("param_query", _BY_BIND.format("1000.0", "'B%'"))
def param_query(spark, folder):
    S.register(spark, folder, ["customer"])
    sql = _BY_BIND.format(":least", ":segment")
    return S.query(spark, {"type": "parameterized", "sql": sql, "params": {"least": 1000.0, "segment": "B%"}})


_PRIORITY = "SELECT o_orderpriority, COUNT(*) AS orders, MAX(o_orderdate) IS NOT NULL AS dated FROM orders GROUP BY o_orderpriority"


@query("custom_query", _PRIORITY)
def custom_query(spark, folder):
    S.register(spark, folder, ["orders"])
    return S.query(spark, {"sql": _PRIORITY, "timeout_ms": 1000})


@query("lookup_by_key", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def lookup_by_key(spark, folder):
    S.register(spark, folder, ["orders"])
    sql = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = ?"
    return S.query(spark, {"type": "parameterized", "sql": sql, "params": [7]})


_INFO_SQL = """
WITH info AS (SELECT column_name, column_type FROM (DESCRIBE events)),
     counts AS (SELECT COUNT(*) AS n FROM events)
SELECT CAST(CASE column_name WHEN 'event_id' THEN 1 WHEN 'ts' THEN 2 WHEN 'user_id' THEN 3
                 WHEN 'event_type' THEN 4 WHEN 'value' THEN 5 ELSE 6 END AS INTEGER) AS ordinal,
       column_name,
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
                        WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type,
       n AS row_count
FROM info, counts
"""


@query("table_info", _INFO_SQL)
def table_info(spark, folder):
    events = table(spark, folder, "events")
    n = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return S.table_info(events).select("ordinal", "column_name", "data_type", n.alias("row_count"))


_COUNTS_SQL = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES)


@query("list_tables", _COUNTS_SQL)
def list_tables(spark, folder):
    S.register(spark, folder, TABLES)
    counts = S.row_counts({t: spark.table(t) for t in TABLES})
    return S.list_tables(spark).select("table_name").join(counts, "table_name")


@query("table_row_counts", _COUNTS_SQL)
def table_row_counts(spark, folder):
    return S.row_counts({t: table(spark, folder, t) for t in TABLES})


@query("sample_rows", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def sample_rows(spark, folder):
    return S.sample_rows(table(spark, folder, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"], 100)


_OBSERVED = {"events": "value > 20", "orders": "o_orderstatus = 'F'", "lineitem": "l_quantity < 10"}


@query(
    "observed_metrics",
    "\nUNION ALL ".join(
        f"""SELECT '{t}' AS table_name, COUNT(*) AS row_count, (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = '{t}') AS column_count,
            TRUE AS timed FROM {t} WHERE {c}"""
        for t, c in _OBSERVED.items()
    ),
)
def observed_metrics(spark, folder):
    """Rows and columns of results, counted while they are written, and the time that took."""
    out, rows = shared_folder(spark, "observed"), []
    for t, condition in _OBSERVED.items():
        result, watch = S.observed(table(spark, folder, t).where(condition), t)
        start = time.perf_counter()
        result.write.parquet(f"{out}/{t}")
        rows.append((t, watch.get["row_count"], watch.get["column_count"], time.perf_counter() - start > 0))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, column_count bigint, timed boolean")
