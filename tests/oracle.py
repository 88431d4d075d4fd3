"""Run registered queries against DuckDB: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (datetime, date)):
        return str(v)
    return v


def duck(folder: str):
    import duckdb

    from registry.common import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark_df, con, sql: str) -> str:
    """Empty text when both sides hold the same rows under the same column names."""
    mine = spark_df.collect()
    names = spark_df.columns
    other_names, other = oracle_rows(con, sql)
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} != {sorted(other_names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in mine), key=repr)
    at = [other_names.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in other), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}: {sorted(set(a) - set(b), key=repr)[:2]} / {sorted(set(b) - set(a), key=repr)[:2]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{order}\n   spark  {x}\n   oracle {y}"
    types_a = [{type(v) for v in col if v is not None} for col in zip(*a)]
    types_b = [{type(v) for v in col if v is not None} for col in zip(*b)]
    return "" if types_a == types_b else f"types {types_a} != {types_b}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as E

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(folder)
    bad = 0
    for name, fn in E.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            sql = E.oracle_sql().get(name)
            note = compare(df, con, sql) if sql else f"rows only: {df.count()}"
            ok = not note or note.startswith("rows only")
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("failed:", bad)
