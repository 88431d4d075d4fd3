"""Keyed writes and partitions, over all orders and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plumbspark.functions import buckets as B
from plumbspark.operators import partitions as P
from plumbspark.operators import writes as W
from registry.common import (
    AS_OF,
    DIRTY_EVENTS_SQL,
    WRITE_SQL,
    batch,
    dirty_events,
    query,
    rounded_price,
    table,
    target,
    time_text,
    time_text_sql,
    twice,
)

_COLS = f"""o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 2) AS o_totalprice,
    {time_text_sql('o_orderdate')} AS o_orderdate, o_orderpriority"""
_EVENT_COLS = f"event_id, {time_text_sql('ts')} AS ts, user_id, event_type, value, props"


@query("write_insert", f"{WRITE_SQL} SELECT {_COLS} FROM target UNION ALL SELECT {_COLS} FROM batch")
def write_insert(spark, folder):
    return rounded_price(W.insert(target(spark, folder), batch(spark, folder)))


_ROUTED = f"SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE 'ev_' || event_type END AS table_name FROM ({DIRTY_EVENTS_SQL})"


@query(
    "write_routed_counts",
    f"SELECT table_name, COUNT(*) AS inserted FROM ({_ROUTED}) WHERE table_name IS NOT NULL GROUP BY table_name",
)
def write_routed_counts(spark, folder):
    mixed = dirty_events(spark, folder).withColumn(
        "table", F.when(F.col("event_type") != "view", F.concat(F.lit("ev_"), F.col("event_type")))
    )
    return W.routed_counts(mixed)


def event_rows(df):
    """All columns of events, times as text and NaN as NULL."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    return df.withColumn("ts", time_text(F.col("ts"))).withColumn("value", value)


_KEPT = "SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.o_orderkey = t.o_orderkey)"


@query("write_replace", f"{WRITE_SQL} SELECT {_COLS} FROM ({_KEPT.format('batch')}) UNION ALL SELECT {_COLS} FROM batch")
def write_replace(spark, folder):
    return rounded_price(W.replace(target(spark, folder), batch(spark, folder), ["o_orderkey"]))


_LAST = """last AS (SELECT * FROM twice WHERE o_orderkey IS NULL OR position =
    (SELECT MAX(position) FROM twice x WHERE x.o_orderkey = twice.o_orderkey))"""


@query(
    "write_replace_last_wins",
    f"{WRITE_SQL}, {_LAST} SELECT {_COLS} FROM ({_KEPT.format('last')}) UNION ALL SELECT {_COLS} FROM last",
)
def write_replace_last_wins(spark, folder):
    return rounded_price(W.replace_last_wins(target(spark, folder), twice(spark, folder), ["o_orderkey"], "position"))


_CHUNKS = """chunks AS (SELECT *, position // 101 AS chunk FROM twice),
    tops AS (SELECT o_orderkey, MAX(chunk) AS chunk FROM chunks GROUP BY o_orderkey),
    kept AS (SELECT c.* FROM chunks c LEFT JOIN tops t ON c.o_orderkey = t.o_orderkey WHERE c.o_orderkey IS NULL OR c.chunk = t.chunk)"""


@query(
    "write_replace_chunked",
    f"{WRITE_SQL}, {_CHUNKS} SELECT {_COLS} FROM ({_KEPT.format('kept')}) UNION ALL SELECT {_COLS} FROM kept",
)
def write_replace_chunked(spark, folder):
    out = W.replace_in_chunks(target(spark, folder), twice(spark, folder), ["o_orderkey"], "position", 101)
    return rounded_price(out)


def _upsert_sql(updated: set[str]) -> str:
    cols = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    pick = ", ".join(
        (f"CASE WHEN b.o_orderkey IS NOT NULL THEN b.{c} ELSE t.{c} END" if c in updated
         else f"CASE WHEN t.o_orderkey IS NOT NULL THEN t.{c} ELSE b.{c} END") + f" AS {c}"
        for c in cols
    )
    return f"""{WRITE_SQL}, keyed AS (SELECT * FROM batch WHERE o_orderkey IS NOT NULL),
    merged AS (SELECT COALESCE(t.o_orderkey, b.o_orderkey) AS o_orderkey, {pick}
               FROM target t FULL OUTER JOIN keyed b ON t.o_orderkey = b.o_orderkey)
    SELECT {_COLS} FROM merged UNION ALL SELECT {_COLS} FROM batch WHERE o_orderkey IS NULL"""


@query("write_upsert", _upsert_sql({"o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"}))
def write_upsert(spark, folder):
    return rounded_price(W.upsert(target(spark, folder), batch(spark, folder), ["o_orderkey"]))


@query("write_upsert_subset", _upsert_sql({"o_orderstatus", "o_totalprice"}))
def write_upsert_subset(spark, folder):
    out = W.upsert(target(spark, folder), batch(spark, folder), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return rounded_price(out)


@query(
    "write_insert_if_absent",
    f"""{WRITE_SQL}, moved AS (SELECT o_orderkey + 100 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, position FROM twice),
    firsts AS (SELECT * FROM moved WHERE position = (SELECT MIN(position) FROM moved x WHERE x.o_orderkey = moved.o_orderkey))
    SELECT {_COLS} FROM target UNION ALL
    SELECT {_COLS} FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.o_orderkey = f.o_orderkey)
    UNION ALL SELECT {_COLS} FROM moved WHERE o_orderkey IS NULL""",
)
def write_insert_if_absent(spark, folder):
    moved = twice(spark, folder).withColumn("o_orderkey", F.col("o_orderkey") + 100)
    return rounded_price(W.insert_if_absent(target(spark, folder), moved, ["o_orderkey"], "position"))


@query(
    "write_operations",
    f"""{WRITE_SQL}, a AS (SELECT * FROM target UNION ALL SELECT * FROM batch),
    b AS (SELECT * FROM a WHERE NOT COALESCE(o_totalprice > 400000, FALSE)),
    c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM b)
    SELECT {_COLS} FROM c""",
)
def write_operations(spark, folder):
    ops = [
        W.Insert("orders", batch(spark, folder)),
        W.Delete("orders", "o_totalprice > 400000"),
        W.Update("orders", "o_orderpriority = '1-URGENT'", {"o_orderstatus": "'U'", "o_totalprice": "o_totalprice * 2"}),
    ]
    return rounded_price(W.apply_operations(spark, {"orders": target(spark, folder)}, ops)["orders"])


@query(
    "write_delete_where",
    f"SELECT {_EVENT_COLS} FROM ({DIRTY_EVENTS_SQL}) WHERE NOT COALESCE(event_type = 'error', FALSE)",
)
def write_delete_where(spark, folder):
    kept = W.delete_where(dirty_events(spark, folder), "event_type = 'error'")
    return event_rows(kept)


@query(
    "write_update_where",
    f"""SELECT event_id, {time_text_sql('ts')} AS ts, CASE WHEN user_id < 50 THEN event_type || '!' ELSE event_type END AS event_type,
        CASE WHEN user_id < 50 THEN user_id + 1000 ELSE user_id END AS user_id, value, props FROM ({DIRTY_EVENTS_SQL})""",
)
def write_update_where(spark, folder):
    changed = {"event_type": "event_type || '!'", "user_id": "user_id + 1000"}
    return event_rows(W.update_where(dirty_events(spark, folder), "user_id < 50", changed))


@query("write_truncate", f"{WRITE_SQL} SELECT {_COLS} FROM batch")
def write_truncate(spark, folder):
    ops = [W.Truncate("orders"), W.Insert("orders", batch(spark, folder))]
    return rounded_price(W.apply_operations(spark, {"orders": target(spark, folder)}, ops)["orders"])


# --- partitions -----------------------------------------------------------------------

_DAY = "'events_' || strftime(ts, '%Y%m%d')"
_MONTH = "'orders_' || strftime(o_orderdate, '%Y%m')"


@query(
    "partition_range_counts",
    f"""SELECT {_DAY} AS partition_name, COUNT(*) AS row_count FROM events GROUP BY 1
    UNION ALL SELECT {_MONTH}, COUNT(*) FROM orders GROUP BY 1""",
)
def partition_range_counts(spark, folder):
    daily = P.partition_counts(table(spark, folder, "events"), B.daily_partition(F.col("ts"), "events"))
    monthly = P.partition_counts(table(spark, folder, "orders"), B.monthly_partition(F.col("o_orderdate"), "orders"))
    return daily.unionByName(monthly)


@query(
    "partition_bounds_counts",
    """SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'small' WHEN l_quantity >= 10 AND l_quantity < 40 THEN 'medium' END AS partition_name,
       COUNT(*) AS row_count FROM lineitem GROUP BY 1""",
)
def partition_bounds_counts(spark, folder):
    label = B.range_partition(F.col("l_quantity"), [("small", 0, 10), ("medium", 10, 40)])
    return P.partition_counts(table(spark, folder, "lineitem"), label)


@query(
    "partition_list_counts",
    """SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browsing' WHEN event_type IN ('purchase') THEN 'sales' END AS partition_name,
       COUNT(*) AS row_count FROM events GROUP BY 1""",
)
def partition_list_counts(spark, folder):
    label = B.list_partition(F.col("event_type"), {"browsing": ["view", "click"], "sales": ["purchase"]})
    return P.partition_counts(table(spark, folder, "events"), label)


@query(
    "partition_hash_counts",
    "SELECT CAST(c_custkey % 4 AS INTEGER) AS partition_name, COUNT(*) AS row_count FROM customer GROUP BY 1",
)
def partition_hash_counts(spark, folder):
    return P.partition_counts(table(spark, folder, "customer"), B.hash_partition(F.col("c_custkey"), 4))


@query(
    "partition_rejects",
    f"""SELECT {_EVENT_COLS} FROM events
       WHERE NOT COALESCE(ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00', FALSE)""",
)
def partition_rejects(spark, folder):
    _, rejected = P.split_by_bounds(table(spark, folder, "events"), "ts", datetime(2024, 1, 5), datetime(2024, 1, 20))
    return event_rows(rejected)
