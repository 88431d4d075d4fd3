"""Stored tables under versions: keyed writes by touched files, transactions, partitions that prune."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbspark.functions import buckets as B
from plumbspark.functions.shared_dir import shared_folder
from plumbspark.operators import partitions as P
from plumbspark.operators import writes as W
from plumbspark.plans.publish import RejectedWrite
from plumbspark.sources.versioned import Store
from registry.common import AS_OF, WRITE_SQL, batch, query, rounded_price, table, target, time_text, time_text_sql
from registry.writes import _COLS, _EVENT_COLS, _KEPT, _upsert_sql, event_rows

_STORED: dict[tuple, Store] = {}


def new_store(spark, folder, *tables):
    """A store of its own that holds orders by key, customers by key, or events by day."""
    store = Store(spark, shared_folder(spark, "store"))
    t = store.begin()
    if "orders" in tables:
        t.create("orders", target(spark, folder), ["o_orderkey"])
    if "customer" in tables:
        t.create("customer", table(spark, folder, "customer"), ["c_custkey"])
    if "events" in tables:
        day = B.daily_partition(F.col("ts"), "events")
        t.create("events", table(spark, folder, "events").withColumn("day", day), ["event_id"], ["day"])
    t.commit()
    return store


def stored(spark, folder, name):
    """The same, once a session for queries that only read it."""
    key = spark.sparkContext.applicationId, folder, name
    if key not in _STORED:
        _STORED[key] = new_store(spark, folder, name)
    return _STORED[key]


def _written(spark, folder, do):
    store = new_store(spark, folder, "orders")
    t = store.begin()
    do(t)
    t.commit()
    return rounded_price(store.read("orders"))


@query("write_replace_files", f"{WRITE_SQL} SELECT {_COLS} FROM ({_KEPT.format('batch')}) UNION ALL SELECT {_COLS} FROM batch")
def write_replace_files(spark, folder):
    return _written(spark, folder, lambda t: t.replace("orders", batch(spark, folder)))


@query("write_upsert_files", _upsert_sql({"o_orderstatus", "o_totalprice"}))
def write_upsert_files(spark, folder):
    return _written(spark, folder, lambda t: t.upsert("orders", batch(spark, folder), ["o_orderstatus", "o_totalprice"]))


@query(
    "write_delete_update_files",
    f"""{WRITE_SQL}, kept AS (SELECT * FROM target WHERE NOT COALESCE(o_totalprice > 400000, FALSE)),
    set_ AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
             o_totalprice, o_orderdate, o_orderpriority FROM kept)
    SELECT {_COLS} FROM set_ WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_orderkey = set_.o_orderkey)""",
)
def write_delete_update_files(spark, folder):
    def do(t):
        t.delete("orders", "o_totalprice > 400000")
        t.update("orders", "o_orderpriority = '1-URGENT'", {"o_orderstatus": "'U'"})
        t.delete_keys("orders", batch(spark, folder))

    return _written(spark, folder, do)


@query(
    "write_transaction",
    f"""{WRITE_SQL}, a AS (SELECT * FROM target UNION ALL SELECT * FROM batch WHERE o_orderkey IS NOT NULL AND o_orderkey % 2 = 1
         UNION ALL SELECT * FROM batch WHERE o_orderkey IS NULL)
    SELECT 'orders' AS table_name, 2 AS version, o_orderkey AS key, ROUND(o_totalprice, 2) AS amount, o_orderstatus AS label
    FROM a WHERE NOT COALESCE(o_totalprice > 400000, FALSE)
    UNION ALL SELECT 'customer', 2, c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE ROUND(c_acctbal, 2) END, c_mktsegment FROM customer""",
)
def write_transaction(spark, folder):
    """A list of operations on two tables is refused for its orders' prices, another for its keys; neither leaves a
    trace. A third is taken as one version."""
    store = new_store(spark, folder, "orders", "customer")
    rows = batch(spark, folder)
    fresh = rows.where("o_orderkey IS NULL OR o_orderkey % 2 = 1")  # doubled keys are even: rows without a key alone
    rules = {"orders": {"positive": "o_totalprice > 0"}, "customer": {"balance": "c_acctbal >= 0"}}
    unique = {"orders": [["o_orderkey"]]}

    def refused(orders):
        t = store.begin()
        t.apply([W.Update("customer", "c_acctbal < 0", {"c_acctbal": "0"}), W.Delete("orders", "o_totalprice > 100000"), W.Insert("orders", orders)])
        try:
            t.commit(rules, unique)
        except RejectedWrite:
            return
        raise AssertionError("the list was taken")

    refused(rows.withColumn("o_totalprice", -F.col("o_totalprice")))
    refused(rows)
    t = store.begin()
    t.apply([W.Insert("orders", fresh), W.Delete("orders", "o_totalprice > 400000"), W.Update("customer", "c_acctbal < 0", {"c_acctbal": "0"})])
    version = F.lit(t.commit({"customer": rules["customer"]})).alias("version")
    orders = store.read("orders").select(
        F.lit("orders").alias("table_name"), version, F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("amount"),
        F.col("o_orderstatus").alias("label"),
    )
    customers = store.read("customer").select(
        F.lit("customer"), version, "c_custkey", F.round("c_acctbal", 2), "c_mktsegment"
    )
    return orders.union(customers)


@query(
    "check_duplicates_indexed",
    f"""{WRITE_SQL} SELECT o_orderkey, COUNT(*) AS count FROM (
        SELECT o_orderkey FROM batch UNION ALL SELECT o_orderkey FROM target WHERE o_orderkey IN (SELECT o_orderkey FROM batch))
    WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1""",
)
def check_duplicates_indexed(spark, folder):
    return stored(spark, folder, "orders").duplicates("orders", batch(spark, folder))


# --- partitions -----------------------------------------------------------------------

_DAY = "'events_' || strftime(ts, '%Y%m%d')"


@query(
    "pruned_daily_agg",
    """SELECT event_type, COUNT(*) AS count, ROUND(AVG(value), 6) AS avg_value FROM events
       WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY event_type""",
)
def pruned_daily_agg(spark, folder):
    """A week of the stored events: the days by their folders, then the exact times."""
    low, high = datetime(2024, 1, 24), datetime(2024, 1, 31)
    days = P.within(stored(spark, folder, "events").read("events"), "day", *[B.daily_partition(F.lit(d), "events") for d in (low, high)])
    week = P.within(days, "ts", *[F.lit(d).cast("timestamp_ntz") for d in (low, high)])
    return week.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("value"), 6).alias("avg_value"))


@query(
    "partition_stats",
    f"""SELECT {_DAY} AS partition_name, COUNT(*) AS row_count, TRUE AS has_bytes, {time_text_sql('MIN(ts)')} AS min_ts,
        {time_text_sql('MAX(ts)')} AS max_ts FROM events GROUP BY 1""",
)
def partition_stats(spark, folder):
    """Rows and bytes from the lists of files, times from the rows."""
    store = stored(spark, folder, "events")
    sizes = store.partitions("events").select("partition_name", "row_count", (F.col("bytes") > 0).alias("has_bytes"))
    times = P.partition_stats(store.read("events"), F.col("day"), "ts").drop("row_count")
    out = sizes.join(times, "partition_name")
    return out.withColumn("min_ts", time_text(F.col("min_ts"))).withColumn("max_ts", time_text(F.col("max_ts")))


@query("retention_prune", f"SELECT {_EVENT_COLS} FROM events WHERE ts >= TIMESTAMP '2024-01-17 12:00:00'")
def retention_prune(spark, folder):
    """Days before the cut-off go by their folders; of its own day the rows before it."""
    cut = AS_OF - timedelta(days=13, hours=12)
    store = new_store(spark, folder, "events")
    t = store.begin()
    t.drop_partitions("events", cut.strftime("events_%Y%m%d"), F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    t.commit()
    return event_rows(store.read("events").drop("day"))
