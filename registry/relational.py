"""Query shapes of a monitoring client."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plumbspark.operators import relational as R
from registry.common import query, rounded, table, time_text, time_text_sql


@query("rel_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def rel_filter(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("rel_count", "SELECT COUNT(*) AS row_count FROM lineitem")
def rel_count(spark, folder):
    return table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("row_count"))


@query("rel_group_count", "SELECT c_mktsegment, COUNT(*) AS count FROM customer GROUP BY c_mktsegment")
def rel_group_count(spark, folder):
    return R.group_counts(table(spark, folder, "customer"), ["c_mktsegment"])


@query(
    "rel_group_stats",
    """SELECT event_type, COUNT(*) AS count, ROUND(AVG(value), 6) AS avg_value,
              MIN(value) AS min_value, MAX(value) AS max_value
       FROM events GROUP BY event_type ORDER BY count DESC""",
)
def rel_group_stats(spark, folder):
    return rounded(R.group_stats(table(spark, folder, "events"), ["event_type"], "value")).orderBy(F.col("count").desc())


@query(
    "rel_group_concat",
    """SELECT user_id, CAST(COUNT(*) AS BIGINT) AS count, string_agg(event_type, ',' ORDER BY event_type) AS joined
       FROM events GROUP BY user_id""",
)
def rel_group_concat(spark, folder):
    return R.group_concat(table(spark, folder, "events"), ["user_id"], "event_type")


@query(
    "rel_topk",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""",
)
def rel_topk(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return R.page(rows, order, 0, 100)


@query(
    "rel_user_activity",
    f"""SELECT user_id, COUNT(*) AS event_count, COUNT(DISTINCT event_type) AS event_types,
              {time_text_sql('MIN(ts)')} AS first_event, {time_text_sql('MAX(ts)')} AS last_event
       FROM events WHERE event_type <> 'view' GROUP BY user_id ORDER BY event_count DESC, user_id LIMIT 20""",
)
def rel_user_activity(spark, folder):
    busy = R.activity(table(spark, folder, "events").filter("event_type <> 'view'"), "user_id", "event_type", "ts")
    top = R.page(busy, [F.col("event_count").desc(), F.col("user_id")], 0, 20)
    return top.withColumn("first_event", time_text(F.col("first_event"))).withColumn("last_event", time_text(F.col("last_event")))


@query(
    "rel_join_agg",
    """SELECT c_name, COUNT(*) AS order_count,
              CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def rel_join_agg(spark, folder):
    # Orders shrink to one row per customer before the join.
    per_customer = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    c = table(spark, folder, "customer")
    return per_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "order_count", "total")


@query(
    "rel_left_join_agg",
    """SELECT c_name, COUNT(event_id) AS event_count FROM customer LEFT JOIN events ON c_custkey = user_id
       GROUP BY c_custkey, c_name ORDER BY event_count DESC, c_name LIMIT 50""",
)
def rel_left_join_agg(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    counted = R.child_counts(c, table(spark, folder, "events"), "c_custkey", "user_id", "event_id")
    rows = counted.select("c_name", F.col("child_count").alias("event_count"))
    return R.page(rows, [F.col("event_count").desc(), F.col("c_name")], 0, 50)


@query(
    "rel_having",
    """SELECT c_custkey, c_name, COUNT(o_orderkey) AS order_count
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey
       WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, c_name HAVING COUNT(o_orderkey) > 5
       ORDER BY order_count DESC, c_custkey LIMIT 100""",
)
def rel_having(spark, folder):
    c = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    counted = R.child_counts(c, table(spark, folder, "orders"), "c_custkey", "o_custkey", "o_orderkey")
    rows = counted.select("c_custkey", "c_name", F.col("child_count").alias("order_count")).filter("order_count > 5")
    return R.page(rows, [F.col("order_count").desc(), F.col("c_custkey")], 0, 100)


@query(
    "rel_cte_join",
    """WITH busy AS (
         SELECT user_id, COUNT(*) AS total_events, COUNT(DISTINCT event_type) AS unique_event_types
         FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY user_id)
       SELECT user_id, total_events, unique_event_types, c_name, c_mktsegment
       FROM busy JOIN customer ON user_id = c_custkey WHERE total_events > 10
       ORDER BY total_events DESC, user_id LIMIT 10""",
)
def rel_cte_join(spark, folder):
    recent = table(spark, folder, "events").filter(F.col("ts") >= F.lit(datetime(2024, 1, 8)).cast("timestamp_ntz"))
    busy = (
        recent.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total_events"), F.countDistinct("event_type").alias("unique_event_types"))
        .filter("total_events > 10")
    )
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = busy.join(c, F.col("user_id") == F.col("c_custkey")).select(
        "user_id", "total_events", "unique_event_types", "c_name", "c_mktsegment"
    )
    return R.page(rows, [F.col("total_events").desc(), F.col("user_id")], 0, 10)


@query(
    "rel_exists",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
def rel_exists(spark, folder):
    large = table(spark, folder, "orders").filter("o_totalprice > 400000")
    return R.matching(table(spark, folder, "customer").select("c_custkey", "c_name"), large, {"c_custkey": "o_custkey"})


@query(
    "rel_search_sort_page",
    """SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(text, 'the')
       ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50""",
)
def rel_search_sort_page(spark, folder):
    docs = table(spark, folder, "documents")
    found = R.search_page(docs, "text", "the", sort_by="n_chars", tie="doc_id", descending=True, number=2, size=50)
    return found.select("doc_id", "lang", "source", "n_chars")
