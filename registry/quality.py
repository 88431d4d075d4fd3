"""Table checks and check runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbspark.operators import checks as C
from plumbspark.plans import check_run as R
from plumbspark.sources.tables import register, table_info
from registry.common import AS_OF, AS_OF_SQL, DIRTY_EVENTS_SQL, dirty_events, query, rounded, table

_STATUS3 = "CASE WHEN {n} > 2 * {m} THEN 'critical' WHEN {n} > {m} THEN 'warning' ELSE 'pass' END"
_AGE = "ROUND((epoch(%s) - epoch(MAX(%s))) / 3600.0, 2)"


def _rows(df):
    return rounded(df.select("table_name", "check_name", "status", "metric", "threshold"))


@query(
    "check_row_count",
    """SELECT 'orders' AS table_name, 'row_count' AS check_name,
       CASE WHEN COUNT(*) >= 1000000000 THEN 'pass' WHEN COUNT(*) = 0 THEN 'critical' ELSE 'warning' END AS status,
       CAST(COUNT(*) AS DOUBLE) AS metric, CAST(1000000000 AS DOUBLE) AS threshold FROM orders""",
)
def check_row_count(spark, folder):
    check = C.TableCheck("orders", row_count_min=1_000_000_000)
    return _rows(C.table_checks(table(spark, folder, "orders"), check, AS_OF))


@query(
    "check_row_count_range",
    """SELECT 'events' AS table_name, 'row_count_range' AS check_name,
       CASE WHEN COUNT(*) BETWEEN 1 AND 5000 THEN 'pass' WHEN COUNT(*) = 0 THEN 'critical' ELSE 'warning' END AS status,
       CAST(COUNT(*) AS DOUBLE) AS metric, CAST(5000 AS DOUBLE) AS threshold FROM events""",
)
def check_row_count_range(spark, folder):
    check = C.TableCheck("events", row_count_range=(1, 5000))
    return _rows(C.table_checks(table(spark, folder, "events"), check, AS_OF))


def _fresh_sql(t: str, c: str, hours: float) -> str:
    age = _AGE % (AS_OF_SQL, c)
    raw = f"(epoch({AS_OF_SQL}) - epoch(MAX({c}))) / 3600.0"
    return f"""SELECT '{t}' AS table_name, 'freshness' AS check_name,
        CASE WHEN MAX({c}) IS NULL THEN 'warning' WHEN {raw} > {hours} * 2 THEN 'critical'
             WHEN {raw} > {hours} THEN 'warning' ELSE 'pass' END AS status,
        CAST({age} AS DOUBLE) AS metric, CAST({hours} AS DOUBLE) AS threshold FROM {t}"""


@query("check_freshness", _fresh_sql("events", "ts", 24) + "\nUNION ALL " + _fresh_sql("orders", "o_orderdate", 24))
def check_freshness(spark, folder):
    parts = []
    for t, c in (("events", "ts"), ("orders", "o_orderdate")):
        check = C.TableCheck(t, freshness=C.Freshness(c, 24))
        parts.append(_rows(C.table_checks(table(spark, folder, t), check, AS_OF)))
    return parts[0].unionByName(parts[1])


_RULES = (
    C.Rule("large_value", "value > 300", 5),
    C.Rule("missing_value", "value IS NULL", 10_000_000),
    C.Rule("missing_user", "user_id IS NULL", 500),
    C.Rule("negative_value", "value < 0", 0),
)
_RULE_SQL = {
    "large_value": ("value > 300", 5),
    "missing_value": ("value IS NULL", 10_000_000),
    "missing_user": ("user_id IS NULL", 500),
    "negative_value": ("value < 0", 0),
}
_DIRTY = f"WITH dirty AS ({DIRTY_EVENTS_SQL})\n"


@query(
    "check_anomaly_rules",
    _DIRTY
    + "\nUNION ALL ".join(
        f"""SELECT 'events' AS table_name, '{n}' AS check_name, COUNT(*) FILTER (WHERE {p}) AS anomaly_count,
            CAST({m} AS BIGINT) AS expected_max, {_STATUS3.format(n=f"COUNT(*) FILTER (WHERE {p})", m=m)} AS status FROM dirty"""
        for n, (p, m) in _RULE_SQL.items()
    ),
)
def check_anomaly_rules(spark, folder):
    return C.anomaly_rule_results(dirty_events(spark, folder), C.TableCheck("events", anomaly_rules=_RULES))


_TOTAL = "COUNT(*) FILTER (WHERE value > 300) + COUNT(*) FILTER (WHERE user_id < 0)"


@query(
    "check_anomaly_overall",
    f"""SELECT 'events' AS table_name, {_TOTAL} AS total_anomalies,
        CASE WHEN {_TOTAL} >= 10 THEN 'critical' WHEN {_TOTAL} > 0 THEN 'warning' ELSE 'pass' END AS overall_status FROM events""",
)
def check_anomaly_overall(spark, folder):
    check = C.TableCheck("events", anomaly_rules=(C.Rule("large", "value > 300"), C.Rule("user", "user_id < 0")))
    return C.anomaly_overall(table(spark, folder, "events"), check)


_SQL_RULE = "SELECT COUNT(*) AS count FROM orders WHERE o_totalprice > 450000"


@query(
    "check_anomaly_sql",
    f"""SELECT 'orders' AS table_name, 'expensive' AS check_name, (SELECT count FROM ({_SQL_RULE})) AS anomaly_count,
        CAST(100 AS BIGINT) AS expected_max, {_STATUS3.format(n=f"(SELECT count FROM ({_SQL_RULE}))", m=100)} AS status""",
)
def check_anomaly_sql(spark, folder):
    register(spark, folder, ["orders"])
    check = C.TableCheck("orders", anomaly_rules=(C.Rule("expensive", sql=_SQL_RULE, expected_max=100),))
    return C.anomaly_rule_results(table(spark, folder, "orders"), check)


_EXPECTED = ["c_custkey", "c_name", "c_email", "c_nationkey", "c_acctbal"]


@query(
    "check_schema",
    """SELECT 'customer' AS table_name, 'row_count' AS check_name, 'pass' AS status, CAST(COUNT(*) AS DOUBLE) AS metric,
       CAST(1 AS DOUBLE) AS threshold, '' AS missing_columns, '' AS extra_columns FROM customer
       UNION ALL
       SELECT 'customer', 'schema', 'critical', 2, 0, 'c_email', 'c_mktsegment'""",
)
def check_schema(spark, folder):
    customer = table(spark, folder, "customer")
    check = C.TableCheck("customer", row_count_min=1, expected_columns=_EXPECTED)
    _, missing, extra = C.schema_difference(customer.columns, _EXPECTED)
    is_schema = F.col("check_name") == "schema"
    return _rows(C.table_checks(customer, check, AS_OF)).select(
        "*",
        F.when(is_schema, ",".join(missing)).otherwise("").alias("missing_columns"),
        F.when(is_schema, ",".join(extra)).otherwise("").alias("extra_columns"),
    )


@query(
    "check_schema_types",
    """SELECT column_name, change, old_type, new_type, severity, (SELECT COUNT(*) FROM customer) AS affected_rows
       FROM (VALUES ('c_custkey', 'type_changed', 'bigint', 'string', 'high'), ('c_email', 'added', NULL, 'string', 'medium'),
                    ('c_mktsegment', 'removed', 'string', NULL, 'high')) AS v(column_name, change, old_type, new_type, severity)""",
)
def check_schema_types(spark, folder):
    before = table(spark, folder, "customer")
    after = before.withColumn("c_custkey", F.col("c_custkey").cast("string")).drop("c_mktsegment").withColumn(
        "c_email", F.lit(None).cast("string")
    )
    rows = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return C.schema_type_changes(table_info(before), table_info(after)).withColumn("affected_rows", rows)


@query(
    "check_duplicates",
    """SELECT user_id, event_type, COUNT(*) AS duplicate_count FROM events
       WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type HAVING COUNT(*) > 1""",
)
def check_duplicates(spark, folder):
    return C.duplicate_keys(table(spark, folder, "events"), ["user_id", "event_type"])


_LIMITS = (C.NullLimit("user_id", 100), C.NullLimit("event_type", 10_000_000), C.NullLimit("value", 0), C.NullLimit("event_id", 0))


@query(
    "check_nulls",
    _DIRTY
    + "\nUNION ALL ".join(
        f"""SELECT '{x.column}' AS column_name, COUNT(*) - COUNT({x.column}) AS null_count, CAST({x.threshold} AS BIGINT) AS threshold,
            CASE WHEN COUNT(*) - COUNT({x.column}) <= {x.threshold} THEN 'pass' ELSE 'warning' END AS status FROM dirty"""
        for x in _LIMITS
    ),
)
def check_nulls(spark, folder):
    return C.null_checks(dirty_events(spark, folder), _LIMITS)


# Names of three parts, an address made from the name, the order status codes.
_CONSTRAINTS_SQL = {
    "name_length": "length(c_name) >= 3",
    "email_format": "regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$', 'i')",
    "positive_balance": "c_acctbal > 0",
    "known_segment": "c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')",
}
_MAILS_SQL = """SELECT *, CASE WHEN c_custkey % 10 = 0 THEN replace(c_name, '#', '') WHEN c_custkey % 7 = 0 THEN NULL
    ELSE replace(c_name, '#', '.') || '@example.com' END AS email FROM customer"""


@query(
    "check_constraints",
    f"WITH mails AS ({_MAILS_SQL})\n"
    + "\nUNION ALL ".join(
        f"""SELECT '{n}' AS constraint_name, COUNT(*) FILTER (WHERE NOT COALESCE({p}, TRUE)) AS violations,
            CASE WHEN COUNT(*) FILTER (WHERE NOT COALESCE({p}, TRUE)) = 0 THEN 'pass' ELSE 'critical' END AS status FROM mails"""
        for n, p in _CONSTRAINTS_SQL.items()
    ),
)
def check_constraints(spark, folder):
    c = table(spark, folder, "customer")
    name = F.col("c_name")
    mails = c.withColumn(
        "email",
        F.when(F.col("c_custkey") % 10 == 0, F.replace(name, F.lit("#"), F.lit("")))
        .when(F.col("c_custkey") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@example.com"))),
    )
    return C.violations(
        mails,
        {
            "name_length": C.min_length("c_name", 3),
            "email_format": C.email_like("email"),
            "positive_balance": C.positive("c_acctbal"),
            "known_segment": C.one_of("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"]),
        },
    )


@query(
    "check_foreign_key",
    """SELECT o_orderkey, o_custkey + o_orderkey % 50 AS o_custkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + o_orderkey % 50)""",
)
def check_foreign_key(spark, folder):
    # Shifted keys: those past the last customer have no parent.
    shifted = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("o_custkey"))
    return C.foreign_key_violations(shifted, ["o_custkey"], table(spark, folder, "customer"), ["c_custkey"])


RUN = [
    C.TableCheck(
        "events",
        row_count_min=1000,
        freshness=C.Freshness("ts", 24),
        anomaly_rules=(C.Rule("large", "value > 400"), C.Rule("no_user", "user_id IS NULL")),
        expected_columns=("event_id", "ts", "user_id", "event_type", "value", "props"),
    ),
    C.TableCheck("orders", row_count_min=1, freshness=C.Freshness("o_orderdate", 24), null_limits=(C.NullLimit("o_custkey"),)),
    C.TableCheck("customer", row_count_min=1, expected_columns=("c_custkey", "c_name", "c_nationkey", "c_acctbal")),
    C.TableCheck("nation", row_count_min=1),
    C.TableCheck("missing_table", row_count_min=1),
]


def run_results(spark, folder):
    return R.check_results(
        spark, {c.table_name: lambda t=c.table_name: table(spark, folder, t) for c in RUN}, RUN, AS_OF
    )


_EV_TOTAL = "COUNT(*) FILTER (WHERE value > 400) + COUNT(*) FILTER (WHERE user_id IS NULL)"
_RESULTS_SQL = f"""
results AS (
  SELECT 'events' AS table_name, CASE WHEN COUNT(*) >= 1000 THEN 0 WHEN COUNT(*) = 0 THEN 3 ELSE 2 END AS r FROM events
  UNION ALL SELECT 'events', CASE WHEN MAX(ts) IS NULL THEN 2
     WHEN (epoch({AS_OF_SQL}) - epoch(MAX(ts))) / 3600.0 > 48 THEN 3
     WHEN (epoch({AS_OF_SQL}) - epoch(MAX(ts))) / 3600.0 > 24 THEN 2 ELSE 0 END FROM events
  UNION ALL SELECT 'events', CASE WHEN {_EV_TOTAL} >= 10 THEN 3 WHEN {_EV_TOTAL} > 0 THEN 2 ELSE 0 END FROM events
  UNION ALL SELECT 'events', 0
  UNION ALL SELECT 'orders', CASE WHEN COUNT(*) >= 1 THEN 0 ELSE 3 END FROM orders
  UNION ALL SELECT 'orders', CASE WHEN (epoch({AS_OF_SQL}) - epoch(MAX(o_orderdate))) / 3600.0 > 48 THEN 3
     WHEN (epoch({AS_OF_SQL}) - epoch(MAX(o_orderdate))) / 3600.0 > 24 THEN 2 ELSE 0 END FROM orders
  UNION ALL SELECT 'orders', CASE WHEN COUNT(*) - COUNT(o_custkey) <= 0 THEN 0 ELSE 2 END FROM orders
  UNION ALL SELECT 'customer', CASE WHEN COUNT(*) >= 1 THEN 0 ELSE 3 END FROM customer
  UNION ALL SELECT 'customer', 2
  UNION ALL SELECT 'nation', CASE WHEN COUNT(*) >= 1 THEN 0 ELSE 3 END FROM nation
  UNION ALL SELECT 'missing_table', 1
),
tables AS (
  SELECT table_name, CASE MAX(r) WHEN 0 THEN 'pass' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'critical' END AS status,
         MAX(r) AS r, COUNT(*) AS checks FROM results GROUP BY table_name
)
"""


@query("check_run_table_status", f"WITH {_RESULTS_SQL} SELECT table_name, status, checks FROM tables")
def check_run_table_status(spark, folder):
    return R.table_status(run_results(spark, folder))


@query(
    "check_run_summary",
    f"""WITH {_RESULTS_SQL}
    SELECT CASE MAX(r) WHEN 0 THEN 'pass' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'critical' END AS overall_status,
           COUNT(*) AS tables_checked, COUNT(*) FILTER (WHERE status = 'pass') AS pass,
           COUNT(*) FILTER (WHERE status = 'warning') AS warning, COUNT(*) FILTER (WHERE status = 'critical') AS critical,
           COUNT(*) FILTER (WHERE status = 'error') AS error FROM tables""",
)
def check_run_summary(spark, folder):
    return R.run_summary(run_results(spark, folder))


@query(
    "anomaly_samples",
    """SELECT table_name, anomaly_type, sample_no, event_id, data_sample FROM (
         SELECT 'events' AS table_name, anomaly_type, event_id,
                '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","user_id":' || user_id || ',"event_type":"' ||
                event_type || '","value":' || value || ',"props":"' || replace(props, '"', '\\"') || '"}' AS data_sample,
                CAST(row_number() OVER (PARTITION BY anomaly_type ORDER BY event_id) AS INTEGER) AS sample_no
         FROM (SELECT *, 'large' AS anomaly_type FROM events WHERE value > 200
               UNION ALL SELECT *, 'error' FROM events WHERE event_type = 'error')) WHERE sample_no <= 5""",
)
def anomaly_samples(spark, folder):
    check = C.TableCheck("events", anomaly_rules=(C.Rule("large", "value > 200"), C.Rule("error", "event_type = 'error'")))
    return C.rule_samples(table(spark, folder, "events"), check, ["event_id"])
