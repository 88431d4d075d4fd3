"""The streaming metrics, run over all events to the end of the input.

The oracle states what an append-mode stream may emit: windows and silences
that the watermark (latest event minus one hour) has passed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbspark.functions.shared_dir import shared_folder
from plumbspark.operators.anomaly import iqr_thresholds
from plumbspark.operators.checks import NullLimit, Rule, TableCheck
from plumbspark.plans.check_run import table_status
from plumbspark.streaming import batches as B
from plumbspark.streaming import source as S
from plumbspark.streaming import windows as W
from registry.common import AS_OF, query, rounded, table, time_text, time_text_sql


def _stream(spark, folder):
    # A pattern, so that the table may be one file or a folder of files.
    schema = table(spark, folder, "events").schema
    return S.file_stream(spark, f"{folder}/events.parque[t]", schema, "ts")


def _finished(spark, stream, purpose):
    out = shared_folder(spark, purpose)
    S.run_available(stream, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


def _timed(df, *columns):
    for c in columns:
        df = df.withColumn(c, time_text(F.col(c)))
    return df


_MARK = "(SELECT MAX(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query(
    "stream_tumbling_metrics",
    f"""WITH w AS (SELECT date_trunc('day', ts) AS a, event_type, value FROM events)
    SELECT {time_text_sql('a')} AS window_start, {time_text_sql('a + INTERVAL 1 DAY')} AS window_end, event_type,
      COUNT(*) AS row_count, COUNT(*) - COUNT(value) AS null_count, MIN(value) AS min_value, MAX(value) AS max_value,
      ROUND(AVG(value), 6) AS mean_value FROM w, {_MARK} m WHERE a + INTERVAL 1 DAY <= mark GROUP BY a, event_type""",
)
def stream_tumbling_metrics(spark, folder):
    metrics = W.tumbling_metrics(_stream(spark, folder), "ts", "event_type", "value")
    return rounded(_timed(_finished(spark, metrics, "tumbling"), "window_start", "window_end"))


@query(
    "stream_sliding_anomaly_rate",
    f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS a,
                 value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS bad FROM events, q, range(2) r(k)),
    -- two-day windows start every day counted from the epoch
    c AS (SELECT a, COUNT(*) AS total, COUNT(*) FILTER (WHERE bad) AS anomalies FROM w, {_MARK} m
          WHERE a + INTERVAL 2 DAY <= mark GROUP BY a)
    SELECT {time_text_sql('a')} AS window_start, {time_text_sql('a + INTERVAL 2 DAY')} AS window_end, total, anomalies,
           ROUND(100.0 * anomalies / total, 2) AS anomaly_rate FROM c""",
)
def stream_sliding_anomaly_rate(spark, folder):
    limits = iqr_thresholds(table(spark, folder, "events"), "value")
    rates = W.sliding_anomaly_rate(_stream(spark, folder), limits, "ts", "value")
    return _timed(_finished(spark, rates, "sliding"), "window_start", "window_end")


@query(
    "stream_silence_alerts",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
    l AS (SELECT user_id, session, MAX(ts) AS last_event, COUNT(*) AS events FROM s GROUP BY user_id, session)
    SELECT user_id, {time_text_sql('last_event')} AS last_event, {time_text_sql('last_event + INTERVAL 24 HOUR')} AS alert_at, events
    FROM l, {_MARK} m WHERE last_event + INTERVAL 24 HOUR <= mark""",
)
def stream_silence_alerts(spark, folder):
    alerts = W.silence_alerts(_stream(spark, folder), "user_id", "ts", 24)
    before = spark.conf.get(W.MERGE_SESSIONS)
    spark.conf.set(W.MERGE_SESSIONS, "true")
    try:
        found = _finished(spark, alerts, "silence")
    finally:
        spark.conf.set(W.MERGE_SESSIONS, before)
    return _timed(found, "last_event", "alert_at")


@query("stream_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, folder):
    # One batch, no eviction within it: one row per key.
    once = W.deduplicated(_stream(spark, folder), ["user_id", "event_type"], "ts").select("user_id", "event_type")
    return _finished(spark, once, "dedup")


@query(
    "stream_upsert",
    """SELECT user_id, event_id, event_type, value FROM events
       WHERE event_id IN (SELECT arg_max(event_id, event_id) FROM events GROUP BY user_id)""",
)
def stream_upsert(spark, folder):
    out = shared_folder(spark, "upsert")
    changes = _stream(spark, folder).select("user_id", "event_id", "event_type", "value")
    B.upsert_stream(changes, f"{out}/log", f"{out}/checkpoint")
    return B.current_rows(spark, f"{out}/log", ["user_id"], "event_id")


@query(
    "stream_check_run",
    """SELECT 'events' AS table_name, CASE WHEN SUM(CASE WHEN value > 400 THEN 1 ELSE 0 END) >= 10 THEN 'critical'
       WHEN SUM(CASE WHEN value > 400 THEN 1 ELSE 0 END) > 0 OR COUNT(*) > COUNT(user_id) THEN 'warning' ELSE 'pass' END AS status,
       CAST(3 AS BIGINT) AS checks FROM events""",
)
def stream_check_run(spark, folder):
    out = shared_folder(spark, "checkrun")
    check = TableCheck("events", row_count_min=1, anomaly_rules=(Rule("large", "value > 400"),), null_limits=(NullLimit("user_id"),))
    B.check_stream(_stream(spark, folder), check, AS_OF, f"{out}/history", f"{out}/checkpoint")
    return table_status(spark.read.parquet(f"{out}/history"))


def _arrivals(spark, folder, purpose, parts):
    """Events that come in several loads: the k-th holds all times, of every ``parts``-th event."""
    out = shared_folder(spark, purpose)
    events = table(spark, folder, "events")
    for k in range(parts):
        events.where(F.col("event_id") % parts == k).write.mode("append").parquet(f"{out}/in")
        yield out, S.file_stream(spark, f"{out}/in", events.schema, "ts"), k


@query(
    "stream_late_rows",
    f"""WITH loads AS (SELECT *, event_id % 4 AS load FROM events),
    marks AS (SELECT load, date_trunc('milliseconds', MAX(ts)) AS t FROM loads GROUP BY load),
    known AS (SELECT a.load, MAX(b.t) - INTERVAL 1 HOUR AS mark FROM marks a JOIN marks b ON b.load < a.load GROUP BY a.load)
    SELECT l.event_id, {time_text_sql('l.ts')} AS ts, l.user_id, l.event_type, l.value, l.props, {time_text_sql('mark')} AS mark,
           load AS batch_id FROM loads l JOIN known USING (load) WHERE l.ts <= mark""",
)
def stream_late_rows(spark, folder):
    for out, stream, _ in _arrivals(spark, folder, "late", 4):
        B.keep_late(stream, "ts", "1 hour", out, f"{out}/checkpoint")
    return _timed(B.late_rows(spark, out, stream.schema), "ts", "mark")


@query(
    "stream_upsert_compacted",
    """SELECT user_id, event_id, event_type, value FROM events WHERE event_id IN (
         SELECT arg_max(event_id, ROW(event_id % 4, event_id)) FROM events GROUP BY user_id)""",
)
def stream_upsert_compacted(spark, folder):
    """The log is folded into its base after the third load, while the fourth is still to come, and again at the end."""
    for out, stream, k in _arrivals(spark, folder, "compacted", 4):
        changes = stream.select("user_id", "event_id", "event_type", "value")
        B.upsert_stream(changes, f"{out}/log", f"{out}/checkpoint")
        if k >= 2:
            B.compact(spark, f"{out}/log", ["user_id"], "event_id")
    return B.current_rows(spark, f"{out}/log", ["user_id"], "event_id")


@query(
    "stream_sliding_refreshed",
    f"""WITH loads AS (SELECT *, event_id % 3 AS load FROM events),
    known AS (SELECT a.load, quantile_cont(b.value, 0.25) AS q1, quantile_cont(b.value, 0.75) AS q3
              FROM range(3) a(load) JOIN loads b ON b.load <= a.load GROUP BY a.load),
    w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS a,
                 value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS bad FROM loads JOIN known USING (load), range(2) r(k)),
    c AS (SELECT a, COUNT(*) AS total, COUNT(*) FILTER (WHERE bad) AS anomalies FROM w, {_MARK} m
          WHERE a + INTERVAL 2 DAY <= mark GROUP BY a)
    SELECT {time_text_sql('a')} AS window_start, {time_text_sql('a + INTERVAL 2 DAY')} AS window_end, total, anomalies,
           ROUND(100.0 * anomalies / total, 2) AS anomaly_rate FROM c""",
)
def stream_sliding_refreshed(spark, folder):
    """Bounds come from all events that have arrived when a batch is run."""
    for out, stream, _ in _arrivals(spark, folder, "refreshed", 3):
        B.flag_stream(stream, lambda out=out: iqr_thresholds(spark.read.parquet(f"{out}/in"), "value"), "value", f"{out}/flagged", f"{out}/checkpoint")
    flagged = S.file_stream(spark, f"{out}/flagged", spark.read.parquet(f"{out}/flagged").schema)
    return _timed(_finished(spark, W.flagged_rate(flagged, "ts"), "refreshed_rates"), "window_start", "window_end")
