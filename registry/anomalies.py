"""Outlier detection, drift and the forest."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from plumbspark.operators import anomaly as A
from plumbspark.operators import drift as D
from plumbspark.operators.distance import two_sample_distances
from registry.common import DIRTY_EVENTS_SQL, dirty_events, query, rounded, table

_DIRTY = f"WITH dirty AS ({DIRTY_EVENTS_SQL})"


def _iqr_sql(source: str, by: str = "") -> str:
    """Thresholds per group (``by`` ends with a comma) as a CTE named lim."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""q AS (SELECT {by}COUNT(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {source} {group}),
    lim AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q WHERE n >= 4)"""


_SCORE = "CASE WHEN value > upper_bound THEN value - q3 ELSE q1 - value END / NULLIF(iqr, 0)"


@query(
    "anomaly_iqr",
    f"""{_DIRTY}, {_iqr_sql('dirty')}
    SELECT event_id, ROUND(value, 6) AS value, ROUND({_SCORE}, 6) AS score, 'iqr' AS method
    FROM dirty, lim WHERE value < lower_bound OR value > upper_bound""",
)
def anomaly_iqr(spark, folder):
    return rounded(A.detect_anomalies(dirty_events(spark, folder), "value", ["event_id"]))


@query(
    "anomaly_iqr_thresholds",
    f"""{_DIRTY}, {_iqr_sql('dirty')}
    SELECT n, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(iqr, 6) AS iqr, ROUND(lower_bound, 6) AS lower_bound,
           ROUND(upper_bound, 6) AS upper_bound FROM lim""",
)
def anomaly_iqr_thresholds(spark, folder):
    return rounded(A.iqr_thresholds(dirty_events(spark, folder), "value"))


_Z = """z AS (SELECT COUNT(value) AS n, AVG(value) AS mean, stddev_samp(value) AS std FROM {0})"""


@query(
    "anomaly_zscore",
    f"""{_DIRTY}, {_Z.format('dirty')}
    SELECT event_id, ROUND(value, 6) AS value, ROUND(ABS((value - mean) / std), 6) AS score, 'zscore' AS method
    FROM dirty, z WHERE std > 0 AND ABS((value - mean) / std) > 3""",
)
def anomaly_zscore(spark, folder):
    return rounded(A.detect_anomalies(dirty_events(spark, folder), "value", ["event_id"], "zscore"))


@query(
    "anomaly_zscore_thresholds",
    f"""{_DIRTY}, {_Z.format('dirty')}
    SELECT n, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, CAST(3 AS DOUBLE) AS z_score_threshold FROM z""",
)
def anomaly_zscore_thresholds(spark, folder):
    return rounded(A.zscore_thresholds(dirty_events(spark, folder), "value"))


@query(
    "anomaly_iqr_documents",
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
    SELECT doc_id, CAST(n_chars AS DOUBLE) AS value, 'iqr' AS method,
           ROUND(CASE WHEN n_chars > q3 + 1.5 * (q3 - q1) THEN n_chars - q3 ELSE q1 - n_chars END / NULLIF(q3 - q1, 0), 6) AS score FROM documents, q
    WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""",
)
def anomaly_iqr_documents(spark, folder):
    return rounded(A.detect_anomalies(table(spark, folder, "documents"), "n_chars", ["doc_id"]))


@query(
    "anomaly_iqr_by_group",
    f"""{_DIRTY}, {_iqr_sql('dirty', 'event_type, ')}
    SELECT d.event_type, event_id, ROUND(value, 6) AS value, ROUND({_SCORE}, 6) AS score, 'iqr' AS method
    FROM dirty d JOIN lim ON d.event_type IS NOT DISTINCT FROM lim.event_type WHERE value < lower_bound OR value > upper_bound""",
)
def anomaly_iqr_by_group(spark, folder):
    return rounded(A.detect_anomalies(dirty_events(spark, folder), "value", ["event_id"], "iqr", by=["event_type"]))


@query(
    "anomaly_zscore_by_group",
    f"""{_DIRTY}, z AS (SELECT event_type, COUNT(value) AS n, AVG(value) AS mean, stddev_samp(value) AS std FROM dirty GROUP BY event_type)
    SELECT d.event_type, event_id, ROUND(value, 6) AS value, ROUND(ABS((value - mean) / std), 6) AS score, 'zscore' AS method
    FROM dirty d JOIN z ON d.event_type IS NOT DISTINCT FROM z.event_type WHERE std > 0 AND ABS((value - mean) / std) > 3""",
)
def anomaly_zscore_by_group(spark, folder):
    return rounded(A.detect_anomalies(dirty_events(spark, folder), "value", ["event_id"], "zscore", by=["event_type"]))


@query(
    "anomaly_detection_rate",
    f"""{_DIRTY}, {_iqr_sql('dirty')}
    SELECT COUNT(*) AS records_analyzed, COUNT(*) FILTER (WHERE value < lower_bound OR value > upper_bound) AS anomalies_detected,
           ROUND(100.0 * COUNT(*) FILTER (WHERE value < lower_bound OR value > upper_bound) / COUNT(*), 2) AS detection_rate
    FROM dirty, lim""",
)
def anomaly_detection_rate(spark, folder):
    return A.detection_summary(A.flag_anomalies(dirty_events(spark, folder), "value", "iqr"))


# The forest in SQL: the same hash sample, one common table expression per tree level.
_TREES, _ROWS, _SEED = 100, 256, 42


def _draw(text: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0"


def _expected(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"


def _forest_sql() -> str:
    wanted = _TREES * _ROWS
    out = f"""WITH n AS (SELECT COUNT(value) AS n FROM events),
    copies AS (SELECT unnest(range(1, CAST(greatest(ceil({wanted} / CAST(n AS DOUBLE)), 1) AS BIGINT) + 1)) AS copy FROM n),
    drawn AS (SELECT value AS v, CAST(event_id AS VARCHAR) AS id, copy,
              {_draw(f"concat_ws('|', CAST(event_id AS VARCHAR), CAST(copy AS VARCHAR), '{_SEED}')")} AS u FROM events, copies),
    ranked AS (SELECT *, row_number() OVER (ORDER BY u, id, copy) AS r FROM drawn),
    s0 AS (SELECT CAST(r % {_TREES} AS INTEGER) AS tree, v, CAST(1 AS BIGINT) AS node, CAST('-infinity' AS DOUBLE) AS low,
           0 AS depth, TRUE AS open FROM ranked WHERE r <= {wanted})"""
    for i in range(math.ceil(math.log2(_ROWS))):
        draw = _draw(f"concat_ws('|', CAST(tree AS VARCHAR), CAST(node AS VARCHAR), '{_SEED}')")
        out += f""",
    a{i} AS (SELECT *, min(v) OVER (PARTITION BY tree, node) AS lo, max(v) OVER (PARTITION BY tree, node) AS hi FROM s{i}),
    b{i} AS (SELECT tree, v, node, low, depth, open, lo, lo + {draw} * (hi - lo) AS split FROM a{i}),
    c{i} AS (SELECT tree, v, node, low, depth, split, open AND split > lo AS open FROM b{i}),
    s{i + 1} AS (SELECT tree, v, CASE WHEN open THEN node * 2 + CAST(v >= split AS INTEGER) ELSE node END AS node,
           CASE WHEN open AND v >= split THEN split ELSE low END AS low, depth + CAST(open AS INTEGER) AS depth, open FROM c{i})"""
    last = math.ceil(math.log2(_ROWS))
    size = "CAST(size AS DOUBLE)"
    rows = "CAST(tree_rows AS DOUBLE)"
    out += f""",
    leaves AS (SELECT tree, node, low, depth, COUNT(*) AS size FROM s{last} GROUP BY ALL),
    paths AS (SELECT tree, low, depth + {_expected(size)} AS path, SUM(size) OVER (PARTITION BY tree) AS tree_rows FROM leaves),
    jumps AS (SELECT *, path - COALESCE(lag(path) OVER (PARTITION BY tree ORDER BY low), 0) AS jump,
              lag(path) OVER (PARTITION BY tree ORDER BY low) IS NULL AS is_first FROM paths),
    norm AS (SELECT AVG({_expected(rows)}) AS norm, COUNT(*) AS trees FROM jumps WHERE is_first),
    steps AS (SELECT low, SUM(SUM(jump)) OVER (ORDER BY low) AS total FROM jumps GROUP BY low),
    scored AS (SELECT event_id, value, power(2.0, -(total / trees) / norm) AS score
               FROM events ASOF JOIN steps ON events.value >= steps.low, norm),
    cut AS (SELECT quantile_cont(score, 0.9) AS cut FROM scored)
    SELECT event_id, value, ROUND(score, 6) AS score, 'isolation_forest' AS method FROM scored, cut WHERE score > cut + 1e-12"""
    return out


@query("anomaly_iforest", _forest_sql())
def anomaly_iforest(spark, folder):
    return rounded(A.detect_anomalies(table(spark, folder, "events"), "value", ["event_id"], "isolation_forest"))


_CUT = datetime(2024, 1, 16)
_CUT_SQL = "TIMESTAMP '2024-01-16 00:00:00'"


def _periods(spark, folder):
    e = table(spark, folder, "events")
    cut = F.lit(_CUT).cast("timestamp_ntz")
    return e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut)


def _drift_stats(c: str, where: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, COUNT(*) AS n, 100.0 * (COUNT(*) - COUNT({c})) / COUNT(*) AS nulls,
      100.0 * COUNT(DISTINCT {c}) / COUNT(*) AS uniq, AVG({x}) AS mean, stddev_samp({x}) AS std,
      quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75 FROM events WHERE {where}"""


def _both(where: str) -> str:
    return " UNION ALL ".join(_drift_stats(c, where) for c in ("event_id", "user_id", "value"))


_BEFORE, _AFTER = f"ts < {_CUT_SQL}", f"ts >= {_CUT_SQL}"


@query(
    "drift_profile",
    f"""WITH a AS ({_both(_BEFORE)}), b AS ({_both(_AFTER)})
    SELECT column_name, a.n AS baseline_count, b.n AS current_count, ROUND(b.nulls - a.nulls, 6) AS null_percentage_delta,
      ROUND(b.uniq - a.uniq, 6) AS unique_percentage_delta, ROUND(b.mean - a.mean, 6) AS mean_value_delta,
      ROUND(b.std - a.std, 6) AS std_value_delta, ROUND(b.q25 - a.q25, 6) AS q25_value_delta,
      ROUND(b.q50 - a.q50, 6) AS median_value_delta, ROUND(b.q75 - a.q75, 6) AS q75_value_delta FROM a JOIN b USING (column_name)""",
)
def drift_profile(spark, folder):
    before, after = _periods(spark, folder)
    return rounded(D.drift_profile(before, after, ["event_id", "user_id", "value"]))


def _bin_sql(value: str, lo: str, hi: str, bins: int) -> str:
    inside = f"greatest(least(floor(({value} - {lo}) * {bins} / ({hi} - {lo})), {bins - 1}), 0)"
    return f"CAST(CASE WHEN {hi} <= {lo} THEN 0 ELSE {inside} END AS INTEGER)"


@query(
    "drift_psi",
    f"""WITH span AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events WHERE {_BEFORE}),
    binned AS (SELECT {_bin_sql('value', 'lo', 'hi', 10)} AS bin, ts < {_CUT_SQL} AS old FROM events, span),
    counts AS (SELECT bin, COUNT(*) FILTER (WHERE old) AS o, COUNT(*) FILTER (WHERE NOT old) AS n FROM binned GROUP BY bin),
    total AS (SELECT CAST(SUM(o) AS DOUBLE) AS o, CAST(SUM(n) AS DOUBLE) AS n FROM counts),
    shares AS (SELECT greatest(COALESCE(c.o / total.o, 0), 0.0001) AS p, greatest(COALESCE(c.n / total.n, 0), 0.0001) AS q
               FROM range(10) r(bin) LEFT JOIN counts c ON r.bin = c.bin, total)
    SELECT 'value' AS column_name, ROUND(SUM((p - q) * ln(p / q)), 6) AS psi FROM shares""",
)
def drift_psi(spark, folder):
    before, after = _periods(spark, folder)
    return rounded(D.population_stability(before, after, "value"))


def _distance_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, MAX(n_a) AS n_baseline, MAX(n_b) AS n_current, ROUND(MAX(gap), 6) AS ks,
      arg_min(v, ROW(-gap, v)) AS ks_at, ROUND(SUM(gap * (next - v)), 6) AS wasserstein FROM (
        SELECT v, n_a, n_b, lead(v) OVER (ORDER BY v) AS next, ABS(SUM(a) OVER (ORDER BY v) / n_a - SUM(b) OVER (ORDER BY v) / n_b) AS gap FROM (
          SELECT CAST({c} AS DOUBLE) AS v, CAST(COUNT(*) FILTER (WHERE {_BEFORE}) AS DOUBLE) AS a, CAST(COUNT(*) FILTER (WHERE {_AFTER}) AS DOUBLE) AS b
          FROM ({DIRTY_EVENTS_SQL}) WHERE {c} IS NOT NULL GROUP BY 1), (
          SELECT COUNT({c}) FILTER (WHERE {_BEFORE}) AS n_a, COUNT({c}) FILTER (WHERE {_AFTER}) AS n_b FROM ({DIRTY_EVENTS_SQL})))"""


@query("drift_ks", "\nUNION ALL ".join(_distance_sql(c) for c in ("event_id", "user_id", "value")))
def drift_ks(spark, folder):
    cut = F.lit(_CUT).cast("timestamp_ntz")
    e = dirty_events(spark, folder)
    return rounded(two_sample_distances(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["event_id", "user_id", "value"]))


@query(
    "anomaly_by_method",
    f"""{_DIRTY}, {_iqr_sql('dirty')}, z AS (SELECT AVG(value) AS mean, stddev_samp(value) AS std FROM dirty)
    SELECT 'iqr' AS method, COUNT(*) AS flagged, ROUND(MIN(value), 6) AS lowest, ROUND(MAX(value), 6) AS highest FROM dirty, lim
    WHERE value < lower_bound OR value > upper_bound
    UNION ALL SELECT 'zscore', COUNT(*), ROUND(MIN(value), 6), ROUND(MAX(value), 6) FROM dirty, z WHERE ABS((value - mean) / std) > 3
    UNION ALL SELECT 'unknown', 0, NULL, NULL
    UNION ALL SELECT 'bounds', COUNT(*), ROUND(MIN(value), 6), ROUND(MAX(value), 6) FROM dirty WHERE value < 1 OR value > 300""",
)
def anomaly_by_method(spark, folder):
    """Methods by name: two built-in ones, one that is added here, and one that nobody knows."""
    events = dirty_events(spark, folder)

    def bounds(df, column, by=(), low=1.0, high=300.0):
        v = F.nanvl(F.col(column), F.lit(None).cast("double"))
        off = F.greatest(low - v, v - high)
        return df.withColumn("__value", v).withColumn("__score", off).withColumn("is_anomaly", F.coalesce(off > 0, F.lit(False)))

    def counted(method):
        found = A.detect_anomalies(events, "value", ["event_id"], method)
        return found.agg(
            F.lit(method).alias("method"), F.count(F.lit(1)).alias("flagged"), F.min("value").alias("lowest"), F.max("value").alias("highest")
        )

    A.register_detector("bounds", bounds)
    try:
        out = counted("iqr").unionByName(counted("zscore")).unionByName(counted("bounds"))
        try:
            A.detect_anomalies(events, "value", ["event_id"], "unknown")
        except ValueError:
            none = spark.createDataFrame([("unknown", 0, None, None)], "method string, flagged bigint, lowest double, highest double")
            out = out.unionByName(none)
    finally:
        del A.DETECTORS["bounds"]
    return rounded(out)
