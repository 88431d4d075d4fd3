"""Outlier detection against thresholds, over a whole column or per group.

Thresholds of a whole column are a one-row aggregate that reaches the filter as
a scalar subquery. Thresholds per group are attached by group: broadcast while
the groups are small (measured in bytes), joined on the group beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.columns import clean_double, percent, quoted
from plumbspark.functions.groups import attach, attach_one, few_groups
from plumbspark.functions.quantiles import approx_quantiles, exact_quantiles

IQR_FACTOR = 1.5
IQR_MIN_ROWS = 4
ZSCORE_LIMIT = 3.0
ZSCORE_MIN_ROWS = 2


def iqr_thresholds(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    exact: bool = True,
    rows: int | None = None,
    few: bool | None = None,
) -> DataFrame:
    """``[*by, n, q1, q3, iqr, lower_bound, upper_bound]``; NULL bounds below four values."""
    value = clean_double(df, column)
    if exact:
        quartiles = exact_quantiles(df, value, [0.25, 0.75], ["q1", "q3"], by=by, rows=rows, few=few)
    else:
        quartiles = approx_quantiles(df, value, [0.25, 0.75], ["q1", "q3"], by=by)
    enough = F.col("n") >= IQR_MIN_ROWS
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        *by,
        "n",
        F.when(enough, F.col("q1")).alias("q1"),
        F.when(enough, F.col("q3")).alias("q3"),
        F.when(enough, iqr).alias("iqr"),
        F.when(enough, F.col("q1") - IQR_FACTOR * iqr).alias("lower_bound"),
        F.when(enough, F.col("q3") + IQR_FACTOR * iqr).alias("upper_bound"),
    )


def zscore_thresholds(
    df: DataFrame, column: str, by: Sequence[str] = (), limit: float = ZSCORE_LIMIT
) -> DataFrame:
    """``[*by, n, mean, std, z_score_threshold]``; NULL below two values."""
    value = clean_double(df, column)
    data = df.select(*by, value.alias("__v"))
    enough = F.col("n") >= ZSCORE_MIN_ROWS
    return (
        data.groupBy(*by)
        .agg(F.count("__v").alias("n"), F.avg("__v").alias("m"), F.stddev_samp("__v").alias("s"))
        .select(
            *by,
            "n",
            F.when(enough, F.col("m")).alias("mean"),
            F.when(enough, F.col("s")).alias("std"),
            F.lit(float(limit)).alias("z_score_threshold"),
        )
    )


def _with_thresholds(
    df: DataFrame, limits: DataFrame, names: Sequence[str], by: Sequence[str], few: bool | None
) -> DataFrame:
    if not by:
        return attach_one(df, limits, names)
    return attach(df, limits, by, names, few)


def flag_iqr(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    exact: bool = True,
    rows: int | None = None,
    few: bool | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """All rows plus ``__value``, ``__score`` (iqr widths beyond the near quartile), ``is_anomaly``."""
    if by and few is None:
        few = few_groups(df, by)
    limits = iqr_thresholds(df, column, by, exact, rows, few) if limits is None else limits
    data = _with_thresholds(df, limits, ["q1", "q3", "iqr", "lower_bound", "upper_bound"], by, few)
    value = clean_double(df, column)
    low, high = value < F.col("lower_bound"), value > F.col("upper_bound")
    beyond = F.when(high, value - F.col("q3")).when(low, F.col("q1") - value)
    return data.select(
        *[F.col(quoted(c)) for c in df.columns],
        value.alias("__value"),
        F.try_divide(beyond, F.col("iqr")).alias("__score"),
        F.coalesce(low | high, F.lit(False)).alias("is_anomaly"),
    )


def flag_zscore(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    limit: float = ZSCORE_LIMIT,
    few: bool | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """All rows plus ``__value``, ``__score`` (absolute z-score; NULL where an infinite value leaves none) and ``is_anomaly``."""
    limits = zscore_thresholds(df, column, by, limit) if limits is None else limits
    data = _with_thresholds(df, limits, ["mean", "std"], by, few)
    value = clean_double(df, column)
    score = F.nanvl(F.abs(F.try_divide(value - F.col("mean"), F.col("std"))), F.lit(None))
    return data.select(
        *[F.col(quoted(c)) for c in df.columns],
        value.alias("__value"),
        score.alias("__score"),
        F.coalesce(score > limit, F.lit(False)).alias("is_anomaly"),
    )


def _flag_forest(df: DataFrame, column: str, by: Sequence[str] = (), **options) -> DataFrame:
    from plumbspark.operators.isolation_forest import flag_isolation_forest

    if by:
        raise ValueError("the isolation forest works on a whole column")
    return flag_isolation_forest(df, column, **options)


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "iqr": flag_iqr,
    "zscore": flag_zscore,
    "isolation_forest": _flag_forest,
}


def register_detector(name: str, flag: Callable[..., DataFrame]) -> None:
    """Add a method: a callable returning the rows with __value, __score and is_anomaly."""
    DETECTORS[name] = flag


def flag_anomalies(df: DataFrame, column: str, method: str = "iqr", by: Sequence[str] = (), **options) -> DataFrame:
    if method not in DETECTORS:
        raise ValueError(f"unknown anomaly detection method: {method}")
    return DETECTORS[method](df, column, by=by, **options)


def detect_anomalies(
    df: DataFrame,
    column: str,
    id_cols: Sequence[str],
    method: str = "iqr",
    by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Only the flagged rows: ``[*by, *id_cols, value, score, method]``."""
    if method == "isolation_forest":
        options.setdefault("id_cols", list(id_cols))
    keep = [*by, *[c for c in id_cols if c not in by]]
    return (
        flag_anomalies(df, column, method, by, **options)
        .filter("is_anomaly")
        .select(*keep, F.col("__value").alias("value"), F.col("__score").alias("score"), F.lit(method).alias("method"))
    )


def detection_summary(flagged: DataFrame) -> DataFrame:
    """Records analysed, anomalies found and the rate in percent, from flagged rows."""
    return flagged.agg(
        F.count(F.lit(1)).alias("records_analyzed"),
        F.count_if("is_anomaly").alias("anomalies_detected"),
    ).withColumn(
        "detection_rate", F.round(percent(F.col("anomalies_detected"), F.col("records_analyzed")), 2)
    )
