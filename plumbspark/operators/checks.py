"""Table checks with a severity ladder.

All rules of one table that are aggregates of its rows (counts, latest
timestamp, predicate counts, null counts) share ONE aggregate, so a table is
scanned once however many rules it has. Schema rules read metadata only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.functions.columns import clean_column, cleaned, hours_between, moment, naive, quoted
from plumbspark.functions.ranking import top_k
from plumbspark.functions.sizes import broadcast_if_small

# Order of severity, worst last. An error ranks below a warning.
STATUS_RANK = {"pass": 0, "error": 1, "warning": 2, "critical": 3}

# Fixed value: from this many anomalies over all rules of a table on, the table is critical.
MANY_ANOMALIES = 10


@dataclass(frozen=True)
class Rule:
    """Rows that match ``predicate`` are anomalies; ``sql`` is the free form (one ``count`` column)."""

    name: str
    predicate: str | Column | None = None
    expected_max: int = 0
    sql: str | None = None

    def __post_init__(self):
        if (self.predicate is None) == (self.sql is None):
            raise ValueError(f"rule {self.name}: give either a predicate or sql")

    def condition(self) -> Column:
        return F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate


@dataclass(frozen=True)
class Freshness:
    timestamp_column: str
    max_age_hours: float


@dataclass(frozen=True)
class NullLimit:
    column: str
    threshold: int = 0


@dataclass(frozen=True)
class TableCheck:
    """What to check on one table; parts left out are not checked."""

    table_name: str
    row_count_min: int | None = None
    row_count_range: tuple[int | None, int | None] | None = None
    freshness: Freshness | None = None
    anomaly_rules: Sequence[Rule] = field(default_factory=tuple)
    null_limits: Sequence[NullLimit] = field(default_factory=tuple)
    expected_columns: Sequence[str] | None = None

    @classmethod
    def from_config(cls, config: Mapping) -> TableCheck:
        """Read the nested-dict form of a run configuration."""
        rows = config.get("row_count_check")
        fresh = config.get("freshness_check")
        rules = config.get("anomaly_checks", ())
        schema = config.get("schema_check")
        span = config.get("row_count_range")
        return cls(
            table_name=config["table_name"],
            row_count_min=None if rows is None else rows.get("expected_min", 0),
            row_count_range=None if span is None else (span.get("min_rows"), span.get("max_rows")),
            freshness=None
            if fresh is None
            else Freshness(fresh["timestamp_column"], fresh["max_age_hours"]),
            anomaly_rules=tuple(
                Rule(r["name"], r.get("predicate"), r.get("expected_max", 0), r.get("sql")) for r in rules
            ),
            null_limits=tuple(
                NullLimit(n["column"], n.get("threshold", 0)) for n in config.get("null_checks", ())
            ),
            expected_columns=None if schema is None else tuple(schema["expected_columns"]),
        )


def row_count_status(n: Column, least: int) -> Column:
    return F.when(n >= least, "pass").when(n == 0, "critical").otherwise("warning")


def row_count_range_status(n: Column, least: int | None, most: int | None) -> Column:
    inside = F.lit(True)
    if least is not None:
        inside = inside & (n >= least)
    if most is not None:
        inside = inside & (n <= most)
    return F.when(inside, "pass").when(n == 0, "critical").otherwise("warning")


def age_status(hours: Column, limit: float) -> Column:
    return (
        F.when(hours.isNull(), "warning")
        .when(hours > limit * 2, "critical")
        .when(hours > limit, "warning")
        .otherwise("pass")
    )


def anomaly_status(n: Column, expected_max: Column) -> Column:
    return (
        F.when(n > expected_max * 2, "critical").when(n > expected_max, "warning").otherwise("pass")
    )


def overall_anomaly_status(total: Column) -> Column:
    """Over all rules of a table; the rules' own limits play no part here."""
    return F.when(total >= MANY_ANOMALIES, "critical").when(total > 0, "warning").otherwise("pass")


def _as_time(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return naive(c.cast("timestamp"))  # ISO text, with or without a zone suffix
    return naive(c)


def _check_row(name, status, metric, threshold, message) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        status.alias("status"),
        metric.cast("double").alias("metric"),
        F.lit(threshold).cast("double").alias("threshold"),
        message.alias("message"),
    )


def _say(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def fused_aggregates(df: DataFrame, check: TableCheck) -> DataFrame:
    """The one-row aggregate behind every scanned rule of a table; NaN is a missing value in all of them."""
    df = cleaned(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    if check.freshness:
        aggs.append(F.max(quoted(check.freshness.timestamp_column)).alias("latest"))
    for i, rule in enumerate(check.anomaly_rules):
        if rule.sql is None:
            aggs.append(F.count_if(rule.condition()).alias(f"rule{i}"))
    for i, limit in enumerate(check.null_limits):
        aggs.append(F.count_if(clean_column(df, limit.column).isNull()).alias(f"nulls{i}"))
    out = df.agg(*aggs)
    for i, rule in enumerate(check.anomaly_rules):
        if rule.sql is not None:
            wrong = F.raise_error(F.lit(f"the SQL of rule {rule.name} must give one row")).cast("bigint")
            one = F.when(F.count(F.lit(1)) == 1, F.max("count").cast("bigint")).otherwise(wrong)
            free = df.sparkSession.sql(rule.sql).agg(one.alias("count"))
            out = out.withColumn(f"rule{i}", F.coalesce(free.scalar(), F.lit(0)))
    return out


def _needs_scan(check: TableCheck) -> bool:
    return bool(
        check.row_count_min is not None
        or check.row_count_range is not None
        or check.freshness
        or check.anomaly_rules
        or check.null_limits
    )


def _rule_counts(check: TableCheck) -> list[Column]:
    return [F.col(f"rule{i}") for i in range(len(check.anomaly_rules))]


def _total(check: TableCheck) -> Column:
    out = F.lit(0).cast("bigint")
    for c in _rule_counts(check):
        out = out + c
    return out


def table_checks(df: DataFrame, check: TableCheck, as_of) -> DataFrame:
    """One row per check: row count, freshness, anomalies, nulls, schema, in that order."""
    rows: list[Column] = []
    n = F.col("n")
    if check.row_count_min is not None:
        rows.append(
            _check_row(
                "row_count",
                row_count_status(n, check.row_count_min),
                n,
                check.row_count_min,
                _say(n, " rows, at least ", check.row_count_min, " expected"),
            )
        )
    if check.row_count_range is not None:
        least, most = check.row_count_range
        rows.append(
            _check_row(
                "row_count_range",
                row_count_range_status(n, least, most),
                n,
                most,
                _say(n, " rows, expected between ", least, " and ", most),
            )
        )
    if check.freshness:
        dtype = df.schema[check.freshness.timestamp_column].dataType.simpleString()
        hours = hours_between(_as_time(F.col("latest"), dtype), moment(as_of))
        rows.append(
            _check_row(
                "freshness",
                age_status(hours, check.freshness.max_age_hours),
                F.round(hours, 2),
                check.freshness.max_age_hours,
                F.when(hours.isNull(), F.lit("no timestamp data")).otherwise(
                    _say("latest row is ", F.round(hours, 1), " hours old")
                ),
            )
        )
    if check.anomaly_rules:
        total = _total(check)
        rows.append(
            _check_row(
                "anomalies",
                overall_anomaly_status(total),
                total,
                sum(r.expected_max for r in check.anomaly_rules),
                _say(total, " anomalies over ", len(check.anomaly_rules), " rules"),
            )
        )
    for i, limit in enumerate(check.null_limits):
        nulls = F.col(f"nulls{i}")
        rows.append(
            _check_row(
                f"nulls:{limit.column}",
                F.when(nulls <= limit.threshold, "pass").otherwise("warning"),
                nulls,
                limit.threshold,
                _say(nulls, " nulls in ", limit.column),
            )
        )
    source = fused_aggregates(df, check) if _needs_scan(check) else df.sparkSession.range(0, 1, 1, 1)
    if check.expected_columns is not None:
        status, missing, extra = schema_difference(df.columns, check.expected_columns)
        rows.append(
            _check_row(
                "schema",
                F.lit(status),
                F.lit(len(missing) + len(extra)),
                0,
                _say(len(missing), " missing, ", len(extra), " extra columns"),
            )
        )
    if not rows:
        raise ValueError(f"nothing to check on {check.table_name}")
    listed = source.select(F.inline(F.array(*rows)))
    return listed.select(F.lit(check.table_name).alias("table_name"), "*")


def anomaly_rule_results(df: DataFrame, check: TableCheck) -> DataFrame:
    """One row per rule: its count against its own limit."""
    one = fused_aggregates(df, check)
    rows = [
        F.struct(
            F.lit(r.name).alias("check_name"),
            c.cast("bigint").alias("anomaly_count"),
            F.lit(r.expected_max).cast("bigint").alias("expected_max"),
            anomaly_status(c, F.lit(r.expected_max)).alias("status"),
        )
        for r, c in zip(check.anomaly_rules, _rule_counts(check), strict=True)
    ]
    return one.select(F.inline(F.array(*rows))).select(F.lit(check.table_name).alias("table_name"), "*")


def anomaly_overall(df: DataFrame, check: TableCheck) -> DataFrame:
    total = _total(check)
    return fused_aggregates(df, check).select(
        F.lit(check.table_name).alias("table_name"),
        total.alias("total_anomalies"),
        overall_anomaly_status(total).alias("overall_status"),
    )


def schema_difference(actual: Sequence[str], expected: Sequence[str]) -> tuple[str, list[str], list[str]]:
    missing = sorted(set(expected) - set(actual))
    extra = sorted(set(actual) - set(expected))
    status = "critical" if missing else "warning" if extra else "pass"
    return status, missing, extra


def schema_check(df: DataFrame, table_name: str, expected: Sequence[str]) -> DataFrame:
    """Missing and extra columns of a table as one row with two sorted arrays."""
    status, missing, extra = schema_difference(df.columns, expected)
    return df.sparkSession.createDataFrame(
        [(table_name, status, missing, extra)],
        "table_name STRING, status STRING, missing_columns ARRAY<STRING>, extra_columns ARRAY<STRING>",
    )


def schema_type_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two ``table_info`` frames: added, removed, type or nullability changed."""
    old = baseline.select("column_name", F.col("data_type").alias("old_type"), F.col("is_nullable").alias("old_null"))
    new = current.select("column_name", F.col("data_type").alias("new_type"), F.col("is_nullable").alias("new_null"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
        .when(F.col("old_null") != F.col("new_null"), "nullability_changed")
    )
    severity = F.when(F.col("change").isin("removed", "type_changed"), "high").otherwise("medium")
    return (
        old.join(new, "column_name", "full_outer")
        .withColumn("change", change)
        .filter("change IS NOT NULL")
        .select("column_name", "change", "old_type", "new_type", severity.alias("severity"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row. Keys with a NULL never collide."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(quoted(k)).isNotNull()
    return (
        df.filter(complete)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter("duplicate_count > 1")
    )


def null_checks(df: DataFrame, limits: Sequence[NullLimit]) -> DataFrame:
    one = df.agg(*[F.count_if(clean_column(df, x.column).isNull()).alias(f"n{i}") for i, x in enumerate(limits)])
    rows = [
        F.struct(
            F.lit(x.column).alias("column_name"),
            F.col(f"n{i}").alias("null_count"),
            F.lit(x.threshold).cast("bigint").alias("threshold"),
            F.when(F.col(f"n{i}") <= x.threshold, "pass").otherwise("warning").alias("status"),
        )
        for i, x in enumerate(limits)
    ]
    return one.select(F.inline(F.array(*rows)))


def min_length(column: str, least: int) -> str:
    return f"length({quoted(column)}) >= {int(least)}"


def positive(column: str) -> str:
    return f"{quoted(column)} > 0"


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(quoted(column)).isin(list(values))


# Fixed value: the e-mail pattern of the row constraint.
#: Fixed value: what an e-mail address has to look like.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def email_like(column: str) -> Column:
    return F.col(quoted(column)).rlike("(?i)" + EMAIL_PATTERN)


def violation_count(constraint: str | Column) -> Column:
    """Rows that break a constraint. A NULL outcome does not."""
    condition = F.expr(constraint) if isinstance(constraint, str) else constraint
    return F.count_if(~F.coalesce(condition, F.lit(True)))


def violations(df: DataFrame, constraints: Mapping[str, str | Column]) -> DataFrame:
    """Violating rows per named constraint, in one scan; NaN is a missing value."""
    names = list(constraints)
    one = cleaned(df).agg(*[violation_count(c).alias(f"v{i}") for i, c in enumerate(constraints.values())])
    rows = [
        F.struct(
            F.lit(name).alias("constraint_name"),
            F.col(f"v{i}").alias("violations"),
            F.when(F.col(f"v{i}") == 0, "pass").otherwise("critical").alias("status"),
        )
        for i, name in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def foreign_key_violations(
    child: DataFrame,
    columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
) -> DataFrame:
    """Child rows whose complete key has no parent.

    The parent's keys are measured: few are broadcast, so the
    child stays where it is; many are joined by key.
    """
    keys = parent.select(*[F.col(quoted(p)).alias(f"__p{i}") for i, p in enumerate(parent_columns)])
    complete, same = F.lit(True), F.lit(True)
    for i, c in enumerate(columns):
        complete = complete & F.col(quoted(c)).isNotNull()
        same = same & (F.col(quoted(c)) == F.col(f"__p{i}"))
    return child.filter(complete).join(broadcast_if_small(keys), same, "left_anti")


def rule_samples(df: DataFrame, check: TableCheck, id_cols: Sequence[str], k: int = 5) -> DataFrame:
    """Per rule up to ``k`` matching rows (lowest ids) as JSON: input of the anomaly history."""
    rules = [r for r in check.anomaly_rules if r.sql is None]
    if not rules:
        raise ValueError("samples need predicate rules")
    hit = F.array_compact(
        F.array(*[F.when(F.coalesce(r.condition(), F.lit(False)), F.lit(r.name)) for r in rules])
    )
    data = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]))
    hits = cleaned(df).select(*id_cols, F.explode(hit).alias("anomaly_type"), data.alias("data_sample"))
    return top_k(hits, ["anomaly_type"], [F.col(quoted(c)).asc() for c in id_cols], k, "sample_no").select(
        F.lit(check.table_name).alias("table_name"), "anomaly_type", "sample_no", *id_cols, "data_sample"
    )


def error_rows(spark: SparkSession, table_name: str, check_name: str, message: str) -> DataFrame:
    """The one row of a check that could not be made."""
    return spark.range(0, 1, 1, 1).select(
        F.lit(table_name).alias("table_name"),
        F.lit(check_name).alias("check_name"),
        F.lit("error").alias("status"),
        F.lit(None).cast("double").alias("metric"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(message).alias("message"),
    )
