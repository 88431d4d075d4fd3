"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbspark.functions.shared_dir import shared_folder
from plumbspark.operators import profile as P
from plumbspark.operators import profile_state as S
from registry.common import DIRTY_EVENTS_SQL, dirty_events, query, rounded, table, time_text, time_text_sql

_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string",
}
_KINDS = {
    "bigint": "numeric", "double": "numeric", "string": "categorical", "timestamp_ntz": "datetime", "int": "numeric",
    "array<float>": "other",
}


def _base_sql(source: str, types: dict[str, str], label: str | None = None) -> str:
    first = f"'{label}' AS table_name, " if label else ""
    parts = [
        f"""SELECT {first}'{c}' AS column_name, '{t}' AS data_type, '{_KINDS[t]}' AS kind, COUNT(*) AS total_count,
            COUNT(*) - COUNT({c}) AS null_count, ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS null_percentage,
            COUNT(DISTINCT {c}) AS unique_count, ROUND(100.0 * COUNT(DISTINCT {c}) / COUNT(*), 6) AS unique_percentage
            FROM {source}"""
        for c, t in types.items()
    ]
    return "\nUNION ALL ".join(parts)


_DIRTY = f"WITH dirty AS ({DIRTY_EVENTS_SQL})\n"


@query("profile_base", _DIRTY + _base_sql("dirty", _TYPES))
def profile_base(spark, folder):
    return rounded(P.base_profile(dirty_events(spark, folder)))


def _numeric_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT '{c}' AS column_name, MIN({x}) AS min_value, MAX({x}) AS max_value, ROUND(AVG({x}), 6) AS mean_value,
            ROUND(quantile_cont({x}, 0.5), 6) AS median_value, ROUND(stddev_samp({x}), 6) AS std_value,
            ROUND(quantile_cont({x}, 0.25), 6) AS q25_value, ROUND(quantile_cont({x}, 0.75), 6) AS q75_value,
            ROUND(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 6) AS iqr_value,
            ROUND(skewness({x}), 6) AS skewness, ROUND(kurtosis({x}), 6) AS kurtosis FROM {source}"""
        )
    return "\nUNION ALL ".join(parts)


@query("profile_numeric", _DIRTY + _numeric_sql("dirty", ["event_id", "user_id", "value"]))
def profile_numeric(spark, folder):
    return rounded(P.numeric_profile(dirty_events(spark, folder)))


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric_lineitem", _numeric_sql("lineitem", _LINE_NUMBERS))
def profile_numeric_lineitem(spark, folder):
    return rounded(P.numeric_profile(table(spark, folder, "lineitem")))


_TOP_SQL = "\nUNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, {tie}) AS INTEGER) AS rank,
        {c} AS value, COUNT(*) AS count FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
    for c, tie in (("lang", "lang"), ("source", "source"), ("text", "sha256(text)"))
)


@query("profile_top_values", _TOP_SQL)
def profile_top_values(spark, folder):
    top = P.top_values(table(spark, folder, "documents"), ["lang", "source", "text"], long_text=["text"])
    return top.select("column_name", "rank", "value", "count")


def _categorical_sql(source: str, columns: list[str], long_text: tuple[str, ...] = ()) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, string_agg(value || ':' || count, ',' ORDER BY r) AS top_values,
        arg_min(value, r) AS top_value, arg_min(count, r) AS top_value_count,
        ROUND(100.0 * arg_min(count, r) / (SELECT COUNT({c}) FROM {source}), 6) AS top_value_percentage
        FROM (SELECT {c} AS value, COUNT(*) AS count, row_number() OVER (ORDER BY COUNT(*) DESC, {f"sha256({c})" if c in long_text else c}) AS r
              FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= 10"""
        for c in columns
    )


_CATEGORICAL_SQL = _categorical_sql("dirty", ["event_type", "props"])


def _texts(profile):
    """Times, and lists of frequent values, as text."""
    if "min_date" in profile.columns:
        profile = profile.withColumn("min_date", time_text(F.col("min_date"))).withColumn("max_date", time_text(F.col("max_date")))
    return rounded(profile.withColumn("top_values", P.top_text(F.col("top_values"))))


@query("profile_categorical", _DIRTY + _CATEGORICAL_SQL)
def profile_categorical(spark, folder):
    return _texts(P.categorical_profile(dirty_events(spark, folder)))


def _dates_sql(source: str, columns: list[str]) -> str:
    def mode(x: str) -> str:
        return f"(SELECT CAST(x AS INTEGER) FROM (SELECT {x} AS x, COUNT(*) AS n FROM {source} GROUP BY 1) ORDER BY n DESC, x LIMIT 1)"

    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {time_text_sql(f'MIN({c})')} AS min_date, {time_text_sql(f'MAX({c})')} AS max_date,
        CAST(FLOOR((epoch(MAX({c})) - epoch(MIN({c}))) / 86400) AS BIGINT) AS date_range_days,
        {mode(f'year({c})')} AS most_common_year, {mode(f'month({c})')} AS most_common_month,
        {mode(f'isodow({c}) - 1')} AS most_common_day_of_week FROM {source}"""
        for c in columns
    )


_DATES_SQL = _dates_sql("events", ["ts"])


@query("profile_datetime", _DATES_SQL)
def profile_datetime(spark, folder):
    p = P.datetime_profile(table(spark, folder, "events"))
    return p.withColumn("min_date", time_text(F.col("min_date"))).withColumn("max_date", time_text(F.col("max_date")))


@query(
    "profile_table",
    """SELECT 'events' AS table_name, COUNT(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns,
       ROUND((COUNT(*) * 32 + SUM(strlen(event_type)) + SUM(strlen(props))) / 1048576.0, 6) AS memory_usage_mb FROM events""",
)
def profile_table(spark, folder):
    return rounded(P.table_profile(table(spark, folder, "events"), "events"))


def _list_sql(condition: str) -> str:
    return f"COALESCE(string_agg(CASE WHEN {condition} THEN column_name END, ',' ORDER BY column_name), '')"


@query(
    "profile_summary",
    f"""{_DIRTY}, base AS ({_base_sql('dirty', _TYPES)})
    SELECT 'events' AS table_name, {_list_sql("kind = 'numeric'")} AS numeric_columns,
           {_list_sql("kind = 'categorical'")} AS categorical_columns, {_list_sql("kind = 'datetime'")} AS datetime_columns,
           {_list_sql('unique_percentage > 80')} AS high_cardinality_columns,
           {_list_sql('null_percentage > 20')} AS high_null_columns FROM base""",
)
def profile_summary(spark, folder):
    base = P.base_profile(dirty_events(spark, folder)).withColumn("table_name", F.lit("events"))
    s = P.table_summary(base)
    return s.select("table_name", *[F.array_join(c, ",").alias(c) for c in s.columns if c != "table_name"])


_KEY = "bigint"
_ALL = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": _KEY, "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": _KEY, "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": _KEY, "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {
        "o_orderkey": _KEY, "o_custkey": _KEY, "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": _KEY, "l_partkey": _KEY, "l_suppkey": _KEY, "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "events": _TYPES,
    "documents": {"doc_id": _KEY, "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": _KEY, "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": _KEY, "url": "string", "html": "string"},
    "benchmark": {"item_id": _KEY, "text": "string"},
    "labels": {"doc_id": _KEY, "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": _KEY, "turn": "bigint", "role": "string", "text": "string"},
}


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric_lineitem", _numeric_sql("lineitem", _LINE_NUMBERS))
def profile_numeric_lineitem(spark, folder):
    return rounded(P.numeric_profile(table(spark, folder, "lineitem")))


_TOP_SQL = "\nUNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, {tie}) AS INTEGER) AS rank,
        {c} AS value, COUNT(*) AS count FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
    for c, tie in (("lang", "lang"), ("source", "source"), ("text", "sha256(text)"))
)


@query("profile_top_values", _TOP_SQL)
def profile_top_values(spark, folder):
    top = P.top_values(table(spark, folder, "documents"), ["lang", "source", "text"], long_text=["text"])
    return top.select("column_name", "rank", "value", "count")


def _categorical_sql(source: str, columns: list[str], long_text: tuple[str, ...] = ()) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, string_agg(value || ':' || count, ',' ORDER BY r) AS top_values,
        arg_min(value, r) AS top_value, arg_min(count, r) AS top_value_count,
        ROUND(100.0 * arg_min(count, r) / (SELECT COUNT({c}) FROM {source}), 6) AS top_value_percentage
        FROM (SELECT {c} AS value, COUNT(*) AS count, row_number() OVER (ORDER BY COUNT(*) DESC, {f"sha256({c})" if c in long_text else c}) AS r
              FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= 10"""
        for c in columns
    )


_CATEGORICAL_SQL = _categorical_sql("dirty", ["event_type", "props"])


def _texts(profile):
    """Times, and lists of frequent values, as text."""
    if "min_date" in profile.columns:
        profile = profile.withColumn("min_date", time_text(F.col("min_date"))).withColumn("max_date", time_text(F.col("max_date")))
    return rounded(profile.withColumn("top_values", P.top_text(F.col("top_values"))))


@query("profile_categorical", _DIRTY + _CATEGORICAL_SQL)
def profile_categorical(spark, folder):
    return _texts(P.categorical_profile(dirty_events(spark, folder)))


def _dates_sql(source: str, columns: list[str]) -> str:
    def mode(x: str) -> str:
        return f"(SELECT CAST(x AS INTEGER) FROM (SELECT {x} AS x, COUNT(*) AS n FROM {source} GROUP BY 1) ORDER BY n DESC, x LIMIT 1)"

    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {time_text_sql(f'MIN({c})')} AS min_date, {time_text_sql(f'MAX({c})')} AS max_date,
        CAST(FLOOR((epoch(MAX({c})) - epoch(MIN({c}))) / 86400) AS BIGINT) AS date_range_days,
        {mode(f'year({c})')} AS most_common_year, {mode(f'month({c})')} AS most_common_month,
        {mode(f'isodow({c}) - 1')} AS most_common_day_of_week FROM {source}"""
        for c in columns
    )


_DATES_SQL = _dates_sql("events", ["ts"])


@query("profile_datetime", _DATES_SQL)
def profile_datetime(spark, folder):
    p = P.datetime_profile(table(spark, folder, "events"))
    return p.withColumn("min_date", time_text(F.col("min_date"))).withColumn("max_date", time_text(F.col("max_date")))


@query(
    "profile_table",
    """SELECT 'events' AS table_name, COUNT(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns,
       ROUND((COUNT(*) * 32 + SUM(strlen(event_type)) + SUM(strlen(props))) / 1048576.0, 6) AS memory_usage_mb FROM events""",
)
def profile_table(spark, folder):
    return rounded(P.table_profile(table(spark, folder, "events"), "events"))


def _list_sql(condition: str) -> str:
    return f"COALESCE(string_agg(CASE WHEN {condition} THEN column_name END, ',' ORDER BY column_name), '')"


@query(
    "profile_summary",
    f"""{_DIRTY}, base AS ({_base_sql('dirty', _TYPES)})
    SELECT 'events' AS table_name, {_list_sql("kind = 'numeric'")} AS numeric_columns,
           {_list_sql("kind = 'categorical'")} AS categorical_columns, {_list_sql("kind = 'datetime'")} AS datetime_columns,
           {_list_sql('unique_percentage > 80')} AS high_cardinality_columns,
           {_list_sql('null_percentage > 20')} AS high_null_columns FROM base""",
)
def profile_summary(spark, folder):
    base = P.base_profile(dirty_events(spark, folder)).withColumn("table_name", F.lit("events"))
    s = P.table_summary(base)
    return s.select("table_name", *[F.array_join(c, ",").alias(c) for c in s.columns if c != "table_name"])


_KEY = "bigint"
_ALL = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": _KEY, "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": _KEY, "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": _KEY, "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {
        "o_orderkey": _KEY, "o_custkey": _KEY, "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": _KEY, "l_partkey": _KEY, "l_suppkey": _KEY, "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "events": _TYPES,
    "documents": {"doc_id": _KEY, "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": _KEY, "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": _KEY, "url": "string", "html": "string"},
    "benchmark": {"item_id": _KEY, "text": "string"},
    "labels": {"doc_id": _KEY, "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": _KEY, "turn": "bigint", "role": "string", "text": "string"},
}


@query("profile_all_tables", "\nUNION ALL ".join(_base_sql(t, types, t) for t, types in _ALL.items()))
def profile_all_tables(spark, folder):
    return rounded(P.profile_all({t: table(spark, folder, t) for t in _ALL}))


_NUMBERS = [
    "min_value", "max_value", "mean_value", "median_value", "std_value", "q25_value", "q75_value", "iqr_value", "skewness", "kurtosis",
]
_TOPS = ["top_values", "top_value", "top_value_count", "top_value_percentage"]
_DATES = ["min_date", "max_date", "date_range_days", "most_common_year", "most_common_month", "most_common_day_of_week"]


def _profile_sql(source: str, types: dict[str, str], label: str, long_text: tuple[str, ...] = ()) -> str:
    def of(kind: str) -> list[str]:
        return [c for c, t in types.items() if _KINDS[t] == kind]

    def or_none(sql: str, names: list[str]) -> str:
        return sql or "SELECT NULL::VARCHAR AS column_name, " + ", ".join(f"NULL AS {n}" for n in names)

    numeric = or_none(_numeric_sql(source, of("numeric")), _NUMBERS)
    tops = or_none(_categorical_sql(source, of("categorical"), long_text), _TOPS)
    dates = or_none(_dates_sql(source, of("datetime")), _DATES)
    return f"""SELECT '{label}' AS table_name, b.*, {", ".join([*_NUMBERS, *_TOPS, *_DATES])} FROM ({_base_sql(source, types)}) b
        LEFT JOIN ({numeric}) n USING (column_name) LEFT JOIN ({tops}) c USING (column_name) LEFT JOIN ({dates}) d USING (column_name)"""


@query("profile_columns", _DIRTY + _profile_sql("dirty", _TYPES, "events"))
def profile_columns(spark, folder):
    return _texts(P.column_profile(dirty_events(spark, folder), "events"))


_LONG = {"documents": ("text",), "pages": ("html",), "benchmark": ("text",), "conversations": ("text",)}


@query("profile_all_tables", "\nUNION ALL ".join(_profile_sql(t, types, t, _LONG.get(t, ())) for t, types in _ALL.items()))
def profile_all_tables(spark, folder):
    return _texts(P.profile_all({t: table(spark, folder, t) for t in _ALL}, long_text=_LONG))


# --- states by day, merged ------------------------------------------------------------


def _incremental_sql() -> str:
    exact = ["min_value", "max_value", "mean_value", "std_value", "skewness", "kurtosis", *_TOPS[1:3], *_DATES[:2], *_DATES[3:]]
    return (
        f"{_DIRTY}, base AS ({_base_sql('dirty', _TYPES)}), num AS ({_numeric_sql('dirty', ['event_id', 'user_id', 'value'])}), "
        f"cat AS ({_CATEGORICAL_SQL}), dates AS ({_DATES_SQL}) "
        f"SELECT b.column_name, b.data_type, b.kind, b.total_count, b.null_count, b.null_percentage, {', '.join(exact)}, "
        f"ROUND(CAST({S.UNIQUE_ERROR!r} AS DOUBLE), 6) AS unique_error, "
        f"CASE WHEN b.kind = 'numeric' THEN ROUND(CAST({S.RANK_ERROR!r} AS DOUBLE), 6) END AS rank_error "
        "FROM base b LEFT JOIN num n USING (column_name) LEFT JOIN cat c USING (column_name) LEFT JOIN dates d USING (column_name)"
    )


@query("profile_incremental", _incremental_sql())
def profile_incremental(spark, folder):
    """Days are profiled as they come, one of them twice; the profile is merged from what was stored. The estimates
    themselves, which SQL can't state, are held against their errors in the tests."""
    events = dirty_events(spark, folder).withColumn("day", F.date_format("ts", "yyyyMMdd"))
    out = shared_folder(spark, "profile")
    for days in ("day < '20240111'", "day BETWEEN '20240111' AND '20240120'", "day >= '20240120'"):
        S.update_states(events.where(days), "day", out)
    top = S.merged_top_values(spark, out, events, "day", k=1).select("column_name", F.col("value").alias("top_value"), F.col("count").alias("top_value_count"))
    whole = S.merged_profile(spark, out).drop("unique_estimate", "q25", "median", "q75")
    whole = whole.join(top, "column_name", "left").join(S.merged_date_parts(spark, out), "column_name", "left")
    return rounded(whole.withColumn("min_date", time_text(F.col("min_date"))).withColumn("max_date", time_text(F.col("max_date"))))
