import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbspark.operators import profile as P

NAN = float("nan")


def frame(spark, values, ddl="v DOUBLE"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_nan_and_null_both_count_as_missing(spark):
    df = frame(spark, [1.0, NAN, None, 1.0, 2.0])
    r = P.base_profile(df).first()
    assert (r.total_count, r.null_count, r.unique_count) == (5, 2, 2)
    assert (r.null_percentage, r.unique_percentage) == (40.0, 40.0)


def test_signed_zero_is_one_value(spark):
    assert P.base_profile(frame(spark, [0.0, -0.0])).first().unique_count == 1


def test_empty_and_all_null(spark):
    empty = P.base_profile(frame(spark, [])).first()
    assert (empty.total_count, empty.null_percentage, empty.unique_count) == (0, None, 0)
    nothing = P.numeric_profile(frame(spark, [None, NAN])).first()
    assert nothing.mean_value is None and nothing.median_value is None and nothing.skewness is None


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 9.0], [3.0] * 6, list(map(float, range(50))) + [1e6]])
def test_numeric_equals_pandas(spark, values):
    r = P.numeric_profile(frame(spark, values)).first()
    s = pd.Series(values)

    def same(got, want):
        want = None if math.isnan(want) else want
        assert (got is None) == (want is None), (got, want)
        if want is not None:
            assert got == pytest.approx(want, rel=1e-9, abs=1e-9)

    same(r.mean_value, s.mean())
    same(r.median_value, s.median())
    same(r.std_value, s.std())
    same(r.q25_value, s.quantile(0.25))
    same(r.iqr_value, s.quantile(0.75) - s.quantile(0.25))
    same(r.skewness, s.skew())
    same(r.kurtosis, s.kurtosis())


def test_top_values_break_ties_by_value(spark, rows):
    values = [c for c in "bbaaccd"] + [None]
    df = frame(spark, values, "v STRING")
    assert rows(P.top_values(df, k=3), "rank", "value", "count") == [(1, "a", 2), (2, "b", 2), (3, "c", 2)]
    r = P.categorical_profile(df).first()
    assert (r.top_value, r.top_value_count) == ("a", 2)
    assert r.top_value_percentage == pytest.approx(200 / 7)
    assert [t["value"] for t in r.top_values] == ["a", "b", "c", "d"]


def test_long_texts_are_counted_whole(spark):
    tail = "x" * 5000
    df = frame(spark, [tail + "1", tail + "1", tail + "2", "short"], "v STRING")
    assert P.base_profile(df).first().unique_count == 3
    best = P.top_values(df, long_text=["v"]).filter("rank = 1").first()
    assert (best.value, best["count"]) == (tail + "1", 2)
    assert P.top_values(df, long_text=["v"]).count() == 3


def test_top_values_limit_groups_before_the_shuffle(spark, sf, plan):
    text = plan(P.top_values(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_datetime(spark):
    df = frame(spark, [datetime(2023, 1, 2, 23), datetime(2024, 2, 6, 1), None], "v TIMESTAMP_NTZ")
    r = P.datetime_profile(df).first()
    assert r.date_range_days == 399  # whole days only
    assert (r.most_common_year, r.most_common_month, r.most_common_day_of_week) == (2023, 1, 0)


def test_kinds_and_summary(spark):
    df = spark.createDataFrame([(i, f"v{i}", i % 2 == 0, None if i < 3 else 1.0) for i in range(10)], "id INT, s STRING, b BOOLEAN, x DOUBLE")
    s = P.table_summary(P.base_profile(df)).first()
    assert s.numeric_columns == ["id", "x"] and s.categorical_columns == ["s"] and s.datetime_columns == []
    assert s.high_cardinality_columns == ["id", "s"] and s.high_null_columns == ["x"]


def test_summary_limits_are_strict(spark):
    df = spark.createDataFrame(
        [(min(i, 7), None if i < 2 else i) for i in range(10)], "a INT, b INT"
    )  # a: 8 of 10 distinct, b: 2 of 10 missing
    s = P.table_summary(P.base_profile(df, ["a", "b"])).first()
    assert s.high_cardinality_columns == [] and s.high_null_columns == []


def test_approximate_mode(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a = P.base_profile(e, ["user_id"], exact=False).first().unique_count
    b = P.base_profile(e, ["user_id"]).first().unique_count
    assert abs(a - b) <= 0.1 * b
    assert P.numeric_profile(e, ["value"], exact=False).first().median_value is not None


def test_nested_columns_get_base_statistics(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), (None,)], "a ARRAY<INT>")
    r = P.base_profile(df).first()
    assert (r.kind, r.null_count, r.unique_count) == ("other", 1, 1)
    assert P.table_profile(df, "t").first().total_rows == 3


def test_full_profile_has_a_row_per_column(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    p = P.column_profile(e, "events", long_text=["props"])
    assert p.count() == len(e.columns)
    assert p.filter(F.col("column_name") == "value").first().median_value is not None


def test_a_text_and_its_own_digest_are_two_values(spark):
    import hashlib

    text = "x" * 80
    digest = hashlib.sha256(text.encode()).hexdigest()
    df = spark.createDataFrame([(text,), (digest,), ("#" + digest,), (text,)], "v STRING")
    assert P.base_profile(df).first().unique_count == 3


def test_a_profile_reads_the_table_a_few_times(spark, sf, plan):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(P.column_profile(e, "events", exact=False))
    assert text.count("FileScan parquet") <= 3
