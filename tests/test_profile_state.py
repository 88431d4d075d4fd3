"""Stored, merged profiles against profiles of the whole table."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbspark.operators import profile as P
from plumbspark.operators import profile_state as S

DDL = "day STRING, k LONG, v DOUBLE, skewed STRING, wide STRING, same STRING, ts TIMESTAMP_NTZ"


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = []
    for i in range(4000):
        day = draw.randrange(8)
        rows.append((
            f"d{day}", i, None if i % 17 == 0 else float("nan") if i % 19 == 0 else 1e6 + draw.lognormvariate(0, 1) * (day + 1),
            f"s{min(int(draw.expovariate(0.08)), 200)}" if i % 5 else f"only{day}", f"w{i}" if i % 3 else "x" * 100, "same",
            datetime(2023, 11, 1) + timedelta(days=draw.randrange(90)),
        ))
    return spark.createDataFrame(rows, DDL)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "profile")


def near(a, b):
    return a == b if a is None or b is None or isinstance(a, (str, datetime)) else a == pytest.approx(b, rel=1e-6)


def test_merged_days_equal_the_whole_table(spark, table, folder):
    for day in range(8):
        S.update_states(table.where(F.col("day") == f"d{day}"), "day", folder)
    got = {r.column_name: r for r in S.merged_profile(spark, folder).collect()}
    base = {r.column_name: r for r in P.base_profile(table).collect()}
    assert set(got) == set(base) - {"day"}
    for name, r in got.items():
        for c in ("data_type", "kind", "total_count", "null_count", "null_percentage"):
            assert near(r[c], base[name][c]), (name, c)
        assert abs(r.unique_estimate - base[name].unique_count) <= max(1, r.unique_error * base[name].unique_count)
    for r in P.numeric_profile(table).collect():
        for c in ("min_value", "max_value", "mean_value", "std_value", "skewness", "kurtosis"):
            assert near(got[r.column_name][c], r[c]), (r.column_name, c)
        values = sorted(x[0] for x in table.select(r.column_name).collect() if x[0] is not None and x[0] == x[0])
        for q, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
            low, high = (values[min(len(values) - 1, max(0, int((q + s * S.RANK_ERROR) * len(values))))] for s in (-1, 1))
            assert low <= got[r.column_name][c] <= high
    dates = P.datetime_profile(table).first()
    assert (got["ts"].min_date, got["ts"].max_date) == (dates.min_date, dates.max_date)
    parts = S.merged_date_parts(spark, folder).first()
    assert parts.asDict() == {k: dates[k] for k in parts.asDict()}


@pytest.mark.parametrize("kept", [1, 3, 12, 60, 5000])
def test_most_frequent_values_are_exact_whatever_a_part_keeps(spark, table, folder, rows, kept):
    S.update_states(table, "day", folder, kept)
    got = S.merged_top_values(spark, folder, table, "day", k=7)
    digest = F.when(F.length("wide") > 64, F.concat(F.lit("#"), F.sha2("wide", 256))).otherwise(F.col("wide"))
    want = P.top_values(table.withColumn("wide", digest), ["skewed", "wide", "same"], k=7).select("column_name", "rank", "value", "count")
    assert rows(got) == rows(want)
    some = S.merged_top_values(spark, folder, table, "day", k=7, parts=["d1", "d5"])
    want = P.top_values(table.where("day IN ('d1', 'd5')").withColumn("wide", digest), ["skewed", "wide", "same"], k=7)
    assert rows(some) == rows(want.select("column_name", "rank", "value", "count"))


def test_provable_columns_are_not_read_again(spark, table, folder):
    S.update_states(table.select("day", "same", "skewed"), "day", folder)
    broken = table.select("day", "same", "skewed").withColumn("skewed", F.raise_error(F.lit("read")).cast("string"))
    assert S.merged_top_values(spark, folder, broken, "day", k=3).count() == 4


def test_a_day_replaces_itself_and_leaves_the_others(spark, table, folder):
    S.update_states(table, "day", folder)
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/states/*/*.parquet")}
    more = table.where("day = 'd3'").unionByName(table.where("day = 'd3'"))
    S.update_states(more, "day", folder)
    S.update_states(more, "day", folder)
    after = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/states/*/*.parquet")}
    assert {p for p in before if "part=d3" not in p} == {p for p in after if "part=d3" not in p}
    assert all(after[p] == t for p, t in before.items() if "part=d3" not in p)
    total = table.count() + table.where("day = 'd3'").count()
    assert {r.total_count for r in S.merged_profile(spark, folder).collect()} == {total}
    assert {r.total_count for r in S.merged_profile(spark, folder, ["d3"]).collect()} == {more.count()}


def test_parts_without_values(spark, folder):
    rows = [("a", None, None), ("a", None, None), ("b", 5.0, "x"), ("c", float("nan"), None)]
    df = spark.createDataFrame(rows, "day STRING, v DOUBLE, s STRING")
    S.update_states(df, "day", folder)
    got = {r.column_name: r for r in S.merged_profile(spark, folder).collect()}
    v = got["v"]
    assert (v.total_count, v.null_count, v.min_value, v.mean_value, v.std_value, v.median) == (4, 3, 5.0, 5.0, None, 5.0)
    assert got["s"].unique_estimate == 1 and got["s"].median is None
    assert [tuple(r) for r in S.merged_top_values(spark, folder, df, "day").collect()] == [("s", 1, "x", 1)]
    none = S.merged_profile(spark, folder, ["a"]).where("column_name = 'v'").first()
    assert (none.null_count, none.mean_value, none.q25, none.unique_estimate) == (2, None, None, 0)
