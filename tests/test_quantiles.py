import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbspark.functions import quantiles as Q

FRACTIONS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
NAMES = [f"p{i}" for i in range(len(FRACTIONS))]
LARGE = {"rows": 10**9}


def expected(values):
    return [float(pd.Series(values).quantile(f)) for f in FRACTIONS]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 101, 2000])
@pytest.mark.parametrize("rounds", [1, 3])
def test_large_path_equals_pandas(spark, n, rounds):
    rng = np.random.default_rng(n)
    values = [float(x) for x in rng.lognormal(3, 2, n)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = Q.exact_quantiles(df, F.col("v"), FRACTIONS, NAMES, rounds=rounds, **LARGE).first()
    assert got.n == n
    assert list(got)[1:] == pytest.approx(expected(values), rel=1e-12)


@pytest.mark.parametrize("rounds", [1, 2])
def test_coarse_sketches_narrow_over_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(Q, "ACCURACY", 40)
    monkeypatch.setattr(Q, "GRID", 10)
    rng = np.random.default_rng(rounds)
    values = [float(x) for x in rng.standard_cauchy(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").repartition(8)
    got = Q.exact_quantiles(df, F.col("v"), FRACTIONS, NAMES, rounds=rounds, **LARGE).first()
    assert list(got)[1:] == pytest.approx(expected(values), rel=1e-12)


def test_rounds_follow_the_row_count():
    assert [Q.sketch_rounds(10**e) for e in (6, 9, 12, 13)] == [1, 2, 3, 3]


@pytest.mark.parametrize("rounds", [1, 2])
def test_one_value_holds_most_rows(spark, rounds):
    values = [7.0] * 900 + [float(x) for x in range(100)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = Q.exact_quantiles(df, F.col("v"), FRACTIONS, NAMES, rounds=rounds, **LARGE).first()
    assert list(got)[1:] == pytest.approx(expected(values))


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("rounds", [1, 2])
def test_groups_with_nulls_and_a_hot_group(spark, few, rounds):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(0, 1, 3000)]
    rows += [(None, float(x)) for x in rng.normal(5, 1, 50)]
    rows += [("few", 1.0), ("few", None), ("few", 2.0), ("few", float("nan"))]
    rows += [("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {
        r.g: list(r)[2:]
        for r in Q.exact_quantiles(df, F.col("v"), FRACTIONS, NAMES, by=["g"], rounds=rounds, few=few).collect()
    }
    assert got["none"] == [None] * len(FRACTIONS)
    for g in ("hot", None, "few"):
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx(expected(values)), g


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_a_table_without_values_and_infinite_ones(spark, rounds):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "v DOUBLE")
    for df in (empty, empty.limit(0)):
        got = Q.exact_quantiles(df, F.col("v"), [0.5], ["m"], rounds=rounds).collect()
        assert [tuple(r) for r in got] == [(0, None)]
    values = [float("-inf")] + [float(x) for x in range(50)] + [float("inf")] * 3
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert Q.exact_quantiles(df, F.col("v"), [0.0, 0.5, 1.0], ["a", "m", "b"], rounds=rounds).first()[1:] == (values[0], 25.5, values[-1])


def test_no_value_map_in_one_task(spark, sf, plan):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert "percentile(" not in plan(Q.exact_quantiles(li, F.col("l_extendedprice"), FRACTIONS, NAMES))


def test_approximate_is_close(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = Q.approx_quantiles(li, F.col("l_quantity"), [0.5], ["m"]).first()
    b = Q.exact_quantiles(li, F.col("l_quantity"), [0.5], ["m"]).first()
    assert abs(a.m - b.m) <= 1


def test_no_round_gives_the_same(spark):
    rng = np.random.default_rng(9)
    rows = [("hot", float(x)) for x in rng.normal(0, 1, 2000).round(1)] + [(None, float(x)) for x in range(7)]
    rows += [("few", 1.0), ("few", None), ("few", float("nan")), ("none", None), ("inf", float("inf")), ("inf", -1.0)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    got = {r.g: list(r)[1:] for r in Q.exact_quantiles(df, F.col("v"), FRACTIONS, NAMES, by=["g"], rounds=0).collect()}
    assert set(got) == {"hot", None, "few", "none", "inf"} and got["none"] == [0] + [None] * len(FRACTIONS)
    for g in ("hot", None, "few"):
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g][0] == len(values) and got[g][1:] == pytest.approx(expected(values))
    whole = Q.exact_quantiles(df.where("g <> 'inf'"), F.col("v"), FRACTIONS, NAMES).first()
    assert list(whole)[1:] == pytest.approx(expected([v for k, v in rows if k not in ("inf", None) and v is not None and v == v]))
    for nothing in (df.where("g = 'none'"), df.limit(0)):
        assert [tuple(r) for r in Q.exact_quantiles(nothing, F.col("v"), [0.5], ["m"]).collect()] == [(0, None)]
