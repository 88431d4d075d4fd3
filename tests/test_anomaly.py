import numpy as np
import pandas as pd
import pytest

from plumbspark.operators import anomaly as A
from plumbspark.operators import drift as D
from plumbspark.operators import isolation_forest as I


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id INT, v DOUBLE")


def flagged(df, method="iqr", **kw):
    return sorted(r.id for r in A.detect_anomalies(df, "v", ["id"], method, **kw).collect())


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 2.0, 1e9], [1.0, None, 1e9, float("nan"), 3.0]])
def test_iqr_needs_four_values(spark, values):
    assert flagged(frame(spark, values)) == []
    assert A.iqr_thresholds(frame(spark, values), "v").first().lower_bound is None


def test_iqr_bounds_are_strict(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0]  # q1 1, q3 3, bounds -2 and 6
    t = A.iqr_thresholds(frame(spark, values), "v").first()
    assert (t.q1, t.q3, t.lower_bound, t.upper_bound) == (1.0, 3.0, -2.0, 6.0)
    limits = A.iqr_thresholds(frame(spark, values), "v")
    probe = frame(spark, [-2.0, 6.0, 6.0001, -2.0001])
    out = A.flag_iqr(probe, "v", limits=limits).filter("is_anomaly").orderBy("id").collect()
    assert [r.id for r in out] == [2, 3]


def test_zscore(spark):
    assert flagged(frame(spark, [1.0]), "zscore") == []
    assert flagged(frame(spark, [5.0] * 20), "zscore") == []  # std 0
    values = [0.0] * 30 + [100.0]
    s = pd.Series(values)
    want = s[((s - s.mean()) / s.std()).abs() > 3].index.tolist()
    assert flagged(frame(spark, values), "zscore") == want == [30]


def test_an_infinite_value_flags_no_row(spark):
    values = [float(i) for i in range(200)] + [float("inf")]
    assert flagged(frame(spark, values), "zscore") == []


def test_grouped_equals_pandas(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.standard_cauchy(400))]
    df = spark.createDataFrame(rows, "id INT, g STRING, v DOUBLE")
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    want = []
    for _, part in pdf.groupby("g"):
        q1, q3 = part.v.quantile(0.25), part.v.quantile(0.75)
        want += part[(part.v < q1 - 1.5 * (q3 - q1)) | (part.v > q3 + 1.5 * (q3 - q1))].id.tolist()
    assert flagged(df, by=["g"]) == sorted(want)
    assert flagged(df, by=["g"], rows=10**9, few=False) == sorted(want)  # many-groups plan


def test_unknown_method_and_registration(spark):
    df = frame(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        A.detect_anomalies(df, "v", ["id"], "magic")
    A.register_detector("none", lambda d, c, by=(): A.flag_zscore(d, c, by, limit=1e9))
    assert flagged(df, "none") == []
    del A.DETECTORS["none"]


def test_whole_column_detection_has_one_threshold_subquery(spark, sf, plan):
    e = spark.read.parquet(f"{sf}/events.parquet")
    out = A.detect_anomalies(e, "value", ["event_id"])
    out.collect()
    text = plan(out)
    final = text.split("Initial Plan")[0]
    assert "ReusedSubquery" in text and "NestedLoop" not in text and "Cartesian" not in text
    assert "percentile" not in final and "Window" in final  # few rows: one running sum over the values' counts


def test_few_groups_are_broadcast(spark, sf, plan):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert "BroadcastHashJoin" in plan(A.detect_anomalies(e, "value", ["event_id"], by=["event_type"]))


def test_forest_finds_planted_outliers_whatever_the_partitioning(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(100, 5, 2000)] + [400.0, -300.0]
    df = frame(spark, values)
    kw = {"trees": 60, "rows_per_tree": 64, "contamination": 0.01}  # every row is drawn at least once
    a = A.detect_anomalies(df.repartition(3), "v", ["id"], "isolation_forest", **kw).collect()
    b = A.detect_anomalies(df.repartition(7, "v"), "v", ["id"], "isolation_forest", **kw).collect()
    assert sorted(a) == sorted(b)
    assert {2000, 2001} <= {r.id for r in a} and len(a) <= 0.02 * len(values)


def test_forest_sample_is_bounded_and_balanced(spark):
    df = frame(spark, [float(i) for i in range(5000)])
    s = I.sample(df, "v", ["id"], 10, 32, 42).groupBy("tree").count().collect()
    assert sorted(r["count"] for r in s) == [32] * 10


def test_forest_steps_match_a_walk_through_every_tree(spark):
    """Mean path from the step function = mean over trees of the leaf holding the value."""
    df = frame(spark, [float((i * 37) % 101) for i in range(300)])
    s = I.sample(df, "v", ["id"], 5, 16, 7)
    leaves = I.grow(s, 16, 7).collect()
    forest = I.fit(df, "v", ["id"], 5, 16, 7)

    def c(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + I.EULER_GAMMA) - 2 * (n - 1) / n

    edges, paths = np.array(forest.steps), np.array([forest.base, *forest.lengths])
    for x in (-50.0, 0.0, 13.5, 50.0, 99.0, 1000.0):
        want = []
        for tree in {r.tree for r in leaves}:
            leaf = max((r for r in leaves if r.tree == tree and r.low <= x), key=lambda r: r.low)
            want.append(leaf.depth + c(leaf.size))
        assert paths[np.searchsorted(edges, x, side="right")] == pytest.approx(np.mean(want))


def test_forest_on_nothing(spark):
    assert A.detect_anomalies(frame(spark, []), "v", ["id"], "isolation_forest").count() == 0
    assert A.detect_anomalies(frame(spark, [1.0]), "v", ["id"], "isolation_forest").count() == 0


def test_detection_summary(spark):
    df = frame(spark, [float(i % 10) for i in range(100)] + [1000.0])
    r = A.detection_summary(A.flag_anomalies(df, "v")).first()
    assert (r.records_analyzed, r.anomalies_detected, r.detection_rate) == (101, 1, 0.99)


def test_psi(spark):
    base = frame(spark, [float(i) for i in range(100)])
    same = D.population_stability(base, base, "v").first()
    assert same.psi == pytest.approx(0)
    moved = D.population_stability(base, frame(spark, [1e6] * 50), "v").first()
    assert moved.psi > 1
