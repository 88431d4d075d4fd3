"""Two-sample distances against plain sums over sorted values."""

import random

import numpy as np
import pytest

from plumbspark.operators.distance import two_sample_distances


def plain(a, b):
    a, b = (np.sort([x for x in s if x is not None and x == x]) for s in (a, b))
    if not len(a) or not len(b):
        return len(a), len(b), None, None, None
    at = np.unique(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b))
    return len(a), len(b), gap.max(), at[gap.argmax()], float((gap[:-1] * np.diff(at)).sum())


def frames(spark, a, b):
    n = max(len(a), len(b))
    return [spark.createDataFrame([(x, float(i % 3)) for i, x in enumerate(s)], "v DOUBLE, w DOUBLE").repartition(1 + n // 50) for s in (a, b)]


def check(spark, a, b):
    got = {r.column_name: r for r in two_sample_distances(*frames(spark, a, b), ["v", "w"]).collect()}
    for name, want in (("v", plain(a, b)), ("w", plain([float(i % 3) for i in range(len(a))], [float(i % 3) for i in range(len(b))]))):
        r = got[name]
        assert (r.n_baseline, r.n_current, r.ks_at) == (*want[:2], want[3])
        assert (r.ks, r.wasserstein) == (pytest.approx(want[2]), pytest.approx(want[4]))


@pytest.mark.parametrize("seed", range(3))
def test_random_samples(spark, seed):
    draw = random.Random(seed)
    a = [draw.choice([None, float("nan"), -0.0, 0.0, draw.gauss(0, 1), float(round(draw.gauss(0, 2)))]) for _ in range(400)]
    b = [draw.choice([None, 0.0, draw.gauss(0.5, 2), float(round(draw.gauss(0, 2)))]) for _ in range(300)]
    check(spark, a, b)


def test_a_hot_value_and_disjoint_sides(spark):
    check(spark, [1.0] * 500 + [2.0], [1.0] * 100 + [3.0] * 7)
    check(spark, [float(i) for i in range(100)], [float(i) for i in range(1000, 1050)])


def test_sides_without_values(spark):
    for a, b in (([], []), ([1.0, 2.0], []), ([None, float("nan")], [1.0])):
        check(spark, a, b)


def test_no_window_over_everything(spark, plan):
    text = plan(two_sample_distances(*frames(spark, [1.0, 2.0], [1.5]), ["v"]))
    assert "SinglePartition" not in text and "Window" in text and "Cartesian" not in text and "NestedLoop" not in text
