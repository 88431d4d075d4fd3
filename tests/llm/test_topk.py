"""Exact top-k against all products, in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbspark.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, row string, chunk string, score string, weights string, slice string"


def plain(rows, every=50, k=5):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(usable) if b != a)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.fixture
def answer(spark):
    def run(rows, every=50, k=5, **options):
        table = spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], SCHEMA).repartition(3)
        vectors = T.integer_vectors(table)
        return sorted(tuple(r) for r in T.top_k(vectors, T.block_index(vectors, **options), F.col("vec_id") % every == 0, k).collect())

    return run


def some(n, dims=8, seed=1, spread=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


def test_chunks_and_slices_don_t_change_the_result(answer, monkeypatch):
    rows = some(900)
    want = plain(rows, every=10)
    assert answer(rows, every=10) == want
    assert answer(rows, every=10, block=16, chunk_bytes=2000) == want
    monkeypatch.setattr(T, "SLICE", 7)
    monkeypatch.setattr(T, "ROUND", 3)
    assert answer(rows, every=10, block=16, chunk_bytes=2000) == want


def test_odd_vectors(answer):
    rows = [
        (0, [0.5, -0.5, 0.25]),
        (1, None),
        (2, []),
        (3, [1.0]),
        (4, [1.0, None]),
        (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]),
        (None, [1.0, 1.0, 1.0]),
        (7, [0.5, -0.5, 0.25]),
        (7, [0.5, -0.5, 0.25]),
        (50, [-0.001, 0.0, 0.001, 9.0]),
        (50, [-0.001, 0.0, 0.001, 9.0]),
        (100, []),
        (150, [1e9, -1e9]),
        (8, [1e9, 1e9]),
        (9, [-3.0]),
    ]
    assert answer(rows) == plain(rows)


def test_ties_go_to_the_smaller_id_across_blocks(answer):
    rows = [(i, [1.0, 0.0]) for i in range(400)]
    assert answer(rows, block=16, chunk_bytes=1000) == plain(rows)


def test_few_and_no_vectors(answer):
    assert answer([]) == []
    assert answer([(50, [1.0])]) == []
    assert answer([(50, [1.0]), (51, [2.0])]) == [(50, 1, 51, 131072)]


def test_blocks_below_the_kth_score_are_not_read():
    draw = np.random.default_rng(3)
    held = T._Blocks.__new__(T._Blocks)
    held.blocks, held.dims = [], 4
    for centre in (0, 100, 1000):
        m = np.int64(centre) + draw.integers(0, 10, (16, 4))
        held.blocks.append((np.arange(16) + centre, np.arange(16) + centre, m))
    held.high = np.array([b[2].max(axis=0) for b in held.blocks])
    held.low = np.array([b[2].min(axis=0) for b in held.blocks])
    query, all_scores = np.ones((1, 4), np.int64), np.concatenate([b[2].sum(axis=1) for b in held.blocks])
    held.blocks[0] = held.blocks[1] = None  # reading them would fail
    score, vec = T._search(held, query, np.array([-1]), np.array([T._NONE]), 5)
    assert score[0].tolist() == sorted(all_scores.tolist())[: -6 : -1] and (vec[0] >= 1000).all()
    assert T._search(held, query, np.array([-1]), np.array([10**6]), 5)[0].tolist() == [[T._NONE] * 5]


def test_weights_beyond_doubles_stay_exact():
    big = np.array([[2**40 + 1, 3], [2**40, 5]], np.int64)
    table = pa.table(
        {
            "block": [0], "dims": [2], "width": [8], "ids": [np.array([1, 2]).tobytes()], "rows": [np.array([1, 2]).tobytes()],
            "weights": [big.tobytes()], "high": [big.max(axis=0).tobytes()], "low": [big.min(axis=0).tobytes()],
        }
    )
    score, vec = T._search(T._Blocks(table), np.array([[2**20 + 1, 1]], np.int64), np.array([-1]), np.array([T._NONE]), 2)
    assert score.tolist() == [[(2**20 + 1) * (2**40 + 1) + 3, (2**20 + 1) * 2**40 + 5]] and vec.tolist() == [[1, 2]]
