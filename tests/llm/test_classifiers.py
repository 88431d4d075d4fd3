"""Fitted scores: held-out accuracy, odd rows, calibration."""

import random
import zlib

import numpy as np
import pytest
from plumbspark.llm.labelled import isotonic, labels_of
from plumbspark.llm.quality import kept_by_quality, quality_scores
from plumbspark.llm.toxicity import fit_toxicity, minimised, toxicity_scores


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def outcome(scores, labels, label):
    known = {r.doc_id: r[label] for r in labels.collect()}
    rows = scores.collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    return [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    pairs = outcome(quality_scores(docs, labels_of(labels, "quality")), labels, "quality")
    assert len(pairs) > 50 and np.mean([p == y for p, y in pairs]) > 0.95


def made(n, draw):
    bad = ["grumflex", "grumflexes", "zorbly", "zorblish"]
    out = []
    for i in range(n):
        words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 7))) for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(40)] = draw.choice(bad)
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_toxicity_on_held_out_rows(docs, spark):
    rows = made(800, random.Random(2))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5 != 3] + [(None, 1), (1, None)], "doc_id long, toxic int")
    scores = toxicity_scores(docs([(i, t) for i, t, _ in rows]), labels_of(labels, "toxic"))
    truth = {i: y for i, _, y in rows}
    got = [(r.predicted, truth[r.doc_id]) for r in scores.collect() if r.held_out or r.doc_id % 5 == 3]
    assert np.mean([p == y for p, y in got]) > 0.97


def test_all_telling_ngrams_have_weights(docs, spark):
    draw = random.Random(6)
    kinds = [["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(800)] for _ in range(2)]
    pairs = [(i, " ".join(draw.sample(kinds[i % 2], 150))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in pairs], "doc_id long, toxic int")
    model = fit_toxicity(docs(pairs).select("doc_id", "text"), labels_of(labels, "toxic"))
    assert len(model.scaled) == (model.feature >= 0).sum() > 10_000 and np.count_nonzero(model.scaled) > 10_000


@pytest.mark.parametrize("operator, label", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_odd_rows(docs, odd, spark, operator, label):
    pairs = odd + [(100 + i, t) for i, t in enumerate(["good words in a line " * 5, "## $$ %% " * 9] * 10)]
    labels = spark.createDataFrame([(100 + i, 1 - i % 2) for i in range(20)], f"doc_id long, {label} int")
    got = operator(docs(pairs), labels_of(labels, label)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in pairs), key=repr)
    assert all(r.held_out for r in got if r.doc_id is None)
    empty = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(empty) == 1
    none = operator(docs(pairs), labels_of(labels.where("doc_id < 0"), label)).collect()
    assert {r.score for r in none} == {0.5}
    assert operator(docs([]), labels_of(labels, label)).count() == 0


def test_kept_rows_are_those_that_score_high_enough(tables):
    docs, labels = tables
    known = labels_of(labels, "quality")
    scores = quality_scores(docs, known, threshold=0.3)
    kept = kept_by_quality(docs, known, threshold=0.3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}


def test_isotonic():
    at, value = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 3, 1]))
    assert value.tolist() == pytest.approx([0.1, 0.35, 0.9]) and at.tolist() == pytest.approx([0, 1.75, 3])


def test_minimised():
    target = np.array([3.0, -2.0, 0.5])
    scale = np.array([1.0, 50.0, 0.1])
    got = minimised(lambda x: (float((scale * (x - target) ** 2).sum()), 2 * scale * (x - target)), np.zeros(3), rounds=100)
    assert got == pytest.approx(target, abs=1e-2)
