"""The fitted scores against plain fits: least squares and min-max isotonic means, counted ratios and Newton's method."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from plumbspark.llm.labelled import labels_of
from plumbspark.llm.quality import quality_scores, statistics
from plumbspark.llm.toxicity import EDGES, SIZES, fit_toxicity, toxicity_scores, word_grams


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def rising_means(mean, weight):
    """Isotonic regression by its min-max formula: the greatest, over starts, of the least mean to any end."""
    total, size = np.concatenate([[0], np.cumsum(mean * weight)]), np.concatenate([[0], np.cumsum(weight)])
    n = len(mean)
    return np.array(
        [max(min((total[k + 1] - total[j]) / (size[k + 1] - size[j]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    )


def plain_quality(texts, labels, waves=256, width=2.0, ridge=1.0, seed=7, bins=2000):
    ids = sorted(texts)
    x = np.vstack([statistics(pa.array([texts[i]])) for i in ids])
    deviation = x.std(axis=0)
    z = ((x - x.mean(axis=0)) / np.where(deviation < 1e-9, 1, deviation)).clip(-5, 5)
    draw = np.random.default_rng(seed)
    frequency = draw.normal(size=(x.shape[1], waves)) / (width * math.sqrt(x.shape[1]))
    phase = draw.uniform(0, 2 * math.pi, waves)
    design = np.hstack([math.sqrt(2 / waves) * np.cos(z @ frequency + phase), np.ones((len(ids), 1))])
    fitting = [k for k, i in enumerate(ids) if i in labels and fold(i) in (2, 3, 4)]
    penalty = np.diag(np.sqrt([ridge] * waves + [1e-9]))
    wanted = np.concatenate([[labels[ids[k]] for k in fitting], np.zeros(waves + 1)])
    raw = design @ np.linalg.lstsq(np.vstack([design[fitting], penalty]), wanted, rcond=None)[0]
    steps = defaultdict(list)
    for k, i in enumerate(ids):
        if i in labels and fold(i) == 1:
            steps[math.floor(min(2, max(-1, raw[k])) * bins / 3 + 0.5)].append(labels[i])
    at = np.array(sorted(steps), float)
    weight = np.array([len(steps[s]) for s in at], float)
    value = rising_means(np.array([np.mean(steps[s]) for s in at]), weight)
    level = np.round(value, 12)
    knots = [(np.average(at[level == v], weights=weight[level == v]) * 3 / bins, value[level == v][0]) for v in np.unique(level)]
    return dict(zip(ids, np.interp(raw, *np.array(knots).T).clip(0, 1)))


def test_quality_scores_are_those_of_a_plain_fit(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), labels_of(spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    got = {r.doc_id: r.score for r in quality_scores(docs, known).collect()}
    want = plain_quality({r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.label for r in known.collect()})
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def words_of(text):
    return {w.lower().strip(EDGES) for w in text.split()}


def noisy(n, draw):
    """Toxic texts hold one of a few stems; a tenth of the labels is wrong."""
    out = []
    for i in range(n):
        words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 6))) for _ in range(25)]
        toxic = i % 3 == 0
        if toxic:
            words[draw.randrange(25)] = draw.choice(["Grumflex,", "zorbly", "zorblish", "quazz"])
        out.append((i, " ".join(words), int(toxic != (draw.random() < 0.1))))
    return out


def test_toxicity_is_a_plain_fit_over_counted_ratios(docs, spark):
    rows = noisy(500, random.Random(4))
    known = labels_of(spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), "toxic")
    table = docs([(i, t) for i, t, _ in rows])
    model = fit_toxicity(table.select("doc_id", "text"), known)

    buckets = {}  # of a word: every n-gram's, repeats included
    for w in set().union(*(words_of(t) for _, t, _ in rows)):
        buckets[w] = word_grams([w])[1].tolist()
        assert len(buckets[w]) == sum(max(0, len(w) + 3 - n) for n in SIZES)
    counts = {0: Counter(), 1: Counter()}
    teaching = [(i, t, y) for i, t, y in rows if fold(i)]
    for _, t, y in teaching:
        for w in words_of(t):
            counts[y].update(buckets[w])
    often = [b for b in counts[0] | counts[1] if counts[0][b] + counts[1][b] >= 3]
    total = [sum(counts[y][b] for b in often) for y in (0, 1)]

    def strength(b):
        n = counts[0][b] + counts[1][b]
        return sum(counts[y][b] * math.log(counts[y][b] * sum(total) / (n * total[y])) for y in (0, 1) if counts[y][b])

    chosen = sorted(b for b in often if strength(b) >= math.log(len(often)) - 2)
    assert np.flatnonzero(model.feature >= 0).tolist() == chosen and len(chosen) > 10
    ratio = np.array([math.log((counts[1][b] + 1) / (total[1] + 1)) - math.log((counts[0][b] + 1) / (total[0] + 1)) for b in chosen])

    def holds(text):
        own = {b for w in words_of(text) for b in buckets[w]}
        return np.array([b in own for b in chosen], float)

    design = np.hstack([np.array([holds(t) for _, t, _ in teaching]) * ratio, np.ones((len(teaching), 1))])
    label = np.array([y for _, _, y in teaching], float)
    ridge = np.append(np.full(len(chosen), 1e-5), 0)

    def loss(weights):
        line = design @ weights
        return (np.logaddexp(0, line) - label * line).mean() + (ridge * weights**2).sum() / 2

    best = np.zeros(len(chosen) + 1)
    for _ in range(200):  # Newton's method, halving steps
        p = 1 / (1 + np.exp(-(design @ best).clip(-30, 30)))
        slope = design.T @ (p - label) / len(label) + ridge * best
        curve = (design.T * (p * (1 - p))) @ design / len(label) + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(best - size * step) > loss(best) and size > 1e-6:
            size /= 2
        best = best - size * step
    found = np.append(model.scaled / ratio, model.bias)
    assert loss(best) <= loss(found) + 1e-9 and loss(found) < loss(best) + 0.01 < loss(0 * best) / 2

    got = {r.doc_id: r.score for r in toxicity_scores(table, known).collect()}
    for i, t, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.bias + holds(t) @ model.scaled))), abs=1e-6)
