"""Toxicity: character n-grams scaled by naive Bayes log-count ratios under a logistic regression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.blocks import Words, blocks, chain, held_out, ids_of, ragged_take, rows_of
from plumbspark.llm.labelled import FIT_PARTS, FIT_ROWS, bounded, teaching
from plumbspark.llm.storage import written

SIZES = (3, 4, 5)
BITS = 20
EDGES = ".,;:!?\"'()[]"


def word_grams(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the character n-grams of words between word marks."""
    framed = ["\x02" + w + "\x03" for w in words]
    length = np.fromiter(map(len, framed), np.int64, len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    found, buckets = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        at = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
        hashes = chain([np.full(len(at), n, np.uint64), *(points[at + k] for k in range(n))])
        found.append(word[at])
        buckets.append((hashes >> np.uint64(64 - bits)).astype(np.int64))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(buckets)


class Vocabulary:
    """The distinct words of each text of a block, lower-cased and without punctuation at the ends."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        coded = pc.ascii_trim(pc.utf8_lower(words.unique), characters=EDGES).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        size = max(1, len(self.words))
        own = np.unique(words.row * size + coded.indices.to_numpy(zero_copy_only=False)[words.code])
        self.row, self.code = own // size, own % size


def gram_counts(known: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): how often texts of each label hold a word with the n-gram; tasks add up first."""

    def count(batches):
        sums = np.zeros((2, 1 << BITS))
        for part, texts in blocks(batches, 6 << 20):
            v = Vocabulary(texts)
            word, bucket = word_grams(v.words)
            label = part.column("label").to_numpy()[v.row]
            for k in (0, 1):
                times = np.bincount(v.code[label == k], minlength=len(v.words))
                sums[k] += np.bincount(bucket, weights=times[word], minlength=1 << BITS)
        at = np.flatnonzero(sums.any(axis=0))
        arrays = [pa.array(at), pa.array(sums[1, at].astype(np.int64)), pa.array(sums[0, at].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "toxic", "clean"])

    found = known.select("text", "label").mapInArrow(count, "bucket long, toxic long, clean long")
    return found.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass(frozen=True)
class ToxicityModel:
    """feature: bucket to feature number or -1; scaled: weight times log-count ratio of each feature."""

    feature: np.ndarray
    scaled: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        row, feature = active(self.feature, texts)
        total = self.bias + np.bincount(row, weights=self.scaled[feature], minlength=len(texts))
        return np.round(1 / (1 + np.exp(-total.clip(-30, 30))), 9)


def active(feature: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the features that each text holds, once each."""
    v = Vocabulary(texts)
    word, bucket = word_grams(v.words)
    chosen = feature[bucket]
    some = np.flatnonzero(chosen >= 0)
    order = some[np.argsort(word[some], kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(word[order], minlength=len(v.words)))])
    flat, ends = ragged_take(chosen[order], offsets, v.code)
    row = np.repeat(v.row, np.diff(ends))
    pairs = np.unique(row * max(1, int(feature.max()) + 1) + flat)
    size = max(1, int(feature.max()) + 1)
    return pairs // size, pairs % size


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 40, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS; ``loss`` gives value and gradient, each by one job over the fitting rows."""
    x, (value, slope) = start, loss(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, saved = -slope, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            saved.append(a)
        if steps:
            direction = direction * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]))
        for (s, y), a in zip(steps, reversed(saved)):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        size = 1.0 if steps else min(1.0, 1.0 / max(1e-12, np.abs(slope).sum()))
        for _ in range(12):
            new = x + size * direction
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * size * (slope @ direction):
                break
            size /= 2
        else:
            break
        step, change, gain = new - x, new_slope - slope, value - new_value
        x, value, slope = new, new_value, new_slope
        if step @ change > 1e-12:
            steps = [*steps, (step, change)][-memory:]
        if gain < 1e-6 * max(1.0, abs(value)):
            break
    return x


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, least: int = 3, ridge: float = 1e-5, fit_rows: int = FIT_ROWS
) -> ToxicityModel | None:
    """The log-count ratios come from all labelled documents outside fold 0. A bucket whose likelihood
    ratio is no more than the best of as many chance buckets would show teaches noise and is left out; all
    others serve, at most one feature for each of the 2^BITS buckets. The weights come from about ``fit_rows`` labelled documents at most. None without both labels."""
    known = teaching(docs, labels).select("doc_id", "text", "label")
    counts = gram_counts(known).where(F.col("toxic") + F.col("clean") >= least)
    counts = written(counts, "toxicity-counts")
    totals = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("n")).first()
    if not totals.toxic or not totals.clean:
        return None
    share = F.lit(totals.toxic / (totals.toxic + totals.clean))
    both = F.col("toxic") + F.col("clean")

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    strength = part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share))
    telling = counts.withColumn("strength", strength).where(F.col("strength") >= float(np.log(totals.n)) - 2)
    chosen = telling.select("bucket", "toxic", "clean").orderBy("bucket").toArrow()
    bucket, toxic, clean = (chosen[c].to_numpy().astype(float) for c in ("bucket", "toxic", "clean"))
    ratio = np.log((toxic + 1) / (totals.toxic + 1)) - np.log((clean + 1) / (totals.clean + 1))
    feature = np.full(1 << BITS, -1, np.int32)
    feature[bucket.astype(np.int64)] = np.arange(len(bucket))
    shared = docs.sparkSession.sparkContext.broadcast(feature)

    def take(batches):
        for rows, texts in blocks(batches, 6 << 20):
            row, own = active(shared.value, texts)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(own.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids_of(rows), rows.column("label"), lists], ["doc_id", "label", "own"])

    taken = written(known.mapInArrow(take, "doc_id long, label int, own array<int>"), "toxicity-features")
    n = taken.count()
    fitting = written(bounded(taken, n, fit_rows).select("label", "own").repartition(FIT_PARTS), "toxicity-fitting")
    rows, k = fitting.count(), len(bucket)

    def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches):
            value, slope = 0.0, np.zeros(k + 1)
            for b in batches:
                lists, label = b.column("own"), b.column("label").to_numpy().astype(float)
                own = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                total = weights[k] + np.bincount(row, weights=(weights[:k] * ratio)[own], minlength=len(lists))
                value += float(np.logaddexp(0, total).sum() - label @ total)
                error = 1 / (1 + np.exp(-total.clip(-30, 30))) - label
                slope[:k] += np.bincount(own, weights=error[row], minlength=k) * ratio
                slope[k] += error.sum()
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tobytes()], pa.binary())], ["value", "slope"])

        value, slope = 0.0, np.zeros(k + 1)
        for r in fitting.mapInArrow(sums, "value double, slope binary").collect():
            value, slope = value + r.value, slope + np.frombuffer(r.slope)
        penal = np.append(weights[:k], 0.0)
        return value / rows + ridge / 2 * float(penal @ penal), slope / rows + ridge * penal

    weights = minimised(loss, np.zeros(k + 1))
    return ToxicityModel(feature, weights[:k] * ratio, float(weights[k]))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``, whole texts.

    ``labels`` (doc_id, label) teach; ids of fold 0 and NULL ids are held out. NULL and empty texts hold no
    n-gram: their score is the bias's. Without both labels to learn from all scores are 0.5. An empty table gives
    no rows.
    """
    rows = rows_of(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(rows, labels))

    def score(batches):
        for part, texts in blocks(batches, 6 << 20):
            scores = np.full(len(texts), 0.5) if model.value is None else model.value.score(texts)
            yield pa.RecordBatch.from_arrays([ids_of(part), pa.array(scores)], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
