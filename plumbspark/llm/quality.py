"""Quality scores: random Fourier features of text statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.blocks import Words, blocks, held_out, ids_of, release, rows_of, split_flat, windows
from plumbspark.llm.bpe import forget
from plumbspark.llm.labelled import FIT_PARTS, FIT_ROWS, bounded, calibrated, fold, labels_of, teaching
from plumbspark.llm.storage import written

NAMES = (
    "log_words log_chars word_chars symbols marks digits upper stops spaces newlines foreign "
    "distinct repeats repeated_windows repeated_lines short all_upper symbol_words log_lines"
).split()

_CLASSES = np.zeros(256, np.uint8)
for _class, _characters in enumerate(("#*$%&|<>{}[]\\^~_@=+/", "!?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:", " \t", "\n\r"), 1):
    _CLASSES[list(_characters.encode())] = _class
_CLASSES[0x80:] = 8


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; an empty text has zeros. Labels and columns beside the text play no part."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(pc.cast(texts, pa.binary()).to_pylist()), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(n) * 9, size) + _CLASSES[raw], minlength=9 * n).reshape(n, 9)
    words = Words(texts)
    count = np.maximum(words.count, 1)
    length = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False).astype(float)
    upper = pc.match_substring_regex(words.unique, r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$").to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(words.unique, r"[#*$%&|<>!]").to_numpy(zero_copy_only=False)

    def per_word(of_unique: np.ndarray) -> np.ndarray:
        return np.bincount(words.row, weights=of_unique[words.code], minlength=n) / count

    pairs = np.unique(words.row * max(1, len(words.unique)) + words.code) // max(1, len(words.unique))
    same = np.flatnonzero((words.row[1:] == words.row[:-1]) & (words.code[1:] == words.code[:-1])) + 1
    at, window = windows(words, words.hashes(), 5)
    row = words.row[at].astype(np.uint64)
    keys = np.sort((row << np.uint64(46)) | (window >> np.uint64(18)))
    again = np.flatnonzero(keys[1:] == keys[:-1])
    line_row, lines = split_flat(pc.split_pattern(texts, "\n"))
    coded = lines.dictionary_encode()
    line_codes = max(1, len(coded.dictionary))
    n_lines = np.bincount(line_row, minlength=n)
    own_lines = np.bincount(np.unique(line_row * line_codes + coded.indices.to_numpy(zero_copy_only=False)) // line_codes, minlength=n)
    chars = np.maximum(size, 1)
    columns = [
        np.log1p(words.count),
        np.log1p(size),
        per_word(length),
        *(kinds[:, k] / chars for k in range(1, 9)),
        np.bincount(pairs, minlength=n) / count,
        np.bincount(words.row[same], minlength=n) / count,
        np.bincount((keys[again] >> np.uint64(46)).astype(np.int64), minlength=n) / count,
        1 - own_lines / n_lines,
        per_word((length <= 3).astype(float)),
        per_word(upper.astype(float)),
        per_word(odd.astype(float)),
        np.log1p(n_lines),
    ]
    out = np.column_stack(columns)
    out[words.count == 0] = 0
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): NAMES as an array."""

    def take(batches):
        for part, texts in blocks(batches, 4 << 20):
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(texts).ravel()), len(NAMES))
            yield pa.RecordBatch.from_arrays([ids_of(part), x.cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows_of(docs, id_col, text_col).mapInArrow(take, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class QualityModel:
    """Everything a task needs to score: a few hundred numbers for each statistic, whatever the corpus."""

    mean: np.ndarray
    deviation: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.deviation).clip(-5, 5)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at, value = self.knots
        return np.round(np.interp(self.raw(x), at, value).clip(0, 1), 9)


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    waves: int = 256,
    width: float = 2.0,
    ridge: float = 1.0,
    seed: int = 7,
    fit_rows: int = FIT_ROWS,
) -> QualityModel | None:
    """A ridge regression on random Fourier features of the Gaussian kernel exp(-|z - z'|^2 / (2 width^2 d)),
    z the d statistics by mean and deviation of all documents.

    Folds 2, 3 and 4 of the ids give the normal equations: each of FIT_PARTS partitions sums its own, and
    the sums, a fixed number of bytes each, are added. Fold 1 calibrates the scores; fold 0 is held out.
    At most about ``fit_rows`` labelled rows serve. None without labelled rows in both.
    """
    d = len(NAMES)
    moments = stats.agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    ).first()
    known = written(teaching(stats, labels), "quality-known")
    n = known.count()
    if not n:
        return None
    known = bounded(known, n, fit_rows)
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    deviation = np.array([moments[f"s{i}"] for i in range(d)])
    deviation[deviation < 1e-9] = 1.0
    draw = np.random.default_rng(seed)
    frequency = draw.normal(size=(d, waves)) / (width * np.sqrt(d))
    model = QualityModel(mean, deviation, frequency, draw.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1))

    def sums(batches):
        gram, cross = np.zeros((waves + 1, waves + 1)), np.zeros(waves + 1)
        for b in batches:
            z = model.features(_matrix(b))
            gram += z.T @ z
            cross += z.T @ b.column("label").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([gram, cross]).tobytes()], pa.binary())], ["sums"])

    fitting = known.where(fold(F.col("doc_id")) > 1).select("x", "label").repartition(FIT_PARTS)
    total = np.zeros((waves + 1, waves + 2))
    for r in fitting.mapInArrow(sums, "sums binary").collect():
        total += np.frombuffer(r.sums).reshape(total.shape)
    if not total.any():
        return None
    penalty = ridge * np.eye(waves + 1)
    penalty[-1, -1] = 1e-9
    model = QualityModel(mean, deviation, frequency, model.phase, np.linalg.solve(total[:, :-1] + penalty, total[:, -1]))

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b))), b.column("label")], ["raw", "label"])

    checked = known.where(fold(F.col("doc_id")) == 1).select("x", "label").mapInArrow(raw, "raw double, label int")
    at, value = calibrated(checked)
    if not len(at):
        return None
    return QualityModel(mean, deviation, frequency, model.phase, model.weight, (at, value))


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.

    ``labels`` (doc_id, label) teach; ids of fold 0 and NULL ids are held out. NULL and empty texts have
    zeros for statistics and get that point's score. Without labels to learn from all scores are 0.5. An
    empty table gives no rows.
    """
    stats = written(text_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit_quality(stats, labels)

    def score(batches):
        for b in batches:
            scores = np.full(b.num_rows, 0.5) if model is None else model.score(_matrix(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_by_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more by the model of quality_scores; without
    labels to learn from all rows stay. The rows are written with their statistics, computed once; only texts, then
    only statistics, pass through Python."""
    name = "statistics"
    while name in docs.columns:
        name += "_"

    @F.arrow_udf("array<double>")
    def statistics_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()  # of a pipeline that ran before in this session
        for part in parts:
            found = [np.empty((0, len(NAMES)))]
            for _, texts in blocks([pa.RecordBatch.from_arrays([part], ["text"])], 3 << 20):
                found.append(statistics(texts))
                release()
            x = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(found).ravel()), len(NAMES))
            yield x.cast(pa.list_(pa.float64()))

    held = written(docs.withColumn(name, statistics_of("text")), "quality-rows", codec="zstd")
    model = fit_quality(held.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).alias("x")), labels)
    if model is None:
        return held.select(*docs.columns)

    @F.arrow_udf("double")
    def score_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in parts:
            yield pa.array(model.score(x.flatten().to_numpy().reshape(len(x), -1)))

    return held.where(score_of(name) >= threshold).select(*docs.columns)


__all__ = ["QualityModel", "fit_quality", "kept_by_quality", "labels_of", "quality_scores", "statistics", "text_statistics"]
