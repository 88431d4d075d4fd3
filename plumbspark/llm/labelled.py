"""Joining documents with their labels, and what fitted scores share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.sizes import broadcast_if_small
from plumbspark.llm.blocks import held_out

FOLDS = 5
FIT_ROWS = 200_000
FIT_PARTS = 32


def labels_of(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label 0 or 1): one row an id; an id with several labels takes the greatest, NULLs leave."""
    rows = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("label"))
    return rows.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))


def teaching(rows: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows that have a label and aren't held out, with ``label``; labels are broadcast if measured small."""
    known = labels.where(~held_out(F.col("doc_id"), folds))
    return rows.join(broadcast_if_small(known), "doc_id")


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded(rows: DataFrame, n: int, limit: int = FIT_ROWS) -> DataFrame:
    """About ``limit`` of the ``n`` rows at most, chosen by a hash of the id; all of them while they are fewer."""
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * limit / n))


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in rising score: knots (score, value) that rise in both."""
    pools: list[list[float]] = []  # [weighted score, weighted value, weight]
    for s, m, w in zip(score.tolist(), mean.tolist(), weight.tolist()):
        pools.append([s * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def calibrated(scored: DataFrame, bins: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Knots from (raw, label) rows: counted by steps of the raw score, so at most as many rows as steps
    in [-1, 2] reach the driver."""
    step = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * bins / 3)
    found = scored.groupBy(step.alias("step")).agg(F.avg("label").alias("mean"), F.count("*").alias("n")).orderBy("step").collect()
    columns = [np.array([r[c] for r in found], float) for c in ("step", "mean", "n")]
    return isotonic(columns[0] * 3 / bins, columns[1], columns[2])
