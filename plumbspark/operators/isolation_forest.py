"""Isolation forest over one numeric column.

Sampling and tree growth are DataFrame steps; their size depends on the number
of trees and the rows per tree only, never on the table. A forest over one
column is a step function of the value (the mean path length between two split
points is constant), so the fitted model is a sorted list of at most
trees * rows_per_tree steps, and scoring is one binary search per value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.functions.columns import clean_double, quoted

# The advertised configuration.
CONTAMINATION = 0.1
TREES = 100
SEED = 42
ROWS_PER_TREE = 256

EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class Forest:
    """Mean path length right of every step; ``base`` applies left of the first one."""

    steps: tuple[float, ...]
    lengths: tuple[float, ...]
    base: float
    norm: float


def expected_path(n: Column) -> Column:
    """Mean path length of an unsuccessful search among ``n`` values."""
    m = n - 1
    long = 2 * (F.ln(m) + EULER_GAMMA) - 2 * m / n
    return F.when(n > 2, long).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


def _fraction(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts only."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sample(df: DataFrame, column: str, id_cols: Sequence[str], trees: int, rows_per_tree: int, seed: int) -> DataFrame:
    """``(tree, v)``: up to ``rows_per_tree`` values per tree, the same on every run.

    Rows are ranked by a hash of their id. A hash limit from the row count keeps
    about twice the wanted rows before anything is ordered; small tables enter
    several times under different hashes.
    """
    wanted = trees * rows_per_tree
    value = clean_double(df, column)
    data = df.select(value.alias("v"), F.concat_ws("|", *[F.col(quoted(c)).cast("string") for c in id_cols]).alias("id"))
    data = data.filter("v IS NOT NULL")
    n = data.agg(F.count(F.lit(1)).alias("n")).scalar()
    copies = F.greatest(F.ceil(F.try_divide(F.lit(wanted), n)), F.lit(1)).cast("int")
    drawn = (
        data.select("v", "id", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
        .withColumn("u", _fraction(F.col("id"), F.col("copy"), F.lit(seed)))
        .filter(F.col("u") * n * copies < 2 * wanted)
    )
    ranked = drawn.withColumn("r", F.row_number().over(Window.orderBy("u", "id", "copy")))
    return ranked.filter(F.col("r") <= wanted).select(F.pmod("r", F.lit(trees)).cast("int").alias("tree"), "v")


def grow(sampled: DataFrame, rows_per_tree: int, seed: int) -> DataFrame:
    """``(tree, low, depth, size)``: the leaves of all trees, each from its lower edge on.

    Every level splits the open nodes of all trees at once. The windows all
    partition by tree first, so the rows are shuffled once for all levels.
    """
    out = sampled.repartition("tree").selectExpr(
        "tree", "v", "1L AS node", "double('-infinity') AS low", "0 AS depth", "true AS open"
    )
    draw = f"(double(conv(left(md5(concat_ws('|', tree, node, {int(seed)})), 8), 16, 10)) + 0.5) / 4294967296D"
    for _ in range(max(1, math.ceil(math.log2(rows_per_tree)))):
        out = (
            out.selectExpr(
                "*",
                "min(v) OVER (PARTITION BY tree, node) AS lo",
                "max(v) OVER (PARTITION BY tree, node) AS hi",
            )
            .selectExpr("*", f"lo + {draw} * (hi - lo) AS split")
            .selectExpr("* EXCEPT (open)", "open AND split > lo AS open")
            .selectExpr(
                "tree",
                "v",
                "IF(open, node * 2 + int(v >= split), node) AS node",
                "IF(open AND v >= split, split, low) AS low",
                "depth + int(open) AS depth",
                "open",
            )
        )
    return out.groupBy("tree", "node", "low", "depth").agg(F.count(F.lit(1)).alias("size"))


def steps(leaves: DataFrame) -> DataFrame:
    """``(low, mean_path, norm)``: the summed step function of all trees, left to right.

    ``norm`` is the mean path length expected for trees of that many rows.
    """
    tree = Window.partitionBy("tree")
    path = F.col("depth") + expected_path(F.col("size").cast("double"))
    before = F.lag("path").over(tree.orderBy("low"))
    jumps = (
        leaves.withColumn("path", path)
        .withColumn("before", before)
        .withColumn("rows", F.sum("size").over(tree).cast("double"))
        .withColumn("is_first", F.col("before").isNull())
    )
    per_step = jumps.groupBy("low").agg(
        F.sum(F.col("path") - F.coalesce("before", F.lit(0.0))).alias("jump"),
        F.count_if("is_first").alias("trees"),
        F.sum(F.when(F.col("is_first"), expected_path(F.col("rows")))).alias("norms"),
    )
    across = Window.orderBy("low")  # the first step, at minus infinity, holds the tree count
    trees = F.first("trees").over(across)
    return per_step.select(
        "low",
        (F.sum("jump").over(across) / trees).alias("mean_path"),
        (F.first("norms").over(across) / trees).alias("norm"),
    )


def fit(
    df: DataFrame,
    column: str,
    id_cols: Sequence[str],
    trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE,
    seed: int = SEED,
) -> Forest:
    """Train on a hash sample; the model has at most trees * rows_per_tree steps."""
    leaves = grow(sample(df, column, id_cols, trees, rows_per_tree, seed), rows_per_tree, seed)
    rows = steps(leaves).orderBy("low").collect()
    if not rows:
        return Forest((), (), 0.0, 0.0)
    inner = rows[1:]
    return Forest(
        tuple(r.low for r in inner), tuple(r.mean_path for r in inner), rows[0].mean_path, rows[0].norm
    )


def score(forest: Forest, value: Column) -> Column:
    """Anomaly score in (0, 1]; NULL for a missing value."""
    edges = np.array(forest.steps)
    paths = np.array([forest.base, *forest.lengths])
    norm = forest.norm

    @F.pandas_udf("double")
    def score_of(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype="float64", na_value=np.nan)
        mean_path = paths[np.searchsorted(edges, x, side="right")]
        s = np.power(2.0, -mean_path / norm) if norm > 0 else np.full(len(x), 0.5)
        return pd.Series(s).mask(np.isnan(x))

    return score_of(value)


def flag_isolation_forest(
    df: DataFrame,
    column: str,
    id_cols: Sequence[str],
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE,
    seed: int = SEED,
) -> DataFrame:
    """All rows plus ``__value``, ``__score`` and ``is_anomaly`` (score above the cut).

    The cut is the exact (1 - contamination) quantile. The score takes no more
    values than the forest has steps, so its value counts are bounded.
    """
    forest = fit(df, column, id_cols, trees, rows_per_tree, seed)
    value = clean_double(df, column)
    scored = df.select("*", value.alias("__value"), score(forest, value).alias("__score"))
    cut = scored.agg(F.percentile("__score", F.lit(1.0 - contamination)).alias("cut")).scalar()
    return scored.withColumn("is_anomaly", F.coalesce(F.col("__score") > cut, F.lit(False)))
