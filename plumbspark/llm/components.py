"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.sizes import FEW_ROWS, gathered
from plumbspark.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node of the links (a, b).

    Each round lets a node point to its least neighbour, follows the pointer once more and contracts, until
    no link is left. Each round is written, so lineage stays short; few links are kept in one partition.
    """
    few = links.count() <= FEW_ROWS

    def one(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        return one(written(df, purpose))

    roots, left = None, one(links.where("a != b"))
    while True:
        both = left.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        points = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        points = kept(points, "component-points")
        if points.isEmpty():
            break
        far = points.select(F.col("a").alias("to"), F.col("to").alias("further"))
        points = points.join(far, "to").select("a", F.col("further").alias("to"))
        if roots is None:
            roots = kept(points.select(F.col("a").alias("node"), F.col("to").alias("root")), "component-roots")
        else:
            moved = points.select(F.col("a").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = kept(roots, "component-roots")
        left = left.join(points.select("a", F.col("to").alias("a2")), "a")
        left = left.join(points.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        left = left.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = kept(one(left).distinct(), "component-links")
    return roots if roots is not None else links.sparkSession.createDataFrame([], "node long, root long")


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links (a, b), a written table: the links between components are
    contracted, not the nodes'."""
    if links.isEmpty():
        return roots
    known, links = gathered(roots), gathered(links)
    ends = links.join(known.select(F.col("node").alias("a"), F.col("root").alias("a2")), "a", "left")
    ends = ends.join(known.select(F.col("node").alias("b"), F.col("root").alias("b2")), "b", "left")
    ends = written(ends.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")), "component-links")
    moved = components(ends).select(F.col("node").alias("root"), F.col("root").alias("to"))
    new = moved.select(F.col("root").alias("node"), F.col("to").alias("root")).join(known.select("node"), "node", "left_anti")
    known = known.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(known.union(new), "component-roots")
