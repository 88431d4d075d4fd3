"""Profiles that are kept and merged: a new day costs one day, whatever the table's age.

Each part (a day, a batch) has one stored row for every column: rows, nulls, central moments, extremes, an HLL
sketch of distinct values, a KLL sketch of the distribution, and the least count that its value list leaves out. Beside
it lie the part's most frequent values and its counts of years, months and weekdays. Merging reads those rows alone.

Counts, moments, extremes and date parts are exact. Most frequent values are exact too: what the kept lists can't
prove is counted again, for the values (or, failing that, the columns) in question only. Distinct counts and quantiles
are estimates within ``UNIQUE_ERROR`` and ``RANK_ERROR``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbspark.functions.columns import CATEGORICAL, DATETIME, NUMERIC, clean, kind_of, naive, percent, quoted
from plumbspark.functions.sizes import broadcast_if_small
from plumbspark.operators.profile import TOP_VALUES, _distinct_key

HLL_BITS = 14
KLL_K = 800
#: Three standard errors of merged HLL sketches, and KLL's normalised rank error at 99 %.
UNIQUE_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)
RANK_ERROR = 2.296 / KLL_K**0.9021
#: Values that a part keeps for a text column.
KEPT = 1000

_FACETS = {"year": F.year, "month": F.month, "weekday": F.weekday}
_NUMBERS = ("low", "high", "mean", "m2", "m3", "m4")


def _state(f) -> Column:
    """Everything of one column that a single pass over a part gives."""
    kind, c = kind_of(f.dataType), clean(f)
    number = c.cast("double") if kind == NUMERIC else F.lit(None).cast("double")
    time = naive(F.col(quoted(f.name))) if kind == DATETIME else F.lit(None).cast("timestamp_ntz")
    n = F.count(number)
    spread = F.coalesce(F.var_pop(number), F.lit(0.0))

    def central(moment: Column, power: float) -> Column:
        return F.when(spread > 0, moment * n * F.pow(spread, F.lit(power))).otherwise(0.0)

    return F.struct(
        F.lit(f.name).alias("column_name"),
        F.lit(f.dataType.simpleString()).alias("data_type"),
        F.lit(kind).alias("kind"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(c.isNull()).alias("nulls"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.avg(number).alias("mean"),
        (spread * n).alias("m2"),
        central(F.skewness(number), 1.5).alias("m3"),
        central(F.kurtosis(number) + 3, 2.0).alias("m4"),
        F.min(time).alias("low_time"),
        F.max(time).alias("high_time"),
        F.hll_sketch_agg(_distinct_key(f)[1].cast("string"), HLL_BITS).alias("distinct"),
        F.kll_sketch_agg_double(number, KLL_K).alias("spread"),
    )


def part_states(df: DataFrame, part: str) -> DataFrame:
    """(part, column_name, ...): the states of every part of ``df``, from one scan."""
    fields = [f for f in df.schema.fields if f.name != part]
    one = df.groupBy(F.col(quoted(part)).cast("string").alias("part")).agg(*[_state(f).alias(f"c{i}") for i, f in enumerate(fields)])
    return one.select("part", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(fields))])))


def _counted(df: DataFrame, part: str) -> DataFrame:
    """(part, column_name, facet, value, count) of texts and date parts; long texts stand as a digest."""
    rows = []
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        if f.name == part or kind not in (CATEGORICAL, DATETIME):
            continue
        facets = {"value": _distinct_key(f)[1]} if kind == CATEGORICAL else {n: g(naive(F.col(quoted(f.name)))).cast("string") for n, g in _FACETS.items()}
        rows += [F.struct(F.lit(f.name).alias("column_name"), F.lit(n).alias("facet"), v.alias("value")) for n, v in facets.items()]
    pairs = df.select(F.col(quoted(part)).cast("string").alias("part"), F.inline(F.array(*rows)))
    return pairs.where("value IS NOT NULL").groupBy("part", "column_name", "facet", "value").agg(F.count(F.lit(1)).alias("count"))


def _has_values(df: DataFrame, part: str) -> bool:
    return any(f.name != part and kind_of(f.dataType) in (CATEGORICAL, DATETIME) for f in df.schema.fields)


def update_states(df: DataFrame, part: str, folder: str, kept: int = KEPT) -> None:
    """Stores the states of the parts that ``df`` holds whole; parts that were stored before are replaced."""

    def put(rows: DataFrame, name: str) -> None:
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("part").parquet(f"{folder}/{name}")

    put(part_states(df, part), "states")
    if _has_values(df, part):
        order = Window.partitionBy("part", "column_name", "facet").orderBy(F.col("count").desc(), "value")
        ranked = _counted(df, part).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept + 1)
        put(ranked.select("part", "column_name", "facet", "value", "count", (F.col("rank") > kept).alias("cut")), "values")


def _stored(spark: SparkSession, folder: str, name: str, parts: Sequence[str] | None) -> DataFrame:
    out = spark.read.parquet(f"{folder}/{name}").withColumn("part", F.col("part").cast("string"))
    return out if parts is None else out.where(F.col("part").isin(list(parts)))


def merged_moments(states: DataFrame) -> DataFrame:
    """One row a column: counts, moments and extremes of all parts together (pairwise update of central sums)."""
    present = F.col("n") - F.col("nulls")
    means = states.groupBy("column_name").agg(F.try_divide(F.sum(F.col("mean") * present), F.sum(F.when(F.col("mean").isNotNull(), present))).alias("centre"))
    d = F.col("mean") - F.col("centre")
    shifted = states.join(F.broadcast(means), "column_name").select(  # a row for each column of the table
        "*",
        (F.col("m2") + present * d * d).alias("s2"),
        (F.col("m3") + 3 * d * F.col("m2") + present * d * d * d).alias("s3"),
        (F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + present * F.pow(d, F.lit(4))).alias("s4"),
    )
    return shifted.groupBy("column_name", "data_type", "kind").agg(
        F.sum("n").alias("total_count"),
        F.sum("nulls").alias("null_count"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        F.first("centre").alias("mean_value"),
        *[F.sum(c).alias(c) for c in ("s2", "s3", "s4")],
        F.min("low_time").alias("min_date"),
        F.max("high_time").alias("max_date"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_estimate"),
        F.kll_merge_agg_double("spread").alias("spread"),
    )


def _shape(n: Column) -> list[Column]:
    """Sample deviation, skewness and kurtosis of central sums."""
    s2, s3, s4 = F.col("s2"), F.col("s3"), F.col("s4")
    flat = F.col("min_value") == F.col("max_value")
    skew = F.sqrt(n) * F.try_divide(s3, F.pow(s2, F.lit(1.5))) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    excess = n * F.try_divide(s4, s2 * s2) - 3
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * excess + 6)
    return [
        F.when(n > 1, F.sqrt(F.try_divide(s2, n - 1))).alias("std_value"),
        F.when(n < 3, F.lit(None)).when(flat, 0.0).otherwise(skew).alias("skewness"),
        F.when(n < 4, F.lit(None)).when(flat, 0.0).otherwise(kurt).alias("kurtosis"),
    ]


def merged_profile(spark: SparkSession, folder: str, parts: Sequence[str] | None = None) -> DataFrame:
    """One row a column from the stored states alone; quantiles and distinct counts within the stated errors."""
    m = merged_moments(_stored(spark, folder, "states", parts))
    n = F.when(F.col("kind") == NUMERIC, F.col("total_count") - F.col("null_count")).cast("double")
    quantile = [F.when(n > 0, F.kll_sketch_get_quantile_double("spread", F.lit(q))).alias(name) for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return m.select(
        "column_name", "data_type", "kind", "total_count", "null_count",
        percent(F.col("null_count"), F.col("total_count")).alias("null_percentage"),
        F.col("unique_estimate"), F.lit(UNIQUE_ERROR).alias("unique_error"),
        "min_value", "max_value", "mean_value", *_shape(n),
        *quantile, F.when(n.isNotNull(), F.lit(RANK_ERROR)).alias("rank_error"),
        "min_date", "max_date",
    )


def merged_date_parts(spark: SparkSession, folder: str, parts: Sequence[str] | None = None) -> DataFrame:
    """(column_name, most_common_year, most_common_month, most_common_day_of_week); the smallest of equal ones."""
    counts = _stored(spark, folder, "values", parts).where("facet <> 'value'").groupBy("column_name", "facet", "value").agg(F.sum("count").alias("count"))
    value = F.col("value").cast("int")

    def most_common(facet: str) -> Column:
        own = F.col("facet") == facet
        return F.max_by(F.when(own, value), F.when(own, F.struct("count", -value)))

    return counts.groupBy("column_name").agg(
        most_common("year").alias("most_common_year"),
        most_common("month").alias("most_common_month"),
        most_common("weekday").alias("most_common_day_of_week"),
    )


def merged_top_values(
    spark: SparkSession, folder: str, source: DataFrame, part: str, k: int = TOP_VALUES, parts: Sequence[str] | None = None
) -> DataFrame:
    """(column_name, rank, value, count): the exact ``k`` most frequent values of each text column, equal counts by value.

    A value's count is at least what the parts that list it say, and at most that plus the cuts of the other parts. If
    the k-th certain count exceeds what an unlisted value can reach, only listed values that may still enter are
    counted in ``source`` (the same parts); otherwise the column is counted as a whole. Columns whose parts list
    all their values are never read again.
    """
    listed = _stored(spark, folder, "values", parts).where("facet = 'value'")
    cuts = listed.where("cut").select("part", "column_name", F.col("count").alias("limit"))
    total = cuts.groupBy("column_name").agg(F.sum("limit").alias("unlisted"))
    kept = listed.where("NOT cut").join(F.broadcast(cuts), ["part", "column_name"], "left")  # a row a part and column
    sums = kept.groupBy("column_name", "value").agg(F.sum("count").alias("least"), F.sum(F.coalesce("limit", F.lit(0))).alias("seen"))
    sums = sums.join(F.broadcast(total), "column_name", "left").withColumn("unlisted", F.coalesce("unlisted", F.lit(0)))
    sums = sums.withColumn("most", F.col("least") + F.col("unlisted") - F.col("seen"))
    order = Window.partitionBy("column_name").orderBy(F.col("least").desc(), "value")
    floor = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("column_name").agg(
        F.min("least").alias("floor"), F.max("rank").alias("held")
    )
    state = floor.join(total, "column_name").collect()  # columns with cut lists
    open_ = [r.column_name for r in state if r.unlisted >= r.floor or r.held < k]
    cut = [r.column_name for r in state]
    sure = sums.where(~F.col("column_name").isin(cut)).select("column_name", "value", F.col("least").alias("count"))
    for columns, wanted in (([c for c in cut if c not in open_], True), (open_, False)):
        if columns:
            held = source if parts is None else source.where(F.col(quoted(part)).cast("string").isin(list(parts)))
            pairs = _counted(held.select(part, *columns), part)
            if wanted:
                may = sums.join(F.broadcast(floor), "column_name").where("most >= floor").select("column_name", "value")
                pairs = pairs.join(broadcast_if_small(may), ["column_name", "value"], "left_semi")
            sure = sure.unionByName(pairs.where("facet = 'value'").groupBy("column_name", "value").agg(F.sum("count").alias("count")))
    best = Window.partitionBy("column_name").orderBy(F.col("count").desc(), "value")
    return sure.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("column_name", "rank", "value", "count")
