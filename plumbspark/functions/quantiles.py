"""Exact linear-interpolation quantiles, per group or over a whole table.

Spark's built-in ``percentile`` keeps a value -> count map per group in one task. Instead:

1. sketch rounds: ``percentile_approx`` on a grid of fractions gives
   a bracket of two values around every wanted rank; the next round looks only
   inside the bracket. The sketches are coarse, because every task sends one to
   the task that merges them; three rounds narrow 10^13 rows to a few million.
   Up to BRACKET_ROWS rows no round is needed: the bracket is everything;
2. one counting pass: rows between the brackets collapse to one count per task,
   rows inside a bracket to one count per distinct value;
3. a running sum over the bracket, which picks the two order statistics.

The number of rounds alone follows the rows. A
bracket that missed its rank raises an error; it never yields a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.functions.columns import quoted
from plumbspark.functions.groups import attach, attach_one, few_groups, same_group

ACCURACY = 2_000
GRID = 500
BRACKET_ROWS = 4_000_000

_V = "__value"
_BELOW, _INSIDE, _ABOVE = 0, 1, 2


def exact_quantiles(
    df: DataFrame,
    value: Column,
    fractions: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    rows: int | None = None,
    rounds: int | None = None,
    few: bool | None = None,
    largest: int | None = None,
) -> DataFrame:
    """``[*by, n, *names]``: values counted and one quantile per fraction. NULL and NaN are no values.

    One row for each group, and one for a whole table, also where there is no value: ``n`` is 0 and the
    quantiles NULL. ``rows`` and ``few`` (see ``few_groups``) save a job each when the caller knows them; ``largest``
    bounds the rows of a group (default: ``rows``).
    """
    by, fractions, names = list(by), [float(f) for f in fractions], list(names)
    number = value.cast("double")
    data = df.select(*by, F.when(~F.isnan(number), number).alias(_V))
    if rounds is None:
        rows = df.count() if rows is None else rows
        rounds = sketch_rounds(rows) if (rows if largest is None else largest) > BRACKET_ROWS else 0
    if not rounds:
        return _counted(data, fractions, names, by)
    if by and few is None:
        few = few_groups(df, by)
    return _bracketed(data, fractions, names, by, rounds, bool(few))


def sketch_rounds(rows: int) -> int:
    """Rounds after which a bracket holds at most ``BRACKET_ROWS`` of ``rows``."""
    width = 3.0 / GRID  # two grid steps and the sketch error on both sides
    rounds, left = 1, rows * width
    while left > BRACKET_ROWS:
        rounds, left = rounds + 1, left * width
    return rounds


def _interpolated(pos: Column, a: Column, b: Column) -> Column:
    between = (F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b
    return F.when(a == b, a).otherwise(between)


def _counted(data: DataFrame, fractions: list[float], names: list[str], by: list[str]) -> DataFrame:
    """The running sum over the counts of all values; a group's missing values count nothing but keep its row."""
    counts = data.groupBy(*by, _V).agg(F.count(_V).alias("__c"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    end, v = F.sum("__c").over(group.orderBy(_V)), F.col(_V)
    ranked = counts.select(*by, _V, end.alias("__end"), (end - F.col("__c")).alias("__start"), F.sum("__c").over(group).alias("__n"))
    aggs = []
    for i, f in enumerate(fractions):
        pos = F.lit(f) * (F.col("__n") - 1)
        for rank, name in ((F.floor(pos), f"__a{i}"), (F.ceil(pos), f"__b{i}")):
            aggs.append(F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__end")), v)).alias(name))
    picked = ranked.groupBy(*by).agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n"), *aggs)
    values = [_interpolated(F.lit(f) * (F.col("n") - 1), F.col(f"__a{i}"), F.col(f"__b{i}")).alias(x) for i, (f, x) in enumerate(zip(fractions, names))]
    return picked.select(*by, "n", *values)


def approx_quantiles(
    df: DataFrame,
    value: Column,
    fractions: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass estimate of the same quantiles (rank error at most rows / accuracy)."""
    number = value.cast("double")
    data = df.select(*by, F.when(~F.isnan(number), number).alias(_V))
    packed = F.percentile_approx(_V, [float(f) for f in fractions], accuracy).alias("__q")
    out = data.groupBy(*by).agg(F.count(_V).alias("n"), packed)
    return out.select(*by, "n", *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def _grid(value: Column) -> Column:
    """Estimated quantiles at 0, 1/GRID, ... 1."""
    return F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _bracket(low: Column, high: Column, grid: Column) -> tuple[Column, Column]:
    """Grid values that surely enclose the fractions ``low`` to ``high``."""
    slack = 2.0 / ACCURACY
    first = F.greatest(F.floor((low - slack) * GRID), F.lit(0)).cast("int")
    last = F.least(F.ceil((high + slack) * GRID), F.lit(GRID)).cast("int")
    return F.get(grid, F.least(first, F.lit(GRID))), F.get(grid, F.greatest(last, F.lit(0)))


def _sketched(
    data: DataFrame, fractions: list[float], by: list[str], rounds: int, few: bool
) -> tuple[DataFrame, list[str]]:
    """Per group the values counted ``__n`` and a bracket ``lo_i``, ``hi_i`` per fraction, NULL without values."""
    n, g = F.col("__n"), F.col("__g")
    first = data.groupBy(*by).agg(F.count(_V).alias("__n"), _grid(F.col(_V)).alias("__g"))
    edges, names = [], ["__n"]
    for i, f in enumerate(fractions):
        lo, hi = _bracket(F.lit(f), F.lit(f), g)
        edges += [lo.alias(f"lo_{i}"), hi.alias(f"hi_{i}")]
        names += [f"lo_{i}", f"hi_{i}"]
    brackets = first.select(*by, "__n", *edges)

    for _ in range(rounds - 1):
        rows = _with(data, brackets, by, names, few)
        aggs = []
        for i in range(len(fractions)):
            v, lo, hi = F.col(_V), F.col(f"lo_{i}"), F.col(f"hi_{i}")
            inside = (v >= lo) & (v <= hi)
            aggs += [
                F.count_if(v < lo).alias(f"below_{i}"),
                F.count_if(inside).alias(f"inside_{i}"),
                _grid(F.when(inside, v)).alias(f"g_{i}"),
            ]
        inner = rows.groupBy(*by).agg(F.coalesce(F.max("__n"), F.lit(0)).alias("__n"), *aggs)
        edges = []
        for i, f in enumerate(fractions):
            pos, below, inside = F.lit(f) * (n - 1), F.col(f"below_{i}"), F.col(f"inside_{i}")
            low, high = F.try_divide(F.floor(pos) - below, inside), F.try_divide(F.ceil(pos) - below + 1, inside)
            lo, hi = _bracket(low, high, F.col(f"g_{i}"))
            edges += [lo.alias(f"lo_{i}"), hi.alias(f"hi_{i}")]
        brackets = inner.select(*by, "__n", *edges)
    return brackets, names


def _with(rows: DataFrame, brackets: DataFrame, by: list[str], names: list[str], few: bool) -> DataFrame:
    return attach(rows, brackets, by, names, few) if by else attach_one(rows, brackets, names)


def _bracketed(
    data: DataFrame, fractions: list[float], names: list[str], by: list[str], rounds: int, few: bool
) -> DataFrame:
    brackets, columns = _sketched(data, fractions, by, rounds, few)
    present = data.filter(F.col(_V).isNotNull())
    v, k = F.col(_V), len(fractions)

    # One group per stretch between brackets, and one per distinct value inside a bracket.
    stretch, within = F.lit(0), F.lit(False)
    for i in range(k):
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        stretch = stretch + (v >= lo).cast("int") + (v > hi).cast("int")
        within = within | ((v >= lo) & (v <= hi))
    counts = (
        _with(present, brackets, by, columns, few)
        .groupBy(*by, stretch.alias("__stretch"), F.when(within, v).alias("__slot"))
        .agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("least"), F.max(v).alias("most"))
    )

    # The same rows seen from each fraction: below, inside or above its bracket.
    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                F.col(f"lo_{i}").alias("lo"),
                F.col(f"hi_{i}").alias("hi"),
                (F.lit(f) * (F.col("__n") - 1)).alias("pos"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    seen = (
        _with(counts, brackets, by, columns, few)
        .select(*by, "c", "least", "most", F.col("__n").alias("n"), F.explode(targets).alias("t"))
        .select(*by, "c", "least", "most", "n", "t.*")
    )
    side = F.when(F.col("least") < F.col("lo"), _BELOW).when(F.col("least") > F.col("hi"), _ABOVE).otherwise(_INSIDE)
    slots = (
        seen.withColumn("side", side)
        .withColumn("slot", F.when(F.col("side") == _INSIDE, F.col("least")))
        .groupBy(*by, "q", "pos", "n", "side", "slot")
        .agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    )
    order = Window.partitionBy(*by, "q").orderBy("side", "slot")
    ranked = slots.withColumn("end", F.sum("c").over(order)).withColumn("start", F.col("end") - F.col("c"))

    def at(rank: Column) -> Column:
        here = (F.col("start") <= rank) & (rank < F.col("end"))
        missed = F.raise_error(F.lit("quantile bracket missed its rank; use more rounds or a higher accuracy"))
        found = (
            F.when(F.col("side") == _INSIDE, F.col("slot"))
            .when((F.col("side") == _BELOW) & (rank == F.col("end") - 1), F.col("most"))
            .when((F.col("side") == _ABOVE) & (rank == F.col("start")), F.col("least"))
            .otherwise(missed.cast("double"))
        )
        return F.max(F.when(here, found))

    picked = ranked.groupBy(*by, "q", "pos", "n").agg(at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"))
    value = _interpolated(F.col("pos"), F.col("a"), F.col("b"))
    out = picked.groupBy(*by).agg(*[F.max(F.when(F.col("q") == i, value)).alias(x) for i, x in enumerate(names)])
    every = brackets.select(*by, F.col("__n").alias("n"))
    if not by:
        return attach_one(every, out, names)
    side = F.broadcast(out) if few else out
    return every.alias("e").join(side.alias("o"), same_group(by, "e", "o"), "left").select("e.*", *[f"o.{quoted(x)}" for x in names])
