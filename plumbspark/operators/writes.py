"""Keyed writes as table-to-table jobs: the new table is a plan over target and batch.

Rows with a NULL in a key column never match anything. They are kept out of
shuffled joins, so that they neither change the result nor pile up in one task.

A batch is usually small beside its target. Its size is measured: a small batch
is broadcast, and the target is read once and not shuffled at all; a large one
takes shuffled joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.functions.columns import all_set, quoted
from plumbspark.functions.sizes import is_small


def _aligned(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Batch columns in target order and type; absent ones NULL, unknown ones dropped."""
    return batch.select(
        *[
            (F.col(quoted(f.name)) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def insert(target: DataFrame, batch: DataFrame, fill_missing: bool = True) -> DataFrame:
    """Append a batch. Without ``fill_missing`` a column the batch lacks is an error."""
    lacking = [c for c in target.columns if c not in batch.columns]
    if lacking and not fill_missing:
        raise KeyError(f"batch lacks columns {lacking}")
    return target.unionByName(_aligned(batch, target))


def route(batch: DataFrame, table_column: str = "table") -> DataFrame:
    """Rows of a mixed batch that name their table; the others are skipped."""
    return batch.filter(F.col(quoted(table_column)).isNotNull())


def append_routed(batch: DataFrame, folder: str, table_column: str = "table") -> None:
    """One pass over a mixed batch, appended to one folder per named table.

    Rebalancing gathers a table's rows into few files and splits a dominant table.
    """
    route(batch, table_column).hint("rebalance", table_column).write.mode("append").partitionBy(table_column).parquet(folder)


def routed_counts(batch: DataFrame, table_column: str = "table") -> DataFrame:
    return (
        route(batch, table_column)
        .groupBy(F.col(quoted(table_column)).alias("table_name"))
        .agg(F.count(F.lit(1)).alias("inserted"))
    )


def without_keys_of(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete-using: target rows whose key is not in the batch."""
    complete = all_set(list(keys))
    gone = batch.filter(complete).select(*keys)
    if is_small(gone):  # a NULL key matches nothing, so those rows stay in the same scan
        return target.join(F.broadcast(gone.distinct()), list(keys), "left_anti").select(*target.columns)
    kept = target.filter(complete).join(gone.distinct(), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(target.filter(~complete))


def _unknown_rows(
    batch: DataFrame, target: DataFrame, keys: list[str], small: bool
) -> DataFrame:
    """Batch rows (complete, unique keys) the target has no row for."""
    if not small:
        return batch.join(target.select(*keys), keys, "left_anti").select(*batch.columns)
    # The keys both sides hold are at most as many as the batch has rows.
    both = target.select(*keys).join(F.broadcast(batch.select(*keys)), keys, "left_semi").distinct()
    return batch.join(F.broadcast(both), keys, "left_anti").select(*batch.columns)


def replace(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete target rows with a key of the batch, then insert every batch row."""
    return insert(without_keys_of(target, batch, keys), batch)


def _whole(batch: DataFrame) -> Column:
    return F.struct(*[quoted(c) for c in batch.columns])


def _set(order: str) -> Column:
    # max_by and min_by pass over rows whose bare order is NULL, and a key with no other row would lose its row
    return F.col(quoted(order)).isNotNull()


def last_rows(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the row with the highest ``order``, a NULL being the lowest; rows without a complete key all stay."""
    complete = all_set(list(keys))
    last = (
        batch.filter(complete)
        .groupBy(*keys)
        .agg(F.max_by(_whole(batch), F.struct(_set(order), quoted(order))).alias("__r"))
        .select("__r.*")
    )
    return last.unionByName(batch.filter(~complete))


def first_rows(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the row with the lowest ``order``, a NULL being the highest; rows without a complete key all stay."""
    complete = all_set(list(keys))
    first = (
        batch.filter(complete)
        .groupBy(*keys)
        .agg(F.min_by(_whole(batch), F.struct(~_set(order), quoted(order))).alias("__r"))
        .select("__r.*")
    )
    return first.unionByName(batch.filter(~complete))


def replace_in_chunks(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    position: str,
    chunk_size: int,
) -> DataFrame:
    """Replace chunk after chunk: a later chunk removes what an earlier one inserted for a key.

    ``position`` numbers the batch rows from 0; running the result fails on a NULL position.
    Of each key the rows of its last chunk stay, which needs no loop over chunks.
    """
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    complete = all_set(list(keys))
    nowhere = F.raise_error(F.lit(f"a batch row has no {position}")).cast("bigint")
    numbered = batch.withColumn("__chunk", F.coalesce(F.floor(F.col(quoted(position)) / F.lit(chunk_size)), nowhere))
    last = numbered.filter(complete).groupBy(*keys).agg(F.max("__chunk").alias("__chunk"))
    kept = numbered.filter(complete).join(last, [*keys, "__chunk"], "left_semi").select(*batch.columns)
    return insert(without_keys_of(target, batch, keys), kept.unionByName(batch.filter(~complete)))


def replace_last_wins(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace where only the last batch row of each key counts."""
    return insert(without_keys_of(target, batch, keys), last_rows(batch, keys, order))


def _unique(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch itself; running it fails when two rows share a key."""
    rest = [c for c in batch.columns if c not in keys]
    clash = F.raise_error(F.lit(f"duplicate key {list(keys)} in upsert batch"))
    packed = F.any_value(F.struct(*[quoted(c) for c in rest], F.lit(True).alias("__in_batch")))
    return (
        batch.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), packed.alias("__b"))
        .select(*keys, F.when(F.col("__n") > 1, clash).otherwise(F.col("__b")).alias("__b"))
    )


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Insert new keys; on a known key set ``update_columns`` (default: all the batch has)."""
    keys = list(keys)
    unknown = [c for c in (update_columns or []) if c not in batch.columns or c in keys]
    if unknown:
        raise ValueError(f"cannot update {unknown}")
    offered = [c for c in batch.columns if c in target.columns and c not in keys]
    changed = set(offered if update_columns is None else update_columns)
    complete = all_set(keys)
    rows = batch.filter(complete).select(*keys, *[quoted(c) for c in offered])
    unique = _unique(rows, keys)
    small = is_small(rows)
    known = (target if small else target.filter(complete)).withColumn("__in_target", F.lit(True))
    in_target, in_batch = F.col("__in_target").isNotNull(), F.col("__b.__in_batch").isNotNull()

    def merged(name: str) -> Column:
        old = F.col(quoted(name))
        if name not in offered:
            return old
        new = F.col("__b")[name].cast(target.schema[name].dataType)
        if name in changed:
            return F.when(in_batch, new).otherwise(old)
        return F.when(in_target, old).otherwise(new)

    columns = [merged(c).alias(c) for c in target.columns]
    if small:
        out = known.join(F.broadcast(unique), keys, "left").select(*columns)
        fresh = _unknown_rows(unique, known, keys, small=True)
        out = insert(out, fresh.select(*keys, "__b.*"))
    else:
        out = known.join(unique, keys, "full_outer").select(*columns).unionByName(target.filter(~complete))
    return insert(out, batch.filter(~complete))


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert keys the target lacks; of equal keys in the batch the first in ``order``."""
    complete = all_set(list(keys))
    first = first_rows(batch.filter(complete), keys, order)
    new = _unknown_rows(first, target.filter(complete), list(keys), is_small(first))
    return insert(insert(target, new), batch.filter(~complete))


def delete_where(target: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which the predicate is not true; an unknown (NULL) outcome keeps the row."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return target.filter(~F.coalesce(condition, F.lit(False)))


def update_where(target: DataFrame, predicate: str | Column, assignments: Mapping[str, str | Column]) -> DataFrame:
    """Set columns where the predicate is true; all assignments see the old row."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    out = []
    for f in target.schema.fields:
        old = F.col(quoted(f.name))
        if f.name in assignments:
            given = assignments[f.name]
            new = F.expr(given) if isinstance(given, str) else given
            out.append(F.when(condition, new.cast(f.dataType)).otherwise(old).alias(f.name))
        else:
            out.append(old)
    return target.select(*out)


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def create_table(spark: SparkSession, ddl: str) -> DataFrame:
    """An empty table from column definitions, e.g. ``id INT, name STRING NOT NULL``."""
    return spark.createDataFrame([], ddl)


@dataclass(frozen=True)
class Insert:
    table: str
    rows: DataFrame


@dataclass(frozen=True)
class Delete:
    table: str
    predicate: str | Column


@dataclass(frozen=True)
class Update:
    table: str
    predicate: str | Column
    assignments: Mapping[str, str | Column]


@dataclass(frozen=True)
class Truncate:
    table: str


@dataclass(frozen=True)
class CreateTable:
    table: str
    ddl: str


@dataclass(frozen=True)
class Partition:
    """Add a derived column for the final ``partitionBy`` write."""

    table: str
    name: str
    value: Column


Operation = Insert | Delete | Update | Truncate | CreateTable | Partition


def apply_operations(
    spark: SparkSession, tables: Mapping[str, DataFrame], operations: Sequence[Operation]
) -> dict[str, DataFrame]:
    """Apply operations in order; nothing is written until the caller writes the result."""
    out = dict(tables)
    for op in operations:
        if isinstance(op, CreateTable):
            out.setdefault(op.table, create_table(spark, op.ddl))
            continue
        if not isinstance(op, (Insert, Delete, Update, Truncate, Partition)):
            raise ValueError(f"unknown operation: {op!r}")
        if op.table not in out:
            raise KeyError(f"no table {op.table}")
        df = out[op.table]
        if isinstance(op, Insert):
            out[op.table] = insert(df, op.rows)
        elif isinstance(op, Delete):
            out[op.table] = delete_where(df, op.predicate)
        elif isinstance(op, Update):
            out[op.table] = update_where(df, op.predicate, op.assignments)
        elif isinstance(op, Truncate):
            out[op.table] = truncate(df)
        else:
            out[op.table] = df.withColumn(op.name, op.value)
    return out
