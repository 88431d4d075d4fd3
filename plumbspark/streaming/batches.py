"""Work per micro-batch: check runs and keyed upserts, safe to repeat after a failure.

A batch writes into its own partition and replaces it when it is run again, so
a batch that Spark repeats leaves the same rows behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbspark.functions.columns import all_set, clean_double, quoted
from plumbspark.functions.shared_dir import exists, names_in, remove
from plumbspark.operators.checks import TableCheck
from plumbspark.operators.writes import upsert
from plumbspark.plans.check_run import run_checks


def _write_batch(rows: DataFrame, batch_id: int, folder: str) -> None:
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(folder)
    )


def _start(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def check_stream(stream: DataFrame, check: TableCheck, as_of, history: str, checkpoint: str) -> StreamingQuery:
    """Run a table's checks on every micro-batch and keep the results by batch.

    A rule that fails on a batch gives an ``error`` row; the stream goes on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        results, _ = run_checks(batch.sparkSession, {check.table_name: batch}, [check], as_of)
        _write_batch(results, batch_id, history)

    return _start(stream, each, checkpoint)


def upsert_stream(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to a change log; ``current_rows`` resolves the keys."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, log)

    return _start(stream, each, checkpoint)


def _folded(spark: SparkSession, log: str) -> tuple[str | None, int]:
    """The finished base that reaches furthest, and the last batch in it."""
    base = f"{log.rstrip('/')}-base"
    done = [int(n.partition("=")[2]) for n in names_in(spark, base) if n.startswith("upto=") and exists(spark, f"{base}/{n}/_SUCCESS")]
    return (f"{base}/upto={max(done)}", max(done)) if done else (None, -1)


def _changes(spark: SparkSession, log: str) -> DataFrame:
    """The base and the batches after it; batches that the base holds don't count, whether or not they are still there."""
    base, upto = _folded(spark, log)
    batches = [n for n in names_in(spark, log) if n.startswith("batch_id=")]
    if not batches:
        return spark.read.parquet(base)
    later = spark.read.parquet(log).where(F.col("batch_id") > upto).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return later if base is None else spark.read.parquet(base).unionByName(later, allowMissingColumns=True)


def _latest(changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    complete = all_set(list(keys))
    latest = F.max_by(F.struct(*[quoted(c) for c in changes.columns]), F.struct("batch_id", quoted(order)))
    known = changes.filter(complete).groupBy(*keys).agg(latest.alias("__r")).select("__r.*")
    return known.unionByName(changes.filter(~complete))


def current_rows(spark: SparkSession, log: str, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key of a change log: later batch first, then higher ``order``, NULL being the lowest.
    Rows without a complete key all stay."""
    return _latest(_changes(spark, log), keys, order).drop("batch_id")


def compact(spark: SparkSession, log: str, keys: Sequence[str], order: str, upto: int | None = None) -> int:
    """Folds the batches up to ``upto`` (default: all but the last, which may still be repeated) into a base and
    removes them; gives the last batch in the base.

    The base counts from the moment its last file is marked, and with it no batch up to its number. So a failure
    before, between or while the batches are removed changes no result, and a batch that Spark repeats
    afterwards is passed over. Bases of before go last.
    """
    old, done = _folded(spark, log)
    batches = [int(n.partition("=")[2]) for n in names_in(spark, log) if n.startswith("batch_id=")]
    last = max(batches, default=0) - 1 if upto is None else upto
    if last > done:
        base = f"{log.rstrip('/')}-base/upto={last}"
        changes = _changes(spark, log).where(F.col("batch_id") <= last)
        _latest(changes, keys, order).withColumn("batch_id", F.lit(last).cast("bigint")).write.mode("overwrite").parquet(base)
        done = last
    for batch in batches:
        if batch <= done:
            remove(spark, f"{log}/batch_id={batch}")
    if old is not None and not old.endswith(f"upto={done}"):
        remove(spark, old)
    return done


def merged_table(target: DataFrame, log: str, keys: Sequence[str], order: str) -> DataFrame:
    """A base table with the change log applied."""
    return upsert(target, current_rows(target.sparkSession, log, keys, order), keys)


def keep_late(stream: DataFrame, ts: str, lateness: str, out: str, checkpoint: str, lag: int = 1) -> StreamingQuery:
    """Rows go to ``out/on_time`` or, behind the watermark, to ``out/late``, by batch; late ones have it as ``mark``.

    The mark is the latest time of all earlier batches, to the millisecond, minus ``lateness``; rows at or before it
    are late. Those are the rows that Spark's stateful operators drop in a run of one batch, since such runs end
    with an empty one. From the second batch of a run on, the operators go by the mark of the batch before: ``lag=2``.
    Every batch stores what it adds to the mark, so a repeated batch deals its rows out as before. Rows without a
    time are on time.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = F.lit(None).cast("timestamp")
        if batch_id >= lag:
            seen = spark.read.parquet(f"{out}/marks").where(F.col("batch_id") <= batch_id - lag).agg(F.max("mark")).first()[0]
            mark = F.lit(seen).cast("timestamp")
        marked = batch.withColumn("mark", mark)
        late = F.coalesce(F.col(quoted(ts)) <= F.col("mark"), F.lit(False))
        _write_batch(marked.where(late), batch_id, f"{out}/late")
        _write_batch(batch.where(~F.coalesce(F.col(quoted(ts)) <= mark, F.lit(False))), batch_id, f"{out}/on_time")
        latest = F.date_trunc("millisecond", F.max(quoted(ts))) - F.expr(f"INTERVAL {lateness}")
        _write_batch(batch.agg(latest.cast("timestamp").alias("mark")), batch_id, f"{out}/marks")

    return _start(stream, each, checkpoint)


def late_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """What ``keep_late`` put aside, with ``mark`` and ``batch_id``; ``schema`` is the stream's."""
    kinds = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    if not [n for n in names_in(spark, f"{out}/late") if n.startswith("batch_id=")]:
        return spark.createDataFrame([], f"{kinds}, mark timestamp, batch_id bigint")
    return spark.read.schema(f"{kinds}, mark timestamp, batch_id bigint").parquet(f"{out}/late")


def flag_stream(stream: DataFrame, limits: Callable[[], DataFrame], value: str, log: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch with ``is_anomaly``, by the bounds that ``limits`` gives when the batch is run.

    ``limits`` returns a row of ``iqr_thresholds``; NULL bounds flag nothing. The flagged rows are kept by batch, and a
    repeated batch is flagged anew. ``windows.flagged_rate`` makes rates of them.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        v, bounds = clean_double(batch, value), limits().first()
        outside = [v < F.lit(bounds.lower_bound).cast("double"), v > F.lit(bounds.upper_bound).cast("double")]
        _write_batch(batch.withColumn("is_anomaly", F.coalesce(outside[0] | outside[1], F.lit(False))), batch_id, log)

    return _start(stream, each, checkpoint)
