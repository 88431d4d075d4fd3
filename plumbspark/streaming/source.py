"""File streams and runs to the end of the available input."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from plumbspark.functions.columns import quoted


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, ts: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` becomes a timestamp usable by watermarks.

    A glob pattern may stand for the folder, and then also match single files.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = reader.parquet(path)
    return out if ts is None else out.withColumn(ts, F.col(quoted(ts)).cast("timestamp"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet until the present input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Counts, for every query started while it listens, the rows dropped behind the watermark.

    A query itself remembers its last progress reports only; this adds up all of them.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._counts, self._ended = spark, defaultdict(int), defaultdict(threading.Event)

    def __enter__(self) -> LateRows:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def of(self, query: StreamingQuery, seconds: float = 60) -> int:
        """Rows dropped in the whole run of an ended query."""
        run = str(query.runId)
        if not self._ended[run].wait(seconds):
            raise TimeoutError("the query's end was not reported")
        return self._counts[run]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._counts[str(progress.runId)] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()
