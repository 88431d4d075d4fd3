"""Packing along a space-filling curve: neighbours by content share training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.llm.blocks import mix
from plumbspark.llm.storage import written
from plumbspark.llm.token_files import IDS, Form, id_type, slices, tokenized

DIMENSIONS = 3
BITS = 12


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with unsigned integer coordinates (n x dimensions).

    Skilling's transform: undo the rotations from the highest bit down, Gray-code, then interleave bits.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def signs(ids: np.ndarray, dimension: int) -> np.ndarray:
    """+1 or -1 for each id, from the id's hash: one dimension of a sparse random projection."""
    h = mix(ids.astype(np.uint64) + np.uint64(0x5EED))
    return 1 - 2 * ((h >> np.uint64(dimension)) & np.uint64(1)).astype(np.int8)


def projection(dimensions: int = DIMENSIONS):
    """A function of all ids and the documents' first places: the mean of each document's projected one-hot vectors."""
    tables: list[np.ndarray] = []

    def project(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        need = max(1 << 16, int(ids.max(initial=0)) + 1)
        if not tables or len(tables[0]) < need:
            tables[:] = [signs(np.arange(need), k) for k in range(dimensions)]
        n = np.diff(np.append(starts, len(ids)))
        # whole numbers: the sums are exact in any order
        return np.column_stack([np.add.reduceat(t[ids], starts, dtype=np.int64) / n for t in tables])

    return project


def curve_order(points: DataFrame, bits: int = BITS, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds ``curve``: the Hilbert key after each dimension is spread by its mean and deviation over all documents."""
    spread = points.agg(
        *[F.avg(F.col("point")[i]).alias(f"m{i}") for i in range(dimensions)],
        *[F.stddev_pop(F.col("point")[i]).alias(f"s{i}") for i in range(dimensions)],
    ).first()
    mean = np.array([spread[f"m{i}"] or 0.0 for i in range(dimensions)])
    deviation = np.array([spread[f"s{i}"] or 0.0 for i in range(dimensions)])
    deviation[deviation == 0] = 1.0

    def place(batches):
        for b in slices(batches):
            p = np.array(b.column("point").to_pylist(), np.float64).reshape(-1, dimensions)
            share = 1 / (1 + np.exp(-1.702 * ((p - mean) / deviation).clip(-20, 20)))  # about the normal share below
            grid = np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            yield b.drop_columns(["point"]).append_column("curve", pa.array(hilbert_key(grid, bits)))

    return points.mapInArrow(place, "doc_id long, n_tokens long, ids binary, curve long")


def packed(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    form: Form = IDS,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: doc_id, start, length, doc_tokens, sequence_id, offset, and
    ids as bytes of ``id_type``, or in another ``form``.

    Documents lie one after another along the Hilbert curve; a sequence is ``length`` ids of that line, so
    only the very last one needs padding. Rows are dealt out by ranges of (curve, hash of the id, doc_id), so
    equal documents spread over tasks. Each task gives positions inside its range; the ranges' totals, one
    row each, make them global.

    NULL and empty texts hold the end id alone; NULL and repeated doc_ids stay rows of their own; an empty
    table gives no pieces. A document longer than a sequence is cut into pieces.
    """
    spark, kind = docs.sparkSession, id_type(vocabulary, end_id)
    width = np.dtype(kind).itemsize
    points = written(tokenized(docs, vocabulary, end_id, id_col, text_col, projection()), "packing-points", codec="zstd")
    order = [F.col("curve"), F.xxhash64("doc_id"), F.col("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = curve_order(points).repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    line = line.withColumn("range", F.spark_partition_id())

    def walk(batches):
        at = 0
        for b in slices(batches):
            n = b.column("n_tokens").to_numpy()
            ends = at + np.cumsum(n)
            yield b.drop_columns(["curve"]).append_column("local", pa.array((ends - n).astype(np.int64)))
            at = int(ends[-1])

    walked = line.mapInArrow(walk, "doc_id long, n_tokens long, ids binary, range int, local long")
    laid = written(walked, "packing-line", codec="zstd")
    totals = laid.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    # one row a range, never a row a document
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the number of ranges is a setting, whatever the corpus
    placed = laid.join(F.broadcast(starts), "range").select(
        "doc_id", F.col("n_tokens").alias("doc_tokens"), (F.col("base") + F.col("local")).alias("at"), "ids"
    )

    def cut(batches):
        for b in slices(batches):
            rows = []
            for doc_id, n, at, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "at", "ids"))):
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    rows.append((doc_id, start, size, n, (at + start) // length, offset, ids[width * start : width * (start + size)]))
                    start += size
            *numbers, parts = zip(*rows) if rows else [[]] * 7
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", form.name]
            arrays = [*(pa.array(c, pa.int64()) for c in numbers), form.make(list(parts), kind)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, f"{schema}, {form.name} {form.type}")
