"""Exact top-k inner products: blocks of a document range, ordered by a bound, scored until the bound falls short.

The index is a table of blocks: each holds a range of vectors as one integer matrix (its forward index) and, for
every component, the largest and smallest weight in it. For a query the block's bound is the sum of its weights
times those extremes; a query reads blocks from the highest bound on and stops when the next can't reach its k-th
best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.llm.storage import written

BLOCK = 256
#: Weights of one chunk (a range of blocks that a task holds), and queries that one task answers from it.
CHUNK_BYTES = 64 << 20
SLICE = 1 << 16
ROUND = 512  # queries that are scored together
_EXACT = float(1 << 53)

_FOUND = "query long, query_row long, chunk long, vec_id long, score long"
_INDEX = "chunk long, block long, dims int, width int, rows binary, ids binary, weights binary, high binary, low binary"


def integer_vectors(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, vec_id, weights): floor(scale * component) of every vector, written with a number for each row.

    NULL ids, NULL vectors and vectors with a NULL, NaN or infinite component take no part.
    """
    v = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].alias("v"))

    def usable(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", usable))
    weights = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return written(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", weights.alias("weights")), "vectors")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Weights as rows of one length: a vector has weight 0 beyond its end."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not m.size or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return m.astype(kind)
    return m


def block_index(vectors: DataFrame, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The blocks of ``vectors`` (row, vec_id, weights) as a written table.

    Vectors are ranged by the components that weigh most in them, so that a block's extremes are tight; the row
    number ends the key, so equal vectors spread over ranges. A chunk holds one range, or ``chunk_bytes`` of it.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.sum(F.size("weights")).alias("weights")).first()
    ranges = max(1, -(-(size.weights or 0) * 2 // chunk_bytes), min(spark.sparkContext.defaultParallelism, size.n // (4 * block)))

    def pack(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        base, number, filled = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                m = _matrix(part.column("weights"))
                held = _narrow(m)
                high, low = (f(m, axis=0).astype(np.int64) if m.size else np.zeros(m.shape[1], np.int64) for f in (np.max, np.min))
                filled += held.nbytes
                chunk = base + filled // chunk_bytes
                ids = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id")]
                values = [m.shape[1], held.itemsize, *ids, held.tobytes(), high.tobytes(), low.tobytes()]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([number], pa.int64()), *[pa.array([v], t) for v, t in zip(values, kinds)]],
                    ["chunk", "block", "dims", "width", "rows", "ids", "weights", "high", "low"],
                )
                number += 1

    def heaviest(after: Column) -> Column:
        """Position, signed, of the largest magnitude among (magnitude, position) below ``after``."""
        return F.array_max(F.filter("by_weight", lambda p: p < after))

    by_weight = F.transform("weights", lambda x, i: F.struct(F.abs(x.cast("double")).alias("size"), F.signum(x.cast("double")) * (i + 1)))
    keyed = vectors.withColumn("by_weight", by_weight).withColumn("first", F.array_max("by_weight"))
    keyed = keyed.withColumn("second", heaviest(F.col("first")))
    keyed = keyed.withColumn("a", F.col("first.col2")).withColumn("b", F.col("second.col2"))
    ranged = keyed.repartitionByRange(int(ranges), "a", "b", "row").sortWithinPartitions("a", "b", "row")
    return written(ranged.select("row", "vec_id", "weights").mapInArrow(pack, _INDEX), "blocks")


class _Blocks:
    """The blocks of one chunk."""

    def __init__(self, table: pa.Table):
        self.blocks = []
        for r in table.sort_by("block").to_pylist():
            kind = {2: np.int16, 4: np.int32, 8: np.int64}[r["width"]]
            ids, rows = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows"))
            self.blocks.append((ids, rows, np.frombuffer(r["weights"], kind).reshape(len(ids), r["dims"])))
        self.dims = max([r[2].shape[1] for r in self.blocks], default=0)
        ends = [self._wide(np.frombuffer(x, np.int64)) for c in ("high", "low") for x in table.sort_by("block").column(c).to_pylist()]
        self.high, self.low = np.array(ends[: len(self.blocks)]), np.array(ends[len(self.blocks) :])

    def _wide(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((*x.shape[:-1], self.dims), np.int64)
        out[..., : x.shape[-1]] = x[..., : self.dims]
        return out


def _best(score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score), axis=-1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)


_NONE = -np.iinfo(np.int64).max  # its negative must fit


def _search(held: _Blocks, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of the chunk for each query that reach ``least``; _NONE marks free places."""
    n = len(queries)
    q = held._wide(queries)
    sizes = np.abs(q.astype(np.float64)).sum(axis=1).max(initial=0) * max(np.abs(held.high).max(initial=0), np.abs(held.low).max(initial=0))
    exact = sizes < _EXACT / BLOCK  # then doubles hold every sum, and sums of sums
    q = q.astype(np.float64) if exact else q
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    if exact:
        bound = up @ held.high.T.astype(np.float64) + down @ held.low.T.astype(np.float64)
    else:  # rounding may not lower a bound
        bound = up.astype(np.float64) @ held.high.T.astype(np.float64) + down.astype(np.float64) @ held.low.T.astype(np.float64)
        bound = bound + np.abs(bound).max(initial=0) * 1e-9 + np.abs(up - down).astype(np.float64) @ np.maximum(np.abs(held.high), np.abs(held.low)).T.astype(np.float64) * 1e-9
    order = np.argsort(-bound, axis=1, kind="stable")
    score, vec = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
    active = np.arange(n)
    for turn in range(len(held.blocks)):
        block = order[active, turn]
        floor = np.maximum(score[active, k - 1], least[active])
        active = active[bound[active, block] >= floor]
        if not len(active):
            break
        block = order[active, turn]
        by_block = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[by_block])) + 1
        for some in np.split(by_block, cuts):
            who = active[some]
            ids, rows, weights = held.blocks[block[some[0]]]
            m = weights.astype(np.float64 if exact else np.int64)
            s = (q[who, : m.shape[1]] @ m.T).astype(np.int64)
            other = rows[None, :] != own[who, None]
            if len(ids) > k:  # what is below the block's own k-th best score can't count
                kth = np.partition(np.where(other, s, _NONE), len(ids) - k, axis=1)[:, len(ids) - k]
                other &= s >= np.maximum(kth, np.maximum(score[who, k - 1], least[who]))[:, None]
            width = int(other.sum(axis=1).max(initial=0))
            if not width:
                continue
            first = np.argsort(~other, axis=1, kind="stable")[:, :width]
            there = np.take_along_axis(other, first, 1)
            s = np.where(there, np.take_along_axis(s, first, 1), _NONE)
            v = np.where(there, ids[first], np.iinfo(np.int64).max)
            score[who], vec[who] = _best(np.concatenate([score[who], s], axis=1), np.concatenate([vec[who], v], axis=1), k)
    return score, vec


def _scored(index: DataFrame, asked: DataFrame, slices: int, k: int) -> DataFrame:
    """The k best of a chunk for each of ``asked`` (chunk, slice, query, query_row, weights, least)."""

    def answer(blocks: pa.Table, queries: pa.Table):
        out = [[], [], [], []]
        if blocks.num_rows and queries.num_rows:
            held = _Blocks(blocks)
            for a in range(0, queries.num_rows, ROUND):
                part = queries.slice(a, ROUND).combine_chunks()
                own = part.column("query_row").to_numpy()
                score, vec = _search(held, _matrix(part.column("weights").chunk(0)), own, part.column("least").to_numpy(), k)
                who, place = np.nonzero((score > _NONE) & (vec < np.iinfo(np.int64).max))
                for x, y in zip(out, (part.column("query").to_numpy()[who], own[who], vec[who, place], score[who, place])):
                    x.append(y)
        query, row, vec, score = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        chunk = np.full(len(query), blocks.column("chunk")[0].as_py() if blocks.num_rows else 0, np.int64)
        return pa.table([pa.array(x) for x in (query, row, chunk, vec, score)], ["query", "query_row", "chunk", "vec_id", "score"])

    repeated = index.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    sides = repeated.groupBy("chunk", "slice").cogroup(asked.groupBy("chunk", "slice"))
    return sides.applyInArrow(answer, _FOUND)


def _k_best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, index: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (row, vec_id, weights) that ``is_query`` names,
    the ``k`` highest integer inner products with all other rows of ``index``, all of them if there are fewer;
    equal scores go by the smaller id.

    A repeated id is a row like any other: each such row is a candidate and, if named, a query of its own. A
    shorter vector has weight 0 beyond its end. Products are exact while they fit 64 bits. Empty tables give no rows.

    Queries first meet the chunk that holds them: its k-th score is a floor, below which blocks of the other
    chunks are passed over. Queries travel to chunks; a chunk is repeated only for each SLICE queries.
    """
    def homes(batches):
        for b in batches:
            for chunk, rows in zip(b.column("chunk").to_pylist(), b.column("rows").to_pylist()):
                row = np.frombuffer(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), chunk))], ["row", "chunk"])

    queries = vectors.where(is_query)
    slices = -(-queries.count() // SLICE) or 1
    spread = F.pmod(F.xxhash64("row"), F.lit(slices)).alias("slice")
    home = queries.join(index.select("chunk", "rows").mapInArrow(homes, "row long, chunk long"), "row")
    home = home.select("chunk", spread, F.col("vec_id").alias("query"), F.col("row").alias("query_row"), "weights")
    home = written(home, "queries")
    near = written(_scored(index, home.withColumn("least", F.lit(_NONE)), slices, k), "near")
    floor = _k_best(near, k).where(F.col("rank") == k).select("query_row", F.col("score").alias("least"))
    numbers = sorted(r.chunk for r in index.select("chunk").distinct().collect())  # one for each 64 MB of vectors
    if len(numbers) < 2:
        found = near
    else:
        everywhere = F.explode(F.filter(F.lit(numbers), lambda c: c != F.col("chunk")))
        far = home.join(floor, "query_row", "left").select(
            everywhere.alias("chunk"), "slice", "query", "query_row", "weights", F.coalesce("least", F.lit(_NONE)).alias("least")
        )
        found = near.unionByName(_scored(index, far, slices, k))
    best = _k_best(found, k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")
