"""Lines that many documents share leave all of them; documents can be added to and taken out of the counts.

The exact state is a table (high, low, n): a line key's 128-bit hash and the number of documents that hold
it. Cuckoo filters, one for each shard of the key space, hold the keys at or over the limit; what the
filters wrongly pass among all counted keys is listed as exceptions, so a line's fate is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbspark.llm.blocks import blocks, rows_of, split_flat
from plumbspark.llm.cuckoo import CuckooFilter
from plumbspark.llm.storage import written

WHITE = " \t\n\v\f\r"
KEYS_PER_SHARD = 1 << 15
#: Filters and exceptions up to this size go to every task; beyond it lines meet the counts in a join.
SHARED_BYTES = 64 << 20


@dataclass(frozen=True)
class LineIndex:
    """counts: (high, low, n); filters: (shard, content); both written tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _keys(texts: pa.Array, min_chars: int):
    """Row and code of each line, the codes' hash halves, and whether a code is long enough to count."""
    row, lines = split_flat(pc.split_pattern(texts, "\n"))
    coded = pc.ascii_lower(pc.ascii_trim(lines, characters=WHITE)).dictionary_encode()
    keys = coded.dictionary
    raw = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys.to_pylist())
    halves = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
    counts = pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= min_chars
    return row, coded.indices.to_numpy(zero_copy_only=False), halves[:, 0], halves[:, 1], counts


def line_counts(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(high, low, n): documents that hold each line key; a task adds up its blocks before the shuffle."""

    def count(batches):
        for _, texts in blocks(batches):
            row, code, high, low, counted = _keys(texts, min_chars)
            pairs = np.unique(row * len(high) + code) % max(1, len(high))
            n = np.bincount(pairs, minlength=len(high))
            arrays = [high[counted].view(np.int64), low[counted].view(np.int64), n[counted]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["high", "low", "n"])

    found = rows_of(docs, id_col, text_col).mapInArrow(count, "high long, low long, n long")
    return found.groupBy("high", "low").agg(F.sum("n").alias("n"))


def _shard(shards: int) -> Column:
    return F.shiftrightunsigned("low", 40).bitwiseAND(F.lit(shards - 1)).cast("int")


def _filters(frequent: DataFrame, shards: int) -> DataFrame:
    """One filter a shard; a shard holds KEYS_PER_SHARD keys or so, whatever the corpus."""

    def build(table: pa.Table) -> pa.Table:
        high, low = (table.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        made = CuckooFilter.sized_for(len(high))
        while not made.insert(high, low):
            made = CuckooFilter(2 * len(made.table))
        return pa.table({"shard": table.column("shard")[:1], "content": pa.array([made.to_bytes()], pa.binary())})

    keyed = frequent.select("high", "low", _shard(shards).alias("shard"))
    return keyed.groupBy("shard").applyInArrow(build, "shard int, content binary")


def _indexed(counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
    frequent = counts.where(F.col("n") >= min_docs)
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, frequent.count()) / KEYS_PER_SHARD))))
    return LineIndex(counts, written(_filters(frequent, shards), "line-filters"), shards, min_docs, min_chars)


def build_index(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> LineIndex:
    return _indexed(written(line_counts(docs, min_chars, id_col, text_col), "line-counts"), min_docs, min_chars)


def changed_index(
    index: LineIndex,
    added: DataFrame | None = None,
    deleted: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> LineIndex:
    """The index after documents came and went. Only keys that cross the limit touch the filters: they are
    inserted into or deleted from their shard's. Deleting what was added restores the earlier decisions."""
    parts = [index.counts.withColumn("was", F.col("n"))]
    for docs, sign in ((added, 1), (deleted, -1)):
        if docs is not None:
            delta = line_counts(docs, index.min_chars, id_col, text_col)
            parts.append(delta.select("high", "low", (F.col("n") * sign).alias("n"), F.lit(0).alias("was")))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("high", "low").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
    merged = written(merged, "line-merged")
    if not merged.where("n < 0").isEmpty():
        raise ValueError("documents were deleted that the index doesn't hold")
    counts = written(merged.where("n > 0").select("high", "low", "n"), "line-counts")
    now, before = F.col("n") >= index.min_docs, F.col("was") >= index.min_docs
    crossed = merged.where(now != before).select("high", "low", now.alias("enters"), _shard(index.shards).alias("shard"))

    def change(filters: pa.Table, keys: pa.Table) -> pa.Table:
        high, low = (keys.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        enters = keys.column("enters").to_numpy().astype(bool)
        content = filters.column("content").to_pylist()
        held = CuckooFilter.from_bytes(content[0]) if content else CuckooFilter.sized_for(max(64, 2 * len(high)))
        held.delete(high[~enters], low[~enters])
        full = not held.insert(high[enters], low[enters])
        shard = (filters if content else keys).column("shard")[:1]
        return pa.table({"shard": shard, "content": pa.array([None if full else held.to_bytes()], pa.binary())})

    sides = index.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
    filters = written(sides.applyInArrow(change, "shard int, content binary"), "line-filters")
    if not filters.where("content IS NULL").isEmpty():
        return _indexed(counts, index.min_docs, index.min_chars)
    return LineIndex(counts, filters, index.shards, index.min_docs, index.min_chars)


def _passes(filters: dict[int, CuckooFilter], shards: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    shard = ((low >> np.uint64(40)) & np.uint64(shards - 1)).astype(np.int64)
    out = np.zeros(len(high), bool)
    for s in np.unique(shard):
        if s in filters:
            own = np.flatnonzero(shard == s)
            out[own] = filters[s].contains(high[own], low[own])
    return out


def without_common_lines(
    docs: DataFrame, index: LineIndex, shared_bytes: int = SHARED_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each counted document's text without the lines whose key is in
    ``min_docs`` documents or more.

    A key is the line without ASCII white space at both ends, ASCII letters lower-cased; keys shorter than
    ``min_chars`` code points stay. One row for each row of ``docs``, repeated rows (each counts as a
    document) and NULL ids included. A NULL or empty text is one empty line. A text that loses all lines
    becomes empty. ``docs`` must be part of what the index counted. An empty table gives no rows.

    The filters go to the tasks while they measure ``shared_bytes`` at most; a larger index is joined with
    the lines by their key, to the same result.
    """
    rows = rows_of(docs, id_col, text_col).withColumnRenamed("doc_id", "carry")
    return _dropped(rows, index, shared_bytes).withColumnRenamed("carry", "doc_id")


def common_lines_dropped(docs: DataFrame, index: LineIndex, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``docs`` with shorter texts: all columns stay, ``n_chars`` follows the text where it is there and
    the text lost lines; a NULL text stays NULL."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(F.struct(others.alias("row"), F.isnull("text").alias("none")).alias("carry"), "text")
    kept = _dropped(rows, index, shared_bytes)
    new = {"text": F.when(~F.col("carry.none"), F.col("kept"))}
    if "n_chars" in docs.columns:
        count = F.length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_dropped") > 0, count).otherwise(F.col("carry.row.n_chars"))
    return kept.select(*[new.get(c, F.col(f"carry.row.`{c}`")).alias(c) for c in docs.columns])


def _dropped(rows: DataFrame, index: LineIndex, shared_bytes: int) -> DataFrame:
    """(carry, n_lines, n_dropped, kept) of rows (carry, text)."""
    spark = rows.sparkSession
    bytes_ = index.filters.agg(F.sum(F.length("content"))).first()[0] or 0
    if bytes_ > shared_bytes:
        return _dropped_joined(rows, index)
    shards, min_chars = index.shards, index.min_chars
    filters = spark.sparkContext.broadcast({r.shard: r.content for r in index.filters.collect()})

    def loaded() -> dict[int, CuckooFilter]:
        return {s: CuckooFilter.from_bytes(raw) for s, raw in filters.value.items()}

    def wrong(batches):
        held = loaded()
        for b in batches:
            high, low = (b.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            yield b.filter(pa.array(_passes(held, shards, high, low)))

    rare = index.counts.where(F.col("n") < index.min_docs).select("high", "low")
    exceptions = written(rare.mapInArrow(wrong, "high long, low long"), "line-exceptions")
    if 64 * exceptions.count() > shared_bytes:
        return _dropped_joined(rows, index)
    except_ = spark.sparkContext.broadcast({(r.high, r.low) for r in exceptions.collect()})

    def drop(batches):
        held = loaded()
        for part, texts in blocks(batches):
            row, code, high, low, counted = _keys(texts, min_chars)
            common = counted & _passes(held, shards, high, low)
            for i in np.flatnonzero(common) if except_.value else ():
                if (int(high[i].view(np.int64)), int(low[i].view(np.int64))) in except_.value:
                    common[i] = False
            yield _kept(part, texts, row, common[code])

    return rows.mapInArrow(drop, _kept_schema(rows))


def _kept_schema(rows: DataFrame) -> T.StructType:
    carry = T.StructType([T.StructField("carry", rows.schema["carry"].dataType)])
    return carry.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")


def _kept(part: pa.RecordBatch, texts: pa.Array, row: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    n_lines = np.bincount(row, minlength=len(texts))
    n_dropped = np.bincount(row[gone], minlength=len(texts))
    ends = np.cumsum(n_lines)
    kept = texts.to_pylist()
    for i in np.flatnonzero(n_dropped):
        stay = ~gone[ends[i] - n_lines[i] : ends[i]]
        kept[i] = "\n".join(line for line, s in zip(kept[i].split("\n"), stay.tolist()) if s)
    arrays = [part.column("carry"), pa.array(n_lines), pa.array(n_dropped), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["carry", "n_lines", "n_dropped", "kept"])


def _dropped_joined(rows: DataFrame, index: LineIndex) -> DataFrame:
    """The same by a join of line keys with the counts: texts are known by a digest, so copies meet once."""
    min_chars = index.min_chars

    def lines(batches):
        for _, texts in blocks(batches):
            row, code, high, low, counted = _keys(texts, min_chars)
            digest = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()]
            number = np.arange(len(row)) - np.repeat(np.cumsum(np.bincount(row)) - np.bincount(row), np.bincount(row))
            some = np.flatnonzero(counted[code])
            arrays = [
                pa.array([digest[i] for i in row[some]], pa.binary()),
                pa.array(number[some]),
                pa.array(high[code[some]].view(np.int64)),
                pa.array(low[code[some]].view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "number", "high", "low"])

    def named(batches):
        for part, texts in blocks(batches):
            digest = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()]
            arrays = [part.column("carry"), texts, pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["carry", "text", "digest"])

    common = index.counts.where(F.col("n") >= index.min_docs).select("high", "low")
    found = rows.mapInArrow(lines, "digest binary, number long, high long, low long").join(common, ["high", "low"])
    gone = found.groupBy("digest").agg(F.collect_set("number").alias("gone"))
    schema = T.StructType([T.StructField("carry", rows.schema["carry"].dataType)])
    schema = schema.add("text", "string").add("digest", "binary")
    whole = rows.mapInArrow(named, schema).join(gone, "digest", "left")

    def drop(batches):
        for part, texts in blocks(batches):
            row, _ = split_flat(pc.split_pattern(texts, "\n"))
            n_lines = np.bincount(row, minlength=len(texts))
            starts = np.cumsum(n_lines) - n_lines
            marked = np.zeros(len(row), bool)
            for i, numbers in enumerate(part.column("gone").to_pylist()):
                marked[starts[i] + np.array(numbers or [], np.int64)] = True
            yield _kept(part, texts, row, marked)

    return whole.select("carry", "text", "gone").mapInArrow(drop, _kept_schema(rows))
