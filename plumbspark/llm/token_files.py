"""Token ids as files: frequency-ranked, byte-aligned variable length, control bytes apart.

A file holds blocks, one to a row, in ascending order of document id. Layout of a block's ``payload``:

    8 bytes   magic ``PSTOKEN1``
    8 x u32   n_docs, n_ids, bytes of control, bytes of data, four reserved
    n_docs x u32   ids of each document
    control   two bits an id, four ids a byte, lowest bits first: bytes of its rank minus one
    data      the ranks, little-endian, 1 to 4 bytes each

A rank is an id's place by falling corpus frequency, so frequent ids take one byte. The blocks lie in
Parquet files (columns ``shard``, ``block``, ``doc_ids``, ``payload``), whose commit protocol makes a
repeated task harmless on any store that Spark can write.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbspark.functions.shared_dir import shared_folder
from plumbspark.llm.blocks import blocks, ids_of, release, rows_of
from plumbspark.llm.bpe import encoder
from plumbspark.llm.storage import written

MAGIC = b"PSTOKEN1"
BLOCK_IDS = 1 << 18
#: Bytes of each of a control byte's four ranks, and their sum: the tables that decoding looks up.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
TOTALS = SIZES.sum(axis=1)


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = ranks.view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) < size[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks again: every control byte's sizes come from a table."""
    size = SIZES[control].reshape(-1)[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < size[:, None]] = data
    return raw.view("<u4").reshape(-1)


def encode_block(lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([len(lengths), len(ranks), len(control), len(data), 0, 0, 0, 0], "<u4")
    return b"".join([MAGIC, head.tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, all ranks)."""
    if payload[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n_ids, n_control, n_data = np.frombuffer(payload, "<u4", 4, 8).tolist()
    at = 40
    lengths = np.frombuffer(payload, "<u4", n_docs, at)
    control = np.frombuffer(payload, np.uint8, n_control, at := at + 4 * n_docs)
    data = np.frombuffer(payload, np.uint8, n_data, at + n_control)
    if len(payload) != at + n_control + n_data or TOTALS[control].sum() - (4 * n_control - n_ids) != n_data:
        raise ValueError("a damaged block of token ids")
    return lengths, unpack(control, data, n_ids)


@dataclass(frozen=True)
class Form:
    """The column that stands for each row's ids: ``make`` takes the rows' bytes and their ``id_type``. Made where the ids
    arise, so that they don't pass through a second Python worker."""

    name: str
    type: str
    make: Callable[[list[bytes | memoryview], str], pa.Array]


def _as_bytes(parts: list[bytes | memoryview], kind: str) -> pa.Array:
    return pa.array([bytes(x) for x in parts], pa.binary())


def _as_crc32(parts: list[bytes | memoryview], kind: str) -> pa.Array:
    wide = parts if kind == "<u4" else (np.frombuffer(x, kind).astype("<u4") for x in parts)
    return pa.array([zlib.crc32(x) for x in wide], pa.int64())


def _as_list(parts: list[bytes | memoryview], kind: str) -> pa.Array:
    ends = np.cumsum([0, *(memoryview(x).nbytes // np.dtype(kind).itemsize for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), kind).astype(np.int32)))


IDS = Form("ids", "binary", _as_bytes)
CRC32 = Form("ids_crc32", "long", _as_crc32)
LISTED = Form("ids", "array<int>", _as_list)


@dataclass(frozen=True)
class TokenFiles:
    """Where the files lie, the ids by rank, and each shard's first position."""

    path: str
    id_of_rank: np.ndarray
    starts: DataFrame


def id_type(vocabulary: str, end_id: int) -> str:
    """Little-endian unsigned integers that hold all ids: two bytes each where they suffice."""
    return "<u2" if max(encoder(vocabulary).library.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def tokenized(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    point: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Each document's ids with the end id as bytes of ``id_type``, and their number. ``point`` makes a column of that name
    in the same pass: a row of numbers for each document, from all ids one after another and the documents' first places."""
    kind = id_type(vocabulary, end_id)

    def encode(batches):
        library = encoder(vocabulary)
        for rows, texts in blocks(batches, 6 << 20):
            ids, offsets = library.encode(texts)
            ids = np.insert(ids.astype(kind), offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            ends = pa.py_buffer((ids.itemsize * offsets).astype(np.int32))
            column = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, ends, pa.py_buffer(ids)])
            out = pa.RecordBatch.from_arrays(
                [ids_of(rows), pa.array(np.diff(offsets).astype(np.int64)), column], ["doc_id", "n_tokens", "ids"]
            )
            if point is not None:
                at = point(ids, offsets[:-1])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), at.shape[1]).cast(pa.list_(pa.float64()))
                out = out.append_column("point", lists)
            yield out
            release()

    schema = "doc_id long, n_tokens long, ids binary" + (", point array<double>" if point is not None else "")
    return rows_of(docs, id_col, text_col).mapInArrow(encode, schema)


def flat_ids(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """All ids of a binary column without NULLs, without a copy."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, kind)
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def slices(batches, rows: int = 1000):
    """Batches of ``rows`` rows at most."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; each task adds up before the shuffle."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in slices(batches):
            n = np.bincount(flat_ids(batch.column("ids"), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(tokens: DataFrame, kind: str, path: str, shards: int | None = None) -> TokenFiles:
    """Write (doc_id, n_tokens, ids) in ascending doc_id order; NULL ids come first, equal ids by their bytes.

    The rank table has one entry for each id in use: bounded by the vocabulary. Rows are dealt out by
    ranges of (doc_id, hash of the ids), so repeated ids can't gather in one task."""
    spark = tokens.sparkSession
    ranked = id_counts(tokens, kind).orderBy(F.desc("n"), "id").collect()
    id_of_rank = np.array([r.id for r in ranked], "<u4")
    rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, "<u4")
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank))
    shared = spark.sparkContext.broadcast(rank_of_id)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    dealt = tokens.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    dealt = dealt.withColumn("shard", F.spark_partition_id())

    def flush(shard, number, start, doc_ids, lengths, parts):
        lengths = np.array(lengths, np.int64)
        ranks = shared.value[np.concatenate(parts)] if parts else np.zeros(0, "<u4")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([number], pa.int64()),
                pa.array([start], pa.int64()),
                pa.array([len(ranks)], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([encode_block(lengths, ranks)], pa.binary()),
            ],
            ["shard", "block", "start", "n_ids", "doc_ids", "payload"],
        )

    def write(batches):
        number = start = held = 0
        doc_ids, lengths, parts, shard = [], [], [], None
        for batch in slices(batches):
            for doc_id, raw, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "shard"))):
                ids = np.frombuffer(raw, kind)
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush(shard, number, start, doc_ids, lengths, parts)
                    number, start, held, doc_ids, lengths, parts = number + 1, start + held, 0, [], [], []
        if doc_ids:
            yield flush(shard, number, start, doc_ids, lengths, parts)

    schema = "shard int, block long, start long, n_ids long, doc_ids array<bigint>, payload binary"
    dealt.select("doc_id", "ids", "shard").mapInArrow(write, schema).write.parquet(path)
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard, never a row a document
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return TokenFiles(path, id_of_rank, starts)


def read_token_files(spark: SparkSession, files: TokenFiles, form: Form = IDS) -> DataFrame:
    """Each document from the files: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, in ``form``)."""
    ids_by_rank = spark.sparkContext.broadcast(files.id_of_rank)

    def read(batches):
        for batch in slices(batches, 8):
            columns = (batch.column(c).to_pylist() for c in ("begin", "doc_ids", "payload"))
            for begin, doc_ids, payload in zip(*columns):
                lengths, ranks = decode_block(payload)
                ids = ids_by_rank.value[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begin + ends - lengths),
                        pa.array(lengths.astype(np.int64)),
                        form.make([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())], "<u4"),
                    ],
                    ["doc_id", "start", "n_tokens", form.name],
                )

    # one small row a shard: the number of shards is a setting, whatever the corpus
    stored = spark.read.parquet(files.path).join(F.broadcast(files.starts), "shard")
    # a few blocks at a time through Arrow: a block holds at most BLOCK_IDS ids and one document's more
    begun = stored.select((F.col("shard_start") + F.col("start")).alias("begin"), "doc_ids", "payload")
    return begun.mapInArrow(read, f"doc_id long, start long, n_tokens long, {form.name} {form.type}")


def token_file_round_trip(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", form: Form = IDS
) -> DataFrame:
    """Encode ``docs``, write the files and read them back: doc_id, start, n_tokens, ids (in ``form``).

    One row for each row of ``docs``. NULL and empty texts hold the end id alone; NULL doc_ids come first,
    repeated doc_ids follow each other in the order of their ids' hash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, vocabulary, end_id, id_col, text_col), "token-ids")
    files = write_token_files(tokens, id_type(vocabulary, end_id), shared_folder(spark, "token-files"))
    return read_token_files(spark, files, form)


def crc_of(rows: DataFrame, kind: str = "<u4") -> DataFrame:
    """Adds ids_crc32, of the ids as 32-bit integers, from the bytes in ``ids``, which leave."""

    def crc(batches):
        for b in slices(batches):
            sums = CRC32.make(b.column("ids").to_pylist(), kind)
            yield b.drop_columns(["ids"]).append_column("ids_crc32", sums)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "ids")
    return rows.mapInArrow(crc, f"{kept}, ids_crc32 long")
