"""Texts inside a task as flat Arrow and numpy arrays, a bounded block of rows at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 12 << 20
#: Rows of a block at most: some operators hold its row numbers in 18 bits.
BLOCK_ROWS = 1 << 17


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text only, under fixed names: further columns of any name are left out."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text is divisible by ``folds`` never teach a model. NULL ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of about ``limit`` bytes of text and BLOCK_ROWS rows at most (a longer text is a slice of its own), with
    their texts, NULL read as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        text = pc.fill_null(text, "") if text.null_count else text
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        part = (ends - 1).clip(0) // limit + np.arange(batch.num_rows) // BLOCK_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a), text.slice(a, b - a)
            pa.default_memory_pool().release_unused()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and the next stage's needs room."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ids_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc_id")


def split_flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row number of every list item, and the items."""
    lengths = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


class Words:
    """Words (runs without ASCII white space) of a block: ``row`` and ``code`` per word, ``unique`` by code."""

    def __init__(self, texts: pa.Array):
        row, flat = split_flat(pc.ascii_split_whitespace(texts))
        if len(flat):
            there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
            row, flat = row[there], flat.filter(pa.array(there))
        coded = flat.dictionary_encode()
        self.rows = len(texts)
        self.row = row
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.unique: pa.Array = coded.dictionary
        self.count = np.bincount(row, minlength=self.rows)
        self.start = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each unique word, the same in every task."""
        return text_hashes(self.unique)


def text_hashes(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(texts.to_pylist(), dtype=object), categorize=False).astype(np.uint64)


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each position over arrays of equal length."""
    with np.errstate(over="ignore"):
        h = mix(parts[0] + _GOLD)
        for p in parts[1:]:
            h = mix(h * np.uint64(3) + p + _GOLD)
        return h


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's position, hash) of each run of ``size`` words inside one text."""
    n = len(words.row)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(words.row[: n - size + 1] == words.row[size - 1 :])
    h = hashes[words.code]
    return at, chain([h[at + k] for k in range(size)])


def ragged_take(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of a ragged array one after another, with their offsets."""
    lengths = offsets[which + 1] - offsets[which]
    out = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(out[-1]) + np.repeat(offsets[which] - out[:-1], lengths)
    return flat[at], out
