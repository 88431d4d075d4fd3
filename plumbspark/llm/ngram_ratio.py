"""Quality rules: counts of words, lines and repeats, and an n-gram likelihood ratio against trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.sizes import broadcast_if_small
from plumbspark.llm.blocks import Words, blocks, chain, ids_of, mix, release, rows_of, split_flat, windows

#: Bytes of text whose n-grams are counted in one task.
PART_BYTES = 32 << 20
#: Bytes of text whose n-grams are sent together, a chunk.
CHUNK_BYTES = 16 << 20
#: Bytes of text that are cut into words at a time.
BLOCK_BYTES = 4 << 20
#: An n-gram in more rows of a chunk than this is frequent there: its counts are sent once for the chunk, not by row.
FREQUENT = 32
#: Log ratios are added up as multiples of 2^-32: the order of a sum never matters.
UNIT = 1 << 32
#: Mean log ratio of a text's n-grams, in nats, from which it counts as target-like.
THRESHOLD = -0.2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def base_counts(texts: pa.Array, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(texts)
    length = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(pc.cast(texts, pa.binary()).to_pylist()), np.uint8)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(_SYMBOLS[raw])
    row, lines = split_flat(pc.split_pattern(texts, "\n"))
    coded = lines.dictionary_encode()
    wordy = pc.binary_length(pc.ascii_trim(coded.dictionary, characters=" \t\n\v\f\r")).to_numpy(zero_copy_only=False) > 0
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, code = row[wordy[code]], code[wordy[code]]
    own = np.unique(row * max(1, len(wordy)) + code) // max(1, len(wordy))
    first, window = windows(words, hashes, 5)
    key = mix(window ^ mix(words.row[first].astype(np.uint64)))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    place = np.searchsorted(twice, key).clip(max=max(0, len(twice) - 1))
    found = first[twice[place] == key] if len(twice) else first[:0]
    edge = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": words.count,
        "word_chars": np.bincount(words.row, weights=length[words.code], minlength=n).astype(np.int64),
        "n_symbols": np.bincount(np.searchsorted(np.cumsum(size), at, side="right"), minlength=n),
        "n_dup_lines": np.bincount(row, minlength=n) - np.bincount(own, minlength=n),
        "n_repeat_words": np.bincount(words.row[covered], minlength=n),
    }


def gram_hashes(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each word and each pair of neighbouring words."""
    single = chain([hashes])[words.code] if len(words.code) else np.empty(0, np.uint64)
    at, double = windows(words, hashes, 2)
    return np.concatenate([words.row, words.row[at]]), np.concatenate([single, double])


def gram_buckets(words: Words, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each word and each pair of neighbouring words: the first ``bits`` of its hash."""
    row, found = gram_hashes(words, hashes)
    return row, (found >> np.uint64(64 - bits)).astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers of columns of one length, byte by byte of their places, compressed."""
    planes = [np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return [np.empty(0, np.int64)] * columns
    raw = pa.decompress(data[8:], decompressed_size=8 * n * columns, codec="zstd")
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]


def steps(key: np.ndarray) -> np.ndarray:
    """Rising keys as differences, the first as it is."""
    return np.diff(key, prepend=0)


def postings(key: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, times) by key and row."""
    if not len(key):
        return key, row, row
    width = int(row.max()).bit_length()
    if bits + width < 64:
        both = key << width
        both |= row
        both.sort()
        first = np.flatnonzero(np.diff(both, prepend=-1))
        times, both = np.diff(first, append=len(both)), both[first]
        return both >> width, both & ((1 << width) - 1), times
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    return key[first], row[first], np.diff(first, append=len(key))


def packed_rows(held: np.ndarray, row: np.ndarray, times: np.ndarray) -> list[bytes]:
    """Rows and times of n-grams, ``held`` of them each, rising: first rows, steps to the next ones; what isn't 1 apart."""
    first = np.zeros(len(row), bool)
    first[np.cumsum(held) - held] = True
    several, often = np.flatnonzero(held > 1), np.flatnonzero(times > 1)
    parts = [packed(row[first]), packed(np.diff(row, prepend=0)[~first]), packed(steps(several), held[several])]
    return [*parts, packed(steps(often), times[often])]


def unpacked_rows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(held, row, times)"""
    (begin,), (step,), (several, number), (often, more) = (unpacked(d, k) for d, k in zip(data, (1, 1, 2, 2)))
    held = np.ones(len(begin), np.int64)
    held[np.cumsum(several)] = number
    start = np.cumsum(held) - held
    row = np.empty(len(begin) + len(step), np.int64)
    first = np.zeros(len(row), bool)
    first[start] = True
    row[first], row[~first] = begin, step
    last = np.cumsum(row)
    row = last - np.repeat(last[start] - begin, held)
    times = np.ones(len(row), np.int64)
    times[np.cumsum(often)] = more
    return held, row, times


def part_of(key: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part of each key: equal ranges of keys, in order."""
    top = min(bits, 32)
    return (key.view(np.uint64) >> np.uint64(bits - top)).astype(np.int64) * parts >> top


#: A chunk's rows are numbered with its ``trusted`` ones first. ``light``: the n-grams and their rows; ``heavy``: (key step,
#: times, times in trusted texts) of the frequent ones; for a chunk's own row ``judged``: (id, whether it is NULL, base
#: counts, n-grams) and ``rest``: the rows of the frequent n-grams.
SENT = "part int, chunk long, trusted int, light array<binary>, heavy binary, judged binary, rest array<binary>"
#: ``sums``: (row, units) of the light n-grams; ``gains``: units of each of the part's frequent n-grams.
SETTLED = "chunk long, part int, sums binary, gains binary, judged binary, rest array<binary>, base double"


def sent_grams(docs: DataFrame, trusted: DataFrame, bits: int, parts: int) -> DataFrame:
    """The n-grams of each chunk by part, counted, each part's in a partition of its own."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    marked = docs.join(broadcast_if_small(ids.withColumn("trusted", F.lit(1))), "doc_id", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, CHUNK_BYTES):
            good = pc.fill_null(rows.column("trusted"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = rows.column("number")[0].as_py()
            order = np.argsort(1 - good, kind="stable")
            place = np.empty(len(good), np.int32)
            place[order] = np.arange(len(good))
            base, keys, places, at = [], [], [], 0
            for _, some in blocks([rows], BLOCK_BYTES):
                words = Words(some)
                hashes = words.hashes()
                row, key = gram_buckets(words, hashes, bits)
                n_grams = np.bincount(row, minlength=len(some))
                base.append([*base_counts(some, words, hashes).values(), n_grams])
                keys.append(key)
                places.append(place[at + row])
                at += len(some)
            base = [np.concatenate(c) for c in zip(*base)]
            keys, places = np.concatenate(keys), np.concatenate(places)
            key, row, times = postings(keys, places, bits)
            del words, hashes, keys, places
            start = np.flatnonzero(np.diff(key, prepend=-1))
            held = np.diff(start, append=len(key))
            often = held > FREQUENT
            heavy = np.repeat(often, held)
            n_good = int(good.sum())
            whole, target = (np.add.reduceat(x, start)[often] if len(start) else start for x in (times, times * (row < n_good)))
            common, keys, held_light = key[start[often]], key[start[~often]], held[~often]
            row_at = np.concatenate([[0], np.cumsum(held_light)])
            row_light, times_light = row[~heavy], times[~heavy]
            ids, missing = ids_of(rows), ids_of(rows).is_null().to_numpy(zero_copy_only=False)
            columns = [pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), missing, *base]
            rest = packed_rows(held[often], row[heavy], times[heavy])
            out = [(chunk % parts, chunk, n_good, None, None, packed(*[c[order] for c in columns]), rest)]
            cuts = [np.searchsorted(part_of(k, bits, parts), np.arange(parts + 1)) for k in (keys, common)]
            for p in range(parts):
                (a, b), (c, d) = ((int(x[p]), int(x[p + 1])) for x in cuts)
                if a < b or c < d:
                    own = slice(row_at[a], row_at[b])
                    light = [packed(steps(keys[a:b])), *packed_rows(held_light[a:b], row_light[own], times_light[own])]
                    out.append((p, chunk, n_good, light, packed(steps(common[c:d]), whole[c:d], target[c:d]), None, None))
            lists = pa.list_(pa.binary())
            kinds = [pa.int32(), pa.int64(), pa.int32(), lists, pa.binary(), pa.binary(), lists]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], SENT_NAMES)
            release()

    numbered = marked.select("doc_id", "text", "trusted", F.monotonically_increasing_id().alias("number"))
    return numbered.mapInArrow(send, SENT).repartitionById(parts, F.col("part"))


SENT_NAMES = [c.split()[0] for c in SENT.split(", ")]
SETTLED_NAMES = [c.split()[0] for c in SETTLED.split(", ")]


class Part:
    """The n-grams that all chunks sent to a part, told apart by key."""

    def __init__(self, sent: list[dict]):
        keys, raw, target = [], [], []
        for r in sent:
            (step,), (held, row, times) = unpacked(r["light"][0], 1), unpacked_rows(r["light"][1:])
            common, whole, good = unpacked(r["heavy"], 3)
            start = np.cumsum(held) - held
            sums = [np.add.reduceat(x, start) if len(start) else start for x in (times, times * (row < r["trusted"]))]
            keys += [np.cumsum(step), np.cumsum(common)]
            raw += [sums[0].astype(np.int32), whole.astype(np.int32)]
            target += [sums[1].astype(np.int32), good.astype(np.int32)]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        del keys
        self.order = np.argsort(key).astype(np.int32)
        key = key[self.order]
        self.start = np.flatnonzero(np.diff(key, prepend=-1))
        self.raw, self.target = (
            np.add.reduceat(np.concatenate(x)[self.order], self.start, dtype=np.int64) if len(key) else key for x in (raw, target)
        )

    def gains(self, kinds: int, n_raw: int) -> np.ndarray:
        """Units of each n-gram sent, in the order sent: its log ratio above that of one that no trusted text holds."""
        units = self.raw + 1.0
        np.divide(self.target, units, out=units)
        units *= (n_raw + kinds) / kinds
        np.log1p(units, out=units)
        units *= UNIT
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.rint(units, out=units), np.diff(self.start, append=len(self.order)))
        return out


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kinds, raw, target) of a part."""
    part = Part([r for b in batches for r in b.to_pylist() if r["light"]])
    sums = [[len(part.start)], [int(part.raw.sum())], [int(part.target.sum())]]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sums], ["kinds", "raw", "target"])
    release()


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    bits: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The base counts, base_failed, ``ratio`` and kept of each document.

    ``ratio`` is the mean over a text's words and word pairs of log p(trusted) - log p(raw); a text is kept
    if the base rules pass and the ratio reaches ``threshold``, each document by itself, without a draw.
    ``trusted``: a table whose first column names the documents of the target. Without trusted documents
    the ratio says nothing and all that pass the base rules are kept. One is added to each raw count, and as many in
    all as there are different n-grams to the trusted counts in the raw proportions, so a small target says little
    rather than less.

    N-grams are told apart by the first bits of their hashes, 12 more than the bytes of all texts need (40 to 63), so
    fewer than one in 30,000 meets another (6 of 2.7 million at sf0.1); or by their first ``bits``, which are then the
    n-grams of the smoothing.
    Texts are read once. Each chunk sends its n-grams, sorted and coded, to parts of the keys (``part_bytes`` of text
    for each); a part counts them and returns what each row gains, or, for n-grams that many rows of a chunk hold,
    what each of those is worth: no part meets a common n-gram row by row. Log ratios are added up in whole units
    of 2^-32, so a repeated run keeps the same documents.

    One row for each row of ``docs``, repeated rows and NULL ids included. A NULL or empty text has no words:
    ratio 0, base_failed. An empty table gives no rows.
    """
    rows = rows_of(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    fixed, bits = bits, bits or min(63, max(40, size.bit_length() + 12))
    parts = 1 + size // part_bytes
    sent = sent_grams(rows, trusted, bits, parts)
    sums = sent.mapInArrow(tally, "kinds long, raw long, target long").agg(
        F.struct(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "raw", "target")]).alias("totals")
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own, totals, number = [], [], None, 0
        for r in (r for b in batches for r in b.to_pylist()):
            totals, number = r["totals"], r["part"]
            (found if r["light"] else own).append(r)
        if totals is None:
            return
        kinds = 1 << fixed if fixed else max(1, totals["kinds"])
        base = float(np.log(kinds / (totals["target"] + kinds)))
        kept = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.binary()), pa.float64()]
        for r in own:
            out = [r["chunk"], -1, None, None, r["judged"], r["rest"], base]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kept)], SETTLED_NAMES)
        gains, at = Part(found).gains(kinds, totals["raw"]), 0
        for r in found:
            held, row, times = unpacked_rows(r["light"][1:])
            end, common = at + len(held), int.from_bytes(r["heavy"][:8], "little")
            more = np.rint(np.bincount(row, weights=np.repeat(gains[at:end], held) * times)).astype(np.int64)
            there = np.flatnonzero(more)
            out = [r["chunk"], number, packed(steps(there), more[there]), packed(gains[end : end + common]), None, None, None]
            at = end + common
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kept)], SETTLED_NAMES)
        del gains
        release()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, told in _by_chunk(batches):
            ids, missing, *base, n_grams = unpacked(own["judged"], 8)
            total = np.zeros(len(ids), np.int64)
            for t in told:
                step, more = unpacked(t["sums"], 2)
                total[np.cumsum(step)] += more
            gains = np.concatenate([unpacked(t["gains"], 1)[0] for t in told]) if told else np.empty(0, np.int64)
            held, row, times = unpacked_rows(own["rest"])
            np.add.at(total, row, np.repeat(gains, held) * times)
            mean = (n_grams * own["base"] + total / UNIT) / np.maximum(1, n_grams)
            arrays = [pa.array(ids, mask=missing.astype(bool)), *map(pa.array, base), pa.array(np.round(mean, 9))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "ratio"])

    settled = sent.withColumn("totals", sums.scalar()).mapInArrow(settle, SETTLED)
    met = settled.repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    judged = met.mapInArrow(judge, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, ratio double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("ratio") >= threshold)).alias("kept"), "ratio")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Each chunk's own row, which comes first, and the rows that its parts told, in order of keys."""
    own, told = None, []
    for r in (r for b in batches for r in b.to_pylist()):
        if r["judged"] is None:
            told.append(r)
            continue
        if own is not None:
            yield own, told
        own, told = r, []
    if own is not None:
        yield own, told
