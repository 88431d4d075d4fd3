"""Spelling variants: words one edit apart, each with the far more frequent word it is a variant of.

Every word's edits are generated inside the task that holds the word and probed against blocked Bloom filters
of the vocabulary, sharded by word length and broadcast; only what the filters pass is shuffled, to a join with
the vocabulary that removes false positives.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.blocks import Words, blocks, ids_of, mix, rows_of
from plumbspark.llm.storage import written

#: What ends a run, and the letters of words after A-Z became a-z.
NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))

LONGEST = 64  # words of this length or more share a class of filters
KEYS_PER_PART = 1 << 17
BITS_PER_KEY = 24
MARKS = 5
#: Filters that one pass over the vocabulary broadcasts; a larger set takes further passes.
PASS_BYTES = 64 << 20
_PROBES = 1 << 19
_DIRECT = 256  # longer runs take their checksum by themselves


def _zero_byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


def _checksums(prefix: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """crc32 of each word behind its row's prefix, from the two checksums alone: the prefix's moves on by one
    zero byte for each byte of the word, all rows at a time. Also the words too long for that, left open, and
    the bytes of each unique word."""
    raw = words.unique.cast(pa.binary()).to_pylist()
    own = np.array([zlib.crc32(w) for w in raw], np.uint32)
    length = pc.binary_length(words.unique).to_numpy(zero_copy_only=False).astype(np.int64)[words.code]
    order = np.argsort(length, kind="stable")
    ends = np.searchsorted(length[order], np.arange(_DIRECT + 2))
    out, moved, table = np.empty(len(words.code), np.uint32), prefix.copy(), _zero_byte_table()
    for n in range(min(_DIRECT, int(length.max(initial=0))) + 1):
        here = order[ends[n] : ends[n + 1]]
        out[here] = moved[words.row[here]] ^ own[words.code[here]]
        moved = table[moved & np.uint32(255)] ^ (moved >> np.uint32(8))
    return out, order[ends[_DIRECT + 1] :], raw


def typed_words(docs: DataFrame, one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, chars): the runs of letters of all texts with planted typing errors, counted by task.

    A run whose crc32 behind ``<doc_id>:`` is divisible by ``one_in`` loses the code point at that checksum
    modulo its length. NULL texts have no runs; a NULL id reads as empty.
    """

    def count(batches):
        for rows, texts in blocks(batches):
            words = Words(pc.ascii_lower(pc.replace_substring_regex(texts, NOT_LETTERS, " ")))
            if not len(words.code):
                continue
            before = [b":" if i is None else b"%d:" % i for i in ids_of(rows).to_pylist()]
            h, long, raw = _checksums(np.array([zlib.crc32(p) for p in before], np.uint32), words)
            for i in long.tolist():
                h[i] = zlib.crc32(before[words.row[i]] + raw[words.code[i]])
            hit = h % np.uint32(one_in) == 0
            chars = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.bincount(words.code[~hit], minlength=len(words.unique))
            there = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays(
                [words.unique.take(pa.array(there)), pa.array(whole[there]), pa.array(chars[there])], ["word", "n", "chars"]
            )
            code = words.code[hit]
            lost = np.stack([code, h[hit].astype(np.int64) % chars[code]])
            (codes, at), n = np.unique(lost, axis=1, return_counts=True)
            shorter: Counter[str] = Counter()
            for w, p, k in zip(words.unique.take(pa.array(codes)).to_pylist(), at.tolist(), n.tolist()):
                shorter[w[:p] + w[p + 1 :]] += k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(shorter), pa.string()),
                    pa.array(list(shorter.values()), pa.int64()),
                    pa.array([len(w) for w in shorter], pa.int64()),
                ],
                ["word", "n", "chars"],
            )

    return rows_of(docs, id_col, text_col).mapInArrow(count, "word string, n long, chars long")


def vocabulary_of(typed: DataFrame, min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): words of ``min_chars`` code points that occur ``min_count`` times, as a written table."""
    counted = typed.where(F.col("chars") >= min_chars).groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.where(F.col("n") >= min_count), "vocabulary")


def _at(position: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A 64-bit value for a letter at a position; a word's hash is their sum, so an edit changes one term."""
    return mix((position.astype(np.uint64) << np.uint64(21)) + letters.astype(np.uint64) + np.uint64(1))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their code points as a matrix) for each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == n)
        flat = np.frombuffer("".join([words[i] for i in which]).encode("utf-32-le", "surrogatepass"), "<u4")
        yield which, flat.reshape(-1, n)


def _hashes(letters: np.ndarray) -> np.ndarray:
    return _at(np.arange(letters.shape[1])[None, :], letters).sum(axis=1, dtype=np.uint64)


def _marks(key: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), np.uint64)
    for j in range(MARKS):
        out |= np.uint64(1) << ((key >> np.uint64(32 + 6 * j)) & np.uint64(63))
    return out


def _block(key: np.ndarray, size) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) * np.asarray(size, np.uint64)) >> np.uint64(32)


def _filters(vocabulary: DataFrame) -> DataFrame:
    """(class, part, parts, content): blocked Bloom filters, 64 bits a block, of some KEYS_PER_PART words each."""

    def keys(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            key, length = np.empty(len(words), np.uint64), np.empty(len(words), np.int64)
            for which, letters in _by_length(words):
                key[which], length[which] = mix(_hashes(letters)), letters.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(length, LONGEST)), pa.array(key.view(np.int64))], ["class", "key"]
            )

    def build(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().view(np.uint64)
        held = np.zeros(max(1, len(key) * BITS_PER_KEY // 64), np.uint64)
        np.bitwise_or.at(held, _block(key, len(held)).astype(np.int64), _marks(key))
        one = {c: table.column(c)[:1] for c in ("class", "part", "parts")}
        return pa.table({**one, "content": pa.array([held.tobytes()], pa.binary())})

    keyed = written(vocabulary.select("word").mapInArrow(keys, "class long, key long"), "vocabulary-keys")
    sizes = {r["class"]: r["n"] for r in keyed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return keyed.sparkSession.createDataFrame([], "class long, part long, parts long, content binary")
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, 1 << max(0, (n // KEYS_PER_PART).bit_length()))])
    split = keyed.withColumn("parts", parts[F.col("class")].cast("long"))
    split = split.withColumn("part", F.col("key").bitwiseAND(F.col("parts") - 1))
    return split.groupBy("class", "part").applyInArrow(build, "class long, part long, parts long, content binary")


class _Held:
    """The filters of one pass: membership of hashes in a class of lengths."""

    def __init__(self, rows):
        by_class: dict[int, list] = {}
        for r in rows:
            by_class.setdefault(r[0], []).append(r)
        self.classes = {}
        for c, own in by_class.items():
            size = np.zeros(own[0][2], np.int64)
            for _, part, _, content in own:
                size[part] = len(content) // 8
            start = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), np.uint64)
            for _, part, _, content in own:
                flat[start[part] : start[part] + size[part]] = np.frombuffer(content, np.uint64)
            self.classes[c] = size, start, flat

    def passed(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that the class of ``length`` may hold."""
        if min(length, LONGEST) not in self.classes:
            return np.empty(0, np.int64)
        size, start, flat = self.classes[min(length, LONGEST)]
        key = mix(hashes)
        part = (key & np.uint64(len(size) - 1)).astype(np.int64)
        left = np.flatnonzero(size[part])
        if len(left) < len(key):
            key, part = key[left], part[left]
        held = flat[start[part] + _block(key, size[part]).astype(np.int64)]
        for j in range(MARKS):
            ok = np.flatnonzero((held >> ((key >> np.uint64(32 + 6 * j)) & np.uint64(63))) & np.uint64(1))
            left, key, held = left[ok], key[ok], held[ok]
        return left


def _edits(letters: np.ndarray, held: _Held, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, new letter or 0 for none) of the edits of words of one length that the filters pass.

    A pair of near words is met from one side: the longer word by what it loses, of equal lengths the word with
    the smaller letter. Of equal neighbouring letters only the first is deleted, as all give the same word.
    """
    rows, n = letters.shape
    step = max(1, _PROBES // (rows * len(alphabet)))
    terms = _at(np.arange(n)[None, :], letters)
    whole = terms.sum(axis=1, dtype=np.uint64)
    if n > 1:
        shifted = _at(np.arange(n - 1)[None, :], letters[:, 1:])
        after = np.zeros((rows, n), np.uint64)
        after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        first = np.ones((rows, n), bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        row, at = np.nonzero(first)
        ok = held.passed(n - 1, before[row, at] + after[row, at])
        yield row[ok], at[ok], np.zeros(len(ok), np.uint32)
    for a in range(0, n, step):
        here = np.arange(a, min(n, a + step))
        new = _at(here[:, None], alphabet[None, :])
        row, at, which = np.nonzero(alphabet[None, None, :] > letters[:, here, None])
        ok = held.passed(n, (whole[:, None] - terms[:, here])[row, at] + new[at, which])
        yield row[ok], here[at[ok]], alphabet[which[ok]]


def near_words(vocabulary: DataFrame, letters: str = LETTERS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, near, near_n), each pair both ways: words of ``vocabulary`` (word, n) that differ by exactly one
    inserted, deleted or replaced code point. Words hold no other code points than ``letters``.

    Filters beyond ``pass_bytes`` are broadcast in several passes over the vocabulary, each edit being probed in
    the one pass that holds its shard. An empty vocabulary has no pairs.
    """
    spark = vocabulary.sparkSession
    filters = written(_filters(vocabulary), "spelling-filters")
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    shard = F.col("class") * (1 << 40) + F.col("part")
    passes, room = [], 0  # first and last shard of each
    for r in filters.select(shard.alias("shard"), F.length("content").alias("bytes")).orderBy("shard").toLocalIterator():
        if not passes or r["bytes"] > room:
            passes.append([r["shard"], r["shard"]])
            room = pass_bytes
        passes[-1][1] = r["shard"]
        room -= r["bytes"]

    def probe(sent):
        def run(batches):
            held = _Held(sent.value)
            for whole in batches:
                for a in range(0, whole.num_rows, 4096):
                    b = whole.slice(a, 4096)
                    words, n = b.column("word").to_pylist(), b.column("n").to_numpy()
                    found, times, near = [], [], []
                    for which, letters_ in _by_length(words):
                        for row, at, new in _edits(letters_, held, alphabet):
                            for i, p, c in zip(which[row].tolist(), at.tolist(), new.tolist()):
                                w = words[i]
                                found.append(w)
                                times.append(n[i])
                                near.append(w[:p] + (chr(c) if c else "") + w[p + 1 :])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.string()), pa.array(times, pa.int64()), pa.array(near, pa.string())],
                        ["word", "n", "near"],
                    )

        return run

    parts = []
    for first, last in passes or [(0, 0)]:
        chosen = filters.where(shard.between(first, last)).select("class", "part", "parts", "content")
        sent = spark.sparkContext.broadcast([tuple(r) for r in chosen.collect()])
        found = vocabulary.mapInArrow(probe(sent), "word string, n long, near string")
        parts.append(written(found, "spelling-candidates") if len(passes) > 1 else found)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    exact = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    one, other = ("word", "n", "near", "near_n"), ("near", "near_n", "word", "n")
    both = F.array(*[F.struct(*[F.col(c).alias(name) for c, name in zip(side, one)]) for side in (one, other)])
    return exact.select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last one, path lengths doubling with every round. A form occurs
    several times as often as its word, so chains are short."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(vocabulary: DataFrame, times: int = 10, letters: str = LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocabulary`` (word, n; each word once).

    A word's form is its near word of largest n, of equal ones the first in code-point order, if that n is at
    least ``times`` its own, else NULL; its root is the last of the chain of forms, the word itself if it has
    none. ``n_near`` counts near words. An empty vocabulary gives no rows.
    """
    near = near_words(vocabulary, letters)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    facts = written(near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
    largest = -F.col("best.less")
    is_form = largest >= F.lit(times) * F.col("n")
    formed = written(
        vocabulary.join(facts, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, largest).alias("form_n"),
        ),
        "spelling-formed",
    )
    rooted = formed.join(_roots(formed.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
