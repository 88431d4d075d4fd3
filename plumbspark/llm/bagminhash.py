"""Weighted MinHash of word shingles, and near-duplicate classes from it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.sizes import broadcast_if_small, gathered
from plumbspark.llm.blocks import Words, blocks, chain, ids_of, mix, release, rows_of, windows
from plumbspark.llm.components import components, joined_components
from plumbspark.llm.storage import written

SHINGLE = 5
BANDS = 25
BAND_ROWS = 5
THRESHOLD = 0.8
#: Star rounds before the remaining pairs of mixed buckets are compared in blocks of so many documents and bytes.
ROUNDS = 2
BLOCK = 1024
BLOCK_BAGS = 16 << 20
#: Pairs for each bucket row up to which no further star round is worth its jobs.
PAIRS_PER_ROW = 64
#: A band key of more documents is hot: its rows meet its size by broadcast, where they lie.
HOT = 500
#: Bytes of a sketch, one for each component, and how far below the threshold two sketches' agreement may lie:
#: four and a half deviations at similarity 0.8.
SKETCH = 1024
SKETCH_SLACK = 0.056
#: A pair's first bytes are looked at before the others, with the slack of so few.
HEAD = 128
HEAD_SLACK = 0.16

_ID_BITS = np.uint64(46)
_ID_MASK = np.uint64((1 << 46) - 1)


def shingle_bags(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times it occurs) of each text, by row. A text of fewer words is one shingle; one
    without words has none. Shingles are 46-bit hashes, the same in every task."""
    hashes = words.hashes()
    at, found = windows(words, hashes, size)
    row = words.row[at]
    for n in range(1, size):  # short texts
        few = np.flatnonzero(words.count == n)
        if len(few):
            h = hashes[words.code]
            parts = [h[words.start[few] + k] for k in range(n)]
            row = np.concatenate([row, few])
            found = np.concatenate([found, chain([*parts, np.full(len(few), n, np.uint64)])])
    key = (row.astype(np.uint64) << _ID_BITS) | (found >> (np.uint64(64) - _ID_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    return (key[first] >> _ID_BITS).astype(np.int64), key[first] & _ID_MASK, times


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash: a (rows x m) array whose components agree between two rows with the probability of
    their weighted Jaccard similarity.

    The weight axis is cut at 0, 1, 2, 4, 8, ...; each element has an independent Poisson process of
    points (time, component, weight position) over every cut, drawn from hashes of the element alone. A
    component is the earliest time of a point below the element's weight. Points are drawn in rising
    time, all processes one point a round, and a process ends when its time passes the latest component
    of its row: about m ln m points and one for each element, not m for each.
    """
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    row, weight = row[of], weight[of]
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    with np.errstate(over="ignore"):
        seed = mix(element[of] * np.uint64(2) + np.uint64(1)) + mix(level.astype(np.uint64) + np.uint64(77))
    time = np.zeros(len(row))
    least = np.full(rows * m, np.inf)
    latest = np.full(rows, np.inf)
    step = np.uint64(0)
    while len(row):
        step += np.uint64(1)
        with np.errstate(over="ignore"):
            draw = mix(seed + step * np.uint64(0x9E3779B97F4A7C15))
            other = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / (m * width)
        live = time <= latest[row]
        if not live.all():
            row, weight, low, width, seed = row[live], weight[live], low[live], width[live], seed[live]
            time, other = time[live], other[live]
        component = ((other >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        position = low + width * (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        inside = position < weight
        np.minimum.at(least, row[inside] * m + component[inside], time[inside])
        there = np.unique(row) if step < np.uint64(4) or int(step) % 4 == 0 else np.empty(0, np.int64)
        latest[there] = least.reshape(rows, m)[there].max(axis=1)
    return least.reshape(rows, m)


def band_keys(signature: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """A hash of each band of each row; the band's number is part of it."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, band_rows)
    number = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2])
    return chain([number, *(bits[:, :, k] for k in range(band_rows))])


def signed(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, digest, keys): a digest of the text (NULL for NULL) and its band keys (none without words)."""

    def sign(batches):
        for part, texts in blocks(batches, 3 << 20):
            words = Words(texts)
            bags = shingle_bags(words, size)
            keys = band_keys(signatures(*bags, len(texts), bands * band_rows), bands, band_rows).view(np.int64)
            some = words.count > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            digests = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in part.column("text").to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([ids_of(part), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "keys"])
            release()

    return rows.mapInArrow(sign, "doc_id long, digest binary, keys array<bigint>")


def sketched(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """(rep, keys, sketch, shingles, times): the band keys, one byte of each component of a longer signature, and
    the text's bag as two arrays."""

    def sketch(batches):
        for part, texts in blocks(batches, 3 << 20):
            row, shingle, times = bags = shingle_bags(Words(texts), size)
            keys = band_keys(signatures(*bags, len(texts), bands * band_rows), bands, band_rows).view(np.int64)
            bits = (mix(signatures(*bags, len(texts), SKETCH).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            cuts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
            times = times.astype(np.uint32)
            columns = [[x.tobytes() for x in bits], [shingle[c].tobytes() for c in cuts], [times[c].tobytes() for c in cuts]]
            arrays = [ids_of(part), lists, *(pa.array(c, pa.binary()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "keys", "sketch", "shingles", "times"])
            release()

    return rows.mapInArrow(sketch, "rep long, keys array<bigint>, sketch binary, shingles binary, times binary")


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser counts over sum of the greater, of two bags (shingles in rising order, times)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0]).clip(max=len(a[0]) - 1)
    same = a[0][at] == b[0]
    common = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _links_in_block(table: pa.Table, threshold: float) -> pa.Table:
    """(a, b): links that join the components of one pair of chunks of a bucket, as few as join them.

    Each document is held against those of other components only; a link merges two components, so the pairs
    still open between them are not looked at any more. A pair counts in the bucket of the least key that it shares."""
    rep, root, chunk = (table.column(c).to_numpy() for c in ("rep", "root", "chunk"))
    n = len(rep)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    head = np.ascontiguousarray(sketch[:, :HEAD])
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(n, -1)
    bags = [
        (np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint32))
        for s, t in zip(table.column("shingles").to_pylist(), table.column("times").to_pylist())
    ]
    earlier = keys < table.column("key")[0].as_py()
    across = table.column("low")[0] != table.column("high")[0]
    part = np.unique(root, return_inverse=True)[1]
    left, right = [], []
    for i in range(n - 1):
        apart = part[i + 1 :] != part[i]
        if across:
            apart &= chunk[i + 1 :] != chunk[i]
        at = np.flatnonzero(apart) + i + 1
        lower = np.flatnonzero(earlier[i])
        if len(at) and len(lower):
            at = at[~(keys[at[:, None], lower] == keys[i, lower]).any(axis=1)]
        if len(at):
            at = at[(head[at] == head[i]).mean(axis=1) >= threshold - HEAD_SLACK]
        if not len(at):
            continue
        agree = (sketch[at] == sketch[i]).mean(axis=1)
        for j in at[np.argsort(-agree, kind="stable")][: int((agree >= threshold - SKETCH_SLACK).sum())]:
            if part[j] != part[i] and _overlap(bags[i], bags[j]) >= threshold:
                left.append(min(rep[i], rep[j]))
                right.append(max(rep[i], rep[j]))
                part[part == part[j]] = part[i]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _without_copies(found: DataFrame) -> DataFrame:
    """``found`` (key, rep, text, ...) without the buckets that hold the same documents as one of a lesser key: a pair
    counts in the bucket of the least key that it shares, and all others of its buckets would only be sent."""
    # compared by a sum over hashes of 64 bits, and by number, least and greatest id
    held = F.sum(F.xxhash64("rep", "text").cast("decimal(20,0)")).alias("held")
    sets = found.groupBy("key").agg(held, F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"))
    return found.join(sets.groupBy("held", "n", "low", "high").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _links_across(found: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of ``threshold`` or more between different components of each bucket in ``found`` (key, rep,
    root).

    A bucket is dealt into chunks by a hash of the document, as many as its documents and the bytes of its bags
    ask for, and compared chunk by chunk inside tasks: no pair becomes a row unless it joins two components."""
    # an id that stands over several texts has several sketches; those of this bucket count
    light = sketches.select("rep", "keys", F.octet_length("shingles").alias("bytes"))
    weight = found.join(light, "rep").where(F.array_contains("keys", F.col("key")))
    weight = weight.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BAGS), F.lit(1)).cast("int")
    weight = written(weight.select("key", chunks.alias("chunks")), "near-chunks")
    rows = found.join(broadcast_if_small(weight), "key").join(sketches, "rep").where(F.array_contains("keys", F.col("key")))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})

    def compare(table: pa.Table) -> pa.Table:
        return _links_in_block(table, threshold)

    return rows.drop("chunks", "other").groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def _with_sizes(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The bucket rows (rep, key) with their bucket's columns in ``sizes``, a written table; buckets without are left
    out. Hot keys, fewer than one row in HOT, are broadcast if measured small, so that none fills a task."""
    hot = broadcast_if_small(sizes.where(F.col("n") > HOT))
    rest = keyed.join(hot.select("key"), "key", "left_anti").join(sizes.where(F.col("n") <= HOT), "key")
    return keyed.join(hot, "key").select(rest.columns).union(rest)


def _rooted(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, text, root): the bucket rows (rep, text, key) with their documents' roots. A document meets its root
    once, not once for each of its buckets; the rows are written, as several jobs read them."""
    documents = buckets.groupBy("rep", "text").agg(F.collect_list("key").alias("keys"))
    documents = documents.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return written(documents.select(F.explode("keys").alias("key"), "rep", "text", F.coalesce("root", "rep").alias("root")), "near-rooted")


def verified(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(a, b, similarity): the overlap of the two texts' shingle multisets, sum of the lesser counts over
    sum of the greater. The texts of the pairs' documents alone are shuffled, once, while the pairs, measured, can
    be broadcast; ``a`` may be a hot pivot, whose partition a skewed join splits. ``pairs`` is a written table."""
    pivots = rows.join(broadcast_if_small(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi")
    both = rows.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(broadcast_if_small(pairs), "b")
    both = both.join(pivots.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches):
        for batch in batches:
            start = 0
            a, b = batch.column("text_a"), batch.column("text_b")
            while start < batch.num_rows:
                part = slice(start, start + 500)
                out = batch.slice(start, 500)
                left, right = a[part].dictionary_encode(), b[part].dictionary_encode()
                texts = pa.concat_arrays([left.dictionary, right.dictionary])
                overlap = _similarities(
                    shingle_bags(Words(texts), size),
                    len(texts),
                    left.indices.to_numpy(),
                    right.indices.to_numpy() + len(left.dictionary),
                )
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b"), pa.array(overlap)], ["a", "b", "similarity"])
                start += 500

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def _similarities(bags, rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    row, shingle, times = bags
    ends = np.searchsorted(row, np.arange(rows + 1))
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        p, q = slice(ends[x], ends[x + 1]), slice(ends[y], ends[y + 1])
        _, u, v = np.intersect1d(shingle[p], shingle[q], assume_unique=True, return_indices=True)
        common = np.minimum(times[p][u], times[q][v]).sum()
        total = times[p].sum() + times[q].sum() - common
        out[i] = common / total if total else 0.0
    return out


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _links_by_id(marks: DataFrame, copies: DataFrame) -> DataFrame:
    """Links between the texts that stand under one id."""
    texts = marks.where("doc_id IS NOT NULL AND digest IS NOT NULL").select("doc_id", "digest")
    several = texts.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high")
    reps = texts.join(several.select("doc_id"), "doc_id", "left_semi").distinct().join(copies.select("digest", "rep"), "digest")
    return reps.where("doc_id != rep").select(*_ordered(F.col("doc_id"), F.col("rep"))).distinct()


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id) for each row: documents linked by a weighted shingle similarity of ``threshold`` or
    more share a class, named by its least id. Words are runs without ASCII white space, as they stand.

    Equal texts are one document up to the last join. Each document first meets the least of its buckets'
    (equal band keys) least documents alone; after components are known, buckets that still hold several of
    them meet again with another pivot while that halves their rows, and at last their pairs across components are compared in blocks inside
    tasks: by sketch, and by bag where that could reach the threshold, until the components are joined. So a
    bucket of copies costs its length, and no candidate pair that could join two classes is left out. A pair at
    the threshold shares no bucket with probability (1 - threshold^5)^25, 5 in 100,000, and fails the sketches'
    tests in fewer than 2 of 100,000 cases.

    Rows with one id are one document. A NULL text is alone in its class; empty texts are equal texts;
    a NULL id gets the class of an equal text, else NULL. An empty table gives no rows.
    """
    rows = rows_of(docs, id_col, text_col)
    marks = written(signed(rows, size, bands, band_rows), "near-marks")
    copies = marks.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    copies = written(copies.where("rep IS NOT NULL"), "near-copies")
    # a document's texts apart: an id that stands over many of them is no single row below
    keyed = copies.select("rep", F.hash("digest").alias("text"), F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    shared = gathered(written(_with_sizes(keyed, written(sizes, "near-sizes")), "near-buckets"))
    named = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def stars(found: DataFrame) -> DataFrame:
        """Links (a, b) of each document of ``found`` (rep, pivot) with the least of its buckets' pivots."""
        pairs = found.groupBy("rep").agg(F.min("pivot").alias("pivot")).select(*_ordered(F.col("pivot"), F.col("rep"))).distinct()
        return verified(gathered(written(pairs, "near-candidates")), named, size).where(F.col("similarity") >= threshold).select("a", "b")

    links = stars(shared.where("rep != pivot")).union(_links_by_id(marks, copies))
    roots = components(written(links, "near-links"))
    many = shared
    for turn in range(ROUNDS + 1):
        found = gathered(_rooted(many, gathered(roots)))
        mixed = found.groupBy("key").agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(turn))).alias("at"),
            F.count("*").alias("n"),
        )
        mixed = mixed.where("low != high").select("key", "n", F.col("at.rep").alias("pivot"), F.col("at.root").alias("pivot_root"))
        found = gathered(written(_with_sizes(found, gathered(written(mixed, "near-mixed-keys"))), "near-mixed"))
        squares = found.groupBy("key", "root").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        cost = squares.agg(F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("cross"), F.sum("c").alias("rows")).first()
        if not cost.rows:
            break
        # a round that left more than half of the rows has found most of what pivots can find
        last = turn == ROUNDS or cost.cross <= 2 * PAIRS_PER_ROW * cost.rows or 2 * cost.rows > many.count()
        if last:
            held = named.join(broadcast_if_small(found.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
            sketches = written(sketched(held, size, bands, band_rows), "near-sketches")
            new = _links_across(gathered(written(_without_copies(found).select("key", "rep", "root"), "near-distinct")), sketches, threshold)
        else:
            new = stars(found.where("root != pivot_root"))
        roots = joined_components(roots, written(new, "near-links"))
        if last:
            break
        many = found
    classed = copies.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classed = classed.select("digest", F.coalesce("root", "rep").alias("class_id"))
    out = marks.select("doc_id", "digest").join(classed, "digest", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names its class, one row for each id; rows with a NULL id stay
    unless they copy a text that has an id. Only ids that occur more than once are brought together."""
    times = classes.groupBy("doc_id", "class_id").agg(F.count("*").alias("n"))
    drop = times.where("doc_id != class_id").select(F.col("doc_id").alias(id_col)).distinct()
    again = times.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1 AND doc_id IS NOT NULL")
    again = again.select(F.col("doc_id").alias(id_col))
    left = docs.join(drop, id_col, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, id_col, "left_anti")
    return once.unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col]))
