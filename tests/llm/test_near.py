"""BagMinHash and near-duplicate classes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import bag, near_classes, similarity
from plumbspark.llm.bagminhash import SKETCH, _links_in_block, _rooted, near_duplicates, one_of_each, shingle_bags, signatures
from plumbspark.llm.blocks import Words, mix
from plumbspark.llm.components import components, joined_components


def sketch(counts, m=4096):
    """Signatures of multisets {element: count}."""
    row = np.concatenate([np.full(len(c), i) for i, c in enumerate(counts)])
    element = np.array([e for c in counts for e in c], np.uint64)
    weight = np.array([n for c in counts for n in c.values()])
    return signatures(row, element, weight, len(counts), m)


@pytest.mark.parametrize("a, b", [({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 5, 2: 1}, {1: 3, 2: 7}), ({9: 100}, {9: 60}), ({1: 1}, {1: 1})])
def test_components_agree_as_often_as_the_weights_overlap(a, b):
    s = sketch([a, b])
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(max(want * (1 - want), 1e-9) / 4096) + 1e-9


def test_signatures_do_not_depend_on_the_block():
    a, b = {5: 2, 6: 9, 7: 1}, {1: 1, 5: 2}
    assert (sketch([a, b], 64)[1] == sketch([b], 64)[0]).all()


def edited(text, words, draw):
    w = text.split()
    for _ in range(words):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def test_classes(docs, real):
    draw = random.Random(3)
    pairs = real[:80]
    base = " ".join(f"w{draw.randrange(500)}" for _ in range(300))
    pairs += [(1000 + i, edited(base, 3, draw)) for i in range(40)]  # a large group of near copies
    pairs += [(2000 + i, base) for i in range(30)]
    pairs += [(3000 + i, edited(base, 30, draw)) for i in range(10)]  # about the threshold or below
    pairs += [(4000, "too few"), (4001, "too few"), (4002, "few too"), (4003, ""), (4004, ""), (4005, " "), (4006, "a b a b a b a b"), (4007, "a b a b a b")]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(pairs)).collect()}
    assert got == near_classes(pairs)


def test_whole_table_against_all_pairs(spark):
    """Every link of 0.8 or more between any two documents, and no other."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_duplicates(table).collect()}
    assert got == near_classes([(r.doc_id, r.text) for r in table.collect()])


def test_links_in_a_block_join_components_once():
    """Of copies with few edits, one link for each merge; blocks of one chunk and of two agree."""
    draw = random.Random(5)
    base = " ".join(f"w{draw.randrange(900)}" for _ in range(200))
    texts = [edited(base, 2, draw) for _ in range(12)] + [edited(base, 60, draw) for _ in range(3)]
    bags = shingle_bags(Words(pa.array(texts)))
    size = len(texts)
    bits = (mix(signatures(*bags, size, SKETCH).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
    own = [(bags[1][bags[0] == i].tobytes(), bags[2][bags[0] == i].astype(np.uint32).tobytes()) for i in range(size)]

    def block(chunk, low, high):
        columns = {"key": [7] * size, "low": [low] * size, "high": [high] * size, "chunk": chunk, "rep": list(range(size))}
        columns |= {"root": list(range(size)), "keys": [[7, 100 + i] for i in range(size)], "sketch": [x.tobytes() for x in bits]}
        found = _links_in_block(pa.table(columns | {"shingles": [o[0] for o in own], "times": [o[1] for o in own]}), 0.8)
        return list(zip(*(found.column(c).to_pylist() for c in "ab")))

    one = block([0] * size, 0, 0)
    two = block([i % 2 for i in range(size)], 0, 1)
    want = near_classes(list(enumerate(texts)))
    for links in (one, two):
        assert len(links) == size - len(set(want.values())) and all(want[a] == want[b] for a, b in links)
    assert all(a % 2 != b % 2 for a, b in two)


def test_a_bucket_of_chained_links(docs):
    """Neighbours in the chain are near, its ends are not; no pivot is near to all."""
    words = [f"c{i}" for i in range(260)]
    pairs = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(30)]
    assert similarity(bag(pairs[0][1]), bag(pairs[1][1])) >= 0.8 > similarity(bag(pairs[0][1]), bag(pairs[4][1]))
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(pairs)).collect()}
    assert got == near_classes(pairs)


def test_mixed_buckets_are_compared_in_blocks(docs, monkeypatch):
    """Copies with so many edits that some are near each other and many aren't."""
    from plumbspark.llm import bagminhash

    monkeypatch.setattr(bagminhash, "BLOCK", 7)
    monkeypatch.setattr(bagminhash, "ROUNDS", 1)
    draw = random.Random(8)
    base = " ".join(f"w{draw.randrange(900)}" for _ in range(150))
    pairs = [(i, edited(base, draw.choice([1, 2, 4, 6, 8]), draw)) for i in range(60)]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(pairs)).collect()}
    assert got == near_classes(pairs)
    assert 1 < len(set(got.values())) < 60


def test_documents_meet_their_roots_once(spark, rows, plan, monkeypatch):
    """One row a text passes the join, not one a bucket; texts under one id stay rows of their own."""
    from plumbspark.llm import bagminhash

    buckets = [(i, 0, 10 * i % 7 + k) for i in range(6) for k in range(5)] + [(5, 9, 3), (5, 9, 8)]
    table = spark.createDataFrame(buckets, "rep long, text int, key long")
    roots = spark.createDataFrame([(1, 0), (0, 0), (5, 4), (4, 4)], "node long, root long")
    root_of = {1: 0, 5: 4}
    want = sorted([(k, r, t, root_of.get(r, r)) for r, t, k in buckets], key=repr)
    assert rows(_rooted(table, roots), "key", "rep", "text", "root") == want
    monkeypatch.setattr(bagminhash, "written", lambda df, purpose: df)
    text = plan(_rooted(table, roots))
    assert text.index("Generate") < text.index("Join") < text.index("collect_list")


def test_buckets_of_the_same_documents_are_sent_once(spark, rows):
    from plumbspark.llm.bagminhash import _without_copies

    buckets = [(k, r, 0, r) for k, ids in {9: (1, 2), 5: (1, 2), 7: (1, 2), 8: (1, 2, 3), 4: (1, 3), 6: (3, 4)}.items() for r in ids]
    buckets += [(3, 1, 0, 1), (3, 2, 1, 2)]  # another text under the id
    table = spark.createDataFrame(buckets, "key long, rep long, text int, root long")
    assert {r[0] for r in rows(_without_copies(table), "key")} == {3, 4, 5, 6, 8}


def test_a_pair_counts_in_the_least_key_that_it_shares():
    bags = shingle_bags(Words(pa.array(["a b c d e f"])))
    bits = (mix(signatures(*bags, 1, SKETCH).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)[0].tobytes()
    columns = {"low": [0, 0], "high": [0, 0], "chunk": [0, 0], "rep": [1, 2], "root": [1, 2], "keys": [[9, 7, -3], [9, 7, -4]], "sketch": [bits] * 2}
    columns |= {"shingles": [bags[1].tobytes()] * 2, "times": [bags[2].astype(np.uint32).tobytes()] * 2}
    found = {key: _links_in_block(pa.table({"key": [key] * 2} | columns), 0.8).num_rows for key in (7, 9)}
    assert found == {7: 1, 9: 0}


def test_few_links_stay_in_one_partition(spark, monkeypatch):
    """And a table of more than FEW_ROWS gives the same components by exchanges."""
    from plumbspark.functions import sizes
    from plumbspark.llm import components as module

    write, partitions = module.written, []

    def counted(df, purpose):
        partitions.append(df.rdd.getNumPartitions())
        return write(df, purpose)

    monkeypatch.setattr(module, "written", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 3) for i in range(0, 50, 5)], "a long, b long").repartition(5)
    few = sorted(map(tuple, components(links).collect()))
    assert set(partitions) == {1}
    monkeypatch.setattr(module, "FEW_ROWS", 0)
    monkeypatch.setattr(sizes, "FEW_ROWS", 0)
    assert sorted(map(tuple, components(links).collect())) == few


def test_long_tables_give_the_same_classes(docs, monkeypatch):
    """Tables of more than FEW_ROWS are dealt out as before; no further star round when the first finds little."""
    from plumbspark.functions import sizes
    from plumbspark.llm import bagminhash
    from plumbspark.llm import components as module

    write, purposes = bagminhash.written, []

    def named(df, purpose):
        purposes.append(purpose)
        return write(df, purpose)

    monkeypatch.setattr(bagminhash, "written", named)
    monkeypatch.setattr(bagminhash, "PAIRS_PER_ROW", 0)
    draw = random.Random(8)
    base = " ".join(f"w{draw.randrange(900)}" for _ in range(150))
    pairs = [(i, edited(base, draw.choice([4, 6, 8]), draw)) for i in range(60)]
    want = near_classes(pairs)
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(pairs)).collect()} == want
    assert purposes.count("near-candidates") == 1
    monkeypatch.setattr(module, "FEW_ROWS", 0)
    monkeypatch.setattr(sizes, "FEW_ROWS", 0)
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(pairs)).collect()} == want


def test_odd_rows(docs, odd):
    got = sorted((tuple(r) for r in near_duplicates(docs(odd)).collect()), key=repr)
    want = near_classes(odd)
    assert got == sorted(((i, want.get(i, i)) for i, _ in odd), key=repr)
    assert near_duplicates(docs([])).count() == 0
    same_id = {r.doc_id: r.class_id for r in near_duplicates(docs([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")])).collect()}
    assert same_id == {1: 1, 2: 1, 3: 1}


def test_one_of_each(docs, rows):
    pairs = [(1, "a b"), (2, "a b"), (3, "c"), (3, "c"), (None, "a b"), (None, "z")]
    table = docs(pairs)
    kept = rows(one_of_each(table, near_duplicates(table)), "doc_id", "text")
    assert kept == sorted([(1, "a b"), (3, "c"), (None, "a b"), (None, "z")], key=repr)
    assert one_of_each(table, near_duplicates(table)).columns == table.columns


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_joined_by_further_links(spark):
    first = [(0, 1), (1, 2), (5, 6), (8, 9)]
    more = [(2, 6), (20, 9), (30, 31)]
    roots = components(spark.createDataFrame(first, "a long, b long"))
    got = joined_components(roots, spark.createDataFrame(more, "a long, b long"))
    want = components(spark.createDataFrame(first + more, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert joined_components(roots, spark.createDataFrame([], "a long, b long")) is roots
