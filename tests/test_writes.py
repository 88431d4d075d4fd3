import random

import pytest
from pyspark.sql import functions as F

from plumbspark.functions import buckets as B
from plumbspark.functions import sizes
from plumbspark.functions.sizes import is_small, measured_bytes
from plumbspark.operators import partitions as P
from plumbspark.operators import writes as W
from plumbspark.plans.publish import RejectedWrite, publish

DDL = "k INT, a STRING, b STRING"


def frame(spark, values, ddl=DDL):
    return spark.createDataFrame(values, ddl)


def test_insert_fills_missing_and_ignores_extra(spark, rows):
    t = frame(spark, [(1, "a", "b")])
    batch = frame(spark, [(2, "x", 9)], "k INT, a STRING, z INT")
    assert rows(W.insert(t, batch)) == [(1, "a", "b"), (2, "x", None)]
    with pytest.raises(KeyError):
        W.insert(t, batch, fill_missing=False)
    assert rows(W.insert(t, t.limit(0))) == [(1, "a", "b")]


@pytest.fixture(params=[True, False])
def small(request, monkeypatch):
    """Both plans: every batch counts as small, or none."""
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 1 << 26 if request.param else -1)
    return request.param


def test_replace_keeps_all_batch_rows_and_null_keys(spark, rows, small):
    t = frame(spark, [(1, "old", "o"), (2, "old", "o"), (None, "old", "o")])
    b = frame(spark, [(1, "n1", "n"), (1, "n2", "n"), (None, "n3", "n"), (4, "n4", "n")])
    assert rows(W.replace(t, b, ["k"]), "k", "a") == [
        (1, "n1"), (1, "n2"), (2, "old"), (4, "n4"), (None, "n3"), (None, "old"),
    ]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_chunked_replace_equals_a_loop_over_chunks(spark, rows, size):
    rnd = random.Random(size)
    start = [(rnd.choice([None, *range(6)]), "t", str(i)) for i in range(12)]
    batch = [(rnd.choice([None, *range(8)]), "b", str(i)) for i in range(20)]
    want = list(start)
    for i in range(0, len(batch), size):
        chunk = batch[i : i + size]
        keys = {r[0] for r in chunk if r[0] is not None}
        want = [r for r in want if r[0] not in keys] + chunk
    b = frame(spark, [(*r, i) for i, r in enumerate(batch)], DDL + ", pos INT")
    got = W.replace_in_chunks(frame(spark, start), b, ["k"], "pos", size)
    assert rows(got) == sorted(want, key=repr)
    if size == 1:
        assert rows(W.replace_last_wins(frame(spark, start), b, ["k"], "pos")) == sorted(want, key=repr)


def test_chunk_size_must_be_positive(spark):
    t = frame(spark, [])
    with pytest.raises(ValueError):
        W.replace_in_chunks(t, t, ["k"], "k", 0)


def test_upsert(spark, rows, small):
    t = frame(spark, [(1, "t", "t"), (2, "t", "t"), (None, "t", "t")])
    b = frame(spark, [(2, "b", None), (3, "b", "b"), (None, "b", "b")])
    assert rows(W.upsert(t, b, ["k"])) == [
        (1, "t", "t"), (2, "b", None), (3, "b", "b"), (None, "b", "b"), (None, "t", "t"),
    ]
    assert rows(W.upsert(t, b, ["k"], ["a"])) == [
        (1, "t", "t"), (2, "b", "t"), (3, "b", "b"), (None, "b", "b"), (None, "t", "t"),
    ]
    part = frame(spark, [(1, "p"), (9, "p")], "k INT, a STRING")
    assert rows(W.upsert(t, part, ["k"])) == [
        (1, "p", "t"), (2, "t", "t"), (9, "p", None), (None, "t", "t"),
    ]
    with pytest.raises(ValueError):
        W.upsert(t, b, ["k"], ["k"])


def test_upsert_rejects_duplicate_keys_in_the_batch(spark, small):
    t = frame(spark, [(1, "t", "t")])
    for k in (1, 2):
        with pytest.raises(Exception, match="duplicate key"):
            W.upsert(t, frame(spark, [(k, "x", "x"), (k, "y", "y")]), ["k"]).collect()


def test_small_batches_leave_the_target_unshuffled(spark, sf, plan, small):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    b = o.limit(10).withColumn("o_totalprice", F.lit(0.0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (W.replace(o, b, ["o_orderkey"]), W.upsert(o, b, ["o_orderkey"])):
            text = plan(df)
            assert ("BroadcastHashJoin" in text) == small and ("SortMergeJoin" in text) != small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_small_replace_reads_the_target_once(spark, sf, plan):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    b = spark.createDataFrame([(1, 5.0)], "o_orderkey LONG, o_totalprice DOUBLE")
    assert plan(W.replace(o, b, ["o_orderkey"])).count("FileScan parquet") == 1
    assert plan(W.upsert(o, b, ["o_orderkey"])).count("FileScan parquet") == 2  # and once its keys alone


def test_null_orders_and_positions_lose_no_row(spark, rows, small):
    t = frame(spark, [(1, "t", "t"), (2, "t", "t")])
    ddl = DDL + ", o INT"
    b = frame(spark, [(1, "n1", "x", None), (1, "n2", "x", None), (9, "n3", "x", None), (9, "n4", "x", 3)], ddl)
    got = rows(W.replace_last_wins(t, b, ["k"], "o"), "k", "a")
    assert got[0][0] == 1 and got[0][1] in ("n1", "n2") and got[1:] == [(2, "t"), (9, "n4")]
    assert rows(W.insert_if_absent(t, b, ["k"], "o"), "k", "a") == [(1, "t"), (2, "t"), (9, "n4")]
    only = frame(spark, [(9, "n5", "x", None)], ddl)
    assert rows(W.insert_if_absent(t, only, ["k"], "o"), "k", "a") == [(1, "t"), (2, "t"), (9, "n5")]
    with pytest.raises(Exception, match="has no o"):
        W.replace_in_chunks(t, b, ["k"], "o", 2).collect()


def test_size_is_measured(spark):
    df = frame(spark, [(1, "x" * 1000, None)])
    assert 1000 < measured_bytes(df) < 1200 and measured_bytes(df.limit(0)) == 0
    assert is_small(df) and not is_small(df, 1 << 27)


def test_insert_if_absent(spark, rows, small):
    t = frame(spark, [(1, "t", "t")])
    b = frame(spark, [(1, "b", "0"), (2, "first", "1"), (2, "second", "2"), (None, "n", "3")])
    assert rows(W.insert_if_absent(t, b, ["k"], "b"), "k", "a") == [(1, "t"), (2, "first"), (None, "n")]


def test_delete_update_and_operations(spark, rows):
    t = frame(spark, [(1, "x", "b"), (2, None, "b"), (3, "y", "b")])
    assert rows(W.delete_where(t, "a = 'x'"), "k") == [(2,), (3,)]
    assert rows(W.update_where(t, "a = 'y'", {"k": "k + 10", "b": F.col("a")})) == [(1, "x", "b"), (13, "y", "y"), (2, None, "b")]
    out = W.apply_operations(
        spark,
        {"t": t},
        [
            W.CreateTable("u", DDL),
            W.CreateTable("t", "other INT"),  # exists: left alone
            W.Insert("u", t),
            W.Delete("u", "k = 1"),
            W.Update("u", "k = 2", {"a": "'set'"}),
            W.Partition("u", "p", F.pmod("k", F.lit(2))),
            W.Truncate("t"),
        ],
    )
    assert rows(out["u"]) == [(2, "set", "b", 0), (3, "y", "b", 1)]
    assert out["t"].count() == 0 and out["t"].columns == ["k", "a", "b"]
    with pytest.raises(ValueError):
        W.apply_operations(spark, {"t": t}, ["drop"])
    with pytest.raises(KeyError):
        W.apply_operations(spark, {}, [W.Truncate("t")])


def test_routed_append_skips_rows_without_a_table(spark, tmp_path, rows):
    b = frame(spark, [("users", 1), ("events", 2), (None, 3), ("users", 4)], "table STRING, v INT")
    W.append_routed(b, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "table", "v") == [("events", 2), ("users", 1), ("users", 4)]


def test_publish_moves_the_view_only_when_all_constraints_hold(spark, tmp_path, rows):
    good = frame(spark, [(1, "a", "b"), (2, "a", "b")])
    kw = {"constraints": {"positive": "k > 0"}, "unique": [["k"]]}
    publish(good, "published", str(tmp_path), partition_by=["a"], **kw)
    assert rows(spark.table("published"), "k") == [(1,), (2,)]
    for bad in ([(3, "a", "b"), (-1, "a", "b")], [(3, "a", "b"), (3, "a", "c")]):
        with pytest.raises(RejectedWrite):
            publish(frame(spark, bad), "published", str(tmp_path), **kw)
        assert rows(spark.table("published"), "k") == [(1,), (2,)]
    publish(W.insert(spark.table("published"), frame(spark, [(7, "z", "z")])), "published", str(tmp_path), **kw)
    assert rows(spark.table("published"), "k") == [(1,), (2,), (7,)]
    spark.sql("DROP VIEW published")


def test_writes_read_no_cross_products(spark, plan):
    t, b = frame(spark, [(1, "a", "b")]), frame(spark, [(1, "x", "y")])
    for df in (W.replace(t, b, ["k"]), W.upsert(t, b, ["k"]), W.insert_if_absent(t, b, ["k"], "b")):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_partitioned_layout_prunes(spark, sf, tmp_path, plan):
    e = spark.read.parquet(f"{sf}/events.parquet")
    path = str(tmp_path / "events")
    P.write_partitioned(e, path, "day", F.date_format("ts", "yyyyMMdd"))
    week = P.within(spark.read.parquet(path), "day", F.lit("20240110"), F.lit("20240117"))
    text = plan(week.groupBy("event_type").count())
    assert "PartitionFilters: [isnotnull(day" in text and "20240110" in text
    assert week.count() == e.filter("ts >= '2024-01-10' AND ts < '2024-01-17'").count()
    sizes = P.partition_sizes(spark, path, "day").agg(F.sum("row_count"), F.min("bytes")).first()
    assert sizes[0] == e.count() and sizes[1] > 0


def test_hash_partitions_are_complete_and_none_is_empty(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    counts = P.partition_counts(c, B.hash_partition(F.col("c_custkey"), 4)).collect()
    assert len(counts) == 4 and sum(r.row_count for r in counts) == c.count()


def test_bins(spark, rows):
    df = frame(spark, [(0.0,), (9.99,), (10.0,), (None,), (-5.0,), (50.0,)], "v DOUBLE")
    b = B.equal_width_bin(F.col("v"), F.lit(0.0), F.lit(10.0), 5)
    assert [r[0] for r in df.select(b).collect()] == [0, 4, 4, None, 0, 4]
    flat = B.equal_width_bin(F.col("v"), F.lit(3.0), F.lit(3.0), 5)
    assert {r[0] for r in df.filter("v IS NOT NULL").select(flat).collect()} == {0}
