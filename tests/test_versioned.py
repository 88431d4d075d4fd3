"""Versioned tables: snapshots, few files rewritten, conflicts, roll back, partitions by metadata."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbspark.functions import sizes
from plumbspark.operators import writes as W
from plumbspark.plans.publish import RejectedWrite
from plumbspark.sources import versioned as V

DDL = "k LONG, a STRING, v DOUBLE"


@pytest.fixture
def store(spark, tmp_path):
    return V.Store(spark, str(tmp_path / "store"))


def numbers(spark, low, high, a="old"):
    return spark.range(low, high).select(F.col("id").alias("k"), F.lit(a).alias("a"), F.col("id").cast("double").alias("v"))


def created(store, rows=2000, files=20):
    t = store.begin()
    t.create("t", numbers(store.spark, 0, rows), ["k"], files=files)
    t.commit()
    assert len(store.begin().files("t")) == files
    return store


def data_files(store):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store.folder}/data/**/*.parquet", recursive=True)}


@pytest.fixture(params=[True, False])
def small(request, monkeypatch):
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 1 << 26 if request.param else -1)
    return request.param


def test_a_replace_rewrites_the_files_it_hits(spark, store, rows, small):
    created(store)
    before = data_files(store)
    old = set(store.begin().files("t"))
    batch = spark.createDataFrame([(5, "new", 1.0), (7, "new", 2.0), (7, "again", 3.0), (None, "none", 4.0), (99999, "far", 5.0)], DDL)
    t = store.begin()
    t.replace("t", batch)
    assert t.touched.rewritten == 1
    assert t.commit() == 2
    now = set(store.begin().files("t"))
    assert len(old & now) == 19 and len(old - now) == 1
    after = data_files(store)
    assert all(after[p] == at for p, at in before.items())  # carried over untouched, the old one kept for readers
    assert rows(store.read("t")) == rows(W.replace(numbers(spark, 0, 2000), batch, ["k"]))
    assert rows(store.read("t", 1)) == rows(numbers(spark, 0, 2000))


def test_filters_pass_over_files_whose_range_holds_the_key(spark, store):
    """Even keys only: a batch of odd keys lies in every range and in no filter."""
    t = store.begin()
    t.create("t", numbers(spark, 0, 4000).where("k % 2 = 0"), ["k"], files=20)
    t.commit()
    t = store.begin()
    t.replace("t", numbers(spark, 0, 4000, "new").where("k % 1000 = 1"))
    assert t.touched.searched <= 1 and t.touched.rewritten == 0
    t.commit()
    assert store.read("t").count() == 2004


def test_upserts_deletes_and_updates_touch_few_files(spark, store, rows, small):
    created(store)
    want = numbers(spark, 0, 2000)
    batch = spark.createDataFrame([(10, 1.5), (5000, 2.5)], "k INT, v DOUBLE")
    steps = [
        (lambda t: t.upsert("t", batch), lambda d: W.upsert(d, batch, ["k"]), 1),
        (lambda t: t.upsert("t", batch.withColumn("v", F.lit(9.0)), ["v"]), lambda d: W.upsert(d, batch.withColumn("v", F.lit(9.0)), ["k"], ["v"]), 2),
        (lambda t: t.delete("t", "k BETWEEN 150 AND 250"), lambda d: W.delete_where(d, "k BETWEEN 150 AND 250"), 2),
        (lambda t: t.update("t", "v = 300", {"a": "'three'"}), lambda d: W.update_where(d, "v = 300", {"a": "'three'"}), 1),
        (lambda t: t.delete_keys("t", batch.select("k")), lambda d: W.without_keys_of(d, batch, ["k"]), 2),
    ]
    for do, same, most in steps:
        t = store.begin()
        do(t)
        assert t.touched.rewritten <= most
        t.commit()
        want = same(want)
        assert rows(store.read("t")) == rows(want)
    assert store.version() == 6


def test_steps_of_a_transaction_see_each_other_and_nobody_else_does(spark, store, rows):
    created(store, 100, 4)
    t = store.begin()
    t.apply([
        W.CreateTable("u", DDL), W.Insert("u", numbers(spark, 0, 3)), W.Insert("t", numbers(spark, 100, 110)),
        W.Delete("t", "k < 105"), W.Update("u", "k = 2", {"a": "'set'"}),
    ])
    t.replace("t", numbers(spark, 108, 112, "late"))
    assert store.read("t").count() == 100 and "u" not in store.manifest(store.version())["tables"]
    t.commit()
    assert rows(store.read("t"), "k", "a") == [*[(k, "old") for k in (105, 106, 107)], *[(k, "late") for k in range(108, 112)]]
    assert rows(store.read("u"), "k", "a") == [(0, "old"), (1, "old"), (2, "set")]
    with pytest.raises(ValueError):
        store.begin().apply(["drop"])
    with pytest.raises(KeyError):
        store.begin().insert("nothing", numbers(spark, 0, 1))


@pytest.mark.parametrize("bad", ["constraint", "unique within the batch", "unique against the table"])
def test_a_rejected_list_leaves_every_table_as_it_was(spark, store, rows, bad):
    created(store, 100, 4)
    files = data_files(store)
    t = store.begin()
    t.create("u", numbers(spark, 0, 5), ["k"])
    t.delete("t", "k < 50")
    k, v = {"constraint": (500, -1.0), "unique within the batch": (500, 1.0), "unique against the table": (70, 1.0)}[bad]
    t.insert("t", spark.createDataFrame([(500, "x", 1.0)][: 1 if "within" in bad else 0] + [(k, "x", v)], DDL))
    with pytest.raises(RejectedWrite, match="duplicate|positive"):
        t.commit({"t": {"positive": "v >= 0"}}, {"t": [["k"]]})
    assert store.version() == 1 and data_files(store) == files
    assert rows(store.read("t")) == rows(numbers(spark, 0, 100))
    t = store.begin()
    t.delete("t", "k < 50")
    t.insert("t", spark.createDataFrame([(1, "x", 1.0), (None, "x", 1.0), (None, "x", 1.0)], DDL))
    assert t.commit({"t": {"positive": "v >= 0"}}, {"t": [["k"]]}) == 2
    assert store.read("t").count() == 53


def test_two_writers(spark, store, rows):
    created(store, 100, 4)
    one, two, three = store.begin(), store.begin(), store.begin()
    one.insert("t", numbers(spark, 200, 201))
    two.insert("t", numbers(spark, 300, 301))
    three.replace("t", numbers(spark, 50, 51, "lost"))
    staged = data_files(store)
    assert one.commit() == 2 and two.commit() == 3  # mere insertions follow one another
    with pytest.raises(V.Conflict):
        three.commit()
    assert store.version() == 3 and len(data_files(store)) < len(staged)
    assert rows(store.read("t"), "k") == sorted([(k,) for k in [*range(100), 200, 300]], key=repr)
    again, other = store.begin(), store.begin()
    again.replace("t", numbers(spark, 50, 51, "won"))
    other.create("u", numbers(spark, 0, 1), ["k"])
    assert other.commit() == 4 and again.commit() == 5  # another table is no conflict
    assert rows(store.read("t").where("k = 50"), "a") == [("won",)] and store.read("u").count() == 1


def test_a_version_number_is_taken_once(spark, store):
    path = f"{store.folder}/log/000000000001.json"
    assert V._publish_text(spark, path, '{"tables": {}}') and not V._publish_text(spark, path, "other")
    assert store.version() == 1 and store.manifest(1) == {"tables": {}}
    assert not [p for p in os.listdir(f"{store.folder}/log") if "json" not in p]


def test_many_versions_merge_their_lists(spark, store, rows, monkeypatch):
    monkeypatch.setattr(V, "LISTS", 3)
    created(store, 20, 2)
    for k in range(4):
        t = store.begin()
        t.replace("t", numbers(spark, k, k + 1, f"r{k}"))
        t.commit()
    held = store.manifest(5)["tables"]["t"]
    assert len(held["added"]) + len(held["removed"]) <= 3
    assert rows(store.read("t"), "k", "a") == sorted([(k, f"r{k}" if k < 4 else "old") for k in range(20)], key=repr)
    assert rows(store.read("t", 2).where("k < 2"), "k", "a") == [(0, "r0"), (1, "old")]


def test_duplicates_of_a_batch_read_few_files(spark, store, rows):
    created(store)
    batch = spark.createDataFrame([(3, "x", 1.0), (5000, "x", 1.0), (5001, "x", 1.0), (5001, "y", 1.0), (None, "z", 1.0), (None, "z", 1.0)], DDL)
    assert rows(store.duplicates("t", batch)) == [(3, 2), (5001, 2)]
    t = store.begin()
    assert len(t._candidates("t", batch.where("k IS NOT NULL").select("k"))) <= 2


def test_partitions_prune_and_go_by_metadata(spark, sf, store, rows, plan):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    t = store.begin()
    t.create("events", e, partition_by=["day"])
    t.commit()
    week = store.read("events").where("day >= '20240110' AND day < '20240117'")
    text = plan(week)
    assert "PartitionFilters: [isnotnull(day" in text and "20240117" in text
    read = week.select(F.input_file_name()).distinct().count()
    days = store.partitions("events")
    assert read == days.where("partition_name >= '20240110' AND partition_name < '20240117'").agg(F.sum("files")).first()[0]
    assert week.count() == e.where("ts >= '2024-01-10' AND ts < '2024-01-17'").count()
    on_disk = sum(os.path.getsize(p) for p in glob.glob(f"{store.folder}/data/events/**/*.parquet", recursive=True))
    assert days.agg(F.sum("bytes"), F.sum("row_count")).first() == (on_disk, e.count())
    before = set(store.begin().files("events"))
    t = store.begin()
    t.drop_partitions("events", "20240117", "ts < TIMESTAMP_NTZ '2024-01-17 12:00:00'")
    t.commit()
    now = set(store.begin().files("events"))
    assert {p for p in now - before} == {p for p in now if "day=20240117" in p} and not [p for p in now if "day=20240116" in p]
    assert rows(store.read("events"), "event_id") == rows(e.where("ts >= '2024-01-17 12:00:00'"), "event_id")


def test_odd_partition_values_and_empty_tables(spark, store, rows):
    odd = spark.createDataFrame([("a b", 1), ("a%20b", 2), ("x:y/z", 3), ("é+", 4), (None, 5), ("", 6)], "p STRING, k LONG")
    t = store.begin()
    t.create("odd", odd, ["k"], ["p"])
    t.create("none", odd.limit(0), ["k"])
    t.commit()
    assert rows(store.read("odd").where("p <> ''")) == rows(odd.where("p <> ''")) and store.read("odd").count() == 6
    t = store.begin()
    t.replace("odd", spark.createDataFrame([("a b", 2), ("new", 3)], "p STRING, k LONG"))
    t.replace("none", odd)
    t.delete("odd", "k = 4")
    t.commit()
    assert rows(store.read("odd").where("p <> ''")) == [("a b", 1), ("a b", 2), ("new", 3)]
    assert store.read("none").count() == 6
    t = store.begin()
    t.truncate("none")
    t.commit()
    assert store.read("none").collect() == [] and store.read("none").columns == ["p", "k"]


def test_folding_loses_no_key():
    h = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    words = np.zeros(V.FILTER_WORDS, np.uint64)
    np.bitwise_or.at(words, V._words(h, len(words)), V._marks(h))
    folded = V._folded(words)
    assert len(folded) < len(words) // 16
    hit = lambda x: (folded[V._words(x, len(folded))] & V._marks(x)) == V._marks(x)
    assert hit(h).all() and hit(h + np.uint64(12345)).mean() < 0.01


def test_stored_queries_prune_their_partitions(spark, sf, plan):
    import __spark_entry__ as E
    from registry.stored import stored

    text = plan(E.queries()["pruned_daily_agg"](spark, sf))
    assert "PartitionFilters: [isnotnull(day" in text and "events_20240124" in text
    days = stored(spark, sf, "events").partitions("events")
    assert days.count() == 30 and days.where("files < 1 OR bytes < 1").isEmpty()
