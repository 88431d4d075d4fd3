from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbspark.functions.shared_dir import shared_folder
from plumbspark.operators.anomaly import iqr_thresholds
from plumbspark.operators.checks import Rule, TableCheck
from plumbspark.streaming import batches as B
from plumbspark.streaming import source as S
from plumbspark.streaming import windows as W

SCHEMA = "id INT, ts TIMESTAMP_NTZ, user INT, kind STRING, value DOUBLE"


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        stream = S.file_stream(spark, src, SCHEMA, "ts", files_per_batch=1)
        with S.LateRows(spark) as late:
            return late.of(S.run_available(W.late_watch(stream, "ts", "kind", "1 day", "1 hour"), out, ck))

    add_file(spark, src, [(1, at(1, 1), 1, "a", 1.0), (2, at(3, 1), 1, "a", 2.0)])
    assert run() == 0
    add_file(spark, src, [(3, at(1, 2), 1, "a", 3.0), (4, at(5, 1), 1, "a", 4.0)])  # id 3 comes too late
    assert run() == 1
    got = {r.window_start.day: r.row_count for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 3: 1}


def test_tumbling_metrics_over_several_batches_equal_one_batch(spark, tmp_path, rows):
    data = [(i, at(1 + i // 20, i % 20), i % 3, "ab"[i % 2], None if i % 7 == 0 else float(i)) for i in range(100)]
    results = []
    for name, parts in (("one", [data]), ("many", [data[i : i + 20] for i in range(0, 100, 20)])):
        for part in parts:
            add_file(spark, tmp_path / name, part)
        stream = S.file_stream(spark, str(tmp_path / name), SCHEMA, "ts", files_per_batch=1)
        S.run_available(W.tumbling_metrics(stream, "ts", "kind", "value"), str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_ck"))
        results.append(rows(spark.read.parquet(str(tmp_path / f"{name}_out"))))
    assert results[0] == results[1] and len(results[0]) == 8


def test_sliding_rate_uses_static_limits(spark, tmp_path):
    src = tmp_path / "in"
    add_file(spark, src, [(i, at(1 + i // 10, i % 10), 1, "a", 1000.0 if i == 5 else float(i % 10)) for i in range(40)])
    stream = S.file_stream(spark, str(src), SCHEMA, "ts")
    limits = iqr_thresholds(spark.read.parquet(str(src)), "value")
    S.run_available(W.sliding_anomaly_rate(stream, limits, "ts", "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.window_start: (r.total, r.anomalies, r.anomaly_rate) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[at(1)] == (20, 1, 5.0) and got[at(2)] == (20, 0, 0.0)


def test_silence_alert_per_entity(spark, tmp_path, rows):
    src = tmp_path / "in"
    add_file(spark, src, [(1, at(1), 1, "a", 0.0), (2, at(1, 5), 1, "a", 0.0), (3, at(3), 1, "a", 0.0), (4, at(3, 1), 2, "a", 0.0)])
    stream = S.file_stream(spark, str(src), SCHEMA, "ts")
    S.run_available(W.silence_alerts(stream, "user", "ts", 24), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, at(1, 5), at(2, 5), 2)]


def test_checks_per_batch_survive_a_repeated_batch(spark, tmp_path, rows):
    src = tmp_path / "in"
    add_file(spark, src, [(1, at(1), 1, "a", 1.0)])
    add_file(spark, src, [(2, at(2), 1, "a", 100.0), (3, at(2), 1, "a", 1.0)])
    check = TableCheck("events", row_count_min=2, anomaly_rules=(Rule("big", "value > 50"),))
    stream = S.file_stream(spark, str(src), SCHEMA, "ts", files_per_batch=1)
    B.check_stream(stream, check, at(3), str(tmp_path / "history"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "history"))
    assert got.count() == 4 and got.select("batch_id").distinct().count() == 2
    before = rows(got)
    # The same batches again under a lost checkpoint: same partitions, same rows.
    B.check_stream(stream, check, at(3), str(tmp_path / "history"), str(tmp_path / "ck2"))
    assert rows(spark.read.parquet(str(tmp_path / "history"))) == before


def test_upsert_stream_and_merge(spark, tmp_path, rows):
    src, log = tmp_path / "in", str(tmp_path / "log")
    columns = ["user", "id", "value"]
    for part in ([(1, at(1), 1, "a", 1.0), (2, at(1), 1, "a", 2.0), (3, at(1), 2, "a", 3.0)], [(0, at(1), 2, "a", 9.0)]):
        add_file(spark, src, part)
        B.upsert_stream(S.file_stream(spark, str(src), SCHEMA).select(*columns), log, str(tmp_path / "ck"))
    assert rows(B.current_rows(spark, log, ["user"], "id")) == [(1, 2, 2.0), (2, 0, 9.0)]
    base = spark.createDataFrame([(2, 5, 5.0), (7, 7, 7.0)], "user INT, id INT, value DOUBLE")
    assert rows(B.merged_table(base, log, ["user"], "id")) == [(1, 2, 2.0), (2, 0, 9.0), (7, 7, 7.0)]


def test_deduplication_across_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in ([(1, at(1), 1, "a", 1.0), (2, at(1), 1, "a", 2.0)], [(3, at(1, 0, 30), 1, "a", 3.0), (4, at(1), 2, "a", 4.0)]):
        add_file(spark, src, part)
        S.run_available(W.deduplicated(S.file_stream(spark, src, SCHEMA, "ts"), ["user"], "ts"), out, ck)
    assert sorted(r.user for r in spark.read.parquet(out).collect()) == [1, 2]


def test_shared_folder_follows_the_cluster_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark, "x")
    if base:
        assert folder.startswith(base)
    assert folder != shared_folder(spark, "x")


def test_shared_folder_needs_a_setting_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return "yarn" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session(), "x")


def test_window_metrics_aggregate_before_the_shuffle(spark, sf, plan):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert "partial_count" in plan(W.tumbling_metrics(e, "ts", "event_type", "value"))


def dropped(spark, src, out, ck):
    """What Spark's own stateful operator counts as dropped behind the watermark."""
    stream = S.file_stream(spark, src, SCHEMA, "ts", files_per_batch=1)
    once = stream.withWatermark("ts", "1 hour").dropDuplicates(["id", "ts"])
    with S.LateRows(spark) as late:
        return late.of(S.run_available(once, out, ck))


def loads(n=5):
    """Every load reaches further and holds rows of all earlier times."""
    return [[(100 * k + i, at(1 + k * i // 10, i % 24, k), i, "a", 1.0) for i in range(20)] + [(100 * k + 99, None, 1, "a", 1.0)] for k in range(n)]


def test_late_rows_are_kept_and_agree_with_the_counter(spark, tmp_path, rows):
    src, counted = str(tmp_path / "in"), 0
    for part in loads():
        add_file(spark, src, part)
        counted += dropped(spark, src, str(tmp_path / "o"), str(tmp_path / "c"))
        stream = S.file_stream(spark, src, SCHEMA, "ts", files_per_batch=1)
        B.keep_late(stream, "ts", "1 hour", str(tmp_path / "run"), str(tmp_path / "run_ck"))
    late = B.late_rows(spark, str(tmp_path / "run"), stream.schema)
    assert late.count() == counted > 10
    whole = late.select("id").union(spark.read.parquet(str(tmp_path / "run/on_time")).select("id"))
    assert rows(whole) == rows(spark.read.parquet(src).select("id"))

    first = dropped(spark, src, str(tmp_path / "o2"), str(tmp_path / "c2"))  # all loads in one run
    B.keep_late(stream, "ts", "1 hour", str(tmp_path / "one"), str(tmp_path / "one_ck"), lag=2)
    late = B.late_rows(spark, str(tmp_path / "one"), stream.schema)
    assert late.count() == first > 5
    assert late.where("ts > mark OR ts IS NULL").isEmpty()
    before = rows(late)
    batch = spark.read.schema(SCHEMA).parquet(src).withColumn("ts", F.col("ts").cast("timestamp")).where("id BETWEEN 300 AND 399")
    assert B.late_rows(spark, str(tmp_path / "nothing"), stream.schema).collect() == []
    B._write_batch(batch.limit(0), 3, str(tmp_path / "one/marks_unused"))  # nothing else changes when a batch is repeated
    assert rows(B.late_rows(spark, str(tmp_path / "one"), stream.schema)) == before


def upserts(spark, tmp_path, n=4):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(n):
        add_file(spark, src, [(10 * k + i, at(1), None if i == 9 else (i + k) % 7, f"b{k}", float(i)) for i in range(10)])
        yield k, log, lambda: B.upsert_stream(S.file_stream(spark, src, SCHEMA, "ts").select("user", "id", "kind"), log, str(tmp_path / "ck"))


@pytest.mark.parametrize("at_batch", [0, 1, 2, 3, None])
def test_compaction_at_any_batch_changes_nothing(spark, tmp_path, rows, at_batch):
    for k, log, run in upserts(spark, tmp_path):
        run()
        want = rows(B.current_rows(spark, log, ["user"], "id"))
        if k == at_batch or (at_batch is None and k):
            assert B.compact(spark, log, ["user"], "id") == k - 1
            assert rows(B.current_rows(spark, log, ["user"], "id")) == want
    assert B.compact(spark, log, ["user"], "id", upto=3) == 3
    assert rows(B.current_rows(spark, log, ["user"], "id")) == want and not [x for x in (tmp_path / "log").glob("batch_id=*")]
    assert len(list((tmp_path / "log-base").glob("upto=*"))) == 1


def test_compaction_that_fails_between_its_writes(spark, tmp_path, rows, monkeypatch):
    for k, log, run in upserts(spark, tmp_path):
        run()
    want = rows(B.current_rows(spark, log, ["user"], "id"))
    saved = spark.read.parquet(f"{log}/batch_id=1").cache()
    saved.count()

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(B, "remove", fail)
        with pytest.raises(OSError):
            B.compact(spark, log, ["user"], "id", upto=2)
    assert rows(B.current_rows(spark, log, ["user"], "id")) == want  # base and batches are both there
    assert B.compact(spark, log, ["user"], "id", upto=2) == 2
    assert rows(B.current_rows(spark, log, ["user"], "id")) == want
    B._write_batch(saved, 1, log)  # Spark repeats a batch that the base holds
    assert rows(B.current_rows(spark, log, ["user"], "id")) == want
    (tmp_path / "log-base/upto=9").mkdir()  # a base that was never finished
    assert rows(B.current_rows(spark, log, ["user"], "id")) == want


def test_timers_fire_in_a_silent_stream_and_once(spark, tmp_path):
    import time

    from plumbspark.streaming.silence import ROCKSDB, STORE, silence_timers

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, src, [(1, at(1, 1), 1, "a", 1.0), (2, at(1, 5), 1, "a", 1.0), (3, at(1, 2), 2, "a", 1.0), (4, None, 3, "a", 1.0), (5, at(1), None, "a", 1.0)])
    stream = S.file_stream(spark, src, SCHEMA, "ts")
    with pytest.raises(ValueError, match="RocksDB"):
        silence_timers(stream, "user", "ts", 3)
    spark.conf.set(STORE, ROCKSDB)

    def run(until, seconds):
        alerts = silence_timers(stream, "user", "ts", 3)
        query = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
        try:
            end = time.time() + seconds
            while time.time() < end:
                query.processAllAvailable() if query.exception() else time.sleep(0.5)
                try:
                    got = sorted(((r.entity, r.last_event, r.events) for r in spark.read.parquet(out).collect()), key=repr)
                except Exception:
                    got = []
                if until and len(got) >= until:
                    return got
            return got
        finally:
            query.stop()

    try:
        first = run(3, 90)
        assert first == [(1, at(1, 5), 2), (2, at(1, 2), 1), (3, None, 1)]
        assert run(None, 8) == first  # restarted from the checkpoint: no second alert
        add_file(spark, src, [(6, at(2, 1), 2, "a", 1.0)])
        assert sorted(run(4, 90), key=repr) == sorted([*first, (2, at(2, 1), 1)], key=repr)
    finally:
        spark.conf.unset(STORE)
