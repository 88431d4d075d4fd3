from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbspark.operators import checks as C
from plumbspark.plans import check_run as R

AS_OF = datetime(2024, 1, 31)


def numbers(spark, n):
    return spark.range(n).select("id", (F.col("id") * 1.0).alias("v"))


def one(spark, df, check):
    return C.table_checks(df, check, AS_OF).first()


@pytest.mark.parametrize("n,least,status", [(5, 5, "pass"), (4, 5, "warning"), (0, 5, "critical"), (0, 0, "pass")])
def test_row_count(spark, n, least, status):
    assert one(spark, numbers(spark, n), C.TableCheck("t", row_count_min=least)).status == status


@pytest.mark.parametrize("n,span,status", [(5, (1, 5), "pass"), (6, (1, 5), "warning"), (0, (1, None), "critical"), (9, (None, None), "pass")])
def test_row_count_range(spark, n, span, status):
    assert one(spark, numbers(spark, n), C.TableCheck("t", row_count_range=span)).status == status


@pytest.mark.parametrize(
    "ts,status,age",
    [
        (datetime(2024, 1, 30), "pass", 24.0),
        (datetime(2024, 1, 29, 23, 59), "warning", 24.02),
        (datetime(2024, 1, 29), "warning", 48.0),
        (datetime(2024, 1, 28, 23, 59), "critical", 48.02),
        (None, "warning", None),
    ],
)
def test_freshness(spark, ts, status, age):
    df = spark.createDataFrame([(ts,), (None,)], "ts TIMESTAMP_NTZ")
    r = one(spark, df, C.TableCheck("t", freshness=C.Freshness("ts", 24)))
    assert (r.status, r.metric) == (status, age)


def test_freshness_of_text_and_zoned_times(spark):
    text = spark.createDataFrame([("2024-01-30T12:00:00Z",), ("2024-01-01T00:00:00Z",)], "ts STRING")
    assert one(spark, text, C.TableCheck("t", freshness=C.Freshness("ts", 24))).metric == 12.0
    zoned = spark.sql("SELECT TIMESTAMP '2024-01-30 12:00:00' AS ts")
    assert one(spark, zoned, C.TableCheck("t", freshness=C.Freshness("ts", 24))).metric == 12.0


@pytest.mark.parametrize("hits,limit,status", [(0, 0, "pass"), (1, 0, "critical"), (3, 3, "pass"), (4, 3, "warning"), (6, 3, "warning"), (7, 3, "critical")])
def test_rule_ladder(spark, hits, limit, status):
    check = C.TableCheck("t", anomaly_rules=(C.Rule("r", f"id < {hits}", limit),))
    r = C.anomaly_rule_results(numbers(spark, 20), check).first()
    assert (r.anomaly_count, r.status) == (hits, status)


@pytest.mark.parametrize("hits,status", [(0, "pass"), (1, "warning"), (9, "warning"), (10, "critical")])
def test_overall_ignores_the_rules_own_limits(spark, hits, status):
    check = C.TableCheck("t", anomaly_rules=(C.Rule("r", f"id < {hits}", 1000),))
    assert C.anomaly_overall(numbers(spark, 20), check).first().overall_status == status


def test_rule_needs_one_form():
    with pytest.raises(ValueError):
        C.Rule("r")
    with pytest.raises(ValueError):
        C.Rule("r", "a > 1", sql="SELECT 1 AS count")


def test_schema(spark):
    df = numbers(spark, 1)
    assert C.schema_check(df, "t", ["id", "v"]).first().status == "pass"
    r = C.schema_check(df, "t", ["id"]).first()
    assert (r.status, r.extra_columns) == ("warning", ["v"])
    r = C.schema_check(df, "t", ["id", "z", "a"]).first()
    assert (r.status, r.missing_columns, r.extra_columns) == ("critical", ["a", "z"], ["v"])


def test_duplicates_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k INT, s STRING")
    assert rows(C.duplicate_keys(df, ["k", "s"])) == [(1, "a", 2)]
    assert [r.status for r in C.null_checks(df, [C.NullLimit("s", 2), C.NullLimit("s", 1)]).collect()] == ["pass", "warning"]


def test_constraints_pass_on_null(spark):
    df = spark.createDataFrame(
        [("user1", "u@example.com", 5.0, "pending"), ("ab", "invalid-email", -50.0, "lost"), (None, None, None, None), ("abc", "U@EXAMPLE.ORG", 0.0, "completed")],
        "username STRING, email STRING, amount DOUBLE, status STRING",
    )
    got = {
        r.constraint_name: r.violations
        for r in C.violations(
            df,
            {
                "length": C.min_length("username", 3),
                "email": C.email_like("email"),
                "amount": C.positive("amount"),
                "status": C.one_of("status", ["pending", "processing", "completed", "cancelled"]),
            },
        ).collect()
    }
    assert got == {"length": 1, "email": 1, "amount": 2, "status": 1}


def test_foreign_key(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, 99999), (3, None)], "id INT, user_id INT")
    parent = spark.createDataFrame([(10,), (10,), (11,)], "id INT")
    assert rows(C.foreign_key_violations(child, ["user_id"], parent, ["id"])) == [(2, 99999)]


def test_all_rules_of_a_table_share_one_scan(spark, sf, plan):
    e = spark.read.parquet(f"{sf}/events.parquet")
    check = C.TableCheck(
        "events",
        row_count_min=1,
        freshness=C.Freshness("ts", 24),
        anomaly_rules=tuple(C.Rule(f"r{i}", f"value > {i}") for i in range(5)),
        null_limits=(C.NullLimit("user_id"),),
        expected_columns=e.columns,
    )
    text = plan(C.table_checks(e, check, AS_OF))
    assert text.count("FileScan") == 1
    assert "props" not in text.split("ReadSchema")[1]


def test_run_from_config_and_precedence(spark, rows):
    config = [
        {"table_name": "a", "row_count_check": {"expected_min": 1}, "schema_check": {"expected_columns": ["id"]}},
        {"table_name": "b", "row_count_check": {}, "anomaly_checks": [{"name": "x", "predicate": "no_such_column > 1"}]},
        {"table_name": "c", "row_count_check": {"expected_min": 5}},
        {"table_name": "gone", "row_count_check": {"expected_min": 5}},
    ]
    checks = [C.TableCheck.from_config(c) for c in config]
    tables = {"a": numbers(spark, 2), "b": numbers(spark, 2), "c": numbers(spark, 0)}
    results = R.check_results(spark, tables, checks, AS_OF)
    assert rows(R.table_status(results)) == [("a", "warning", 2), ("b", "error", 2), ("c", "critical", 1), ("gone", "error", 1)]
    s = R.run_summary(results).first()
    assert tuple(s) == ("critical", 4, 0, 1, 1, 2)


def test_failure_while_running_stays_in_its_check(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s STRING")
    check = C.TableCheck("t", row_count_min=1, anomaly_rules=(C.Rule("bad", "CAST(s AS INT) > 0"),))
    other = C.TableCheck("u", row_count_min=1)
    results, timing = R.run_checks(spark, {"t": df, "u": df}, [check, other], AS_OF)
    got = {(r.table_name, r.check_name): r.status for r in results.collect()}
    assert got == {("t", "row_count"): "pass", ("t", "anomalies"): "error", ("u", "row_count"): "pass"}
    assert timing["duration_seconds"] >= 0


def test_sql_rules(spark):
    numbers(spark, 30).createOrReplaceTempView("thirty")
    check = C.TableCheck("thirty", anomaly_rules=(C.Rule("r", sql="SELECT COUNT(*) AS count FROM thirty WHERE id >= 20", expected_max=5),))
    r = C.anomaly_rule_results(spark.table("thirty"), check).first()
    assert (r.anomaly_count, r.status) == (10, "warning")


def test_history_rows_can_be_written_twice(spark, tmp_path):
    check = C.TableCheck("t", row_count_min=5, anomaly_rules=(C.Rule("big", "id > 7"),))
    df = numbers(spark, 10)
    results = C.table_checks(df, check, AS_OF)
    history = R.history_checks(results, "run1", AS_OF)
    for _ in range(2):
        R.append_run(history, str(tmp_path / "checks"), "run1")
    R.append_run(R.history_checks(results, "run2", AS_OF), str(tmp_path / "checks"), "run2")
    assert spark.read.parquet(str(tmp_path / "checks")).count() == 4
    samples = C.rule_samples(df, check, ["id"], 1)
    a = R.history_anomalies(samples, "run1", AS_OF).first()
    assert (a.anomaly_type, a.resolution_status, a.data_sample) == ("big", "investigating", '{"id":8,"v":8.0}')


def test_type_changes(spark, rows):
    from plumbspark.sources.tables import table_info

    old = spark.createDataFrame([], "a INT, b STRING, c INT NOT NULL")
    new = spark.createDataFrame([], "a STRING, c INT, d INT")
    got = rows(C.schema_type_changes(table_info(old), table_info(new)), "column_name", "change", "severity")
    assert got == [("a", "type_changed", "high"), ("b", "removed", "high"), ("c", "nullability_changed", "medium"), ("d", "added", "medium")]


def test_nan_is_missing_in_rules_and_constraints(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-1.0,), (500.0,)], "v DOUBLE")
    check = C.TableCheck("t", anomaly_rules=(C.Rule("large", "v > 300"), C.Rule("missing", "v IS NULL")))
    assert [r.anomaly_count for r in C.anomaly_rule_results(df, check).collect()] == [1, 2]
    assert C.violations(df, {"p": C.positive("v")}).first().violations == 1


def test_a_sql_rule_must_give_one_row(spark):
    for sql in ("SELECT id AS count FROM range(2)", "SELECT id AS count FROM range(0)"):
        check = C.TableCheck("t", anomaly_rules=(C.Rule("r", sql=sql),))
        with pytest.raises(Exception, match="one row"):
            C.anomaly_rule_results(numbers(spark, 3), check).collect()
