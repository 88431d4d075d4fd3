import pytest
from pyspark.sql import functions as F

from plumbspark.operators import relational as Rel
from plumbspark.operators import trends as T
from plumbspark.sources import jdbc, tables


def test_jdbc_options():
    o = jdbc.jdbc_options({"host": "db", "port": 5433, "database": "m", "user": "u", "password": "p"})
    assert o["url"] == "jdbc:postgresql://db:5433/m" and o["user"] == "u" and "partitionColumn" not in o
    split = {"partition_column": "id", "lower_bound": 0, "upper_bound": 10**9, "num_partitions": 400}
    o = jdbc.jdbc_options({"connector_type": "postgres-psycopg3", "database": "m", **split})
    assert (o["partitionColumn"], o["numPartitions"]) == ("id", "400")
    assert jdbc.jdbc_options({"connector_type": "sqlite", "database": "/x.db"})["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        jdbc.jdbc_options({"connector_type": "oracle", "database": "m"})
    with pytest.raises(ValueError):
        jdbc.jdbc_options({"database": "m", "partition_column": "id"})


def test_query_forms(spark):
    spark.createDataFrame([(1, "Alice", True), (2, "Bob", False), (3, "Amy", True)], "id INT, name STRING, active BOOLEAN").createOrReplaceTempView("users")
    assert tables.query(spark, "SELECT COUNT(*) AS n FROM users").first().n == 3
    named = {"type": "parameterized", "sql": "SELECT * FROM users WHERE id > :least AND name LIKE :name", "params": {"least": 1, "name": "A%"}}
    assert [r.id for r in tables.query(spark, named).collect()] == [3]
    assert tables.query(spark, {"sql": "SELECT * FROM users WHERE active = ?", "params": [True]}).count() == 2
    assert tables.query(spark, {"sql": "SELECT 1 AS a", "timeout_ms": 10}).count() == 1
    info = tables.query(spark, {"type": "table_info", "table_name": "users"}).collect()
    assert [(r.ordinal, r.column_name, r.data_type) for r in info] == [(1, "id", "int"), (2, "name", "string"), (3, "active", "boolean")]
    for bad in ({"type": "parameterized"}, {"type": "stream", "sql": "SELECT 1"}):
        with pytest.raises(ValueError):
            tables.query(spark, bad)
    with pytest.raises(Exception):
        tables.query(spark, "SELECT * FROM no_such_table")
    assert tables.table_info_or_empty(spark, "no_such_table").count() == 0
    assert tables.table_info_or_empty(spark, "users").count() == 3
    assert "users" in [r.table_name for r in tables.list_tables(spark).collect()]


def test_row_counts_of_a_lost_table(spark, rows):
    found = tables.row_counts({"a": spark.range(3).toDF("x"), "gone": None, "bad": lambda: spark.table("no_such_table")})
    assert rows(found) == [("a", 3), ("bad", 0), ("gone", 0)]


def test_files(spark, tmp_path):
    df = spark.range(5).toDF("a")
    for fmt in ("csv", "json", "orc", "parquet"):
        path = str(tmp_path / fmt)
        writer = df.write.option("header", True) if fmt == "csv" else df.write
        writer.format(fmt).save(path)
        assert tables.read_file(spark, path, fmt, "a BIGINT").agg(F.sum("a")).first()[0] == 10
    with pytest.raises(ValueError):
        tables.read_file(spark, "x", "csv")
    with pytest.raises(ValueError):
        tables.read_file(spark, "x", "xml")


def test_observed_counts_without_a_second_pass(spark):
    df, watch = tables.observed(spark.range(7).toDF("a"), "q1")
    df.collect()
    assert watch.get == {"row_count": 7, "column_count": 1}


def test_filters_and_columns_reach_the_scan(spark, sf, plan):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = plan(o.filter("o_orderstatus = 'F'").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    assert "TakeOrderedAndProject" in plan(Rel.page(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10, 5))


def test_relational_corners(spark, rows):
    users = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "id INT, name STRING, active BOOLEAN")
    none = spark.createDataFrame([], "id INT, user_id INT")
    assert rows(Rel.child_counts(users, none, "id", "user_id", "id"), "id", "child_count") == [(1, 0), (2, 0), (3, 0)]
    assert rows(Rel.group_concat(users, ["active"], "name")) == [(False, 1, "b"), (True, 2, "a,c")]
    twice = spark.createDataFrame([("g", "x"), ("g", None), ("g", "x"), ("g", "a")], "g STRING, v STRING")
    assert rows(Rel.group_concat(twice, ["g"], "v")) == [("g", 4, "a,x,x")]
    assert Rel.exists(users, "id = 3").first().found and not Rel.exists(users, "id = 9").first().found
    found = Rel.search_page(users, "name", "c", "name", "id", True, 1, 10)
    assert [r.id for r in found.collect()] == [3]


def test_dense_days_and_constant_histogram(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2024-01-01 05:00:00', TIMESTAMP_NTZ '2024-01-04 01:00:00', NULL)) AS ts, 3.0D AS v")
    assert [(str(r.day), r["count"]) for r in T.daily_series(df, "ts").orderBy("day").collect()] == [
        ("2024-01-01", 1), ("2024-01-02", 0), ("2024-01-03", 0), ("2024-01-04", 1),
    ]
    h = T.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 0, 0, 0]
