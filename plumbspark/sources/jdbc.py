"""Database tables through Spark's JDBC source, split over executors by a key range."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The database kinds a configuration may name, with URL prefix and driver class.
_DIALECTS = {
    "postgres": ("postgresql", "org.postgresql.Driver"),
    "postgres-psycopg3": ("postgresql", "org.postgresql.Driver"),
    "postgres-sqlalchemy": ("postgresql", "org.postgresql.Driver"),
    "sqlite": ("sqlite", "org.sqlite.JDBC"),
}


def jdbc_options(config: Mapping) -> dict[str, str]:
    """Reader/writer options for ``{connector_type, host, port, database, user, password}``.

    ``partition_column`` with ``lower_bound``, ``upper_bound`` and ``num_partitions``
    splits the read; ``fetch_size`` and ``batch_size`` set the transfer unit.
    """
    kind = config.get("connector_type", "postgres")
    if kind not in _DIALECTS:
        raise ValueError(f"unknown connector type: {kind}")
    scheme, driver = _DIALECTS[kind]
    if scheme == "sqlite":
        url = f"jdbc:sqlite:{config['database']}"
    else:
        url = f"jdbc:{scheme}://{config.get('host', 'localhost')}:{config.get('port', 5432)}/{config['database']}"
    out = {
        "url": url,
        "driver": driver,
        "fetchsize": str(config.get("fetch_size", 10_000)),
        "batchsize": str(config.get("batch_size", 10_000)),
    }
    for key in ("user", "password"):
        if config.get(key) is not None:
            out[key] = str(config[key])
    split = ("partition_column", "lower_bound", "upper_bound", "num_partitions")
    given = [k for k in split if config.get(k) is not None]
    if given and len(given) != len(split):
        raise ValueError("a split read needs " + ", ".join(split))
    if given:
        out["partitionColumn"] = str(config["partition_column"])
        out["lowerBound"] = str(config["lower_bound"])
        out["upperBound"] = str(config["upper_bound"])
        out["numPartitions"] = str(config["num_partitions"])
    return out


def read_table(spark: SparkSession, config: Mapping, table: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config)).option("dbtable", table).load()


def append_table(df: DataFrame, config: Mapping, table: str) -> None:
    options = {k: v for k, v in jdbc_options(config).items() if k not in ("partitionColumn", "lowerBound", "upperBound")}
    df.write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()
