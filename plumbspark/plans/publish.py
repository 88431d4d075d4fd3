"""All-or-nothing table writes: stage, check, then move a catalog view to the new data."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbspark.operators.checks import duplicate_keys, violation_count


class RejectedWrite(ValueError):
    """The staged data broke a constraint; the published table is unchanged."""


def publish(
    df: DataFrame,
    view: str,
    folder: str,
    constraints: Mapping[str, str | Column] | None = None,
    unique: Sequence[Sequence[str]] = (),
    partition_by: Sequence[str] = (),
) -> str:
    """Write ``df`` to a new folder and let ``view`` read it if all constraints hold.

    Readers see the old or the new data, never a mix; the old folder stays until
    it is cleaned up. Returns the new folder.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{view}/{uuid.uuid4().hex}"
    broken = []
    rows = df
    if constraints:  # counted while the rows are written, without a second pass
        watch = Observation()
        rows = df.observe(watch, *[violation_count(c).alias(f"v{i}") for i, c in enumerate(constraints.values())])
    rows.write.partitionBy(*partition_by).parquet(path)
    if constraints:
        counts = watch.get
        broken += [f"{name}: {counts[f'v{i}']} rows" for i, name in enumerate(constraints) if counts[f"v{i}"]]
    staged = spark.read.parquet(path)
    for keys in unique:
        if duplicate_keys(staged, keys).select(F.lit(1)).head(1):
            broken.append(f"duplicate {list(keys)}")
    if broken:
        raise RejectedWrite("; ".join(broken))
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{path}`")
    return path
