import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Extra columns clash with names that the operators use.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("n_tokens", "kept", "score", "key", "rep", "label", "carry", "ids")],
    ]
)


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash."""

    def make(pairs):
        return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in pairs], SCHEMA).repartition(3)

    return make


@pytest.fixture
def real(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (None, "one two three four five six seven"),
    (None, None),
    (6, "x" * 20000),
    (7, "a b " * 5000),
    (8, "\n".join(["same line"] * 30)),
    (9, "déjà vu — naïve Ünïcödé 日本語 😀 ½ ٣"),
]


@pytest.fixture
def odd():
    return list(ODD)
