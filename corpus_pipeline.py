"""The corpus pipeline: quality, lines, near copies, benchmark items, packed sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), and all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder before the next one reads them.

No stage before the last can be told in SQL (a fitted classifier, weighted minhash), so ``ORACLE_SQL`` is None;
the tests hold ``run`` against a plain version over a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.functions.sizes import broadcast_if_small
from plumbspark.llm.bagminhash import near_duplicates, one_of_each
from plumbspark.llm.decontamination import contaminated
from plumbspark.llm.labelled import labels_of
from plumbspark.llm.line_dedup import build_index, common_lines_dropped
from plumbspark.llm.packing import packed
from plumbspark.llm.quality import kept_by_quality
from plumbspark.llm.queries import END_ID, SEQUENCE, table, vocabulary
from plumbspark.llm.storage import written
from plumbspark.llm.token_files import LISTED


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return kept_by_quality(docs, labels_of(table(spark, sf_dir, "labels"), "quality"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; the documents stay, with what is left."""
    return common_lines_dropped(docs, build_index(docs, min_docs=10, min_chars=1))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id."""
    return one_of_each(docs, near_duplicates(docs))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by itself under a number of its own, those with a
    NULL id too."""
    number = "row_number"
    while number in docs.columns:
        number += "_"
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-rows", codec="zstd")
    found = contaminated(numbered, table(spark, sf_dir, "benchmark"), id_col=number, slot_heavy=True)
    found = written(found.select(F.col("doc_id").alias(number)).distinct(), "contaminated")
    return numbered.join(broadcast_if_small(found), number, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along the curve, with their ids."""
    return packed(docs, vocabulary("word_bpe_49k.json"), END_ID, SEQUENCE, form=LISTED)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
