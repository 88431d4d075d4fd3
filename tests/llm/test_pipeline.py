"""The pipeline's stages on a small table, each against a plain version."""

import __spark_entry__ as E
import corpus_pipeline as P
import numpy as np
import pytest
from brute import lines_dropped, near_classes
from oracle import compare, duck
from plumbspark.llm.decontamination import contaminated
from plumbspark.llm.labelled import labels_of
from plumbspark.llm.quality import quality_scores
from plumbspark.llm.queries import ORACLE, QUERIES
from plumbspark.llm.storage import written

SF = "/root/testdata/sf0.001"


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    made = []
    for name, stage in P.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        made.append((name, before, docs))
    quality, lines, near, benchmark, packing = made
    assert all(after.columns == columns for _, _, after in made[:-1])

    scores = quality_scores(quality[1], labels_of(spark.read.parquet(f"{SF}/labels.parquet"), "quality"))
    assert {i for i, _ in pairs_of(quality[2])} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    assert sorted(pairs_of(lines[2])) == sorted((i, kept) for i, _, _, kept in lines_dropped(pairs_of(lines[1])))
    assert lines[2].where("n_chars != length(text)").count() == lines[1].where("n_chars != length(text)").count()
    classes = near_classes(pairs_of(near[1]))
    assert sorted(pairs_of(near[2])) == sorted(p for p in pairs_of(near[1]) if classes[p[0]] == p[0])
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in contaminated(benchmark[1], items, slot_heavy=True).collect()}
    held = {d for d, t in pairs_of(benchmark[1]) for r in items.collect() if r.text in t}
    assert held <= leaks
    assert sorted(pairs_of(benchmark[2])) == sorted(p for p in pairs_of(benchmark[1]) if p[0] not in leaks)
    pieces = packing[2].toPandas()
    assert set(pieces.doc_id) == {i for i, _ in pairs_of(benchmark[2])}
    assert (pieces.ids.map(len) == pieces.length).all() and pieces.groupby("sequence_id").length.sum().iloc[:-1].eq(2048).all()

    run = P.run(spark, SF).toPandas()
    keys = ["sequence_id", "offset"]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (run, pieces))
    assert a.drop(columns="ids").equals(b.drop(columns="ids")) and all(map(np.array_equal, a.ids, b.ids))


def test_benchmark_items_without_an_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    texts = [(None, item), (None, "some other words of no item at all " * 3), (None, None), (-1, item.upper()), (-1, "a second text of that id")]
    made = spark.createDataFrame(texts, "doc_id long, text string")
    left = P.benchmark_items(spark, docs.limit(20).unionByName(made, allowMissingColumns=True), SF)
    assert left.columns == docs.columns
    assert sorted(r.text or "" for r in left.where("doc_id IS NULL OR doc_id = -1").collect()) == ["", texts[4][1], texts[1][1]]


def test_all_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) == ""
