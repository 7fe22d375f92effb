"""The stages one after the other, on their own inputs."""

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from test_similar import components_by_hand
from tideline.llm import rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{n}")
        docs.append(spark.read.parquet(f"{folder}/{n}"))
    return docs


def test_columns_and_rules(stages):
    assert all(d.columns == stages[0].columns for d in stages[:5])
    kept = {r.doc_id for r in rules.judge(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    words = {r.doc_id: len(r.text.split()) for r in stages[0].collect()}
    good = [d for d, y in labels.items() if y == 1 and words[d] >= 50]
    assert sum(d in kept for d in good) > 0.97 * len(good)


def test_recurring_passages_are_in_one_document(stages):
    def lines(docs):
        return Counter(line for r in docs.collect() for line in {x for x in r.text.split("\n") if len(x.split()) > 50})

    before, after = lines(stages[1]), lines(stages[2])
    assert max(before.values()) > 3 and max(after.values()) == 1
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r in stages[1].collect()} and all(r.n_chars == len(r.text) for r in stages[2].collect())
    assert {x for x in before if re.search(r"\S", x)} >= set(after)


def test_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    found = components_by_hand(rows, corpus_pipeline.SIMILARITY)
    assert {r.doc_id for r in stages[3].collect()} == set(found.values())


def test_mixture_and_packing(stages, spark):
    ids = {r.doc_id for r in stages[3].collect()}
    times = Counter(r.doc_id for r in stages[4].collect())
    assert set(times) <= ids and max(times.values()) <= corpus_pipeline.EPOCHS
    total = lambda d: sum(len(r.text.split()) for r in d.collect())
    assert 0.9 * total(stages[3]) < total(stages[4]) <= total(stages[3])
    assert Counter(r.doc_id for r in stages[5].collect() if r.piece == 0) == times
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", "en", "s1", 0), (2, "a b " * 80, "en", "s1", 5), (2, "a b " * 80, "en", "s1", 5), (3, " ".join(f"w{i}" for i in range(90)), "en", "s2", 1)]
    for frame in (spark.createDataFrame(rows, docs), spark.createDataFrame([], docs)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame.selectExpr("*", "1 AS row", "2 AS key", "3 AS tokens", "4 AS dropped"), SF)
            out.count()
            assert stage is corpus_pipeline.packed or out.columns == [*frame.columns, "row", "key", "tokens", "dropped"]
