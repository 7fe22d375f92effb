"""Language mixtures: against plain expectation-maximisation, on mixed texts, and held out."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import langmix

SF = "/root/testdata/sf0.01"


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS count", "'x' AS bucket", "2 AS n", "3 AS score")


def invented(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


ALPHABETS = {"aa": "abcdefg", "bb": "efghijk", "cc": "klmnopa"}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, invented(rng, letters, 200), lang) for lang, letters in ALPHABETS.items() for i in range(40)]
    return langmix.learn(corpus(spark, rows), F.lit(True))


def likelihood(model, bucket_counts, languages):
    """Greatest log-likelihood of a mixture, by many rounds of plain expectation-maximisation from equal shares."""
    buckets, counts = bucket_counts
    p = np.exp(model.table[buckets][:, languages].astype(float))
    theta = np.full(len(languages), 1 / len(languages))
    for _ in range(3000):
        share = p * theta
        theta = (counts[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / counts.sum()
    return float(counts @ np.log(p @ theta)) * langmix.SHARE, theta


def bag(text):
    (_, buckets, counts), = langmix.bags([text])
    return (buckets, counts) if counts is not None else np.unique(buckets, return_counts=True)


@pytest.mark.parametrize("parts", [{"aa": 100}, {"aa": 150, "bb": 60}, {"aa": 60, "bb": 60, "cc": 60}, {"cc": 12}, {"bb": 400, "cc": 25}])
def test_languages_and_shares_against_plain_maximisation(model, parts):
    rng = random.Random(9)
    text = "\n".join(invented(rng, ALPHABETS[lang], n) for lang, n in parts.items())
    got, shares = model.mixture(*bag(text))
    assert {model.names[i] for i in got} == set(parts)
    counted = bag(text)
    value, theta = likelihood(model, counted, got)
    assert np.abs(theta - shares).max() < 0.02
    # no set of languages has a better penalised likelihood
    cost = langmix.PENALTY * np.log1p(counted[1].sum() * langmix.SHARE)
    for k in (1, 2, 3):
        for others in combinations(range(3), k):
            assert likelihood(model, counted, list(others))[0] - cost * k <= value - cost * len(got) + 0.5


def test_counted_and_listed_buckets_agree(model, monkeypatch):
    rng = random.Random(2)
    texts = [invented(rng, "abcdefg", n) for n in (3000, 5, 900)] + ["", None, "word"] + [invented(rng, "klmn", 2000)]
    apart = [np.bincount(b, minlength=1 << langmix.BITS) for _, b, _ in langmix.bags(texts)]
    monkeypatch.setattr("tideline.llm.hashing.SEGMENT", 700)
    joined = {n: np.bincount(b, c, 1 << langmix.BITS) for n, b, c in langmix.bags(texts)}
    assert sorted(joined) == list(range(len(texts)))
    # only n-grams over a cut are lost or new: none, as cuts are at white space and n-grams stay within words
    for n, counts in enumerate(apart):
        assert abs(joined[n].sum() - counts.sum()) <= 0.002 * counts.sum() + 2
        assert np.abs(joined[n] - counts).sum() <= 0.01 * counts.sum() + 2


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!\n"), (4, "漢字"), (None, "abc bad cab"), (5, "abc bad cab " * 100_000), (6, "efg hij"), (6, "efg hij"), (7, "a" * 300_000), (8, "\ud83d".encode("utf-8", "replace").decode() + " 9")]
    got = {(r.doc_id, r.lang_pred): r for r in langmix.identify(corpus(spark, [(*r, None) for r in rows]), model).collect()}
    assert {k: v.score for k, v in got.items() if k[0] in (1, 2, 3, 8)} == {(1, "und"): 0, (2, "und"): 0, (3, "und"): 0, (8, "und"): 0}
    assert (None, "aa") in got and got[5, "aa"].score == 1 and (7, "aa") in got and (6, "bb") in got
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_and_empty_table(spark, model):
    none = corpus(spark, [(1, "abc", None), (2, None, "aa")])
    assert langmix.learn(none, F.lit(True)) is None
    assert [r.lang_pred for r in langmix.identify(none, None).collect()] == ["und", "und"]
    one = langmix.learn(corpus(spark, [(1, "abc", "zz")]), F.lit(True))
    assert [r.lang_pred for r in langmix.identify(none, one).collect()] == ["zz", "und"]
    assert langmix.identify(corpus(spark, []), model).collect() == []


def test_held_out_documents(spark):
    got = langmix.op12(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = {r.held_out: r.right for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert right[True] > 0.98 and right[False] > 0.98
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
