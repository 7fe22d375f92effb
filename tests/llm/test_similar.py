"""Near copies by shingle similarity, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tideline.llm import common, neardup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components_by_hand(rows, similarity):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or len(x & y) * 1000 >= similarity * 1000 * len(x | y) > 0:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {d: min(ds) for ds in groups.values() for d in ds}


def copies():
    """Copies with changed words, a crowd around one text, chains, a passage that many texts share, and odd texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts, passage = [], some(60)
    for n in (5, 9, 40, 120, 700):
        base = some(n)
        for _ in range(12):
            one = list(base)
            for i in rng.sample(range(n), min(n, rng.randrange(1 + n // 25 + 2))):
                one[i] = rng.choice(words)
            texts.append(one)
    crowd = some(100)
    for _ in range(80):
        one = list(crowd)
        one[rng.randrange(100)] = rng.choice(words)
        texts.append(one[: rng.randrange(90, 101)])
    chain = some(400)
    texts += [chain[i : i + 100] for i in range(0, 300, 9)]
    texts += [passage + some(rng.randrange(5, 80)) for _ in range(60)]
    texts += [["One"], ["one"], ["two", "words"], [], [" \n"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (9000, None), (9001, rows[0][1])]


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_similar_documents_against_all_pairs(spark, similarity):
    rows = copies()
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC).selectExpr("*", "1 AS node", "2 AS h", "'k' AS key", "4 AS root")
    got = {r.doc_id: r.component_id for r in neardup.similar_documents(frame, 5, similarity).collect()}
    assert got == components_by_hand(rows, similarity)


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark):
    rows = copies()
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows] * 2, DOC)
    kept = corpus_pipeline.near_dedup(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components_by_hand(rows, 0.8).values()))
    assert neardup.keep_one(frame).count() > kept.count()


def test_share_of_similar_pairs_that_meet_in_a_band():
    """Pairs of sets at the similarity itself: at most one in a thousand is missed; of pairs at 0.4, few meet."""
    shape = neardup.band_shape(0.8)
    assert shape == (20, 5)
    rng = np.random.default_rng(3)

    def met(common, apart):
        one = rng.integers(0, 1 << 63, common + 2 * apart, np.uint64)
        a, b = (np.unique(x) for x in (one[: common + apart], np.concatenate([one[:common], one[common + apart :]])))
        return (neardup._bands(a, *shape) == neardup._bands(b, *shape)).any()

    assert sum(met(80, 10) for _ in range(3000)) >= 2995
    assert sum(met(40, 30) for _ in range(500)) < 180


def test_of_repeated_ids_and_texts_the_same_row_stays(spark):
    rows = [(1, "a b c d e f g", "en", f"s{i}", i) for i in (3, 1, 2)]
    for seed in (1, 2):
        kept = neardup.keep_one_similar(spark.createDataFrame(rows[seed:] + rows[:seed], DOC)).collect()
        assert [tuple(r) for r in kept] == [rows[1]]


def test_shingles_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    whole = neardup._shingle_set(text, 5)
    assert len(whole) == len(shingles(text))
    monkeypatch.setattr(neardup, "CHUNK", 50)
    assert (neardup._shingle_set(text, 5) == whole).all()


def test_sets_with_close_fingerprints_are_linked_without_a_common_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "band_shape", lambda similarity: (1, 3000))
    rng, rows = random.Random(11), []
    of = lambda text: neardup._fingerprint([neardup._shingle_set(text, 5)])
    while len(rows) < 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        one, two = " ".join(words), " ".join([*words[:-1], "other"])
        if ((of(one) ^ of(two)) & (1 << 64) - 1).bit_count() <= 2:
            rows += [(len(rows), one), (len(rows) + 1, two)]
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 2, 4, 6]


def chains():
    """Links of 40 chains of 30 nodes, and the smallest node of each node's chain."""
    nodes = [[100 * c + i for i in random.Random(c).sample(range(100), 30)] for c in range(40)]
    return [(a, b) for chain in nodes for a, b in zip(chain, chain[1:], strict=False)], {n: min(chain) for chain in nodes for n in chain}


@pytest.mark.parametrize("full", [7, 20_000])
def test_components_over_one_and_many_partitions(spark, monkeypatch, full):
    monkeypatch.setattr(common, "FULL", full)
    links, want = chains()
    got = neardup.components(spark.createDataFrame(links, "u long, v long"))
    assert sorted((r.node, r.root) for r in got.collect()) == sorted(want.items())


def test_few_links_take_few_tasks(spark):
    """A round over a few links does not take a task for each of the session's shuffle partitions, and its shuffles no file for each."""
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    links, want = chains()
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few links", "")
        assert neardup.components(spark.createDataFrame(links, "u long, v long")).count() == len(want)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 500
