"""Supervised subword embeddings for text quality.

Every hashed word, word pair and character n-gram has a learned vector; a document is the mean of its vectors (of each kind), and a softmax
over two classes is fitted with them by stochastic gradient descent in numpy. For scoring, each vector is multiplied with the
output weights once, so a document's score is the mean of one number for each of its grams: the same result in one pass
over the whole text.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.hashing import Layout, bucket, segments
from tideline.llm.common import load

BITS, WIDTH, NGRAMS, KINDS = 17, 12, (3, 4, 5), 3


def _grams(layout: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, places and buckets of all grams of a layout; all pairs of a word and itself are one gram."""
    h = layout.words()
    yield 0, layout.word_from, bucket(h, 1, BITS)
    first = np.searchsorted(layout.word_from, layout.starts)
    second = np.setdiff1d(np.arange(len(h)), first, assume_unique=False)  # the first word of a stretch has no pair
    pairs = np.where(h[second] == h[second - 1], np.uint64(0), h[second] * np.uint64(3) + h[second - 1])
    yield 1, layout.word_from[second], bucket(pairs, 2, BITS)
    for n in NGRAMS:
        places, h = layout.ngrams(n)
        yield 2, places, bucket(h, 2 * n, BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights; words, pairs and character n-grams weigh a third each."""
    counts = np.zeros((KINDS, 1 << BITS))
    for _, parts in segments([(text or "").encode()]):
        for kind, _, b in _grams(Layout(parts)):
            counts[kind] += np.bincount(b, minlength=1 << BITS)
    weights = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).sum(axis=0) / KINDS
    found = np.flatnonzero(weights)
    return found, weights[found]


class Model:
    """vectors (buckets x width), out (width x 2) and bias (2)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.1, 0.1, (1 << BITS, WIDTH)).astype(np.float32) / WIDTH
        self.out, self.bias = rng.normal(0, WIDTH**-0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 5, rate: float = 0.1, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        share = labels.mean() if len(labels) else 0.5
        if share in (0, 1) or not len(labels):
            self.bias[:] = 0, np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
            return self
        self.bias[:] = 0, np.log(share / (1 - share))
        steps = epochs * len(rows)
        for e in range(epochs):
            for n, i in enumerate(rng.permutation(len(rows))):
                lr = rate * (1 - (e * len(rows) + n) / steps)
                found, weight = rows[i]
                if not len(found):
                    continue
                mean = weight.astype(np.float32) @ self.vectors[found]
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max())
                g = p / p.sum()
                g[labels[i]] -= 1
                back = self.out @ g
                self.out -= lr * np.outer(mean, g)
                # the gradient, scaled to move the document's own output alike at every length
                self.vectors[found] -= (lr * weight / (weight @ weight)).astype(np.float32)[:, None] * back
                self.bias -= 0.1 * lr * g
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, vectors=self.vectors, out=self.out, bias=self.bias)
        return held.getvalue()

    @classmethod
    def restore(cls, data: bytes) -> Model:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as x:
            made.vectors, made.out, made.bias = x["vectors"], x["out"], x["bias"]
        return made


def scores(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros((KINDS, len(texts))), np.zeros((KINDS, len(texts)))
    for numbers, parts in segments([(x or "").encode() for x in texts]):
        layout = Layout(parts)
        for kind, places, b in _grams(layout):
            edges = np.searchsorted(places, layout.starts)
            run = np.concatenate([[0.0], np.cumsum(table[b], dtype=np.float64)])
            ends = np.append(edges[1:], len(places))
            np.add.at(total[kind], numbers, run[ends] - run[edges])
            np.add.at(count[kind], numbers, ends - edges)
    return 1 / (1 + np.exp(-((total / np.maximum(count, 1)).sum(axis=0) / KINDS + bias)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents: those with the smallest hashes among the ids that may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 2000, epochs: int = 5) -> Model:
    """A model from at most `rows` labelled documents, trained in one task that holds only those; `learn` says which ids may be used."""

    def run(batches):
        texts, seen, kinds = [], [], []
        for pdf in batches:
            seen += pdf.doc_id.tolist()
            texts += [features(x) for x in pdf.text]
            kinds += pdf.label.tolist()
        order = np.argsort(seen, kind="stable")
        model = Model().fit([texts[i] for i in order], np.array(kinds, int)[order], epochs)
        yield pd.DataFrame({"model": [model.dump()]})

    sample = labelled_sample(docs, labels, "quality", learn, rows).repartition(1)
    found = sample.mapInPandas(run, "model binary").first()
    return Model.restore(bytes(found[0])) if found else Model().fit([], np.zeros(0, int))


def classify(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """doc_id, score (probability of good quality, 0 to 1) and predicted for each row of `docs`, from its whole text alone.

    Needs doc_id and text; other columns are not read. Null and empty texts get the share of good documents in the sample; repeated rows
    stay. Without labels all scores come from an untrained model near 0.5. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(scores(text.tolist(), *held.value), dtype="float64")

    found = docs.select("doc_id", F.pandas_udf(run, "double")("text").alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = classify(docs, fit(docs, labels, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
