"""Language identification as a mixture of languages.

A document's character n-grams are drawn from a mixture of languages, each with its own n-gram probabilities; expectation-maximisation
gives the document's language proportions. The set of languages is chosen by penalised likelihood: beginning with the single language
that fits best, the one whose mixture gains most is added while the gain in log-likelihood exceeds the penalty. The log-likelihood is
concave in the proportions, so a bound on every possible gain follows from its slope (n log of the greatest mean ratio of a language's
probability to the mixture's); most documents end there without any iteration.

The n-grams of a text overlap, so each counts as a fraction of an observation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import load
from tideline.llm.hashing import Layout, bucket, segments

BITS, NGRAMS = 16, (2, 3, 4)
#: Observations that an n-gram counts for, and the count that every n-gram of a language has besides its own.
SHARE, SMOOTH = 1 / (2 * len(NGRAMS)), 0.05
#: A language more must gain so many times log(1 + observations) in log-likelihood.
PENALTY = 3.0
ROUNDS = 60


def bags(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(number, buckets, counts) of each text in order; without counts every bucket stands for one n-gram. Long texts are counted piece by piece."""
    at, counts = 0, None
    lowered = [(x or "").lower().encode(errors="replace") for x in texts]
    for numbers, parts in segments(lowered):
        layout = Layout(parts)
        found = []
        for n in NGRAMS:
            places, h = layout.ngrams(n)
            found.append((bucket(h, 2 * n, BITS), [*np.searchsorted(places, layout.starts).tolist(), len(places)]))
        for k, number in enumerate(numbers):
            one = np.concatenate([b[edges[k] : edges[k + 1]] for b, edges in found])
            if number != at:  # the text before is complete
                if counts is not None:
                    yield at, np.flatnonzero(counts), counts[counts > 0]
                at, counts = number, None
            more = k + 1 < len(numbers) and numbers[k + 1] == number or k + 1 == len(numbers) and len(parts[k]) and len(lowered[number]) > len(parts[k])
            if more or counts is not None:
                counts = (0 if counts is None else counts) + np.bincount(one, minlength=1 << BITS)
            else:
                yield number, one, None
    if counts is not None:
        yield at, np.flatnonzero(counts), counts[counts > 0]


class Model:
    """Names of the languages and the log-probability of each bucket (rows) in each of them."""

    def __init__(self, names: list[str], counts: np.ndarray):
        """`counts`: a row of bucket counts for each language."""
        self.names = names
        smooth = counts.astype(np.float64) + SMOOTH
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T, dtype=np.float32)

    def mixture(self, buckets: np.ndarray, counts: np.ndarray | None, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
        """The chosen languages, the first the largest (ties: the first name), and their proportions."""
        logs = self.table[buckets]
        fit = logs.sum(axis=0, dtype=np.float64) if counts is None else counts @ logs.astype(np.float64)
        chosen, shares = [int(np.argmax(fit))], np.ones(1)
        if not len(buckets) or len(self.names) == 1:
            return chosen, shares
        best = logs.max(axis=1, keepdims=True)
        p = np.exp((logs - best).astype(np.float64))
        weights = np.ones(len(buckets)) if counts is None else counts.astype(np.float64)
        n = weights.sum()
        least = penalty * np.log1p(n * SHARE) / (n * SHARE)  # gain of an observation
        now = p[:, chosen[0]]
        while len(chosen) < len(self.names):
            # no mixture is better than this one by more than the logarithm of the greatest slope
            slope = (weights / now) @ p / n
            slope[chosen] = 0
            gains = []
            for other in np.flatnonzero(np.log(np.maximum(slope, 1e-300)) > least).tolist():
                made, theta = em(p[:, [*chosen, other]], weights, np.append(0.9 * shares, 0.1))
                gains.append((float(weights @ np.log(made / now)) / n, -other, theta, made))
            if not gains or (top := max(gains, key=lambda g: g[:2]))[0] <= least:
                break
            chosen, shares, now = [*chosen, -top[1]], top[2], top[3]
        order = sorted(range(len(chosen)), key=lambda i: (-shares[i], chosen[i]))
        return [chosen[i] for i in order], shares[order]


def em(p: np.ndarray, weights: np.ndarray, theta: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of proportions: the probability of each bucket in the mixture, and the proportions."""
    total = weights.sum()
    for _ in range(rounds):
        after = theta * ((weights / (p @ theta)) @ p) / total
        still = np.abs(after - theta).max() < 1e-4
        theta = after
        if still:
            break
    return p @ theta, theta


def learn(docs: DataFrame, usable: Column, rows: int = 2000, most: int = 256) -> Model | None:
    """A model from about `rows` documents of each language (all, where there are fewer), chosen by a hash of id and text, for the `most`
    languages with most documents (ties: the first names); None without any. Counts are added up by Spark, and a language's counts are
    one row of as many numbers as there are buckets."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    counted = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    # at most `most` rows
    sample = known.join(F.broadcast(counted), "lang").where(chance * F.col("count") < rows).select("lang", "text")

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang").text:
                held = np.zeros(1 << BITS, np.int64)
                for _, buckets, counts in bags(texts.tolist()):
                    held += np.bincount(buckets, counts, 1 << BITS).astype(np.int64)
                some = np.flatnonzero(held)
                yield pd.DataFrame({"lang": lang, "bucket": some, "n": held[some]})

    sums = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row for each language, of at most as many pairs as there are buckets
    found = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).toPandas().sort_values("lang", ignore_index=True)
    if found.empty:
        return None
    return Model(found.lang.tolist(), np.array([np.bincount(np.asarray(b, np.int64), c, 1 << BITS) for b, c in zip(found.buckets, found.counts, strict=True)]))


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, langs and shares of each row: the language with the largest share of the whole text, that share, and all
    chosen languages with theirs.

    Needs doc_id and text; other columns are not read. Null texts, texts without a letter, and all texts where nothing was learned are
    `und` with score 0 and no languages. Ties go to the first name. Null ids and repeated rows stay. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pd.Series) -> pd.DataFrame:
        model, texts = held.value, text.tolist()
        rows = [("und", 0.0, [], [])] * len(texts)
        if model:
            for number, buckets, counts in bags(texts):
                if any(map(str.isalpha, texts[number] or "")):
                    chosen, shares = model.mixture(buckets, counts, penalty)
                    rows[number] = (model.names[chosen[0]], float(shares[0]), [model.names[i] for i in chosen], shares.tolist())
        return pd.DataFrame(rows, columns=["lang_pred", "score", "langs", "shares"])

    found = F.pandas_udf(run, "lang_pred string, score double, langs array<string>, shares array<double>")
    return docs.select("doc_id", found("text").alias("found")).select("doc_id", "found.*")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = identify(docs, learn(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "shares")
