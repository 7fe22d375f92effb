"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks of a bounded size; a block is indexed by one sorted list for each dimension. A query
reads each list from the end where its contributions are largest, a stretch of all lists at a time. Every entry that is read is added
to its candidate's lower bound (unread contributions at their list's least), for all queries that read together; the upper bound has the unread
contributions at the last value read. No candidate is scored from its whole vector before. When few enough candidates still reach the k-th best lower bound, no outsider can
qualify, and the scores of those that remain are resolved. Queries and candidates meet block by block; the best of each block are
ranked at the end. Every row is a candidate of its own, also where rows share an id; a query leaves out its own row only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpointed, load

#: Shares of the lists that have been read after each step; queries that read together.
STEPS, TOGETHER = (0.125, 0.25, 0.5, 0.75, 0.875, 1.0), 64


def _number_type(queries: np.ndarray, vectors: np.ndarray):
    """The cheapest type in which all bounds are exact."""
    most = 4 * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def aggregate_lists(queries: np.ndarray, vectors: np.ndarray, first_ids: np.ndarray, k: int, reads: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best distinct vectors, ties to the smaller first id; `reads` takes the number of list
    entries that each query has read."""
    n, dims = vectors.shape
    kind = _number_type(queries, vectors)
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).astype(kind).T)
    order = np.ascontiguousarray(order.T)
    bottom, top = lists[:, :1], lists[:, -1:]
    out: list = [None] * len(queries)
    entries = np.zeros(len(queries), np.int64)
    enough = max(4 * k, 32)
    for start in range(0, len(queries), TOGETHER):
        names = np.arange(start, min(start + TOGETHER, len(queries)))
        q = np.ascontiguousarray(queries[names].T.astype(kind))
        # a row for each candidate, a column for each query: lists are read from the top for the positive, from the bottom for the negative components
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        lower = np.repeat((plus * bottom + minus * top).sum(axis=0)[None, :], n, axis=0)
        read = 0
        for share in STEPS if n > enough else (1.0,):
            to = min(n, int(np.ceil(n * share)))
            for j in range(dims):
                for new, end, part in (slice(n - to, n - read), bottom, plus), (slice(read, to), top, minus):
                    lower[order[j, new]] += (lists[j, new] - end[j])[:, None] * part[j]
            entries[names] += (to - read) * (q != 0).sum(axis=0)
            read = to
            best = np.partition(lower.T, n - min(k, n), axis=1)[:, n - min(k, n)]
            upper = lower
            if read < n:
                # an unread contribution is at most what was reached; of read and unread entries the fewer are gone through
                over, under = plus * (lists[:, n - to : n - to + 1] - bottom), minus * (lists[:, to - 1 : to] - top)
                few = 2 * to <= n
                upper = lower + (over + under).sum(axis=0) if few else lower.copy()
                for j in range(dims):
                    if few:
                        upper[order[j, n - to :]] -= over[j]
                        upper[order[j, :to]] -= under[j]
                    else:
                        upper[order[j, : n - to]] += over[j]
                        upper[order[j, to:]] += under[j]
            alive = upper >= best
            done = (alive.sum(axis=0) <= enough) | (read == n)
            for row in np.flatnonzero(done):
                left = np.flatnonzero(alive[:, row])
                scores = vectors[left] @ queries[names[row]]
                first = np.lexsort((first_ids[left], -scores))[:k]
                out[names[row]] = (left[first], scores[first])
            if done.any():
                names, q, plus, minus, lower = names[~done], *(np.ascontiguousarray(x[:, ~done]) for x in (q, plus, minus, lower))
            if not len(names):
                break
    if reads is not None:
        reads += entries.tolist()
    return out


RESULT = "query long, query_id long, row long, vec_id long, score long, read long"


def _block(k: int):
    def run(key, asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in RESULT.split(", ")]
        if asked.empty or given.empty:
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in names})
        size = max(1, int(key[0]))
        stack = lambda col: np.array([np.asarray(v, np.int64) for v in col], np.int64).reshape(len(col), -1) if key[0] else np.zeros((len(col), size), np.int64)
        # from here on a candidate's id is its place in the order of ties
        given = given.sort_values(["unnamed", "id", "row"], ignore_index=True)
        vectors, first, place = np.unique(stack(given.v), axis=0, return_index=True, return_inverse=True)
        order = np.argsort(place.ravel(), kind="stable")
        starts = np.searchsorted(place.ravel()[order], np.arange(len(vectors) + 1))
        own, ids, unnamed = given.row.tolist(), given.id.tolist(), given.unnamed.tolist()
        rows, reads = [], []
        # one more than k, as one may be the query itself
        best = aggregate_lists(stack(asked.v), vectors, first, k + 1, reads)
        for query, name, (places, scores), read in zip(asked.row.tolist(), asked.id.tolist(), best, reads, strict=True):
            found = [(-s, i) for b, s in zip(places.tolist(), scores.tolist(), strict=True) for i in order[starts[b] : min(starts[b + 1], starts[b] + k + 1)].tolist() if own[i] != query]
            rows += [(query, name, own[i], None if unnamed[i] else ids[i], -s, read) for s, i in sorted(found)[:k]]
        return pd.DataFrame(rows, columns=names).astype("Int64")

    return run


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): floor(256 x) of every component, of each row under a number of its own; vectors that are null or hold a null or
    non-finite component are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    # numbers are fixed by the checkpoint
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, query_block: int = 1024, work: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k best rows of `vectors`, its own row left out, ties to the smaller id (null
    ids last). With `work` also query (its row) and read, the list entries that the query has read in all blocks.

    Both hold row, vec_id and integer arrays v, as integer_vectors gives them. Rows that share an id are rows of their own, as queries and as
    candidates. Vectors of another number of components than the query's are not compared with it. A query without candidates, and an
    empty table, give no rows. Scores are 64-bit.
    """
    blocks, query_blocks = (max(1, -(-x.count() // n)) for x, n in ((vectors, block), (queries, query_block)))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # new names on each side, as both may come from one table
    columns = [F.col("row").alias("row"), F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("unnamed"), F.col("v").alias("v")]
    dim = F.size("v").alias("dim")
    given = vectors.select(dim, deal(blocks, 1).alias("b"), every(query_blocks).alias("q"), *columns)
    asked = queries.select(dim, every(blocks).alias("b"), deal(query_blocks, 2).alias("q"), *columns)
    by = ["dim", "b", "q"]
    best = asked.groupBy(*by).cogroup(given.groupBy(*by)).applyInPandas(_block(k), RESULT)
    one = Window.partitionBy("query")
    best = best.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")))
    if work:  # a block gives its count with each of its rows
        best = best.withColumn("b", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))).withColumn("first", F.row_number().over(Window.partitionBy("query", "b").orderBy("rank")) == 1)
        best = best.withColumn("read", F.sum(F.when(F.col("first"), F.col("read")).otherwise(0)).over(one))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *["query", "read"] * work)


def op9(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(load(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, vec_id, len(v) AS n, unnest(range(len(v))) AS i, unnest(v) AS x FROM v),
scored AS (SELECT q.r AS query, q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM parts q JOIN parts c ON q.i = c.i AND q.n = c.n AND q.r <> c.r
    WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
