"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into five blocks. Two fingerprints that differ in two bits or fewer agree on at least three whole
blocks, so each is filed under its ten choices of three blocks, blocks are joined, and the Hamming distance is verified.
Equal fingerprints are one row before that. A block with many fingerprints is not paired within: there, each
fingerprint is filed under itself and its one-bit changes outside the block, two are within two bits exactly when they
share such a point, and each is linked with the smallest of the point's (at most 27) fingerprints.
Components of the links are found by alternating large-star and small-star steps.

`similar_documents` links by the exact Jaccard similarity of shingle sets, which no small number of differing bits can stand for: sets
that are similar to 0.8 differ in up to a dozen bits. The SimHashes of the sets at two or fewer differing bits are candidates first, through the
same blocks; then sets are filed under bands of their least hashes. Each that is not connected yet is compared first
with the smallest set of its bands, then with the smallest of its other bands if it is not connected with that yet, and
then with what shares a band and is still in another component. Texts travel to the comparison, not shingles.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpointed, filled, if_few, load, narrow, stored, text_key

CHUNK = 1 << 20
WIDTHS = (13, 13, 13, 13, 12)
DISTANCE = 2


def _shingle_hashes(text: bytes, size: int, seed: int):
    """Arrays of the hashes of all word shingles of a text; holds about a megabyte of it at a time."""
    from xxhash import xxh64_intdigest

    digest = partial(xxh64_intdigest, seed=seed)
    at, carry, some = 0, [], False
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        words = carry + text[at:end].split()
        at = end
        if len(words) >= size:
            some = True
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens + 1) - 1
            joined = b" ".join(words)
            spans = zip((ends - lens).tolist(), ends[size - 1 :].tolist(), strict=False)
            yield np.array([digest(joined[a:b]) for a, b in spans], np.uint64)
            words = words[len(words) - size + 1 :] if size > 1 else []
        carry = words
    if carry and not some:
        yield np.array([digest(b" ".join(carry))], np.uint64)


def _fingerprint(parts) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), 1 << 15):
            part = hashes[i : i + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def simhash(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Fingerprint as a signed 64-bit integer; no words: 0."""
    return _fingerprint(_shingle_hashes((text or "").encode().lower(), size, seed))  # bytes.lower() changes A-Z only


def _simhashes(text: pd.Series) -> pd.Series:
    return pd.Series([simhash(x) for x in text], dtype="int64")


def _masks() -> list[tuple[int, list[int]]]:
    """For each choice of three blocks: the signed mask of its bits, and the bits outside."""
    ends = np.cumsum(WIDTHS).tolist()
    blocks = [list(range(e - w, e)) for e, w in zip(ends, WIDTHS, strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for free in combinations(range(len(blocks)), DISTANCE):
        bits = [b for i in free for b in blocks[i]]
        out.append((signed((1 << 64) - 1 - sum(1 << b for b in bits)), bits))
    return out


def links(prints: DataFrame, crowded: int = 48) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints `fp` at two or fewer differing bits, complete up to connection:
    all such pairs are linked directly, or in blocks of over `crowded` fingerprints through a common neighbour."""
    masks = _masks()
    signed = lambda b: (1 << b) - (1 << 64) if b == 63 else 1 << b
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(masks)))
    filed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    shared = filed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    # each of these rows becomes up to 27 points, or is paired with up to 47
    filed = narrow(filed.join(shared, ["c", "key"]), 2_000)
    few, many = filed.where(F.col("n") <= crowded), filed.where(F.col("n") > crowded)
    pairs = few.alias("a").join(
        few.alias("b"),
        (F.col("a.c") == F.col("b.c")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(signed(b)).cast("long") for b in bits)) for _, bits in masks))
    points = many.select("fp", F.explode(F.element_at(flips, F.col("c") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    least = points.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = points.join(least, "point").where("u < fp").where(F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= DISTANCE).select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v): root is the smallest node of its component."""
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        # there are never more links than before
        edges = filled(edges, mark[0])
        if mark == seen:
            return filled(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct()), 2 * mark[0])
        seen = mark
        # large star: neighbours above a node go to its smallest neighbour
        both = filled(edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select("lo", "hi")), 2 * mark[0])
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.join(if_few(least, rows=2 * mark[0]), "n").where("m > n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = large.join(if_few(low, rows=mark[0]), "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        edges = checkpointed(filled(low.select("hi", F.col("least").alias("lo")).union(moved), mark[0]).distinct())


def near_duplicates(docs: DataFrame, crowded: int = 48) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): doc_id, key, fp, component_id.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest doc_id of the
    component; null ids count only where a component has no other. Repeated rows stay. An empty table gives no rows.
    """
    prints = checkpointed(docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")), F.pandas_udf(_simhashes, "long")("text").alias("fp")))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), crowded))
    label = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = label.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(label.join(of, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "key", "fp", "root", "component_id")


#: Least hashes of a set, the share of pairs at the similarity that may be missed, and longs of a set's parity sketch.
HASHES, MISSED, SKETCH = 100, 0.0005, 8


def band_shape(similarity: float) -> tuple[int, int]:
    """Bands and least hashes in each: as many in each as the share of missed pairs allows (20 bands of 5 for 0.8, of which it is 0.0004)."""
    rows = [r for r in range(1, 11) if (1 - similarity**r) ** (HASHES // r) <= MISSED]
    return HASHES // max(rows, default=1), max(rows, default=1)


def _shingle_set(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; no words: none."""
    parts = [np.unique(h) for h in _shingle_hashes((text or "").encode().lower(), size, seed)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _parities(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _bands(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band: of the least values of the set under `rows` random orders."""
    odd = np.random.default_rng(5).integers(1, 1 << 63, (bands * rows, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        for k, (a, b) in enumerate(odd):
            x = part * a
            least[k] = min(least[k], ((x ^ (x >> np.uint64(32))) * b).min())
    mixed = least.reshape(bands, rows) * (np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    mixed = (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _set_columns(size: int, similarity: float):
    """UDF of a text: node (64-bit digest of its shingle set), n shingles, the SimHash of the set, its bands, and the parity sketch."""
    fields, shape = ", ".join(f"s{i} long" for i in range(SKETCH)), band_shape(similarity)

    @F.pandas_udf(f"node long, n long, fp long, bands array<long>, {fields}")
    def columns(text: pd.Series) -> pd.DataFrame:
        from xxhash import xxh64_intdigest

        nodes, counts, prints, bands, sketches = [], [], [], [], []
        for x in text:
            h = _shingle_set(x, size)
            nodes.append(xxh64_intdigest(h.tobytes()))
            counts.append(len(h))
            prints.append(_fingerprint([h]))
            bands.append(_bands(h, *shape))
            sketches.append(_parities(h))
        table = np.array(sketches, np.int64).reshape(-1, SKETCH)
        out = {"node": np.array(nodes, np.uint64).view(np.int64), "n": np.array(counts, np.int64), "fp": np.array(prints, np.int64), "bands": bands}
        return pd.DataFrame(out | {f"s{i}": table[:, i] for i in range(SKETCH)})

    return columns


def _may_be_similar(similarity: float) -> str:
    """Necessary condition on sizes and sketches of two sets a and b: the differing parities are never more than the differing shingles."""
    apart = " + ".join(f"bit_count(a.s{i} ^ b.s{i})" for i in range(SKETCH))
    return f"least(a.n, b.n) >= {similarity}D * greatest(a.n, b.n) - 1e-6D AND {apart} <= {(1 - similarity) / (1 + similarity)}D * (a.n + b.n) + 1e-6D"


def _verified(pairs: DataFrame, keys: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar; `keys` has the key of one text of each node. Each v's text goes to its u's."""
    pairs = narrow(pairs.distinct())
    texts = docs.select(text_key(F.col("doc_id"), F.col("text")), "text")
    place = lambda node: keys.withColumnRenamed("node", node)
    lesser = narrow(if_few(pairs).join(place("v"), "v").select("key", "u", "v"))
    first = narrow(if_few(pairs.select("u").distinct()).join(place("u"), "u").select("key", "u"))
    moved = texts.join(if_few(lesser), "key").select("u", "v", F.col("text").alias("text_v"))
    # of repeated rows one is enough on this side
    both = moved.join(texts.join(if_few(first), "key").groupBy("u").agg(F.first("text").alias("text_u")), "u")

    @F.pandas_udf("boolean")
    def similar(u: pd.Series, text_u: pd.Series, text_v: pd.Series) -> pd.Series:
        out, last, held = [], None, None
        for name, a, b in zip(u, text_u, text_v, strict=True):
            if name != last:
                last, held = name, _shingle_set(a, size)
            h = _shingle_set(b, size)
            at = np.searchsorted(held, h)
            common = int((held[np.minimum(at, len(held) - 1)] == h).sum()) if len(held) else 0
            out.append(common >= similarity * (len(held) + len(h) - common) - 1e-9)
        return pd.Series(out, dtype=bool)

    # rows of one u stand together after the join by u
    return narrow(both.where(similar("u", "text_u", "text_v")).select("u", "v").distinct())


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): doc_id, key, node, root, component_id.

    Documents are linked when the Jaccard similarity of their sets of `size`-word shingles (A-Z in lower case) is at least `similarity`,
    which is above 0. Pairs whose SimHashes are within two bits are candidates, and pairs that share a band are found: of pairs at 0.8, 0.04 % share none, of those at 0.9 1 in 10 million (see band_shape). No
    pair that is less similar is linked. A text of fewer words is one shingle; null and blank texts have none and link with each
    other only. Shingles and sets are told apart by 64-bit hashes. component_id is as in near_duplicates. Repeated rows stay. An empty
    table gives no rows.
    """
    base = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")), _set_columns(size, similarity)("text").alias("set"))
    made = stored(base.select("doc_id", "key", "set.*"))
    sketch = [f"s{i}" for i in range(SKETCH)]
    least = made.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *(F.min(c).alias(c) for c in ("n", "fp", *sketch)))
    keys = stored(least)
    places, sides = keys.select("node", "key"), keys.select("node", "n", *sketch)
    filed = made.select("node", F.explode("bands").alias("band")).distinct()
    first = filed.groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").drop("last")
    filed = stored(filed.join(first, "band"))
    near = _may_be_similar(similarity)

    def sized(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that may be similar."""
        pairs = narrow(narrow(pairs.distinct()).transform(if_few).join(sides, F.expr("u = node")).drop("node"))
        return narrow(if_few(pairs).alias("a").join(sides.alias("b"), F.expr(f"v = b.node AND {near}")).select("u", "v"))

    # fingerprints at two or fewer differing bits, each through its smallest set
    prints = checkpointed(keys.groupBy("fp").agg(F.min("node").alias("u"), F.count("*").alias("n")))
    place = lambda c: prints.select(F.col("fp").alias(f"{c}_fp"), F.col("u").alias(c))
    close = narrow(if_few(narrow(links(prints.select("fp")).toDF("u_fp", "v_fp"))).join(place("u"), "u_fp"))
    close = if_few(close).join(place("v"), "v_fp").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    equal = keys.select("fp", F.col("node").alias("v")).join(if_few(narrow(prints.where("n > 1"))), "fp").where("u < v").select("u", "v")
    alike = sized(close.union(equal))
    found = _verified(alike, places, docs, size, similarity)
    roots = components(found)

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are in different components."""
        few = if_few(roots)
        of = lambda c: few.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        placed = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
        return placed.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")

    # the smallest sets of each set's bands
    stars = sized(filed.where("u <> node").select("u", F.col("node").alias("v")))
    found = narrow(found.union(_verified(apart(stars).groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), places, docs, size, similarity)))
    roots = components(found)
    found = narrow(found.union(_verified(apart(stars), places, docs, size, similarity)))
    roots = components(found)
    # bands that still hold several components
    placed = checkpointed(filed.select("band", "node").join(if_few(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = narrow(placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band"))
    placed = checkpointed(placed.join(if_few(mixed), "band").join(sides, "node"))
    rest = placed.alias("a").join(placed.alias("b"), F.expr(f"a.band = b.band AND a.node < b.node AND a.root <> b.root AND {near}")).selectExpr("a.node AS u", "b.node AS v")
    found = found.union(_verified(rest.join(if_few(stars), ["u", "v"], "left_anti"), places, docs, size, similarity))
    label = keys.select("node", "least").join(if_few(components(found)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = label.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.select("doc_id", "key", "node").join(label.join(of, "root").select("node", "root", "component_id"), "node").select("doc_id", "key", "node", "root", "component_id")


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).getField("key").alias("key")).select("key").distinct()
    packed = docs.select(F.struct("*").alias("row"), text_key(F.col("doc_id"), F.col("text")))
    one = packed.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.select("row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without all but one document of each component: the one with the smallest doc_id (nulls last), then the
    smallest digest of id and text. Of rows with one id and text the one stays whose columns come first as JSON text. All columns stay, whatever
    they are called."""
    return _one_of_each(docs, near_duplicates(docs))


def keep_one_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """As keep_one, with the components of similar_documents."""
    return _one_of_each(docs, similar_documents(docs, size, similarity))


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
