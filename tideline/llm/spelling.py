"""Spelling variants by a relational trie frontier.

All words, and all words read backwards, are tries that lie in one distributed table of nodes with their edges. A search state is
(word, position, node, edits). States without an edit are a word's own prefixes; at each of them one edit is spent (an edge of another letter, an
edge with the word's position kept, or a letter of the word left out), and then all states follow their words' letters, one level of
the tries a round, by joins with the edges. A state that reaches the end of its word at a word's end has found a neighbour.

Two things keep the frontier small. A pair of one edit shares the first half of a word or, read backwards, the second, so edits are
spent from the middle on only, where few words share a node. A node with one word below it has no edges in the table: a state
that gets there is settled by comparing the two words.

Words of `DEEP` code points and more do not go down the tries: equal hashes of what is left without one letter pair them, and the
pairs are compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpointed, load, stored

#: Words from this length on are paired by hashes, so that tries have fewer levels than this.
DEEP = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _letter(word: str, place: Column) -> Column:
    """The code point at a place counted from 0; nothing beyond the end."""
    return F.substring(F.col(word), place + 1, F.lit(1))


def _start(word: str, n: Column) -> Column:
    return F.substring(F.col(word), F.lit(1), n)


def _turned(words: DataFrame) -> DataFrame:
    """(back, word, size): each word as it is and backwards."""
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), "word"), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))).alias("w"))
    return both.select("w.*", F.length("w.word").alias("size"))


def trie(turned: DataFrame) -> DataFrame:
    """(back, node, edges): nodes are prefixes with two or more words below, an edge has letter, words below, the word if it is one only,
    whether a word ends there, and the letters of the edges beyond. A node counts the words of up to twice its depth and two letters; a
    state at it can reach no others."""
    steps = turned.select("back", "word", "size", F.explode(F.sequence(F.floor((F.col("size") - 1) / 2).cast("int"), F.col("size"))).alias("d"))
    steps = steps.select("back", _start("word", F.col("d")).alias("node"), _letter("word", F.col("d")).alias("letter"), "word", (F.col("d") + 1 == F.col("size")).alias("ends"))
    edges = steps.groupBy("back", "node", "letter").agg(F.count("*").alias("words"), F.min("word").alias("only"), F.max("ends").alias("ends"))
    # a word that ends at a node counts there as an edge without a letter, which is not kept
    edge = F.when(F.col("letter") != "", F.struct("letter", "words", F.when(F.col("words") == 1, F.col("only")).alias("only"), "ends"))
    # one edge for each letter
    nodes = edges.groupBy("back", "node").agg(F.collect_list(edge).alias("edges"), F.sum("words").alias("below")).where("below > 1").drop("below")
    nodes = stored(nodes)
    beyond = nodes.select("back", F.col("node").alias("child"), F.array_join("edges.letter", "").alias("beyond"))
    edges = nodes.select("back", "node", F.explode("edges").alias("e")).withColumn("child", F.concat("node", "e.letter")).join(beyond, ["back", "child"], "left")
    return edges.groupBy("back", "node").agg(F.collect_list(F.struct("e.letter", "e.words", "e.only", "e.ends", "beyond")).alias("edges"))


def _useful(arrived: DataFrame) -> DataFrame:
    """The states that have found a neighbour (`near`) or go on (`near` is null), as (back, word, size, at, node, near)."""
    single = F.when(F.levenshtein("word", "only", 1) == 1, F.col("only"))
    near = F.when(F.col("words") == 1, single).when((F.col("at") == F.col("size")) & F.col("ends"), F.col("node"))
    found = arrived.select("back", "word", "size", "at", "node", "beyond", near.alias("near"))
    onward = F.coalesce(F.instr("beyond", _letter("word", F.col("at"))) > 0, F.lit(False)) & (F.col("at") < F.col("size"))
    return found.where(F.col("near").isNotNull() | onward).drop("beyond")


def short_neighbours(words: DataFrame) -> DataFrame:
    """(word, near), repeated, of the words that differ by exactly one edit."""
    turned = _turned(words)
    nodes = stored(trie(turned))
    flat = ("e.words", "e.only", "e.ends", "e.beyond")
    edges = nodes.select("back", "node", F.explode("edges").alias("e")).select("back", F.concat("node", "e.letter").alias("node"), *flat)
    middle = F.when(F.col("back"), F.ceil(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2)).cast("int")
    own = turned.select("back", "word", "size", F.explode(F.sequence(middle, F.col("size"))).alias("d")).withColumn("node", _start("word", F.col("d")))
    # one letter more, or another letter; a letter that repeats is added after its last or left out at its last, so each edit is made once
    met = own.join(nodes, ["back", "node"]).select("back", "word", "size", "d", "node", F.explode("edges").alias("e")).where(F.col("e.letter") != _letter("word", F.col("d")))
    places = F.when(F.col("d") < F.col("size"), F.array(F.col("d"), F.col("d") + 1)).otherwise(F.array(F.col("d")))
    more = met.select("back", "word", "size", F.explode(places).alias("at"), F.concat("node", "e.letter").alias("node"), *flat)
    # one letter fewer
    after = _letter("word", F.col("d") + 1)
    fewer = own.where(F.col("d") < F.col("size")).where(_letter("word", F.col("d")) != after)
    fewer = fewer.select("back", "word", "size", F.least(F.col("d") + 2, F.col("size")).alias("at"), F.concat("node", after).alias("node"))
    states = stored(_useful(more).unionByName(_useful(fewer.join(edges, ["back", "node"]))))
    found = []
    while True:
        found.append(states.where("near IS NOT NULL"))
        going = states.where("near IS NULL").select("back", "word", "size", (F.col("at") + 1).alias("at"), F.concat("node", _letter("word", F.col("at"))).alias("node"))
        if going.isEmpty():
            break
        states = stored(_useful(going.join(edges, ["back", "node"])))
    way = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    return reduce(DataFrame.union, found).select(way("word").alias("word"), way("near").alias("near"))


def _without_one(batches):
    """(id, key) of each word: a key for the word itself and for the word without each of its letters; equal words give equal keys."""
    odd = 0x9E3779B97F4A7C15
    back = np.uint64(pow(odd, -1, 1 << 64))
    for pdf in batches:
        for name, word in zip(pdf.id, pdf.word, strict=True):
            points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = len(points)
            powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, odd, np.uint64)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * powers, dtype=np.uint64)])
            left = sums[:-1] + (sums[-1] - sums[1:]) * back
            # the place counts: words that differ in one letter agree without that place
            place = np.arange(n, dtype=np.uint64)
            cut = pd.DataFrame({"key": left.view(np.int64), "place": place.view(np.int64), "size": n - 1, "whole": False})
            whole = pd.DataFrame({"key": sums[-1:].view(np.int64), "place": [-1], "size": n, "whole": True})
            yield pd.concat([cut, whole]).assign(id=name)


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near), repeated, of long words that differ by exactly one edit; time and rows grow with the sum of their lengths."""
    named = checkpointed(words.select("word", F.md5("word").alias("id")))
    keys = named.mapInPandas(_without_one, "key long, place long, size long, whole boolean, id string")
    shared = keys.groupBy("key", "size").agg(F.count_distinct("id").alias("n")).where("n > 1").drop("n")
    keys = checkpointed(keys.join(shared, ["key", "size"]))
    cut, whole = keys.where("NOT whole"), keys.where("whole")
    one = F.expr("a.key = b.key AND a.size = b.size AND a.id <> b.id")
    replaced = cut.alias("a").join(cut.alias("b"), one & F.expr("a.place = b.place")).selectExpr("a.id AS u", "b.id AS v", "a.place", "true AS even")
    shorter = cut.alias("a").join(whole.alias("b"), one).selectExpr("a.id AS u", "b.id AS v", "a.place", "false AS even")
    pairs = replaced.union(shorter).groupBy("u", "v", "even").agg(F.min("place").cast("int").alias("place"))
    pairs = pairs.join(named.selectExpr("id AS u", "word"), "u").join(named.selectExpr("id AS v", "word AS near"), "v")
    left = lambda c: F.concat(_start(c, F.col("place")), F.substring(F.col(c), F.col("place") + 2, F.length(c)))
    # hashes only propose; this comparison is linear in the length, unlike an edit distance
    true = pairs.where((left("word") == F.when(F.col("even"), left("near")).otherwise(F.col("near"))) & (F.col("word") != F.col("near")))
    return true.select(F.explode(F.when(F.col("even"), F.array(F.struct("word", "near"))).otherwise(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))).alias("p")).select("p.*")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) of all distinct words of `words` that differ by exactly one inserted, deleted or replaced code point, both ways round."""
    short = short_neighbours(words.where(F.length("word") <= DEEP))
    return short.union(long_neighbours(words.where(F.length("word") >= DEEP))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until all are at words without one."""
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpointed(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return roots


def spelling_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `words` (word, n; other columns are not read).

    A word's form is its neighbour of the largest n (ties: the first in code-point order) if that n is at least `factor` (above 1) times its
    own; root follows forms to the last, and is the word itself where there is none. Null and empty words are left out, rows of
    one word add up, nulls in n count as 0. An empty table gives no rows.
    """
    words = checkpointed(words.where("word <> ''").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")))
    pairs = neighbours(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # strings compare by bytes of UTF-8, which is the order of code points
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("enough", F.col("best.less") <= -factor * F.col("n"))
    form = lambda c: F.when(F.col("enough"), c)
    found = checkpointed(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.near")).alias("form"), form(-F.col("best.less")).alias("form_n")))
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted_words(docs: DataFrame, least: int = 5, length: int = 6, every: int = 199) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z in lower case, of at least `length` code points and `least` occurrences in all.

    Where `every` divides h, the crc32 of `<doc_id>:<run>`, the run has lost its code point h % length before it is counted. Needs doc_id
    and text. A null text has no runs, a null doc_id reads `null`; repeated rows count again.
    """
    # a shorter run is too short with or without a lost letter
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"([a-z\\u00C0-\\u00FF]{{{length},}})"), F.lit(1))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    lost = F.concat(_start("run", place), F.substring("run", place + 2, F.length("run")))
    words = run.select(F.when(h % every == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def op11(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(counted_words(load(spark, sf_dir, "documents")))
