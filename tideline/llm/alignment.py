"""Alignment of the tokens of two vocabularies by white-space anchors.

Both vocabularies encode the whole text, word by word where neither joins over a single space, so a word that was met before is not encoded
again. Where a token of each ends at one byte and the next token of each begins with a space, the text is cut into windows of token ids.
Windows are short and repeat, so their alignments are remembered by their two tuples of ids: the groups between shared ends, and the pairs of
tokens whose bytes overlap.

How often two ids are linked is counted over all documents. Each document's links then meet the counts: pairs that hold more than
one in `FEW` of the rows are at most `FEW` and are broadcast, all others are joined by a shuffle, in which no pair is frequent.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import FEW, checkpointed, load, stored, vocabulary

#: White space by Unicode, as the byte-level vocabulary's rules see it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Places where both vocabularies may be cut: a single space between other characters, before which neither joins.
CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Code points of a text that are held as tokens at a time, and documents that are aligned together.
STRETCH, TOGETHER = 1 << 18, 128
#: Windows that a task remembers, and the most code points of a word whose windows are remembered.
REMEMBERED, LARGEST = 300_000, 512
#: The most code points of a word that is remembered as one window.
WORD = 64
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


#: Stands between the ids of the two vocabularies in the key of a window.
BETWEEN = 0xFFFFFFFF


class Side:
    """A vocabulary: the bytes of its tokens, which of them begin with a space, and the ids of a text that begins with a space."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.size_of = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.comma = np.array([f"{i}," for i in range(len(tokens))], object)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encode(text), np.uint32)

    def spelt(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_level(path: str, pattern: str | None = None) -> Side:
    """A byte-level vocabulary from its ranks; a file `x.json` stands beside its ranks, `x.tiktoken`. No token is special."""
    import public_tokenizers
    import tiktoken

    with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Side(tokens, coder.encode_ordinary)


def pieces(path: str) -> Side:
    """A vocabulary of sentence pieces; the library adds the space with which a text begins."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    spell = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    tokens = [spell(i) for i in range(model.vocab_size())]
    if any(b" " in t.lstrip(b" ") for t in tokens):
        raise ValueError(f"{path}: long texts cannot be cut before a space, as pieces have spaces after other characters")
    return Side(tokens, lambda text: model.encode(text[1:]))


class Windows:
    """Alignments of windows, remembered by the ids of both vocabularies: number of groups, their text, the bytes, and the pairs of tokens that
    overlap. A key holds the two tuples of ids as unsigned 32-bit bytes with BETWEEN between them. A word that follows a single space is one
    window under its own name, with the number -1 where its tokens do not spell it."""

    def __init__(self, left: Side, right: Side):
        self.left, self.right = left, right
        self.bar, self.semicolon = (np.array([x[:-1] + end for x in side.comma], object) for side, end in ((left, "|"), (right, ";")))
        self.forget()

    def forget(self):
        self.number: dict[bytes | str, int] = {}
        self.shown: list[str] = []
        self.spelt: list[bytes | None] = []
        self.groups = self.first = self.pairs = self.sizes = self.n_a = self.n_b = np.zeros(0, np.int64)

    def meet(self, words: set[str]) -> dict[str, list[int] | None]:
        """Remember the words, and give the numbers of the windows of those that are too long or odd for that; none where one is not spelt. New words
        are encoded as one text, in which neither vocabulary joins them either."""
        new = words.difference(self.number)
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = words
        plain = [w for w in new if 0 < len(w) <= WORD and not w[0].isspace() and not w[-1].isspace() and "\u2581" not in w]
        if plain:
            text = " " + " ".join(plain)
            a, b, ends = self.left.ids(text), self.right.ids(text), np.cumsum([1 + len(w.encode()) for w in plain])
            ends_a, ends_b = np.cumsum(self.left.size_of[a]), np.cumsum(self.right.size_of[b])
            at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
            if (np.take(ends_a, at_a, mode="clip") == ends).all() and (np.take(ends_b, at_b, mode="clip") == ends).all():
                start = len(self.shown)
                self.learn(keys_between(a, b, at_a + 1, at_b + 1), plain)
                self.number.update((w, -1) for w, spelt in zip(plain, self.spelt[start:], strict=True) if spelt != b" " + w.encode())
        odd = {w: windows(self.left.ids(" " + w), self.right.ids(" " + w), self.left, self.right) for w in new if w not in self.number}
        unknown = list(set().union(*filter(None, odd.values())).difference(self.number))
        if unknown:
            self.learn(unknown, unknown)
        found = {w: keys and list(map(self.number.__getitem__, keys)) for w, keys in odd.items()}
        spelt = lambda w: found[w] and None not in (parts := [self.spelt[i] for i in found[w]]) and b"".join(parts) == b" " + w.encode()
        return {w: found[w] if spelt(w) else None for w in found}

    def learn(self, keys: list[bytes], names: list) -> None:
        """Align windows that are not known yet, all at once, and remember them by these names: one after the other they are two texts of tokens with equal sizes."""
        ids = np.frombuffer(b"".join(keys), np.uint32)
        ends = np.cumsum([len(k) // 4 for k in keys])
        between = np.flatnonzero(ids == BETWEEN)
        # ids after a window's BETWEEN belong to the second vocabulary
        change = np.zeros(len(ids) + 1, np.int8)
        change[between], change[ends] = 1, -1
        second = np.cumsum(change[:-1]) > 0
        a, b = ids[~second], np.delete(ids, between)[np.delete(second, between)]
        n_a = between - np.concatenate([[0], ends[:-1]])
        last_a, last_b = np.cumsum(n_a), np.cumsum(ends - between - 1)
        ends_a, ends_b = np.cumsum(self.left.size_of[a]), np.cumsum(self.right.size_of[b])
        # each stretch between neighbouring ends of either lies in one token of each: these are the links
        cuts = np.union1d(ends_a, ends_b)
        i, j = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        pairs = a[i].astype(np.int64) << 32 | b[j].astype(np.int64)
        shared = np.flatnonzero((ends_a[i] == cuts) & (ends_b[j] == cuts))
        windows_end = ends_a[last_a - 1]
        of_link, of_group = np.searchsorted(cuts, windows_end) + 1, np.searchsorted(cuts[shared], windows_end) + 1
        # each group's ids of the first vocabulary, then those of the second, each with what follows it
        to_a, to_b = i[shared] + 1, j[shared] + 1
        shown_a, shown_b = self.left.comma[a], self.right.comma[b]
        shown_a[to_a - 1], shown_b[to_b - 1] = self.bar[a[to_a - 1]], self.semicolon[b[to_b - 1]]
        flat = np.empty(len(a) + len(b), object)
        flat[np.arange(len(a)) + np.repeat(np.concatenate([[0], to_b[:-1]]), np.diff(to_a, prepend=0))] = shown_a
        flat[np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = shown_b
        flat, borders = flat.tolist(), (last_a + last_b).tolist()
        self.number.update(zip(names, range(len(self.shown), len(self.shown) + len(keys)), strict=True))
        self.shown += ["".join(flat[p:q]) for p, q in zip([0, *borders], borders, strict=False)]
        one, two, at = self.left.spelt(a.tolist()), self.right.spelt(b.tolist()), windows_end.tolist()
        same = one == two
        self.spelt += [one[p:q] if same or one[p:q] == two[p:q] else None for p, q in zip([0, *at], at, strict=False)]
        self.groups = np.concatenate([self.groups, np.diff(of_group, prepend=0)])
        self.first = np.concatenate([self.first, len(self.pairs) + np.concatenate([[0], of_link[:-1]])])
        self.sizes = np.concatenate([self.sizes, np.diff(of_link, prepend=0)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, ends - between - 1])

    def links(self, numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some windows, each met so many times, and how often each pair is linked."""
        sizes = self.sizes[numbers]
        places = np.arange(sizes.sum()) + np.repeat(self.first[numbers] - np.cumsum(sizes) + sizes, sizes)
        return added(self.pairs[places], np.repeat(times, sizes))


def added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(pairs, return_inverse=True)
    return found, np.bincount(place, times, len(found)).astype(np.int64)


@lru_cache(maxsize=2)
def remembered(path_a: str, path_b: str) -> Windows:
    return Windows(byte_level(path_a), pieces(path_b))


def stretches(text: str) -> Iterator[str]:
    """A text that begins with a space in parts of about STRETCH code points that do too, cut where neither vocabulary joins."""
    at = 0
    while len(text) - at > STRETCH and (cut := CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def windows(a: np.ndarray, b: np.ndarray, left: Side, right: Side) -> list[bytes] | None:
    """The key of each window of the tokens of one text; none where the tokens of the two have not as many bytes."""
    size_b = right.size_of[b]
    ends_a, ends_b = np.cumsum(left.size_of[a]), np.cumsum(size_b)
    if not len(a) or not len(b) or ends_a[-1] != ends_b[-1]:
        return None
    begins = np.zeros(ends_b[-1] + 1, bool)
    begins[(ends_b - size_b)[right.spaced[b]]] = True
    # a token of each begins with a space at this byte, so one of each ends before it
    last = np.flatnonzero(left.spaced[a[1:]] & begins[ends_a[:-1]])
    to_a = np.append(last + 1, len(a))
    to_b = np.append(np.searchsorted(ends_b, ends_a[last]) + 1, len(b))
    return keys_between(a, b, to_a, to_b)


def keys_between(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[bytes]:
    """The keys of windows that end at these numbers of tokens."""
    keys = np.full(len(a) + len(b) + len(to_a), BETWEEN, np.uint32)
    order = np.arange(len(to_a))
    keys[np.arange(len(a)) + np.repeat(np.concatenate([[0], to_b[:-1]]) + order, np.diff(to_a, prepend=0))] = a
    keys[np.arange(len(b)) + np.repeat(to_a + order + 1, np.diff(to_b, prepend=0))] = b
    data, at = keys.tobytes(), (4 * (to_a + to_b + order + 1)).tolist()
    return [data[p:q] for p, q in zip([0, *at], at, strict=False)]


class Alignment:
    """What is gathered of one document, stretch by stretch."""

    def __init__(self, keep: bool):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.keep, self.kept, self.spelt = hashlib.sha256(), keep, [], True
        self.pairs = self.times = np.zeros(0, np.int64)

    def add(self, words: list[str], odd: dict[str, list[int] | None], known: Windows) -> None:
        if odd.keys().isdisjoint(words):
            numbers = list(map(known.number.__getitem__, words))
        elif any(odd.get(w, ()) is None for w in words):
            numbers = [-1]
        else:
            numbers = list(chain.from_iterable(odd[w] if w in odd else (known.number[w],) for w in words))
        distinct, times = np.unique(np.array(numbers), return_counts=True)
        if distinct[0] < 0:
            self.spelt = False
            return
        shown = "".join(map(known.shown.__getitem__, numbers))[:-1]
        self.digest.update((";" * (self.n_a > 0) + shown).encode())
        self.kept += [shown] * self.keep
        pairs, times_of = known.links(distinct, times)
        self.n_a, self.n_b = self.n_a + int(known.n_a[distinct] @ times), self.n_b + int(known.n_b[distinct] @ times)
        self.n_groups += int(known.groups[distinct] @ times)
        self.n_links += int(times_of.sum())
        self.pairs, self.times = added(np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times_of])) if len(self.pairs) else (pairs, times_of)

    def row(self) -> tuple:
        if not self.n_a or not self.spelt:
            return 0, 0, 0, 0, "", self.pairs[:0], self.times[:0], *[""] * self.keep
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(), self.pairs, self.times, *[";".join(self.kept)] * self.keep


def aligned(texts: list[str | None], known: Windows, keep: bool = False) -> list[tuple]:
    """For each text n_a, n_b, n_groups, n_links, the digest of the groups, the pairs, how often each is linked, and with `keep` the groups."""
    found, waiting, held = [Alignment(keep) for _ in texts], [], 0

    def settle():
        odd = known.meet(set().union(*(words for _, words in waiting)))
        for one, words in waiting:
            one.add(words, odd, known)
        if any(len(w) > LARGEST for w in odd):
            known.forget()
        waiting.clear()

    for one, text in zip(found, texts, strict=True):
        for part in stretches(" " + text) if text else ():
            waiting.append((one, CUT.split(part[1:])))
            held += len(part) // 4
            if held > STRETCH:
                settle()
                held = 0
    settle()
    return [one.row() for one in found]


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * 2**32 + b) and times (links of each) of each row; with `keep_groups` also
    `groups`, as `a1,a2|b1;a3|b2`.

    Needs doc_id and text; other columns are not read. Texts that are null, empty or not spelt by the tokens have zeros and empty
    values. Null ids and repeated rows stay. Of a very long text a stretch of tokens is held at a time, and its distinct pairs; a
    text without a single space between other characters is one stretch. An empty table gives no rows.
    """
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["groups"] * keep_groups

    def run(batches):
        known = remembered(path_a, path_b)
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                rows = [(d, *row) for d, row in zip(part.doc_id, aligned(part.text.tolist(), known, keep_groups), strict=True)]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"} | {c: "int64" for c in names[1:5]})

    return docs.select("doc_id", "text").mapInPandas(run, COLUMNS + ", groups string" * keep_groups)


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best, docs) of links (pair, times): n is how many links hold the pair, best whether no pair of its second id has more."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("docs")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = checkpointed(counts)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "docs")


def count_links(found: DataFrame) -> DataFrame:
    """Adds n_best (links whose pair is, over all rows, a most frequent one of its second id) and count_sum (the pairs' counts, added over
    links) to rows with arrays `pairs` and `times`, which are dropped."""
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = checkpointed(link_counts(links))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    # each of these pairs is in more than one of FEW rows, so there are fewer than FEW of them
    often = F.broadcast(counts.where(F.col("docs") > total / FEW).drop("docs"))
    rare = counts.where(F.col("docs") <= total / FEW).drop("docs")
    added = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    parts = links.join(often, "pair").groupBy("row").agg(*added).union(links.join(often, "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*added))
    sums = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("pairs", "times").join(sums, "row", "left").select(*(c for c in found.columns if c not in ("pairs", "times", "row")), zero("n_best"), zero("count_sum"))


def op13(spark, sf_dir: str) -> DataFrame:
    return count_links(align_documents(load(spark, sf_dir, "documents")))
