"""Quality rules by tokeniser fertility: what public vocabularies make of a text.

Each text is measured in one pass where it is read: counts of the base rules, and for a vocabulary of sentence pieces and a byte-level
one characters per token, the share of tokens that stand for a raw byte, and the entropy of the tokens. Texts of one language (or
script, where no language is given) and of one length class are alike in these, so a text far from the median of its class, in median
absolute deviations over all documents, is rejected. Deviations are weighed less above the median than below: foreign passages in
sound prose raise the entropy, while repetition, capitals, symbols and tables lower it.

Every class has a band. A class's median and deviation are averaged with those of the wider class (all lengths of the language, and
for that all documents), which counts as `WEIGHT` documents: what is known of a small class grows with each document, and no
number of documents switches a rule on.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.alignment import byte_level, stretches
from tideline.llm.common import checkpointed, if_few, load, text_key, vocabulary
from tideline.llm.wordcache import Cache, ids_of

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@lru_cache(maxsize=2)
def piece_cache(path: str) -> tuple[Cache, np.ndarray]:
    """Words to their ids as 32-bit bytes, and for each id whether it stands for a raw byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    raw = np.array([model.is_byte(i) for i in range(model.vocab_size())])
    encode = model.encode
    return Cache(lambda word: array("I", encode(word.decode())).tobytes(), 300_000), raw


@lru_cache(maxsize=2)
def byte_tokens(path: str):
    """The encoder of a byte-level vocabulary, and for each id whether it stands for a part of a character."""
    side = byte_level(path)

    def part(token: bytes) -> bool:
        try:
            return not token.decode()
        except UnicodeDecodeError:
            return True

    return side.encode, np.array([part(t) for t in side.tokens])


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    seen, dup = set(), 0
    lines = text.split("\n")
    if len(lines) > 1:
        for line in lines:
            if line.strip(SPACES):
                dup += line in seen
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated


def _summed(counts: np.ndarray, raw: np.ndarray) -> tuple[int, int, float]:
    n = int(counts.sum())
    if not n:
        return 0, 0, 0.0
    some = counts[counts > 0]
    return n, int(counts[raw].sum()), float(np.log2(n) - (some * np.log2(some)).sum() / n)


def fertility(text: str, path: str) -> tuple[int, int, float]:
    """n_tokens, n_raw (tokens that stand for a byte), entropy of the tokens in bits, of the pieces of a text."""
    cache, raw = piece_cache(path)
    counts = np.zeros(len(raw), np.int64)
    for data in ids_of(text, cache):
        counts += np.bincount(np.frombuffer(data, np.uint32), minlength=len(raw))
    return _summed(counts, raw)


def byte_fertility(text: str, path: str) -> tuple[int, int, float]:
    """The same of the byte-level tokens of a text, with a space before it."""
    encode, raw = byte_tokens(path)
    counts = np.zeros(len(raw), np.int64)
    for part in stretches(" " + text) if text else ():
        counts += np.bincount(encode(part), minlength=len(raw))
    return _summed(counts, raw)


def script(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names."""
    (found,) = Counter(x for x in text if x.isalpha()).most_common(1) or [("", 0)]
    return unicodedata.name(found[0], "NONE").split()[0] if found[0] else "NONE"


#: Measure -> deviations below and above the median that are let pass, and the least deviation counted as one.
BANDS = {
    "chars_per_token": (6.0, 18.0, 0.02), "raw_share": (1e9, 6.0, 0.02), "entropy": (4.5, 13.5, 0.02),
    "byte_chars_per_token": (6.0, 18.0, 0.02), "byte_raw_share": (1e9, 6.0, 0.02), "byte_entropy": (4.5, 13.5, 0.02),
}
#: Documents that a wider class counts as in the band of a class.
WEIGHT = 5.0
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, " + ", ".join(f"{m} double" for m in BANDS) + ", class string"


def _measured(path: str, byte_path: str):
    def run(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = []
        for x, given in zip(text, lang, strict=True):
            x = x or ""
            base = base_counts(x)
            (n, raw, entropy), (m, part, spread) = fertility(x, path), byte_fertility(x, byte_path)
            rows.append((*base, n, m, base[1] / max(n, 1), raw / max(n, 1), entropy, base[1] / max(m, 1), part / max(m, 1), spread, given or "script " + script(x)))
        names = [m.split()[0] for m in MEASURES.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "int64" for c in names[:7]} | {c: "float64" for c in BANDS})

    return F.pandas_udf(run, MEASURES)


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def _row_key(docs: DataFrame) -> Column:
    """Identity of id, text and language."""
    return F.md5(F.concat(text_key(F.col("doc_id"), F.col("text")), F.coalesce(_lang(docs), F.lit(""))))


def measures(docs: DataFrame, path: str | None = None, byte_path: str | None = None) -> DataFrame:
    """doc_id, key (identity of id, text and language), the measures and base_failed of every row."""
    lang, key = _lang(docs), _row_key(docs)
    m = _measured(path or vocabulary("piece_bpe_32k.model"), byte_path or vocabulary("byte_bpe_50k.json"))(F.col("text"), lang)
    found = docs.select("doc_id", key.alias("key"), m.alias("m")).select("doc_id", "key", "m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("*", failed.alias("base_failed"), F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).alias("size_class"))


def bands(found: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(class, size_class, low_*, high_*) over all rows that pass the base rules; size_class -1 holds for all lengths of a class, and class
    null for all documents.

    A class's median and deviation are averaged with the wider class's, which weighs as `weight` documents. A language's deviation counts
    its distance from all documents besides, as languages differ in kind.
    """
    sound = found.where(~F.col("base_failed"))
    level = lambda c, s: F.struct(c.cast("string").alias("class"), s.cast("long").alias("size_class"))
    levels = F.array(level(F.col("class"), F.col("size_class")), level(F.col("class"), F.lit(-1)), level(F.lit(None), F.lit(-1)))
    sound = sound.select(F.explode(levels).alias("level"), *BANDS).select("level.*", *BANDS)
    by = ["class", "size_class"]
    same = lambda a, b: F.expr(f"{a}.class <=> {b}.class AND {a}.size_class = {b}.size_class")
    middle = sound.groupBy(*by).agg(*(F.percentile_approx(m, 0.5, 10000).alias(f"mid_{m}") for m in BANDS))
    apart = sound.alias("a").join(if_few(checkpointed(middle)).alias("b"), same("a", "b"))
    spread = apart.groupBy("a.class", "a.size_class").agg(
        F.count("*").alias("n"), *(F.first(f"mid_{m}").alias(f"mid_{m}") for m in BANDS), *(F.percentile_approx(F.abs(F.col(m) - F.col(f"mid_{m}")), 0.5, 10000).alias(f"dev_{m}") for m in BANDS)
    )
    spread = checkpointed(spread)
    every = spread.where("class IS NULL")
    mixed = lambda x, wider: (F.col("n") * x + weight * wider) / (F.col("n") + weight)

    def blend(rows: DataFrame, wider: DataFrame, on, gap: bool) -> DataFrame:
        """Averages of the statistics with those of the wider class."""
        names = [f"{s}_{m}" for m in BANDS for s in ("mid", "dev")]
        w = wider.select(F.col("class").alias("wider_class"), F.struct(*names).alias("wide"))
        out = []
        for m in BANDS:
            mid, dev, far = F.col(f"mid_{m}"), F.col(f"wide.dev_{m}"), F.col(f"wide.mid_{m}")
            out += [mixed(mid, far).alias(f"mid_{m}"), mixed(F.col(f"dev_{m}"), dev + F.abs(mid - far) if gap else dev).alias(f"dev_{m}")]
        return rows.join(if_few(w), on).select(*by, "n", *out)

    # one row for all documents
    languages = blend(spread.where("class IS NOT NULL AND size_class = -1"), every, F.lit(True), True)
    languages = checkpointed(languages)
    lengths = blend(spread.where("class IS NOT NULL AND size_class >= 0"), languages, F.col("class") == F.col("wider_class"), False)
    edges = []
    for m, (below, above, floor) in BANDS.items():
        one = F.greatest(F.col(f"dev_{m}"), F.lit(floor))
        edges += [(F.col(f"mid_{m}") - below * one).alias(f"low_{m}"), (F.col(f"mid_{m}") + above * one).alias(f"high_{m}")]
    return lengths.unionByName(languages).unionByName(every.select(*lengths.columns)).select(*by, *edges)


def judge(docs: DataFrame, path: str | None = None, byte_path: str | None = None, weight: float = WEIGHT) -> DataFrame:
    """The measures of every row, base_failed and kept; a text is kept when it passes the base rules and lies in the bands of its
    language and length class.

    Needs doc_id and text, and lang if there is one; other columns are not read. A null text has no words and fails; a null or
    missing language is replaced by the text's main script. Repeated rows stay. An empty table gives no rows. The words and lines of one
    text are held at a time.
    """
    found = checkpointed(measures(docs, path, byte_path))
    # every row that passes the base rules is in a class of its own band
    edges = checkpointed(bands(found, weight)).where("size_class >= 0")
    names = [f"{side}_{m}" for m in BANDS for side in ("low", "high")]
    both = found.join(if_few(edges.select("class", "size_class", F.struct(*names).alias("band"))), ["class", "size_class"], "left")
    inside = F.lit(True)
    for m in BANDS:
        inside &= F.col(m).between(F.col(f"band.low_{m}"), F.col(f"band.high_{m}"))
    return both.select(*found.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, whatever they are called."""
    kept = judge(docs).where("kept").select("key").distinct()
    packed = docs.select(F.struct("*").alias("row"), _row_key(docs).alias("key"))
    return packed.join(kept, "key", "left_semi").select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).drop("key", "size_class")
