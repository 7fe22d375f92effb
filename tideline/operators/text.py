"""Lexicon sentiment over document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the word lists
POSITIVE = (
    "beat beats surge surges surged rally rallies rallied record strong stronger strength growth growing upgrade upgraded upgrades raise "
    "raises raised jump jumps jumped gain gains gained outperform outperforms outperformed bullish buy profit profits profitability expand "
    "expands expanding exceed exceeds exceeded accelerate accelerating momentum optimistic recovery recovers opportunity breakout "
    "breakthrough innovate innovation dominant leader leading impressive soar soars soared skyrocket positive boost boosts boosted demand"
).split()
NEGATIVE = (
    "miss misses missed drop drops dropped decline declines declined fall falls fell plunge plunges plunged crash crashes crashed downgrade "
    "downgraded downgrades cut cuts cutting weak weaker weakness lawsuit lawsuits investigation probe fraud scandal layoff layoffs recession "
    "recessions warning warns warned bearish sell selling slump slumps slumped loss losses losing underperform underperforms risk risks "
    "volatility uncertainty headwind headwinds shrink shrinking delay delays delayed recall recalls guilty criminal fine penalty debt "
    "bankruptcy insolvent trouble struggle struggles struggling disappoint disappointing negative concern concerns"
).split()
WORD = r"\\b[a-z''-]+\\b"


def _words(ws) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in ws) + ")"


def hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """Positive and negative word counts per document.

    The whole text is tokenised and counted inside the row; the word lists are literals, so there is
    no join, no explode and no shuffle whatever the length of one document. Letters and digits of any script, with
    their combining marks, belong to a word: ``sell`` in ``sellóta`` is none.
    """
    # engines and Java versions differ in which of these end a word, so those beyond ASCII become an underscore
    whole = rf"regexp_replace(lower({text}), '([\\p{{L}}\\p{{Nd}}])\\p{{Mn}}+', '$1_')"
    whole = rf"regexp_replace({whole}, '[^\\P{{L}}\\x00-\\x7F]|[^\\P{{Nd}}\\x00-\\x7F]', '_')"
    tok = rf"regexp_extract_all({whole}, '\\b[a-z\'-]+\\b', 0)"
    d = docs.selectExpr("*", f"{tok} AS _tok")
    return d.selectExpr(
        "*", f"size(filter(_tok, w -> array_contains({_words(POSITIVE)}, w))) AS pos", f"size(filter(_tok, w -> array_contains({_words(NEGATIVE)}, w))) AS neg"
    ).drop("_tok")


def band(pos: str, neg: str) -> str:
    """(pos - neg) / (pos + neg) with a neutral band of 0.15; zero without hits."""
    raw = f"({pos} - {neg}) / nullif({pos} + {neg}, 0)"
    return f"CASE WHEN abs({raw}) < 0.15 THEN 0 ELSE coalesce({raw}, 0) END"


def weighted_sentiment(docs: DataFrame, key: str, weight: str) -> DataFrame:
    """Relevance-weighted score per key with a confidence that grows with total relevance."""
    g = hits(docs).groupBy(key).agg(F.expr(f"sum({weight} * pos) AS wp"), F.expr(f"sum({weight} * neg) AS wn"), F.expr(f"sum({weight}) AS rel"), F.expr("count(*) AS n"))
    return g.selectExpr(key, "n", f"{band('wp', 'wn')} AS score", "least(1, rel / 5) AS confidence")
