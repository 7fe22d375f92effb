"""Line dedup by a log-template tree, in DataFrame operations only.

A line is parsed at a fixed depth: its number of tokens, then its leading tokens, tokens with a digit standing for any such
token. Below that, a template may have one variable stretch of up to a fifth of the tokens: a line belongs to one template for
each place of the stretch, so two lines of a template agree in at least 0.8 of their tokens, and any two lines that
differ within one such place share a template. A template that recurs across documents stays in its first document (the one
with the smallest doc_id) and is dropped from all others.

A template's key is a 64-bit hash of the line's tokens before and after the stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import load

#: Tokens that hold a digit.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
LAST = 2**63 - 1


def _even(text: Column) -> Column:
    """The text with single spaces between the tokens of a line; most texts are so already."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd |= F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, "<*>")).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """doc (its id, nulls last), dh (hash of id and text), number, text and token count n of each line."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    base = docs.select(doc, F.xxhash64("doc_id", "text").alias("dh"), F.posexplode(F.split(_even(F.col("text")), "\n")).alias("line", "shown"))
    base = base.withColumn("shown", _masked(F.trim("shown")))
    n = F.octet_length("shown") - F.octet_length(F.replace("shown", F.lit(" "), F.lit(""))) + F.when(F.col("shown") == "", 0).otherwise(1)
    return base.withColumn("n", n)


def templates(docs: DataFrame, lead: int = 2, least: int = 3) -> DataFrame:
    """(doc, dh, line, template): every template of every line."""
    # lines of fewer than five tokens have no variable stretch
    places = F.expr(f"CASE WHEN n < {least} THEN array() WHEN n < 5 OR n <= {lead} THEN array(n) ELSE sequence({lead}, n - 1, greatest(n div 5, 1)) END")
    found = _lines(docs).select("doc", "dh", "line", "shown", "n", F.explode(places).alias("i"))
    before, after = F.expr("substring_index(shown, ' ', i)"), F.expr("substring_index(shown, ' ', least(i + greatest(n div 5, 1) - n, 0))")
    return found.select("doc", "dh", "line", F.xxhash64("i", "n", before, after).alias("template"))


def recurring_lines(docs: DataFrame, lead: int = 2, least: int = 3) -> DataFrame:
    """(doc, dh, dropped): the numbers of the lines to drop, ascending, for each document that has any."""
    found = templates(docs, lead, least)
    first = found.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    late = found.join(first, "template").where(F.col("first") < F.col("doc")).select("doc", "dh", "line")
    return late.groupBy("doc", "dh").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def with_dropped(docs: DataFrame, lead: int = 2, least: int = 3) -> DataFrame:
    """(row, dropped) for every row of `docs`: the whole row as a struct and the numbers of its lines to drop, or null."""
    dropped = recurring_lines(docs, lead, least)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    packed = docs.select(F.struct("*").alias("row"), doc, F.xxhash64("doc_id", "text").alias("dh"))
    return packed.join(dropped, ["doc", "dh"], "left").select("row", "dropped")


def _without(text: str, dropped: str) -> Column:
    kept = f"array_except(sequence(0, size(split({text}, '\\n')) - 1), {dropped})"
    return F.expr(f"IF({dropped} IS NULL, {text}, array_join(transform({kept}, i -> element_at(split({text}, '\\n'), i + 1)), '\\n'))")


def drop_recurring_lines(docs: DataFrame, lead: int = 2, least: int = 3) -> DataFrame:
    """`docs` with the recurring lines taken out of `text`; all other columns stay as they are, whatever they are called.

    Lines of fewer than `least` tokens are no templates. Documents are told apart by doc_id: rows of one id do not drop each
    other's lines, rows with a null id count as one last document. A null text stays null, a text all of whose lines recur
    becomes empty, repeated rows all stay. An empty table gives no rows.
    """
    found = with_dropped(docs, lead, least).withColumn("text", F.col("row.text")).withColumn("text", _without("text", "dropped"))
    return found.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = with_dropped(docs.select("doc_id", "text")).select("row.*", "dropped")
    return found.select(
        "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.greatest(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"), _without("text", "dropped").alias("text"),
    )


OP2_SQL = r"""
WITH docs AS (SELECT coalesce(doc_id, 9223372036854775807) AS doc, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc, text, unnest(range(len(ls))) AS line, unnest(ls) AS shown FROM docs),
toks AS (SELECT doc, text, line, list_transform(string_split_regex(regexp_replace(shown, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+'),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM lines),
sized AS (SELECT *, len(t) AS n, len(t) // 5 AS w FROM toks WHERE len(t) >= 3),
keys AS (SELECT doc, text, line, unnest(CASE WHEN w = 0 OR n <= 2 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(2, n, w), lambda i: i || '|' || n || '|' || array_to_string(t[1:i], ' ') || ' * ' || array_to_string(t[i + w + 1:n], ' ')) END) AS k FROM sized),
firsts AS (SELECT k, min(doc) AS f FROM keys GROUP BY k HAVING min(doc) < max(doc)),
late AS (SELECT DISTINCT doc, text, line FROM keys JOIN firsts USING (k) WHERE f < doc),
drops AS (SELECT doc, text, list_sort(list(line)) AS d FROM late GROUP BY doc, text)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(d), 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(d, ','), '') AS dropped,
    CASE WHEN d IS NULL THEN docs.text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(d, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text
FROM docs LEFT JOIN drops ON docs.doc = drops.doc AND docs.text = drops.text
"""
