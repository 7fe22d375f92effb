"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

A token budget runs down a tree of domain, language and source. Each node shares its budget among its children by weight; a child
that cannot use its share keeps what it can, and the rest goes to its siblings by weight. A node is given no more than its
leaves can supply, so a shortage reaches the siblings of an ancestor only when all nodes below the ancestor are used up.
A leaf's budget is whole seeded epochs of its documents and a token-prefix of one more epoch, in the order of a seeded hash.

The prefix of a leaf of any size is found from sums of hash ranges and one range's rows; all that reaches the last pass over
the documents is one row per leaf, which is broadcast only while their number is within a fixed bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, checkpointed, if_few, load

LEVELS = ("domain", "language", "origin")
BIG = "decimal(38,0)"
#: Target weights of the registered queries; a name that is not listed has weight 1.
WEIGHTS = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 6, "de": 2, "fr": 1, "es": 1}, {"src0": 3})


def tokens_of(text: Column) -> Column:
    """Number of words; a null or blank text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]++$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo four, or none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("d"), (F.when(number != "", number).cast("long") % 4).cast("string")))


def _keyed(docs: DataFrame) -> DataFrame:
    """The row, its leaf, its id for the seeded order, and its tokens."""
    leaf = [domain_of(F.col("source").cast("string")).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("language"), F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("origin")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("id")
    return docs.select(F.struct("*").alias("row"), *leaf, name, tokens_of(F.col("text")).alias("tokens"))


def _weight(level: int, weights) -> Column:
    named = weights[level]
    if not named:
        return F.lit(1).cast("long")
    table = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    return F.coalesce(F.element_at(table, F.col(LEVELS[level])), F.lit(1)).cast("long")


def allocate(leaves: DataFrame, weights, percent: int, epochs: int) -> DataFrame:
    """Adds `quota` tokens to leaves of (domain, language, origin, avail)."""
    nodes = leaves.select(*LEVELS, "avail", *(_weight(i, weights).alias(f"w{i}") for i in range(3)))
    usable = reduce(lambda a, b: a & b, (F.col(f"w{i}") > 0 for i in range(3)))
    nodes = nodes.withColumn("cap2", F.when(usable, F.col("avail") * epochs).otherwise(0))
    for i in (1, 0):
        nodes = nodes.withColumn(f"cap{i}", F.sum("cap2").over(Window.partitionBy(*LEVELS[: i + 1])))
    total = nodes.agg(F.sum("avail").alias("all"), F.sum("cap2").alias("most")).select(F.least(F.expr(f"all * {percent} div 100"), "most").alias("root"))
    budgets = nodes.crossJoin(F.broadcast(total)).withColumnRenamed("root", "quota")
    for i in range(3):
        budgets = _share(budgets, i)
    return budgets.select(*LEVELS, "avail", "quota")


def _share(rows: DataFrame, i: int) -> DataFrame:
    """`quota` of the parents becomes `quota` of the nodes of level i."""
    up = [*LEVELS[:i]]
    node = LEVELS[i]
    children = rows.groupBy(*up, node).agg(F.first(f"cap{i}").cast(BIG).alias("cap"), F.first(f"w{i}").cast(BIG).alias("w"), F.first("quota").cast(BIG).alias("b"))
    # the children that can take least for their weight come first; they fill up first
    family = Window.partitionBy(*(up or [F.lit(0)]))
    turn = family.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf"))), node)
    past = turn.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(BIG)
    left = lambda c, t: (t - F.coalesce(F.sum(c).over(past), zero)).cast(BIG)
    children = children.withColumn("rb", left("cap", F.col("b"))).withColumn("rw", left("w", F.sum("w").over(family)))
    children = children.withColumn("full", (F.col("cap") * F.col("rw")).cast(BIG) <= (F.col("rb") * F.col("w")).cast(BIG))
    open_w = F.when(F.col("full"), zero).otherwise(F.col("w"))
    children = children.withColumn("ob", (F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(family)).cast(BIG))
    children = children.withColumn("ow", F.sum(open_w).over(family).cast(BIG)).withColumn("cw", F.sum(open_w).over(turn.rowsBetween(Window.unboundedPreceding, 0)).cast(BIG))
    portion = "IF(full, CAST(cap AS bigint), IF(ow = 0 OR w = 0, 0L, ob * cw div ow - ob * (cw - w) div ow))"
    shared = children.select(*up, node, F.expr(portion).alias("quota"))
    return rows.drop("quota").join(shared, [*up, node])


def plan(keyed: DataFrame, weights=WEIGHTS, percent: int = 60, epochs: int = 2, seed: int = 17) -> DataFrame:
    """One row per leaf: quota, whole epochs, the tokens left for a prefix, and the last hash of that prefix (or null)."""
    narrow = checkpointed(keyed.select(*LEVELS, "id", "tokens"))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("avail"))
    quotas = allocate(leaves, weights, percent, epochs)
    quotas = checkpointed(quotas.select(*LEVELS, "avail", "quota", F.expr("IF(avail = 0, 0L, quota div avail)").alias("whole"), F.expr("IF(avail = 0, 0L, quota % avail)").alias("rest")))
    partial = narrow.join(if_few(quotas.where("rest > 0")), [*LEVELS]).withColumn("u", _order(seed)).withColumn("range", F.substring("u", 1, 3))
    ranges = partial.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("some"))
    run = Window.partitionBy(*LEVELS).orderBy("range")
    ranges = ranges.withColumn("to", F.sum("some").over(run)).withColumn("before", F.col("to") - F.col("some"))
    edge = ranges.where("to > rest AND before <= rest").select(*LEVELS, "range", "before")
    inside = partial.join(edge, [*LEVELS, "range"])
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("u").rangeBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("fits", upto + F.col("before") <= F.col("rest"))
    cut = inside.groupBy(*LEVELS).agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("u"))), F.first("range")).alias("cut"))
    return checkpointed(quotas.join(cut, [*LEVELS], "left"))


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "id"))


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = 60, epochs: int = 2, seed: int = 17) -> DataFrame:
    """(row, domain, language, origin, tokens, epoch): the documents of the mixture, a document once for each epoch it is in.

    `percent` of all tokens is the budget, `epochs` the most times a leaf is used, `weights` a mapping of names to whole weights
    for each level. Needs doc_id, text, lang and source. Null languages and sources are leaves named none. A document without an
    id is ordered by its text, rows of one id are taken together, repeated rows each count. Documents without tokens are in an epoch
    with the rest of their leaf; a leaf without any tokens gives none. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    chosen = keyed.join(if_few(plan(keyed, weights, percent, epochs, seed)), [*LEVELS])
    copies = F.col("whole") + F.coalesce((_order(seed) <= F.col("cut")).cast("long"), F.lit(0).cast("long"))
    picked = chosen.withColumn("copies", copies).where("copies > 0")
    return picked.select("row", *LEVELS, "tokens", F.explode(F.expr("sequence(0L, copies - 1L)")).alias("epoch"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture with their own columns, whatever they are called."""
    return mix(docs, **how).select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("row.doc_id", *LEVELS, "tokens", "epoch")


def _level_sql(name: str, keys: str, up: str, rows: str) -> str:
    """CTEs that share `budget` of the rows' parents among the nodes `keys`, by weights `w` and capacities `cap`."""
    part = f"PARTITION BY {up}" if up else ""
    return f"""
{name}_a AS (SELECT *, CASE WHEN w > 0 THEN cap / CAST(w AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS r FROM {rows}),
{name}_b AS (SELECT *, budget - coalesce(sum(cap) OVER ({part} ORDER BY r, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb,
    sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY r, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rw FROM {name}_a),
{name}_c AS (SELECT *, CAST(cap AS HUGEINT) * rw <= CAST(rb AS HUGEINT) * w AS is_full FROM {name}_b),
{name}_d AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({part}), 0) AS ob, coalesce(sum(w) FILTER (WHERE NOT is_full) OVER ({part}), 0) AS ow,
    coalesce(sum(w) FILTER (WHERE NOT is_full) OVER ({part} ORDER BY r, node), 0) AS cw FROM {name}_c),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN cap WHEN ow = 0 OR w = 0 THEN 0 ELSE ob * cw // ow - ob * (cw - w) // ow END AS quota FROM {name}_d)"""


OP8_SQL = rf"""
WITH base AS (SELECT doc_id, text, coalesce(source, 'none') AS origin, coalesce(lang, 'none') AS language, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS id,
    regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS num, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
keyed AS (SELECT doc_id, origin, language, id, CAST(tokens AS BIGINT) AS tokens, CASE WHEN num = '' THEN 'none' ELSE 'd' || (CAST(num AS BIGINT) % 4) END AS domain FROM base),
leaves AS (SELECT domain, language, origin, CAST(sum(tokens) AS HUGEINT) AS avail, CAST(2 * sum(tokens) AS HUGEINT) AS cap FROM keyed GROUP BY ALL),
roots AS (SELECT domain, domain AS node, sum(cap) AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w,
    (SELECT least(sum(avail) * 60 // 100, sum(cap)) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_level_sql("q0", "domain", "", "roots").lstrip()},
langs AS (SELECT domain, language, language AS node, sum(cap) AS cap, CASE language WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END AS w, any_value(quota) AS budget
    FROM leaves JOIN q0 USING (domain) GROUP BY domain, language),
{_level_sql("q1", "domain, language", "domain", "langs").lstrip()},
ends AS (SELECT domain, language, origin, origin AS node, avail, cap, CASE origin WHEN 'src0' THEN 3 ELSE 1 END AS w, quota AS budget FROM leaves JOIN q1 USING (domain, language)),
{_level_sql("q2", "domain, language, origin, avail", "domain, language", "ends").lstrip()},
quotas AS (SELECT domain, language, origin, CASE WHEN avail = 0 THEN 0 ELSE quota // avail END AS whole, CASE WHEN avail = 0 THEN 0 ELSE quota % avail END AS rest FROM q2),
ordered AS (SELECT *, md5('17:' || whole || ':' || id) AS u FROM keyed JOIN quotas USING (domain, language, origin)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered),
picked AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM summed)
SELECT doc_id, domain, language, origin, tokens, CAST(unnest(range(CAST(copies AS BIGINT))) AS BIGINT) AS epoch FROM picked WHERE copies > 0
"""
