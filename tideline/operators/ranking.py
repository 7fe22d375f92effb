"""Exact ranks and quantiles of groups that do not fit one task.

Equal values are counted first (map-side combined), so a value that covers a third of the rows is
one row afterwards. Distinct values are cut into value buckets by approximate quantile edges; the
edges only balance the work, the result is exact because bucket counts are added up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import panel as P

LEAST_BUCKETS = 64


def _buckets(df: DataFrame) -> int:
    """As many value buckets as the session deals shuffles into, which follows the data's size."""
    return max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(x: str, buckets: int) -> Column:
    cuts = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    return F.expr(f"approx_percentile({x}, array({cuts}), {20 * buckets})")


def value_ranks(df: DataFrame, group: list[str], x: str, buckets: int | None = None) -> DataFrame:
    """Per (group, value): ``eq`` rows with the value, ``lt`` rows below it, ``n`` rows in the group.

    Ungrouped edges and bucket totals are one row each and reach the rows as scalar subqueries, so nothing is
    joined on a constant.
    """
    vc = df.where(f"{x} IS NOT NULL").groupBy(*group, x).agg(F.expr("count(*) AS eq"))
    n = buckets or _buckets(df)
    edges = vc.groupBy(*group).agg(_edges(x, n).alias("_edges"))
    b = vc.join(edges, group) if group else vc.withColumn("_edges", edges.scalar())
    b = b.selectExpr(*group, x, "eq", f"size(filter(_edges, e -> e < {x})) AS _b")
    sums = b.groupBy(*group, "_b").agg(F.expr("sum(eq) AS _m"))
    k = ", ".join([*group, "_b"])
    within = f"coalesce(sum(eq) OVER (PARTITION BY {k} ORDER BY {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _lo"
    if group:
        g = ", ".join(group)
        per = sums.selectExpr(*group, "_b", f"coalesce(sum(_m) OVER (PARTITION BY {g} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off", f"sum(_m) OVER (PARTITION BY {g}) AS n")
        placed = b.selectExpr("*", within).join(per, [*group, "_b"])
    else:
        # at most one entry for each bucket
        totals = sums.agg(F.expr("map_from_entries(collect_list(struct(_b, _m))) AS _t"))
        placed = b.selectExpr("*", within).withColumn("_t", totals.scalar())
        below = "aggregate(map_entries(_t), 0L, (a, e) -> a + IF(e.key < _b, e.value, 0L)) AS _off"
        placed = placed.selectExpr("*", below, "aggregate(map_values(_t), 0L, (a, v) -> a + v) AS n")
    return placed.selectExpr(*group, x, "eq", "_off + _lo AS lt", "n")


def row_numbers(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """1-based position of each row in the order of SQL sort terms; the first term is a numeric column with ASC or DESC.

    Rows are dealt into ranges of that column, each is sorted on its own, and the sizes of the ranges before it are added.
    Nulls come last. Ties of all terms are numbered in any order.
    """
    x, _, way = order[0].partition(" ")
    edges = df.agg(_edges(x, _buckets(df)))
    up = f"CASE WHEN {x} IS NULL THEN 2147483647 ELSE size(filter(_edges, e -> e < {x})) END"
    down = f"CASE WHEN {x} IS NULL THEN 2147483647 ELSE size(filter(_edges, e -> e > {x})) END"
    b = df.withColumn("_edges", edges.scalar()).selectExpr("*", f"{down if way.upper().startswith('DESC') else up} AS _b").drop("_edges")
    totals = b.groupBy("_b").agg(F.expr("count(*) AS _m")).agg(F.expr("map_from_entries(collect_list(struct(_b, _m))) AS _t"))
    placed = b.selectExpr("*", f"row_number() OVER (PARTITION BY _b ORDER BY {', '.join(order)}) AS _i").withColumn("_t", totals.scalar())
    return placed.selectExpr(*df.columns, f"_i + aggregate(map_entries(_t), 0L, (a, e) -> a + IF(e.key < _b, e.value, 0L)) AS {out}")


def with_avg_rank(df: DataFrame, group: list[str], x: str, out: str) -> DataFrame:
    """Average rank of ties, 1-based; null values get a null rank."""
    r = value_ranks(df, group, x).selectExpr(*group, x, f"lt + (eq + 1) / 2.0D AS {out}")
    return df.join(r, [*group, x], "left")


def expanding_percentile(rows: DataFrame, x: str, out: str = "percentile") -> DataFrame:
    """symbol, ts, ``out``: per cent of a symbol's values up to and including each row that are not above the row's own; null values are left out.

    Counting smaller earlier values is cut into blocks of ``panel.CHUNK`` rows by time and by rank. Whole blocks that lie earlier and
    lower are added up from a table of counts; inside the row's time block its earlier values are compared, and inside its rank
    block the counts of earlier time blocks. Neither holds more than a block, and no window covers a symbol.
    """
    size = P.CHUNK
    d = P.index_panel(rows.where(f"{x} IS NOT NULL").selectExpr("symbol", "ts", f"{x} AS x")).withColumn("c", F.expr(f"int(rn div {size})"))
    d = d.join(value_ranks(d, ["symbol"], "x").selectExpr("symbol", "x", "lt", f"int(lt div {size}) AS b"), ["symbol", "x"])
    here = "size(filter(collect_list(x) OVER (PARTITION BY symbol, c ORDER BY rn), v -> v <= x)) AS _here"
    d = d.selectExpr("symbol", "ts", "rn", "c", "b", "lt", here)
    # equal values of a time block are one cell
    cells = d.groupBy("symbol", "b", "c", "lt").agg(F.expr("count(*) AS n"))
    seen = "collect_list(struct(c, n)) OVER (PARTITION BY symbol, b ORDER BY lt RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    near = cells.selectExpr("symbol", "b", "c", "lt", f"{seen} AS _s").selectExpr("symbol", "c", "lt", "aggregate(_s, 0L, (a, e) -> a + IF(e.c < c, e.n, 0L)) AS _near")
    grid = cells.groupBy("symbol", "b", "c").agg(F.expr("sum(n) AS n"))
    last = d.groupBy("symbol").agg(F.expr("max(c) AS last_c"))
    every = grid.select("symbol", "b").distinct().join(last, "symbol").selectExpr("symbol", "b", "explode(sequence(0, last_c)) AS c")
    before = "coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY symbol, b ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _t"
    grid = every.join(grid, ["symbol", "b", "c"], "left").selectExpr("symbol", "b", "c", before)
    whole = grid.selectExpr("symbol", "b", "c", "coalesce(sum(_t) OVER (PARTITION BY symbol, c ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _whole")
    j = d.join(near, ["symbol", "c", "lt"]).join(whole, ["symbol", "b", "c"])
    return j.selectExpr("symbol", "ts", f"100.0D * (_here + _near + _whole) / (rn + 1) AS {out}")


def quantiles(df: DataFrame, group: list[str], x: str, ps: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles {name: p} per group."""
    r = value_ranks(df, group, x)
    aggs, outs = [], []
    for name, p in ps.items():
        at = f"((n - 1) * {p}D)"
        for side, pos in (("lo", f"floor({at})"), ("hi", f"ceil({at})")):
            aggs.append(F.expr(f"max(CASE WHEN lt <= {pos} AND {pos} < lt + eq THEN {x} END) AS _{side}_{name}"))
        aggs.append(F.expr(f"max({at} - floor({at})) AS _w_{name}"))
        outs.append(f"_lo_{name} + (_hi_{name} - _lo_{name}) * _w_{name} AS {name}")
    return r.groupBy(*group).agg(*aggs).selectExpr(*group, *outs)


def rank_corr(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group over rows where both are known; equal pairs are counted before they are ranked."""
    d = df.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(*group, x, y).agg(F.expr("count(*) AS _c"))
    rx = value_ranks(df.where(f"{y} IS NOT NULL"), group, x).selectExpr(*group, x, "lt + (eq + 1) / 2.0D - (n + 1) / 2.0D AS _rx")
    ry = value_ranks(df.where(f"{x} IS NOT NULL"), group, y).selectExpr(*group, y, "lt + (eq + 1) / 2.0D - (n + 1) / 2.0D AS _ry")
    d = d.join(rx, [*group, x]).join(ry, [*group, y])
    sums = {"n": "sum(_c)", "_xy": "sum(_c * _rx * _ry)", "_xx": "sum(_c * _rx * _rx)", "_yy": "sum(_c * _ry * _ry)"}
    out = d.groupBy(*group).agg(*(F.expr(e).alias(k) for k, e in sums.items()))
    return out.selectExpr(*group, "n", "CASE WHEN _xx > 0 AND _yy > 0 THEN _xy / sqrt(_xx * _yy) END AS ic")
