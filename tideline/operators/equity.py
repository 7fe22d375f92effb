"""Fundamental scores and the cross-sectional factor model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking as K
from .panel import add


def _band(x: str, lo: float, hi: float) -> str:
    return f"100 - (least(greatest({x}, {lo}), {hi}) - {lo}) / {hi - lo} * 100"


def _mean(parts: list[str]) -> str:
    n = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for p in parts)
    return f"({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / nullif({n}, 0)"


VALUE_PARTS = {
    "v_pe": f"CASE WHEN pe > 0 THEN {_band('pe', 8.0, 40.0)} END",
    "v_ev": f"CASE WHEN ev_ebitda > 0 THEN {_band('ev_ebitda', 4.0, 25.0)} END",
    "v_pb": f"CASE WHEN pb > 0 THEN {_band('pb', 0.5, 12.0)} END",
}
QUALITY_PARTS = {
    "q_roe": "CASE WHEN roe_pct IS NOT NULL THEN (least(greatest(roe_pct, 5.0), 35.0) - 5.0) / 30.0 * 100 END",
    "q_de": "CASE WHEN debt_to_equity >= 0 THEN 100 - least(debt_to_equity, 1.5) / 1.5 * 100 END",
}
VALUE, QUALITY = _mean(list(VALUE_PARTS)), _mean(list(QUALITY_PARTS))
# category -> (field, sign); weight
FACTORS = {"value": ([("pe", -1), ("ev_ebitda", -1), ("pb", -1)], 0.33), "quality": ([("roe_pct", 1), ("debt_to_equity", -1)], 0.33), "momentum": ([("mom_12m", 1)], 0.34)}


def factor_scores(fund: DataFrame) -> DataFrame:
    """1/99% winsorised z-scores, mean per category, 50 + 25 z, weighted over the available categories.

    The six fields are ranked in one stacked pass; limits and moments are one-row scalar subqueries.
    """
    fields = [f for fs, _ in FACTORS.values() for f, _ in fs]
    stacked = fund.selectExpr(f"stack({len(fields)}, {', '.join(f'{f!r}, CAST({f} AS DOUBLE)' for f in fields)}) AS (field, x)")
    limits = K.quantiles(stacked, ["field"], "x", {"lo": 0.01, "hi": 0.99})
    # one entry for each field
    table = limits.agg(F.expr("map_from_entries(collect_list(struct(field, struct(lo, hi)))) AS _limits"))
    d = fund.withColumn("_limits", table.scalar())
    d = add(d, {f"_lo_{f}": f"_limits['{f}'].lo" for f in fields} | {f"_hi_{f}": f"_limits['{f}'].hi" for f in fields})
    d = d.selectExpr("symbol", *[f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, _lo_{f}), _hi_{f}) END AS {f}" for f in fields])
    m = d.agg(F.struct(*[F.expr(f"{fn}({f}) AS _{fn}_{f}") for f in fields for fn in ("avg", "stddev_pop")]).alias("_m"))
    d = d.withColumn("_m", m.scalar()).select("*", "_m.*")
    d = add(d, {f"z_{f}": f"CASE WHEN _stddev_pop_{f} > 0 THEN ({f} - _avg_{f}) / _stddev_pop_{f} ELSE {f} * 0 END" for f in fields})
    d = add(d, {f"{c}_score": f"greatest(0, least(100, 50 + 25 * ({_mean([f'({s} * z_{f})' for f, s in fs])})))" for c, (fs, _) in FACTORS.items()})
    d = add(d, {f"_n_{c}": f"{_mean([f'({s} * z_{f})' for f, s in fs])} IS NULL" for c, (fs, _) in FACTORS.items()})
    num = " + ".join(f"CASE WHEN _n_{c} THEN 0 ELSE {w} * {c}_score END" for c, (_, w) in FACTORS.items())
    den = " + ".join(f"CASE WHEN _n_{c} THEN 0 ELSE {w} END" for c, (_, w) in FACTORS.items())
    return add(d, {"composite": f"({num}) / nullif({den}, 0)"}).select("symbol", *[f"{c}_score" for c in FACTORS], "composite")


MOMENTUM = "0.8 * greatest(0, least(100, 50 + ({}) * 40)) + 0.2 * coalesce(rsi_14, 50)"


def momentum_sql(lookbacks=(21, 63, 126, 252)) -> str:
    parts = [f"greatest(-1, least(1, r{n} / 30))" for n in lookbacks]
    return MOMENTUM.format(_mean(parts))
