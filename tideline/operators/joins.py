"""As-of and calendar joins of slow series onto the panel, macro scores, sensitivities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel as P
from .panel import add, over, rolling


def asof(bars: DataFrame, series: DataFrame, cols: list[str], shift_days: int = 1) -> DataFrame:
    """Newest ``series`` row at or before each bar date, the series moved forward by ``shift_days``.

    The series is one global table by date. Each of its rows is valid until the next one, so it is
    turned into intervals once and expanded to the days it covers; the bars then equi-join on the
    day. No symbol is sorted and the join key is spread by date.
    """
    s = series.selectExpr(f"date_add(ts, {shift_days}) AS from_ts", "year(ts) AS _y", *cols)
    # the date table holds one row per day, so ordering it is bounded by the calendar
    s = s.selectExpr("*", "lead(from_ts) OVER (ORDER BY from_ts) AS to_ts")
    end = bars.agg(F.expr("max(to_date(ts)) AS _end"))
    days = s.crossJoin(F.broadcast(end)).where("from_ts <= _end").selectExpr(
        "explode(sequence(from_ts, greatest(from_ts, least(coalesce(date_sub(to_ts, 1), _end), _end)))) AS _day", *cols
    )
    return bars.selectExpr("*", "to_date(ts) AS _day").join(days, "_day", "left").drop("_day")


def macro_frame(panel: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Symbols playing macro series, outer-joined on date and filled forward: ts plus one column per role."""
    wide = panel.where(f"symbol IN ({', '.join(repr(s) for s in roles)})").groupBy("ts").agg(
        *[F.expr(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {r}") for s, r in roles.items()]
    )
    p = P.index_panel(wide.selectExpr("'macro' AS symbol", "*"))
    return P.ffill(P.own_rows(P.with_halo(p)), {f"{r}": r for r in roles.values()}).drop("_c")


def factor_scores(macro: DataFrame, vix_low: float = 15, vix_high: float = 25, vix_move: float = 2, tnx_move: float = 0.1) -> DataFrame:
    """Dollar, risk and rates scores in [-2, 2]; null during warm-up."""
    h = P.with_halo(macro, 230)
    h = add(h, {"_d": f"dxy - {P.lag('dxy')}"})
    h = add(
        h,
        {
            "_m": rolling("avg(dxy)", 200), "_tm": rolling("avg(tnx)", 200),
            "_g": f"avg(greatest(_d, 0)) {over(13)}", "_l": f"avg(greatest(-_d, 0)) {over(13)}", "_n": f"count(_d) {over(13)}",
            "_vc": f"vix - {P.lag('vix', 20)}", "_ts": f"tnx - {P.lag('tnx', 20)}",
        },
    )
    h = add(P.own_rows(h), {"_rsi": "CASE WHEN _n = 14 AND _l > 0 THEN 100 - 100 / (1 + _g / _l) END"})
    d = add(
        h,
        {
            "dxy_score": "CASE WHEN _m IS NOT NULL THEN greatest(-2, least(2, int(signum(dxy - _m)) + CASE WHEN _rsi > 50 THEN 1 WHEN _rsi < 50 THEN -1 ELSE 0 END)) END",
            "vix_score": f"""CASE WHEN _vc IS NOT NULL THEN greatest(-2, least(2, CASE WHEN vix < {vix_low} THEN 1 WHEN vix > {vix_high} THEN -1 ELSE 0 END
                + CASE WHEN _vc < -{vix_move} THEN 1 WHEN _vc > {vix_move} THEN -1 ELSE 0 END)) END""",
            "tnx_score": f"""CASE WHEN _tm IS NOT NULL THEN greatest(-2, least(2, CASE WHEN tnx > _tm THEN 1 ELSE -1 END
                + CASE WHEN _ts < -{tnx_move} THEN 1 WHEN _ts > {tnx_move} THEN -1 ELSE 0 END)) END""",
        },
    )
    return d.select("ts", "dxy", "vix", "tnx", "dxy_score", "vix_score", "tnx_score")


# class -> linear mix of the scores
BIAS_BY_CLASS = {
    "fx_usd_quote": "-dxy", "fx_usd_base": "dxy", "fx": "0.5 * vix - 0.5 * dxy", "metal": "-0.6 * dxy - 0.4 * tnx + 0.3 * vix",
    "crypto": "1.5 * vix - 0.3 * dxy", "commodity": "vix - 0.3 * dxy - 0.2 * tnx", "index": "vix - 0.5 * tnx", "equity": "vix - 0.3 * tnx",
}
_Z = {k: f"coalesce({k}_score, 0)" for k in ("dxy", "vix", "tnx")}


def _mix(e: str) -> str:
    for k, v in _Z.items():
        e = e.replace(k, v)
    return e


MACRO_BIAS = "greatest(-2, least(2, CASE kind " + " ".join(f"WHEN '{k}' THEN {_mix(v)}" for k, v in BIAS_BY_CLASS.items() if k != "equity") + f" ELSE {_mix(BIAS_BY_CLASS['equity'])} END))"
MACRO_LABEL = "CASE WHEN bias >= 1.5 THEN 'Strong Tailwind' WHEN bias >= 0.5 THEN 'Tailwind' WHEN bias > -0.5 THEN 'Neutral' WHEN bias > -1.5 THEN 'Headwind' ELSE 'Strong Headwind' END"
REGIME_LABELS = {
    "usd": "CASE WHEN dxy_score >= 1 THEN 'USD Bullish' WHEN dxy_score <= -1 THEN 'USD Bearish' WHEN dxy_score IS NULL THEN 'USD Neutral' ELSE 'Neutral' END",
    "risk": "CASE WHEN vix_score >= 1 THEN 'Risk-On' WHEN vix_score <= -1 THEN 'Risk-Off' ELSE 'Neutral' END",
    "rates": "CASE WHEN tnx_score >= 1 THEN 'Easing' WHEN tnx_score <= -1 THEN 'Tightening' ELSE 'Neutral' END",
    "composite": "(coalesce(dxy_score, 0) + coalesce(vix_score, 0) + coalesce(tnx_score, 0)) / nullif(CASE WHEN dxy_score IS NULL THEN 0 ELSE 1 END + CASE WHEN vix_score IS NULL THEN 0 ELSE 1 END + CASE WHEN tnx_score IS NULL THEN 0 ELSE 1 END, 0)",
}


def cross_asset(panel: DataFrame, risk: list[str], gold: str) -> DataFrame:
    """5/20-bar momentum of a risk basket (mean) and of gold on the same dates, lagged one bar; neutral 0."""
    h = P.with_halo(panel.select("symbol", "ts", "rn", "close"), 20)
    m = P.own_rows(add(h, {"m5": f"close / {P.lag('close', 5)} - 1", "m20": f"close / {P.lag('close', 20)} - 1"}))
    r = ", ".join(repr(s) for s in risk)
    wide = m.where(f"symbol IN ({r}, '{gold}')").groupBy("ts").agg(
        *[F.expr(f"avg(CASE WHEN symbol IN ({r}) THEN m{k} END) AS risk_mom{k}") for k in (5, 20)],
        *[F.expr(f"max(CASE WHEN symbol = '{gold}' THEN m{k} END) AS gold_mom{k}") for k in (5, 20)],
    )
    j = P.with_halo(panel.select("symbol", "ts", "rn").join(wide, "ts", "left"), 1)
    cols = ["risk_mom5", "risk_mom20", "gold_mom5", "gold_mom20"]
    return P.own_rows(P.put(j, {c: f"coalesce({P.lag(c)}, 0.0D)" for c in cols})).drop("_c")


def positioning(panel: DataFrame, reports: DataFrame) -> DataFrame:
    """Weekly percentile on the bar of its exact date, lagged one bar, filled forward, 50 before the first, clipped."""
    j = P.with_halo(panel.select("symbol", "ts", "rn").join(reports, ["symbol", "ts"], "left"), 1)
    own = P.own_rows(P.put(j, {"percentile": P.lag("percentile")}))
    return P.put(P.ffill(own, {"pct": "percentile"}), {"pct": "greatest(0, least(100, coalesce(pct, 50)))"}).drop("_c", "percentile")


def sensitivities(panel: DataFrame, factors: DataFrame, names: list[str], lookback: int = 90, min_rows: int = 25) -> DataFrame:
    """Correlation and beta of the last ``lookback`` bar returns with each factor's one-day-lagged return."""
    h = P.with_halo(panel.select("symbol", "ts", "rn", "close"), 1)
    r = P.own_rows(add(h, {"ret": f"close / {P.lag('close')} - 1"})).where("ret IS NOT NULL")
    f = factors.selectExpr("date_add(ts, 1) AS ts", *names)
    last = P.last_n(r.join(f, "ts"), lookback)
    aggs = ["count(*) AS n"]
    for x in names:
        aggs += [f"CASE WHEN count({x}) >= {min_rows} THEN corr(ret, {x}) END AS corr_{x}", f"CASE WHEN count({x}) >= {min_rows} THEN covar_samp(ret, {x}) / nullif(var_samp({x}), 0) END AS beta_{x}"]
    return last.groupBy("symbol").agg(*[F.expr(a) for a in aggs])
