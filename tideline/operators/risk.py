"""Sizing, VaR, stress, correlation, exposure, limits and order selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel as P
from .panel import add

Z95 = 1.645
# fixed values: crash scenarios (drawdown %, volatility multiple, horizon in sessions)
SCENARIOS = [("2008 GFC", 54.0, 3.0, 200), ("COVID-19 2020", 34.0, 2.5, 23), ("2022 drawdown", 25.0, 1.8, 250)]
DAILY_LIMIT, SCENARIO_CAP = 2.0, 10.0

UNIT_RISK = "CASE WHEN side = 'short' THEN stop - entry ELSE entry - stop END"


def fractional_qty(equity: str = "equity", pct: str = "0.01") -> str:
    return f"CASE WHEN {UNIT_RISK} > 0 AND {equity} > 0 THEN {equity} * {pct} / ({UNIT_RISK}) ELSE 0 END"


def vol_target_qty(equity: str = "equity", target: str = "0.02", hold: int = 1, cap: str = "0.01") -> str:
    """Notional so that the trade adds ``target`` volatility, capped by the fractional size."""
    raw = f"{equity} * {target} / (atr / entry * sqrt({max(hold, 1)})) / entry"
    return f"CASE WHEN atr > 0 AND entry > 0 AND {equity} > 0 THEN greatest(least({raw}, {fractional_qty(equity, cap)}), 0) ELSE 0 END"


def kelly_qty(equity: str = "equity", p: float = 0.55, payoff: float = 1.5, fraction: float = 0.5, cap: str = "0.01") -> str:
    f = max(0.0, p - (1 - p) / payoff) * fraction if 0 < p < 1 and payoff > 0 else 0.0
    return f"least({fractional_qty(equity, str(f))}, {fractional_qty(equity, cap)})" if f > 0 else "0"


def risk_rows(positions: DataFrame) -> DataFrame:
    """Three sizing rows per setup with dollars at risk, risk share and one-bar VaR."""
    m = f"named_struct('method', 'fractional', 'qty', double({fractional_qty()})), named_struct('method', 'voltarget', 'qty', double({vol_target_qty()})), named_struct('method', 'kelly', 'qty', double({kelly_qty()}))"
    d = positions.selectExpr("*", f"inline(array({m}))")
    d = add(d, {"risk_usd": f"greatest({UNIT_RISK}, 0) * qty", "var95": f"{Z95} * atr * qty"})
    return add(d, {"risk_pct": "100 * risk_usd / equity", "var_pct": "100 * var95 / equity"})


def stress(positions: DataFrame) -> DataFrame:
    """Every position under every scenario; the scenario list is a literal of three rows."""
    rows = ", ".join(f"named_struct('scenario', '{n}', 'dd', {d}D, 'vm', {v}D, 'hz', {h})" for n, d, v, h in SCENARIOS)
    d = positions.selectExpr("*", f"inline(array({rows}))")
    d = add(
        d,
        {
            "loss": "CASE side WHEN 'short' THEN -1 ELSE 1 END * qty * entry * dd / 100",
            "var_stress": f"{Z95} * atr * vm * qty * sqrt(hz)",
            "var_1d_pct": f"100 * {Z95} * atr * vm * qty / equity",
        },
    )
    return add(
        d,
        {
            "loss_pct": "100 * loss / equity", "daily_breach": f"var_1d_pct > {DAILY_LIMIT}", "cap_breach": f"100 * loss / equity > {SCENARIO_CAP}",
            "days_of_limit": f"greatest(100 * loss / equity / {DAILY_LIMIT}, 0)",
        },
    )


def pair_correlation(returns: DataFrame, x: str = "ret") -> DataFrame:
    """Correlation of every symbol pair i < j over shared dates.

    Per date the symbols are few; pairs are formed inside the date's array and combine map-side
    into one row per pair, so nothing is joined per symbol.
    """
    day = returns.where(f"{x} IS NOT NULL").groupBy("ts").agg(F.expr(f"array_sort(collect_list(struct(symbol, {x} AS v))) AS a"))
    pr = day.selectExpr("explode(flatten(transform(a, (s, i) -> transform(slice(a, i + 2, size(a)), t -> struct(s.symbol AS a, t.symbol AS b, s.v AS x, t.v AS y))))) AS p").select("p.*")
    return pr.groupBy("a", "b").agg(F.expr("count(*) AS n"), F.expr("corr(x, y) AS corr"))


def daily_returns(panel: DataFrame) -> DataFrame:
    h = P.with_halo(panel.select("symbol", "ts", "rn", "close"), 1)
    return P.own_rows(add(h, {"ret": f"close / {P.lag('close')} - 1"})).drop("_c")


def portfolio_var(weights: DataFrame, pairs: DataFrame, vols: DataFrame, total: float) -> DataFrame:
    """z * sqrt(w' C w) * notional from one row per symbol and one per pair."""
    w = weights.join(vols, "symbol").selectExpr("symbol", "w * vol AS wv")
    own = w.agg(F.expr("sum(wv * wv) AS s0"))
    x = pairs.join(w.selectExpr("symbol AS a", "wv AS wa"), "a").join(w.selectExpr("symbol AS b", "wv AS wb"), "b")
    cross = x.agg(F.expr("sum(2 * wa * wb * corr) AS s1"))
    return own.crossJoin(F.broadcast(cross)).selectExpr(f"{Z95} * sqrt(greatest(s0 + coalesce(s1, 0), 0)) * {total} AS var95")


def select_orders(candidates: DataFrame, max_concurrent: int = 6, max_per_cluster: int = 1, max_heat: float = 0.04) -> DataFrame:
    """Greedy selection per pass in EV order under position, cluster and heat caps, with reasons.

    ``candidates``: pass_id, symbol, ev, risk_frac, clusters array<string>. One pass holds the
    alerts of one bar, so its array is as long as the universe is wide; passes run in parallel.
    """
    g = candidates.groupBy("pass_id").agg(F.expr("array_sort(collect_list(struct(-ev AS o, symbol, ev, risk_frac, clusters))) AS c"))
    why = f"""CASE WHEN a.n >= {max_concurrent} THEN 'max concurrent'
        WHEN exists(x.clusters, k -> size(filter(a.used, u -> u = k)) >= {max_per_cluster}) THEN 'cluster cap'
        WHEN a.heat + x.risk_frac > {max_heat} + 1e-12 THEN 'heat' ELSE 'kept' END"""
    out_t = "array<struct<symbol:string,ev:double,decision:string>>"
    fold = f"""aggregate(transform(c, x -> named_struct('symbol', x.symbol, 'ev', x.ev, 'risk_frac', x.risk_frac, 'clusters', x.clusters)),
        named_struct('n', 0, 'heat', 0.0D, 'used', cast(array() AS array<string>), 'out', cast(array() AS {out_t})),
        (a, x) -> named_struct('n', a.n + CASE WHEN {why} = 'kept' THEN 1 ELSE 0 END, 'heat', a.heat + CASE WHEN {why} = 'kept' THEN x.risk_frac ELSE 0.0D END,
          'used', CASE WHEN {why} = 'kept' THEN concat(a.used, x.clusters) ELSE a.used END,
          'out', concat(a.out, array(named_struct('symbol', x.symbol, 'ev', x.ev, 'decision', {why})))),
        a -> a.out)"""
    return g.selectExpr("pass_id", f"inline({fold})")


def loss_limits(fills: DataFrame, equity: float, daily: float = 0.02, weekly: float = 0.04) -> DataFrame:
    """Halt flags from the running P&L of each day and week; fills: ts, seq, pnl.

    Days are summed first; the running total inside a day is needed only for the daily flag and a
    day of fills is one bounded partition. The weekly total adds the earlier days of the week.
    """
    d = fills.selectExpr("*", "to_date(ts) AS day", "to_date(date_trunc('week', ts)) AS week")
    run = d.selectExpr("*", "sum(pnl) OVER (PARTITION BY day ORDER BY ts, seq) AS run_day")
    per = d.groupBy("week", "day").agg(F.expr("sum(pnl) AS _p"))
    before = per.selectExpr("week", "day", "coalesce(sum(_p) OVER (PARTITION BY week ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0D) AS _w")
    j = run.join(before, ["week", "day"]).selectExpr("*", "_w + run_day AS run_week")
    hit = j.groupBy("week", "day").agg(F.expr(f"min(run_day) <= -{daily} * {equity} AS daily_halt"), F.expr(f"min(run_week) <= -{weekly} * {equity} AS weekly_halt_today"), F.expr("count(*) AS n"), F.expr("sum(pnl) AS pnl"))
    return hit.selectExpr("day", "n", "pnl", "daily_halt", "max(weekly_halt_today) OVER (PARTITION BY week ORDER BY day) AS weekly_halt")


# scalar EV of a ladder from first-touch masses; null unless every mass is known and they do not exceed one
def target_level_ev(p1: str, p2: str, p3: str, ps: str, cost: str = "0.0") -> str:
    ok = " AND ".join(f"{p} BETWEEN 0 AND 1" for p in (p1, p2, p3, ps)) + f" AND {p1} + {p2} + {p3} + {ps} <= 1.000001"
    return f"CASE WHEN {ok} THEN {p1} + 2 * {p2} + 3 * {p3} - {ps} - {cost} END"


def allocation_ev(p1: str, p2: str, p3: str, ps: str, cost: str = "0.0") -> str:
    """A third exits at each rung that is reached; the rest of a first-rung exit is closed flat."""
    ok = " AND ".join(f"{p} BETWEEN 0 AND 1" for p in (p1, p2, p3, ps))
    return f"CASE WHEN {ok} THEN {p1} * (1.0 / 3) + {p2} * (3.0 / 3) + {p3} * (6.0 / 3) - {ps} - {cost} END"


def order_portfolio(orders: DataFrame, by: list[str], notional: float = 100_000.0) -> DataFrame:
    """Shared legs of sets of orders: per set and leg its orders, long and short notional, and whether they express one view more than once.

    ``orders``: the columns of ``by``, symbol, side, entry, stop, base, quote. Every order with a risk has the same notional; a long is long its
    base and short its quote. ``share`` is a leg's part of the gross notional of its set, ``concentration`` net against gross of the leg.
    """
    n = f"CASE WHEN entry <> stop THEN {notional}D ELSE 0.0D END"
    sg = "CASE side WHEN 'long' THEN 1 ELSE -1 END"
    legs = orders.selectExpr(*by, "symbol", f"inline(array(named_struct('leg', base, 'x', {sg} * {n}), named_struct('leg', quote, 'x', -({sg}) * {n})))")
    g = legs.groupBy(*by, "leg").agg(
        *[F.expr(f"{e} AS {k}") for k, e in {"n_orders": "count(*)", "n_symbols": "count(distinct symbol)", "long_notional": "sum(greatest(x, 0))", "short_notional": "sum(greatest(-x, 0))"}.items()]
    )
    total = g.groupBy(*by).agg(F.expr("sum(long_notional + short_notional) AS _gross"))
    g = add(g.join(total, by), {"net": "long_notional - short_notional", "share": "(long_notional + short_notional) / nullif(_gross, 0)"})
    return add(g, {"concentration": "abs(net) / nullif(long_notional + short_notional, 0)", "shared": "n_symbols > 1 AND abs(net) = long_notional + short_notional"}).drop("_gross")
