"""Queries: trade statistics, resampling, sizing, stress, portfolio, fundamentals, sentiment."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import equity as E
from ..operators import panel as P
from ..operators import ranking as K
from ..operators import resampling as B
from ..operators import research as X
from ..operators import risk as R
from ..operators import stats as S
from ..operators import text as T
from ..sources import derive as D
from . import sql_base  # noqa: F401
from .outcomes import trades
from .registry import cte, query, show
from .statistics import _SS, _SSP, _SSQ, events, q

# ---- trades -----------------------------------------------------------------------------------
_TS = {**_SS, "avg_hold": "avg(bars_held)", "best": "max(r)", "worst": "min(r)", "sortino": "avg(r) / nullif(stddev_samp(CASE WHEN r < 0 THEN r END), 0)"}
_TSQ = ", ".join(f"{v.replace('1.0D', '1.0').replace('0.0D', '0.0')} AS {k}" for k, v in _TS.items())
_TSP = _SSP + " avg_hold:4 best:4 worst:4 sortino:4"
_GS = "CASE WHEN grouping({0}) = 1 THEN 'ALL' ELSE {0} END AS {0}"
q("trade_statistics", f"side symbol {_TSP}", f"SELECT {_GS.format('side')}, {_GS.format('symbol')}, {_TSQ} FROM trades GROUP BY GROUPING SETS ((side), (side, symbol))", "trades")(
    lambda spark, sf: S.grouping_sets(trades(spark, sf), [["side"], ["side", "symbol"]], _TS)
)
q("regime_breakdown", f"regime {_SSP}", f"SELECT regime, {_SSQ} FROM trades GROUP BY 1", "trades")(lambda spark, sf: S.agg(trades(spark, sf), ["regime"], _SS))
q("trade_drawdown", "side max_dd:5", "SELECT side, min(e - p) AS max_dd FROM (SELECT side, e, greatest(max(e) OVER (PARTITION BY side ORDER BY signal_ts, symbol), 0) AS p FROM (SELECT side, signal_ts, symbol, sum(r) OVER (PARTITION BY side ORDER BY signal_ts, symbol) AS e FROM trades)) GROUP BY 1", "trades")(
    lambda spark, sf: S.drawdown(trades(spark, sf), "side", "r", ["signal_ts", "symbol"])
)
q("score_ablation", f"side threshold:i {_SSP}", f"SELECT side, threshold, {_SSQ} FROM trades, (VALUES (0), (4), (5), (6), (7)) v(threshold) WHERE score >= threshold GROUP BY 1, 2", "trades")(
    lambda spark, sf: S.agg(trades(spark, sf).selectExpr("side", "r", "explode(filter(array(0, 4, 5, 6, 7), t -> score >= t)) AS threshold"), ["side", "threshold"], _SS)
)
q("tail_loss", "side p05:5", "SELECT side, quantile_cont(r, 0.05) AS p05 FROM trades GROUP BY 1", "trades")(lambda spark, sf: K.quantiles(trades(spark, sf), ["side"], "r", {"p05": 0.05}))


@q(
    "trade_ratios", "side total_r:5 years:4 max_dd:5 calmar:5 exposure:6",
    """WITH e AS (SELECT side, signal_ts, symbol, sum(r) OVER (PARTITION BY side ORDER BY signal_ts, symbol) AS e FROM trades), d AS (SELECT side, min(e - p) AS max_dd FROM (SELECT side, e, greatest(max(e) OVER (PARTITION BY side ORDER BY signal_ts, symbol), 0) AS p FROM e) GROUP BY 1),
    t AS (SELECT side, sum(r) AS total_r, date_diff('day', min(signal_ts), max(exit_ts)) / 365.25 AS years, sum(bars_held) AS held FROM trades GROUP BY 1)
    SELECT side, total_r, years, max_dd, CASE WHEN max_dd < 0 THEN total_r / years / abs(max_dd) ELSE 0 END AS calmar, held / (SELECT count(*) FROM wb) AS exposure FROM t JOIN d USING (side)""", "trades", "wb",
)
def trade_ratios(spark, sf):
    """R a year against the largest fall (Calmar), and the share of all bars spent in a position."""
    t = trades(spark, sf)
    d = S.agg(t, ["side"], {"total_r": "sum(r)", "years": "datediff(max(exit_ts), min(signal_ts)) / 365.25D", "held": "sum(bars_held)"})
    d = d.join(S.drawdown(t, "side", "r", ["signal_ts", "symbol"]), "side").crossJoin(F.broadcast(D.walk_d(spark, sf).agg(F.count("*").alias("bars"))))
    return P.add(d, {"calmar": "CASE WHEN max_dd < 0 THEN total_r / years / abs(max_dd) ELSE 0.0D END", "exposure": "held / bars"})


# probabilistic Sharpe: kurtosis is raw (excess + 3), moments from population aggregates
_SRD = {"n": "count(r)", "sr": "avg(r) / stddev_samp(r)", "sk": "skewness(r)", "ku": "kurtosis(r) + 3"}


@q(
    "probabilistic_sharpe", "side n:i sr:5 z:4 psr:4",
    """WITH m AS (SELECT side, count(*) AS n, avg(r) AS mu, avg(r) / stddev_samp(r) AS sr FROM trades GROUP BY 1), c AS (SELECT t.side, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM trades t JOIN m USING (side) GROUP BY 1),
    z AS (SELECT side, n, sr, sr / sqrt((1 - m3 / pow(m2, 1.5) * sr + (m4 / (m2 * m2) - 1) / 4 * sr * sr) / (n - 1)) AS z FROM m JOIN c USING (side))
    SELECT *, CASE WHEN z >= 0 THEN 1 - """ + S.two_sided_p("z") + " / 2 ELSE " + S.two_sided_p("z") + " / 2 END AS psr FROM z", "trades",
)
def probabilistic_sharpe(spark, sf):
    d = S.agg(trades(spark, sf), ["side"], _SRD)
    d = P.add(d, {"z": "sr / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1))"})
    return P.add(d, {"psr": f"CASE WHEN z >= 0 THEN 1 - {S.two_sided_p('z')} / 2 ELSE {S.two_sided_p('z')} / 2 END"})


def _expected_max(trials: int) -> float:
    """Expected largest z among independent trials."""
    inv, g = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - g) * inv(1 - 1 / trials) + g * inv(1 - 1 / (trials * math.e))


_EM = _expected_max(20)
_PHI = "CASE WHEN {0} >= 0 THEN 1 - " + S.two_sided_p("{0}").replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + " / 2 ELSE " + S.two_sided_p("{0}").replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + " / 2 END"
_DZ = f"(z - {_EM!r})"


@q(
    "deflated_sharpe", "side n:i sr:5 dsr:4",
    """WITH m AS (SELECT side, count(*) AS n, avg(r) AS mu, avg(r) / stddev_samp(r) AS sr FROM trades GROUP BY 1), c AS (SELECT t.side, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM trades t JOIN m USING (side) GROUP BY 1),
    z AS (SELECT side, n, sr, sr / sqrt((1 - m3 / pow(m2, 1.5) * sr + (m4 / (m2 * m2) - 1) / 4 * sr * sr) / (n - 1)) AS z FROM m JOIN c USING (side)) SELECT *, """ + _PHI.format(_DZ) + " AS dsr FROM z", "trades",
)
def deflated_sharpe(spark, sf):
    """P(the Sharpe beats the expected best of 20 trials)."""
    d = P.add(S.agg(trades(spark, sf), ["side"], _SRD), {"z": "sr / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1))"})
    return P.add(d, {"dsr": _PHI.format(_DZ)})


# ---- resampling: the unit ids are plain integers, so SQL repeats the draws ---------------------------
# 44 bits of a digest of the symbol, or of the symbol and the day: the largest that the draws' integer arithmetic takes
_UID, _ROW = (f"CAST(conv(substr(md5({e}), 1, 11), 16, 10) AS BIGINT)" for e in ("symbol", "concat(symbol, ' ', date_format(ts, 'yyyy-MM-dd'))"))
_UID_SQL, _ROW_SQL = (f"CAST('0x' || substr(md5({e}), 1, 11) AS BIGINT)" for e in ("symbol", "symbol || ' ' || strftime(ts, '%Y-%m-%d')"))
# fixed values: numbers of replicates
BOOTSTRAPS, FLIPS, TIMINGS, PATHS = 2000, 300, 300, 10_000
_DAY = "CAST(date_diff('day', DATE '1990-01-01', ts) AS BIGINT)"


def _ev(spark, sf):
    return events(spark, sf).selectExpr("symbol", "ts", "rn", "r", f"{_ROW} AS row_id", "bigint(floor(datediff(ts, DATE '1990-01-01') / 10)) AS block_id", f"{_UID} AS sym_id")


def _boot(name, unit, sql_unit, reps=BOOTSTRAPS):
    @q(
        name, "lo:5 mid:5 hi:5",
        f"""WITH e AS (SELECT r, CAST({sql_unit} AS BIGINT) AS uid FROM evt), w AS (SELECT rep, r, {B.poisson1(B.unit('rep', 'uid', 42))} AS w FROM e, range(1, {reps + 1}) t(rep)),
        s AS (SELECT rep, sum(w * r) / nullif(sum(w), 0) AS stat FROM w GROUP BY 1) SELECT quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.5) AS mid, quantile_cont(stat, 0.975) AS hi FROM s""", "evt",
    )
    def run(spark, sf):
        return B.interval(B.bootstrap(_ev(spark, sf), unit, "r", reps))


_boot("bootstrap_ci", "row_id", _ROW_SQL)
_boot("block_bootstrap", "block_id", "floor(date_diff('day', DATE '1990-01-01', ts) / 10)")
_boot("symbol_bootstrap", "sym_id", _UID_SQL)


@q(
    "sign_flip_test", "observed:5 p:5",
    f"WITH e AS (SELECT r, {_ROW_SQL} AS uid FROM evt), f AS (SELECT rep, avg(CASE WHEN {B.unit('rep', 'uid', 7)} < 0.5 THEN -1 ELSE 1 END * r) AS m, avg(r) AS obs FROM e, range(1, {FLIPS + 1}) t(rep) GROUP BY 1) SELECT max(obs) AS observed, avg(CASE WHEN abs(m) >= abs(obs) THEN 1.0 ELSE 0 END) AS p FROM f", "evt",
)
def sign_flip_test(spark, sf):
    return B.sign_flip(_ev(spark, sf), "row_id", "r", FLIPS)


@q(
    "random_timing_null", "observed:5 null_mean:5 p:5",
    f"""WITH o AS (SELECT count(r) AS n, avg(r) AS obs FROM evt), p AS (SELECT fwd10_r AS r, {_ROW_SQL} AS uid FROM rk WHERE fwd10_r IS NOT NULL), c AS (SELECT count(*) AS np FROM p),
    s AS (SELECT rep, avg(r) AS m, any_value(obs) AS obs FROM p, o, c, range(1, {TIMINGS + 1}) t(rep) WHERE {B.unit('rep', 'uid', 11)} < n / np GROUP BY 1) SELECT max(obs) AS observed, avg(m) AS null_mean, avg(CASE WHEN m >= obs THEN 1.0 ELSE 0 END) AS p FROM s""", "evt", "rk",
)
def random_timing_null(spark, sf):
    pool = D.research_d(spark, sf).where("fwd10_r IS NOT NULL").selectExpr("fwd10_r AS r", f"{_ROW} AS unit_id")
    return B.random_timing(_ev(spark, sf), pool, "r", TIMINGS)


@query("block_drawdown_distribution")
def block_drawdown_distribution(spark, sf):
    """Drawdown, final R and losing streak of block-resampled trade sequences."""
    d = trades(spark, sf).selectExpr("'all' AS symbol", "struct(signal_ts, symbol, side) AS ts", "to_date(signal_ts) AS _day", "r")
    t = S.index_by(d, "_day", "ts").selectExpr("rn AS k", "r")
    return show(B.block_drawdowns(t), "rep:i final_r:4 max_dd:4 losing_streak:i")


# ---- positions: both sides of the latest bar -----------------------------------------------------
cte("posn", "SELECT symbol, close, atr_14 AS atr, side, close AS entry, close - CASE side WHEN 'long' THEN 1 ELSE -1 END * 1.5 * atr_14 AS stop, 250000.0 AS equity, 10.0 + rn % 7 + CASE side WHEN 'short' THEN 3 ELSE 0 END AS qty FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1), (VALUES ('long'), ('short')) v(side)", "f")


def positions(spark, sf):
    d = P.latest(D.panel_d(spark, sf).select("symbol", "ts", "rn", "close", "atr_14")).selectExpr("symbol", "rn", "close", "atr_14 AS atr", "explode(array('long', 'short')) AS side")
    return P.add(d, {"entry": "close", "stop": "close - CASE side WHEN 'long' THEN 1 ELSE -1 END * 1.5 * atr", "equity": "250000.0D", "qty": "10.0D + rn % 7 + CASE side WHEN 'short' THEN 3 ELSE 0 END"})


def _union_methods():
    return " UNION ALL ".join(f"SELECT *, '{m}' AS method, {e} AS q FROM posn" for m, e in (("fractional", R.fractional_qty()), ("voltarget", R.vol_target_qty()), ("kelly", R.kelly_qty())))


q("risk_plan_rows", "symbol side method qty:5 risk_usd:3 risk_pct:5 var95:3 var_pct:5", f"SELECT symbol, side, method, q AS qty, greatest({R.UNIT_RISK}, 0) * q AS risk_usd, 100 * greatest({R.UNIT_RISK}, 0) * q / equity AS risk_pct, 1.645 * atr * q AS var95, 100 * 1.645 * atr * q / equity AS var_pct FROM ({_union_methods()})", "posn")(
    lambda spark, sf: R.risk_rows(positions(spark, sf).drop("qty"))
)
_SC = ", ".join(f"('{n}', {d}, {v}, {h})" for n, d, v, h in R.SCENARIOS)
cte("strs", f"SELECT *, 100 * loss / equity AS loss_pct, var_1d_pct > 2.0 AS daily_breach, 100 * loss / equity > 10.0 AS cap_breach, greatest(100 * loss / equity / 2.0, 0) AS days_of_limit FROM (SELECT *, CASE side WHEN 'short' THEN -1 ELSE 1 END * qty * entry * dd / 100 AS loss, 1.645 * atr * vm * qty * sqrt(hz) AS var_stress, 100 * 1.645 * atr * vm * qty / equity AS var_1d_pct FROM posn, (VALUES {_SC}) v(scenario, dd, vm, hz))", "posn")
q("stress_positions", "symbol side scenario loss:3 loss_pct:3 var_stress:3 var_1d_pct:4 daily_breach:b cap_breach:b days_of_limit:2", "SELECT * FROM strs", "strs")(lambda spark, sf: R.stress(positions(spark, sf)))
_SP = {"loss": "sum(loss)", "var_sum": "sum(var_stress)", "any_daily": "max(CASE WHEN daily_breach THEN 1 ELSE 0 END)", "any_cap": "max(CASE WHEN cap_breach THEN 1 ELSE 0 END)"}
q("stress_portfolio", "scenario loss:3 var_sum:3 any_daily:i any_cap:i", f"SELECT scenario, {', '.join(f'{v} AS {k}' for k, v in _SP.items())} FROM strs GROUP BY 1", "strs")(lambda spark, sf: S.agg(R.stress(positions(spark, sf)), ["scenario"], _SP))
q("portfolio_heat", "heat:6 heat_signed:6", "SELECT sum(greatest(entry - stop, 0) * qty) / 250000 AS heat, sum(abs(entry - stop) * qty) / 250000 AS heat_signed FROM posn", "posn")(
    lambda spark, sf: S.agg(positions(spark, sf), [], {"heat": "sum(greatest(entry - stop, 0) * qty) / 250000", "heat_signed": "sum(abs(entry - stop) * qty) / 250000"})
)
_LEG = {"exposure": "sum(sg * qty * entry)", "n": "count(*)"}
q(
    "currency_exposure", "leg exposure:3 n:i share:5 concentrated:b",
    "WITH l AS (SELECT substr(symbol, 1, 1) AS leg, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg, qty, entry FROM posn UNION ALL SELECT substr(symbol, 2, 1), -CASE side WHEN 'long' THEN 1 ELSE -1 END, qty, entry FROM posn), g AS (SELECT leg, sum(sg * qty * entry) AS exposure, count(*) AS n FROM l GROUP BY 1) SELECT *, abs(exposure) / nullif(sum(abs(exposure)) OVER (), 0) AS share, abs(exposure) / nullif(sum(abs(exposure)) OVER (), 0) >= 0.4 AS concentrated FROM g", "posn",
)(
    lambda spark, sf: S.agg(
        positions(spark, sf).selectExpr("qty", "entry", "CASE side WHEN 'long' THEN 1 ELSE -1 END AS s0", "symbol").selectExpr("qty", "entry", "inline(array(named_struct('leg', substr(symbol, 1, 1), 'sg', s0), named_struct('leg', substr(symbol, 2, 1), 'sg', -s0)))"), ["leg"], _LEG
    ).selectExpr("*", "abs(exposure) / nullif(sum(abs(exposure)) OVER (), 0) AS share").selectExpr("*", "share >= 0.4 AS concentrated")
)
cte("dret", "SELECT symbol, ts, rn, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM wb", "wb")
cte("cpair", "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.ret, y.ret) AS corr FROM dret x JOIN dret y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2", "dret")


def pairs(spark, sf):
    return R.pair_correlation(R.daily_returns(D.walk_d(spark, sf)))


q("correlation_pairs", "a b n:i corr:5", "SELECT * FROM cpair", "cpair")(pairs)
q("top_correlated_pairs", "a b corr:5", "SELECT * FROM cpair ORDER BY abs(corr) DESC, a, b LIMIT 6", "cpair")(lambda spark, sf: pairs(spark, sf).orderBy(F.desc(F.expr("abs(corr)")), "a", "b").limit(6))
q(
    "portfolio_var", "var95:3", "WITH v AS (SELECT symbol, stddev_samp(ret) / 6 AS wv FROM dret GROUP BY 1) SELECT 1.645 * sqrt((SELECT sum(wv * wv) FROM v) + (SELECT sum(2 * x.wv * y.wv * corr) FROM cpair JOIN v x ON x.symbol = a JOIN v y ON y.symbol = b)) * 1000000 AS var95", "dret", "cpair",
)(
    lambda spark, sf: R.portfolio_var(D.walk_d(spark, sf).select("symbol").distinct().selectExpr("symbol", "1 / 6.0D AS w"), pairs(spark, sf), S.agg(R.daily_returns(D.walk_d(spark, sf)), ["symbol"], {"vol": "stddev_samp(ret)"}), 1000000.0)
)
q("correlation_gate", "symbol avg_corr:5 allowed:b", "WITH h AS (SELECT b AS symbol, corr FROM cpair WHERE a IN ('AF', 'AO') AND b NOT IN ('AF', 'AO')) SELECT symbol, avg(corr) AS avg_corr, avg(corr) <= 0.6 AS allowed FROM h GROUP BY 1", "cpair")(
    lambda spark, sf: S.agg(pairs(spark, sf).where("a IN ('AF', 'AO') AND b NOT IN ('AF', 'AO')").selectExpr("b AS symbol", "corr"), ["symbol"], {"avg_corr": "avg(corr)", "allowed": "avg(corr) <= 0.6"})
)
q("symbol_risk_contribution", "symbol share:5 mean_abs_corr:5", "WITH s AS (SELECT symbol, abs(sum(net)) AS v FROM evt GROUP BY 1), c AS (SELECT symbol, avg(abs(corr)) AS mc FROM (SELECT a AS symbol, corr FROM cpair UNION ALL SELECT b, corr FROM cpair) GROUP BY 1) SELECT symbol, v / sum(v) OVER () AS share, mc AS mean_abs_corr FROM s JOIN c USING (symbol)", "evt", "cpair")(
    lambda spark, sf: S.agg(events(spark, sf), ["symbol"], {"v": "abs(sum(net))"}).join(S.agg(pairs(spark, sf).selectExpr("corr", "explode(array(a, b)) AS symbol"), ["symbol"], {"mean_abs_corr": "avg(abs(corr))"}), "symbol").selectExpr("symbol", "v / sum(v) OVER () AS share", "mean_abs_corr")
)
q(
    "rolling_drawdown", "symbol worst_23:6 worst_250:6", "SELECT symbol, min(close / m23 - 1) AS worst_23, min(close / m250 - 1) AS worst_250 FROM (SELECT symbol, close, CASE WHEN rn >= 22 THEN max(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 22 PRECEDING AND CURRENT ROW) END AS m23, CASE WHEN rn >= 249 THEN max(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) END AS m250 FROM wb) GROUP BY 1", "wb",
)(lambda spark, sf: S.agg(P.own_rows(P.add(P.chunked(D.walk_d(spark, sf), 250), {"m23": P.rolling("max(close)", 23), "m250": P.rolling("max(close)", 250)})), ["symbol"], {"worst_23": "min(close / m23 - 1)", "worst_250": "min(close / m250 - 1)"}))
_CR = "ts >= DATE '1998-03-01' AND ts < DATE '1998-07-01'"


@q(
    "crisis_statistics", "symbol vol_mult:5 n:i max_dd:6",
    """WITH c AS (SELECT symbol, ts, close / max(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS fall FROM wb WHERE ts >= DATE '1998-03-01' AND ts < DATE '1998-07-01'), x AS (SELECT symbol, min(fall) AS max_dd FROM c GROUP BY 1)
    SELECT symbol, stddev_samp(ret) FILTER (WHERE ts >= DATE '1998-03-01' AND ts < DATE '1998-07-01') / stddev_samp(ret) FILTER (WHERE ts >= DATE '1997-11-01' AND ts < DATE '1998-03-01') AS vol_mult,
      count(ret) FILTER (WHERE ts >= DATE '1998-03-01' AND ts < DATE '1998-07-01') AS n, any_value(max_dd) AS max_dd FROM dret LEFT JOIN x USING (symbol) GROUP BY 1""", "dret", "wb",
)
def crisis_statistics(spark, sf):
    """Volatility in a crisis against the months before it, and the largest fall from a high inside it."""
    w = D.walk_d(spark, sf)
    d = S.agg(R.daily_returns(w), ["symbol"], {"vol_mult": f"stddev_samp(CASE WHEN {_CR} THEN ret END) / stddev_samp(CASE WHEN ts >= DATE '1997-11-01' AND ts < DATE '1998-03-01' THEN ret END)", "n": f"count(CASE WHEN {_CR} THEN ret END)"})
    # a crisis is a few months of a symbol
    falls = P.add(w.where(_CR), {"fall": "close / max(close) OVER (PARTITION BY symbol ORDER BY ts) - 1"})
    return d.join(S.agg(falls, ["symbol"], {"max_dd": "min(fall)"}), "symbol", "left")


# ---- limits and selection --------------------------------------------------------------------------
q(
    "loss_limits", "day:d n:i pnl:2 daily_halt:b weekly_halt:b",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderdate AS ts, o_orderkey AS seq, 25.0 * (o_orderkey % 401 - 200) AS pnl FROM orders), r AS (SELECT *, sum(pnl) OVER (PARTITION BY day ORDER BY ts, seq) AS rd, sum(pnl) OVER (PARTITION BY week ORDER BY day, ts, seq) AS rw FROM d),
    h AS (SELECT week, day, count(*) AS n, sum(pnl) AS pnl, min(rd) <= -5000 AS dh, min(rw) <= -10000 AS wh FROM r GROUP BY 1, 2) SELECT day, n, pnl, dh AS daily_halt, bool_or(wh) OVER (PARTITION BY week ORDER BY day) AS weekly_halt FROM h""",
)(lambda spark, sf: R.loss_limits(D.table(spark, sf, "orders").selectExpr("o_orderdate AS ts", "o_orderkey AS seq", "25.0D * (o_orderkey % 401 - 200) AS pnl"), 250000.0))


@q(
    "portfolio_order_selection", "pass_id:d symbol ev:4 decision",
    """WITH RECURSIVE c AS (SELECT ts AS pass_id, symbol, confidence AS ev, [substr(symbol, 1, 1), substr(symbol, 2, 1)] AS cl, row_number() OVER (PARTITION BY ts ORDER BY confidence DESC, symbol) AS k FROM cand),
    r AS (SELECT pass_id, symbol, ev, k, 'kept' AS decision, 1 AS n, 0.01::DOUBLE AS heat, cl AS used FROM c WHERE k = 1 UNION ALL
      SELECT c.pass_id, c.symbol, c.ev, c.k, d.decision, r.n + CASE WHEN d.decision = 'kept' THEN 1 ELSE 0 END, r.heat + CASE WHEN d.decision = 'kept' THEN 0.01 ELSE 0 END, CASE WHEN d.decision = 'kept' THEN list_concat(r.used, c.cl) ELSE r.used END
      FROM r JOIN c ON c.pass_id = r.pass_id AND c.k = r.k + 1, LATERAL (SELECT CASE WHEN r.n >= 6 THEN 'max concurrent' WHEN list_has_any(r.used, c.cl) THEN 'cluster cap' WHEN r.heat + 0.01 > 0.04 + 1e-12 THEN 'heat' ELSE 'kept' END AS decision) d)
    SELECT * FROM r""", "cand",
)
def portfolio_order_selection(spark, sf):
    """One pass per bar date over the classified candidates."""
    from .statistics import candidates

    c = candidates(spark, sf).selectExpr("ts AS pass_id", "symbol", "confidence AS ev", "0.01D AS risk_frac", "array(substr(symbol, 1, 1), substr(symbol, 2, 1)) AS clusters")
    return R.select_orders(c)


# ---- fundamentals: part rows stand in as instruments ---------------------------------------------
_FU = {
    "symbol": "p_partkey", "pe": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 50 END", "ev_ebitda": "p_size / 2e0", "pb": "(p_partkey % 130) / 10e0",
    "roe_pct": "p_size - 10.0", "debt_to_equity": "(p_partkey % 37) / 15e0", "mom_12m": "(p_partkey % 201) - 100.0",
}
cte("fund", "SELECT " + ", ".join(f"CAST({v} AS {'BIGINT' if k == 'symbol' else 'DOUBLE'}) AS {k}" for k, v in _FU.items()) + " FROM part")


def fund(spark, sf):
    return D.table(spark, sf, "part").selectExpr(*[f"cast({v} AS {'bigint' if k == 'symbol' else 'double'}) AS {k}" for k, v in _FU.items()])


_VQ = {**E.VALUE_PARTS, **E.QUALITY_PARTS}
q("value_quality_scores", "symbol:i value_score:4 quality_score:4", f"SELECT symbol, {E.VALUE} AS value_score, {E.QUALITY} AS quality_score FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _VQ.items())} FROM fund)", "fund")(
    lambda spark, sf: P.add(P.add(fund(spark, sf), _VQ), {"value_score": E.VALUE, "quality_score": E.QUALITY})
)
_FF = ["pe", "ev_ebitda", "pb", "roe_pct", "debt_to_equity", "mom_12m"]
cte("fmod", "WITH w AS (SELECT symbol, " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, (SELECT quantile_cont({f}, 0.01) FROM fund)), (SELECT quantile_cont({f}, 0.99) FROM fund)) END AS {f}" for f in _FF) + " FROM fund), z AS (SELECT symbol, " + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z_{f}" for f in _FF) + f""" FROM w),
 c AS (SELECT symbol, {', '.join(f"greatest(0, least(100, 50 + 25 * ({E._mean([f'({s} * z_{f})' for f, s in fs])}))) AS {k}_score" for k, (fs, _) in E.FACTORS.items())} FROM z) SELECT *, (0.33 * value_score + 0.33 * quality_score + 0.34 * momentum_score) / (0.33 + 0.33 + 0.34) AS composite FROM c""", "fund")
q("factor_model", "symbol:i value_score:4 quality_score:4 momentum_score:4 composite:4", "SELECT * FROM fmod", "fmod")(lambda spark, sf: E.factor_scores(fund(spark, sf)))
@q(
    "equity_ranking", "symbol:i composite:4 rank:i",
    "SELECT symbol, composite, row_number() OVER (ORDER BY round(composite, 9) DESC NULLS LAST, round(momentum_score, 9) DESC NULLS LAST, symbol) AS rank FROM fmod", "fmod",
)
def equity_ranking(spark, sf):
    """The whole universe by composite score, then by the technical bias (momentum score)."""
    s = E.factor_scores(fund(spark, sf)).selectExpr("symbol", "composite", "round(composite, 9) AS _c", "round(momentum_score, 9) AS _t")
    return K.row_numbers(s, ["_c DESC NULLS LAST", "_t DESC NULLS LAST", "symbol"]).select("symbol", "composite", "rank")
_LBK = (21, 63, 126, 252)
q("momentum_score", "symbol score:4", f"SELECT symbol, {E.momentum_sql()} AS score FROM (SELECT *, {', '.join(f'(close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY rn) - 1) * 100 AS r{n}' for n in _LBK)} FROM f) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1", "f")(
    lambda spark, sf: P.add(P.latest(P.own_rows(P.add(P.with_halo(D.panel_d(spark, sf).select("symbol", "ts", "rn", "close", "rsi_14"), 252), {f"r{n}": f"(close / {P.lag('close', n)} - 1) * 100" for n in _LBK}))), {"score": E.momentum_sql()})
)
q("heatmap_scaling", "symbol rsi_14:5 adx:5 bias_score:5", "SELECT symbol, " + ", ".join(f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}" for c in ("rsi_14", "adx", "bias_score")) + " FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1)", "f")(
    lambda spark, sf: (lambda d: d.crossJoin(F.broadcast(S.agg(d, [], {f"{fn}_{c}": f"{fn}({c})" for c in ("rsi_14", "adx", "bias_score") for fn in ("min", "max")}))).selectExpr("symbol", *[f"({c} - min_{c}) / nullif(max_{c} - min_{c}, 0) AS {c}" for c in ("rsi_14", "adx", "bias_score")]))(P.latest(D.panel_d(spark, sf)).select("symbol", "rsi_14", "adx", "bias_score"))
)
q("comparison_series", "symbol ts:d rebased:4", "SELECT symbol, ts, 100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY rn) AS rebased FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS k FROM wb) WHERE k <= 250", "wb")(
    lambda spark, sf: (lambda t: t.join(F.broadcast(S.agg(t, ["symbol"], {"base": "min_by(close, ts)"})), "symbol").selectExpr("symbol", "ts", "100 * close / base AS rebased"))(P.last_n(D.walk_d(spark, sf).select("symbol", "ts", "close"), 250))
)
q("regime_distribution", "regime n:i mean_bias:5", "SELECT regime, count(*) AS n, avg(bias_score) AS mean_bias FROM f GROUP BY 1", "f")(lambda spark, sf: S.agg(D.panel_d(spark, sf), ["regime"], {"n": "count(*)", "mean_bias": "avg(bias_score)"}))

# ---- sentiment ------------------------------------------------------------------------------------
# letters and digits of any script, with their combining marks, belong to a word; this engine's \b knows ASCII only, and its lower() drops the dot of a capital I
_LOW = "lower(replace(text, chr(304), 'i' || chr(775)))"
_WHOLE = rf"regexp_replace(regexp_replace({_LOW}, '([\p{{L}}\p{{Nd}}])\p{{Mn}}+', '\1_', 'g'), '[^\P{{L}}\x00-\x7F]|[^\P{{Nd}}\x00-\x7F]', '_', 'g')"
_TOK = rf"regexp_extract_all({_WHOLE}, '\b[a-z''-]+\b')"
_PL, _NL = "[" + ", ".join(f"'{w}'" for w in T.POSITIVE) + "]", "[" + ", ".join(f"'{w}'" for w in T.NEGATIVE) + "]"
cte("sent", f"SELECT *, len(list_filter(tok, lambda w: list_contains({_PL}, w))) AS pos, len(list_filter(tok, lambda w: list_contains({_NL}, w))) AS neg FROM (SELECT *, {_TOK} AS tok FROM documents)")
q("lexicon_sentiment", "doc_id:i pos:i neg:i score:4", f"SELECT *, {T.band('pos', 'neg')} AS score FROM sent", "sent")(lambda spark, sf: P.add(T.hits(D.table(spark, sf, "documents")), {"score": T.band("pos", "neg")}))
_WT = "CASE WHEN n_chars < 500 THEN 1.0 WHEN n_chars < 5000 THEN 0.8 ELSE 0.3 END"
q("weighted_sentiment", "source n:i score:4 confidence:4", f"SELECT source, count(*) AS n, {T.band(f'sum({_WT} * pos)', f'sum({_WT} * neg)')} AS score, least(1, sum({_WT}) / 5) AS confidence FROM sent GROUP BY 1", "sent")(lambda spark, sf: T.weighted_sentiment(D.table(spark, sf, "documents"), "source", _WT))
