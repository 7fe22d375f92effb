"""Queries: aggregate statistics over returns, outcomes, trades and probabilities."""

from ..operators import outcomes as O
from ..operators import panel as P
from ..operators import ranking as K
from ..operators import research as X
from ..operators import resampling as B
from ..operators import setups as U
from ..operators import stats as S
from ..sources import derive as D
from ..sources.store import stored
from . import sql_base  # noqa: F401
from .outcomes import _paths, trades
from .registry import cte, query, sel, show, sql_with

WD = "(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
LG = "lag(close, {0}) OVER (PARTITION BY symbol ORDER BY rn)"
cte(
    "rs0",
    f"""SELECT *, close - sma_200 AS dist, CASE WHEN close > {LG.format(1)} THEN 1 ELSE 0 END AS up_, CASE WHEN close < {LG.format(1)} THEN 1 ELSE 0 END AS dn_,
  CASE WHEN count(atr_14) OVER {WD.format(19)} = 20 THEN round(avg(atr_14) OVER {WD.format(19)}, 9) END AS atr20,
  close / {LG.format(5)} - 1 AS ret_5, close / {LG.format(10)} - 1 AS ret_10, close / {LG.format(20)} - 1 AS ret_20,
  (close - {LG.format(5)}) / nullif(atr_14, 0) AS move5,
  {', '.join(f'(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY rn) - close) / nullif(1.25 * atr_14, 0) AS fwd{h}_r' for h in X.HORIZONS)}
 FROM f""",
    "f",
)
cte(
    "rs",
    f"""SELECT *, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in X.TRIGGERS.items())}, {X.VOL_BUCKET} AS vol_bucket FROM (
 SELECT *, (close / nullif(sma_200, 0) - 1) * 100 AS dist_pct, dist / nullif(atr_14, 0) AS dist_atr, (close / nullif(sma_20, 0) - 1) * 100 AS sma20_gap,
  CASE WHEN count(dist) OVER {WD.format(99)} >= 60 THEN dist / nullif(stddev_samp(dist) OVER {WD.format(99)}, 0) END AS dist_z,
  CASE WHEN rn >= 4 THEN sum(up_) OVER {WD.format(4)} END AS streak5p, CASE WHEN rn >= 4 THEN sum(dn_) OVER {WD.format(4)} END AS streak5n,
  CASE WHEN count(dist) OVER {WD.format(249)} >= 150 AND dist IS NOT NULL THEN CAST(len(list_filter(list(dist) OVER {WD.format(249)}, lambda v: v <= dist)) AS DOUBLE) / least(rn + 1, 250) END AS dist_rank,
  CASE WHEN count(atr20) OVER {WD.format(249)} = 250 THEN (len(list_filter(list(atr20) OVER {WD.format(249)}, lambda v: v < atr20)) + (len(list_filter(list(atr20) OVER {WD.format(249)}, lambda v: v = atr20)) + 1) / 2.0) / 250 END AS vol_pct
 FROM rs0)""",
    "rs0",
)
cte("rk", f"SELECT *, {X.kofn(X.LONG3)} AS long_score, {X.kofn(X.SHORT3)} AS short_score FROM rs", "rs")
cte(
    "pool",
    " UNION ALL ".join(f"SELECT symbol, ts, rn, regime, vol_bucket, dist_pct, dist_z, rsi_14, ret_5, ret_20, long_score, short_score, {h} AS horizon, fwd{h}_r AS fwd FROM rk WHERE fwd{h}_r IS NOT NULL" for h in X.HORIZONS),
    "rk",
)


def q(name, spec, body, *deps):
    """Register with the projection on both sides; the function returns the unprojected frame."""

    def deco(fn):
        query(name, sql_with(f"SELECT {sel(spec)} FROM ({body})", *deps))(lambda spark, sf: show(fn(spark, sf), spec))
        return fn

    return deco


def R(spark, sf):
    return D.research_d(spark, sf)


def pool(spark, sf):
    return X.pooled(R(spark, sf), ("vol_bucket", "dist_pct", "dist_z", "rsi_14", "ret_5", "ret_20", "long_score", "short_score"))


TS = "avg({0}) / nullif(stddev_samp({0}) / sqrt(count({0})), 0)"

q("distance_features", "symbol ts:d dist_pct:5 dist_atr:5 dist_z:5 dist_rank:5", "SELECT * FROM rs", "rs")(R)
q("forward_returns", "symbol ts:d " + " ".join(f"fwd{h}_r:5" for h in X.HORIZONS), "SELECT * FROM rs", "rs")(R)
q("trigger_flags", "symbol ts:d streak5p:i streak5n:i move5:5 " + " ".join(f"{t}:b" for t in X.TRIGGERS), "SELECT * FROM rs WHERE rn >= 4", "rs")(
    lambda spark, sf: R(spark, sf).where("rn >= 4")
)
q("vol_bucket", "symbol ts:d vol_pct:5 vol_bucket", "SELECT * FROM rs", "rs")(R)
q("proxy_features", "symbol ts:d ret_5:6 ret_10:6 ret_20:6 sma20_gap:5", "SELECT * FROM rs", "rs")(R)
q("risk_proxy", "symbol ts:d risk:5", "SELECT *, move5 AS risk FROM rs", "rs")(lambda spark, sf: X.risk_proxy(D.panel_d(spark, sf)))
_MASKS = ["long_k2", "short_k2", *X.FAMILIES]
_MEX = {"long_k2": "long_score >= 2", "short_k2": "short_score >= 2", **{k: " AND ".join(v) for k, v in X.FAMILIES.items()}}
q("family_masks", "symbol ts:d long_score:i short_score:i " + " ".join(f"{m}:b" for m in _MASKS), f"SELECT *, {', '.join(f'{e} AS {m}' for m, e in _MEX.items())} FROM rk", "rk")(
    lambda spark, sf: P.add(R(spark, sf), _MEX)
)

# ---- edges -------------------------------------------------------------------------------------
_UE = {"n": "count(fwd)", "mean": "avg(fwd)", "hit": "avg(CASE WHEN fwd > 0 THEN 1e0 ELSE 0 END)", "t": TS.format("fwd")}


def _cols(d):
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


@q(
    "unconditional_edge", "horizon:i symbol regime n:i mean:5 hit:5 t:4",
    f"""SELECT horizon, CASE WHEN grouping(symbol) = 1 THEN 'ALL' ELSE symbol END AS symbol, CASE WHEN grouping(regime) = 1 THEN 'ALL' ELSE regime END AS regime, {_cols(_UE)}
    FROM pool GROUP BY GROUPING SETS ((horizon), (horizon, symbol), (horizon, regime))""", "pool",
)
def unconditional_edge(spark, sf):
    d = pool(spark, sf).selectExpr("symbol", "regime", "cast(horizon as string) AS horizon", "fwd")
    return S.grouping_sets(d, [["horizon"], ["horizon", "symbol"], ["horizon", "regime"]], _UE)


@q("median_forward_return", "horizon:i p25:5 median:5 p75:5", "SELECT horizon, quantile_cont(fwd, 0.25) AS p25, quantile_cont(fwd, 0.5) AS median, quantile_cont(fwd, 0.75) AS p75 FROM pool GROUP BY 1", "pool")
def median_forward_return(spark, sf):
    return K.quantiles(pool(spark, sf), ["horizon"], "fwd", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@q(
    "flat_base_rates", "threshold:2 p_up:5 p_down:5 p_flat:5",
    "SELECT threshold, avg(CASE WHEN fwd > threshold THEN 1e0 ELSE 0 END) AS p_up, avg(CASE WHEN fwd < -threshold THEN 1e0 ELSE 0 END) AS p_down, avg(CASE WHEN abs(fwd) <= threshold THEN 1e0 ELSE 0 END) AS p_flat FROM pool, (VALUES (0.25), (0.5), (1.0), (1.5)) v(threshold) WHERE horizon = 10 GROUP BY 1",
    "pool",
)
def flat_base_rates(spark, sf):
    d = pool(spark, sf).where("horizon = 10").selectExpr("fwd", "explode(array(0.25D, 0.5D, 1.0D, 1.5D)) AS threshold")
    return S.agg(d, ["threshold"], {"p_up": "avg(CASE WHEN fwd > threshold THEN 1e0 ELSE 0 END)", "p_down": "avg(CASE WHEN fwd < -threshold THEN 1e0 ELSE 0 END)", "p_flat": "avg(CASE WHEN abs(fwd) <= threshold THEN 1e0 ELSE 0 END)"})


@q("label_entropy", "horizon:i p_up:6 entropy:6 always_long:6", "SELECT horizon, p_up, -(p_up * log2(p_up) + (1 - p_up) * log2(1 - p_up)) AS entropy, greatest(p_up, 1 - p_up) AS always_long FROM (SELECT horizon, avg(CASE WHEN fwd > 0 THEN 1e0 ELSE 0 END) AS p_up FROM pool GROUP BY 1)", "pool")
def label_entropy(spark, sf):
    d = S.agg(pool(spark, sf), ["horizon"], {"p_up": "avg(CASE WHEN fwd > 0 THEN 1e0 ELSE 0 END)"})
    return d.selectExpr("*", "-(p_up * log2(p_up) + (1 - p_up) * log2(1 - p_up)) AS entropy", "greatest(p_up, 1 - p_up) AS always_long")


# strategy -> position on the bar; the random one draws from the bar ordinal
_STRAT = {
    "long": "1", "short": "-1", "alternate": "CASE WHEN rn % 2 = 0 THEN 1 ELSE -1 END",
    "sma200": "CASE WHEN close > sma_200 THEN 1 WHEN close < sma_200 THEN -1 ELSE 0 END",
    "momentum20": "CASE WHEN ret_20 > 0 THEN 1 WHEN ret_20 < 0 THEN -1 ELSE 0 END",
    "fade5": "CASE WHEN ret_5 > 0 THEN -1 WHEN ret_5 < 0 THEN 1 ELSE 0 END",
    "random": f"CASE WHEN {B.unit('rn', 'rn * 31 + 7', 3)} < 0.5 THEN 1 ELSE -1 END",
    "donchian": "CASE WHEN close >= hi20 THEN 1 WHEN close <= lo20 THEN -1 ELSE 0 END",
}
_BS = {"n": "count(*)", "gross": "avg(pos * fwd10_r)", "net": "avg(pos * fwd10_r) - 0.05", "hit": "avg(CASE WHEN pos * fwd10_r > 0 THEN 1e0 ELSE 0 END)"}
_BSS = " UNION ALL ".join(f"SELECT '{k}' AS strategy, {v} AS pos, fwd10_r FROM d" for k, v in _STRAT.items())


@q(
    "baseline_strategies", "strategy n:i gross:5 net:5 hit:5",
    f"""WITH d AS (SELECT *, max(close) OVER {WD.format(19)} AS hi20, min(close) OVER {WD.format(19)} AS lo20 FROM rk), s AS ({_BSS})
    SELECT strategy, {_cols(_BS)} FROM s WHERE pos <> 0 AND fwd10_r IS NOT NULL GROUP BY 1""", "rk",
)
def baseline_strategies(spark, sf):
    h = P.with_halo(R(spark, sf).select("symbol", "rn", "close", "sma_200", "ret_20", "ret_5", "fwd10_r"), 19)
    h = P.own_rows(P.add(h, {"hi20": f"max(close) {P.over(19)}", "lo20": f"min(close) {P.over(19)}"}))
    items = ", ".join(f"'{k}', {v}" for k, v in _STRAT.items())
    d = h.selectExpr("fwd10_r", f"stack({len(_STRAT)}, {items}) AS (strategy, pos)").where("pos <> 0 AND fwd10_r IS NOT NULL")
    return S.agg(d, ["strategy"], _BS)


# ---- rank information -------------------------------------------------------------------------
_AVGR = "(rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0)"


@q(
    "cross_sectional_ic", "n_days:i mean_ic:5 t_ic:4 spread:5 t_spread:4",
    f"""WITH r AS (SELECT ts, fwd10_r, {_AVGR.format(g='ts', x='ret_20')} AS rx, {_AVGR.format(g='ts', x='fwd10_r')} AS ry, count(*) OVER (PARTITION BY ts) AS n FROM rk WHERE ret_20 IS NOT NULL AND fwd10_r IS NOT NULL),
    d AS (SELECT ts, corr(rx, ry) AS ic, avg(CASE WHEN rx > n * 2 / 3.0 THEN fwd10_r END) - avg(CASE WHEN rx <= n / 3.0 THEN fwd10_r END) AS spread FROM r WHERE n >= 5 GROUP BY 1)
    SELECT count(ic) AS n_days, avg(ic) AS mean_ic, {TS.format('ic')} AS t_ic, avg(spread) AS spread, {TS.format('spread')} AS t_spread FROM d WHERE NOT isnan(ic)""", "rk",
)
def cross_sectional_ic(spark, sf):
    """Daily Spearman of momentum against the forward return and the tercile spread.

    A day holds one row per symbol, so the per-day window is small whatever the history.
    """
    d = R(spark, sf).where("ret_20 IS NOT NULL AND fwd10_r IS NOT NULL").select("ts", "ret_20", "fwd10_r")
    r = d.selectExpr("ts", "fwd10_r", f"{_AVGR.format(g='ts', x='ret_20')} AS rx", f"{_AVGR.format(g='ts', x='fwd10_r')} AS ry", "count(*) OVER (PARTITION BY ts) AS n")
    day = S.agg(r.where("n >= 5"), ["ts"], {"ic": "corr(rx, ry)", "spread": "avg(CASE WHEN rx > n * 2 / 3.0 THEN fwd10_r END) - avg(CASE WHEN rx <= n / 3.0 THEN fwd10_r END)"})
    return S.agg(day.where("ic IS NOT NULL AND NOT isnan(ic)"), [], {"n_days": "count(ic)", "mean_ic": "avg(ic)", "t_ic": TS.format("ic"), "spread": "avg(spread)", "t_spread": TS.format("spread")})


@q(
    "basket_alpha", "basket symbol n:i ic:5 mean_alpha:5",
    f"""WITH m AS (SELECT substr(symbol, 1, 1) AS basket, * FROM rk WHERE ret_20 IS NOT NULL AND fwd10_r IS NOT NULL UNION ALL SELECT 'line_' || substr(symbol, 2, 1), * FROM rk WHERE ret_20 IS NOT NULL AND fwd10_r IS NOT NULL),
    a AS (SELECT basket, symbol, ret_20 - avg(ret_20) OVER w AS x, fwd10_r - avg(fwd10_r) OVER w AS y FROM m WINDOW w AS (PARTITION BY basket, ts)),
    r AS (SELECT *, {_AVGR.format(g='basket, symbol', x='x')} AS rx, {_AVGR.format(g='basket, symbol', x='y')} AS ry FROM a)
    SELECT basket, symbol, count(*) AS n, corr(rx, ry) AS ic, avg(y) AS mean_alpha FROM r GROUP BY 1, 2""", "rk",
)
def basket_alpha(spark, sf):
    """Symbol minus basket mean on each day; the basket-day means are a plain aggregate joined back."""
    d = R(spark, sf).where("ret_20 IS NOT NULL AND fwd10_r IS NOT NULL").selectExpr(
        "symbol", "ts", "ret_20", "fwd10_r", "explode(array(substr(symbol, 1, 1), concat('line_', substr(symbol, 2, 1)))) AS basket"
    )
    m = S.agg(d, ["basket", "ts"], {"_mx": "avg(ret_20)", "_my": "avg(fwd10_r)"})
    a = d.join(m, ["basket", "ts"]).selectExpr("basket", "symbol", "round(ret_20 - _mx, 12) AS x", "round(fwd10_r - _my, 12) AS y")
    ic = K.rank_corr(a, ["basket", "symbol"], "x", "y")
    return ic.join(S.agg(a, ["basket", "symbol"], {"mean_alpha": "avg(y)"}), ["basket", "symbol"])


_FEATS = ["dist_pct", "dist_z", "rsi_14", "ret_5", "ret_20"]
_FST = ", ".join(f"'{f}', {f}" for f in _FEATS)
_FSQ = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, horizon, fwd, ts, rn, regime FROM pool WHERE {f} IS NOT NULL" for f in _FEATS)


@q(
    "horizon_ic_curve", "feature horizon:i n:i ic:5",
    f"""WITH s AS ({_FSQ}), r AS (SELECT feature, horizon, {_AVGR.format(g='feature, horizon', x='x')} AS rx, {_AVGR.format(g='feature, horizon', x='fwd')} AS ry FROM s)
    SELECT feature, horizon, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY 1, 2""", "pool",
)
def horizon_ic_curve(spark, sf):
    s = pool(spark, sf).selectExpr("horizon", "fwd", f"stack({len(_FEATS)}, {_FST}) AS (feature, x)").where("x IS NOT NULL")
    return K.rank_corr(s, ["feature", "horizon"], "x", "fwd")


@q(
    "feature_audit", "feature n:i ic:5 p:5 ic_early:5 ic_late:5 hit_spread:5 q_adj:5 bh_pass:b",
    f"""WITH s AS (SELECT * FROM ({_FSQ}) WHERE horizon = 10), md AS (SELECT feature, median(x) AS md FROM s GROUP BY 1),
    g AS (SELECT *, CASE WHEN ts < DATE '1998-07-01' THEN 'early' ELSE 'late' END AS half FROM s),
    r AS (SELECT feature, {_AVGR.format(g='feature', x='x')} AS rx, {_AVGR.format(g='feature', x='fwd')} AS ry, half, {_AVGR.format(g='feature, half', x='x')} AS hx, {_AVGR.format(g='feature, half', x='fwd')} AS hy, x, fwd FROM g),
    a AS (SELECT feature, count(*) AS n, corr(rx, ry) AS ic, corr(CASE WHEN half = 'early' THEN hx END, CASE WHEN half = 'early' THEN hy END) AS ic_early, corr(CASE WHEN half = 'late' THEN hx END, CASE WHEN half = 'late' THEN hy END) AS ic_late,
      avg(CASE WHEN x > md THEN CASE WHEN fwd > 0 THEN 1e0 ELSE 0 END END) - avg(CASE WHEN x <= md THEN CASE WHEN fwd > 0 THEN 1e0 ELSE 0 END END) AS hit_spread FROM r JOIN md USING (feature) GROUP BY 1),
    p AS (SELECT *, {S.two_sided_p('(ic * sqrt((n - 2) / (1 - ic * ic)))')} AS p FROM a), k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p),
    z AS (SELECT *, least(min(p * m / r) OVER (ORDER BY p, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_adj FROM k)
    SELECT *, q_adj <= 0.10 AS bh_pass FROM z""", "pool",
)
def feature_audit(spark, sf):
    s = pool(spark, sf).where("horizon = 10").selectExpr("ts", "fwd", f"stack({len(_FEATS)}, {_FST}) AS (feature, x)").where("x IS NOT NULL")
    s = P.add(s, {"half": "CASE WHEN ts < DATE '1998-07-01' THEN 'early' ELSE 'late' END"})
    ic = K.rank_corr(s, ["feature"], "x", "fwd")
    halves = K.rank_corr(s, ["feature", "half"], "x", "fwd")
    h = S.agg(halves, ["feature"], {"ic_early": "max(CASE WHEN half = 'early' THEN ic END)", "ic_late": "max(CASE WHEN half = 'late' THEN ic END)"})
    md = K.quantiles(s, ["feature"], "x", {"md": 0.5})
    win = "CASE WHEN fwd > 0 THEN 1e0 ELSE 0 END"
    sp = S.agg(s.join(md, "feature"), ["feature"], {"hit_spread": f"avg(CASE WHEN x > md THEN {win} END) - avg(CASE WHEN x <= md THEN {win} END)"})
    d = P.add(ic.join(h, "feature").join(sp, "feature"), {"p": S.two_sided_p("(ic * sqrt((n - 2) / (1 - ic * ic)))")})
    return S.bh_fdr(d)


@q(
    "monotonicity_deciles", "decile:i n:i dist_mean:5 fwd_mean:5",
    """WITH d AS (SELECT dist_pct, fwd FROM pool WHERE horizon = 10 AND dist_pct IS NOT NULL), e AS (SELECT quantile_cont(dist_pct, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM d)
    SELECT len(list_filter(e, lambda v: v < dist_pct)) + 1 AS decile, count(*) AS n, avg(dist_pct) AS dist_mean, avg(fwd) AS fwd_mean FROM d, e GROUP BY 1""", "pool",
)
def monotonicity_deciles(spark, sf):
    """Right-closed quantile bins of the distance against the mean forward return."""
    d = pool(spark, sf).where("horizon = 10 AND dist_pct IS NOT NULL").select("dist_pct", "fwd")
    from pyspark.sql import functions as F

    e = K.quantiles(d, [], "dist_pct", {f"e{i}": i / 10 for i in range(1, 10)})
    below = " + ".join(f"CASE WHEN e{i} < dist_pct THEN 1 ELSE 0 END" for i in range(1, 10))
    b = d.crossJoin(F.broadcast(e)).selectExpr("dist_pct", "fwd", f"{below} + 1 AS decile")
    return S.agg(b, ["decile"], {"n": "count(*)", "dist_mean": "avg(dist_pct)", "fwd_mean": "avg(fwd)"})


@q(
    "symbol_heterogeneity", "symbol n:i ic:5 rule_n:i rule_mean:5",
    f"""WITH r AS (SELECT symbol, {_AVGR.format(g='symbol', x='dist_pct')} AS rx, {_AVGR.format(g='symbol', x='fwd10_r')} AS ry, CASE WHEN long_score >= 2 THEN fwd10_r END AS rl FROM rk WHERE dist_pct IS NOT NULL AND fwd10_r IS NOT NULL)
    SELECT symbol, count(*) AS n, corr(rx, ry) AS ic, count(rl) AS rule_n, avg(rl) AS rule_mean FROM r GROUP BY 1""", "rk",
)
def symbol_heterogeneity(spark, sf):
    d = R(spark, sf).where("dist_pct IS NOT NULL AND fwd10_r IS NOT NULL")
    rule = "CASE WHEN long_score >= 2 THEN fwd10_r END"
    return K.rank_corr(d, ["symbol"], "dist_pct", "fwd10_r").join(S.agg(d, ["symbol"], {"rule_n": f"count({rule})", "rule_mean": f"avg({rule})"}), "symbol")


@q(
    "risk_timing", "risk_state n:i ic:5",
    f"""WITH m AS (SELECT ts, avg(move5) AS rk FROM rk WHERE symbol IN ('AO', 'NO') AND move5 IS NOT NULL GROUP BY 1), j AS (SELECT d.dist_pct, d.fwd10_r, CASE WHEN m.rk > 0 THEN 'on' ELSE 'off' END AS risk_state FROM rk d JOIN m ON m.ts = d.ts - INTERVAL 1 DAY WHERE dist_pct IS NOT NULL AND fwd10_r IS NOT NULL),
    r AS (SELECT risk_state, {_AVGR.format(g='risk_state', x='dist_pct')} AS rx, {_AVGR.format(g='risk_state', x='fwd10_r')} AS ry FROM j) SELECT risk_state, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY 1""", "rk",
)
def risk_timing(spark, sf):
    """Rank IC split by the sign of the one-day-lagged mean risk proxy of two symbols."""
    d = R(spark, sf)
    m = S.agg(d.where("symbol IN ('AO', 'NO') AND move5 IS NOT NULL"), ["ts"], {"rk": "avg(move5)"}).selectExpr("date_add(ts, 1) AS ts", "CASE WHEN rk > 0 THEN 'on' ELSE 'off' END AS risk_state")
    return K.rank_corr(d.select("ts", "dist_pct", "fwd10_r").join(m, "ts"), ["risk_state"], "dist_pct", "fwd10_r")


# ---- rules ------------------------------------------------------------------------------------
_TRAIN = "ts < DATE '1998-07-01'"
_RULE = {"n": "count(*)", "mean": "avg(sg * fwd10_r)", "net": "avg(sg * fwd10_r) - 0.05", "win": "avg(CASE WHEN sg * fwd10_r > 0 THEN 1e0 ELSE 0 END)"}


@q(
    "rule_evaluation", "direction k:i part n:i mean:5 net:5 win:5",
    f"""WITH g AS (SELECT *, CASE WHEN {_TRAIN} THEN 'train' ELSE 'oos' END AS part FROM rk WHERE fwd10_r IS NOT NULL),
    s AS (SELECT 'long' AS direction, long_score AS sc, 1 AS sg, part, fwd10_r FROM g UNION ALL SELECT 'short', short_score, -1, part, fwd10_r FROM g)
    SELECT direction, k, part, {_cols(_RULE)} FROM s, (VALUES (1), (2), (3)) v(k) WHERE sc >= k GROUP BY 1, 2, 3""", "rk",
)
def rule_evaluation(spark, sf):
    d = R(spark, sf).where("fwd10_r IS NOT NULL").selectExpr("fwd10_r", f"CASE WHEN {_TRAIN} THEN 'train' ELSE 'oos' END AS part", "stack(2, 'long', long_score, 1, 'short', short_score, -1) AS (direction, sc, sg)")
    return S.agg(d.where("sc >= 1").selectExpr("*", "explode(sequence(1, sc)) AS k"), ["direction", "k", "part"], _RULE)


_GRID = [(v, t) for v in ("dist_pct", "dist_z") for t in (1.0, 2.0, 3.0, 4.0)]
_GSQL = ", ".join(f"('{v}', CAST({t} AS DOUBLE))" for v, t in _GRID)
_THR = {"n": "count(*)", "gross": "avg(sg * fwd10_r)"}


@q(
    "threshold_rule_selection", "side feature threshold:1 n_train:i gross_train:5 n_oos:i gross_oos:5",
    f"""WITH b AS (SELECT *, CASE WHEN {_TRAIN} THEN 'train' ELSE 'oos' END AS part FROM rk WHERE fwd10_r IS NOT NULL), g AS (SELECT * FROM (VALUES {_GSQL}) v(feature, threshold)),
    e AS (SELECT feature, threshold, part, side, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg, fwd10_r FROM b, g, (VALUES ('long'), ('short')) s(side)
      WHERE CASE side WHEN 'long' THEN CASE feature WHEN 'dist_pct' THEN dist_pct ELSE dist_z END < -threshold ELSE CASE feature WHEN 'dist_pct' THEN dist_pct ELSE dist_z END > threshold END),
    a AS (SELECT side, feature, threshold, part, {_cols(_THR)} FROM e GROUP BY 1, 2, 3, 4), t AS (SELECT * FROM a WHERE part = 'train' AND n >= 30 QUALIFY row_number() OVER (PARTITION BY side ORDER BY gross DESC, feature, threshold) = 1)
    SELECT t.side, t.feature, t.threshold, t.n AS n_train, t.gross AS gross_train, o.n AS n_oos, o.gross AS gross_oos FROM t LEFT JOIN (SELECT * FROM a WHERE part = 'oos') o USING (side, feature, threshold)""", "rk",
)
def threshold_rule_selection(spark, sf):
    """Threshold grid per side chosen on the training window only, reported out of sample."""
    grid = ", ".join(f"named_struct('feature', '{v}', 'threshold', {t}D, 'x', {v})" for v, t in _GRID)
    d = R(spark, sf).where("fwd10_r IS NOT NULL").selectExpr("fwd10_r", f"CASE WHEN {_TRAIN} THEN 'train' ELSE 'oos' END AS part", f"inline(array({grid}))")
    d = d.where("abs(x) > threshold").selectExpr("*", "CASE WHEN x < 0 THEN 'long' ELSE 'short' END AS side", "CASE WHEN x < 0 THEN 1 ELSE -1 END AS sg")
    a = S.agg(d, ["side", "feature", "threshold", "part"], _THR)
    t = S.agg(a.where("part = 'train' AND n >= 30"), ["side"], {"b": "min_by(struct(feature, threshold, n, gross), struct(-gross, feature, threshold))"}).selectExpr("side", "b.feature AS feature", "b.threshold AS threshold", "b.n AS n_train", "b.gross AS gross_train")
    o = a.where("part = 'oos'").selectExpr("side", "feature", "threshold", "n AS n_oos", "gross AS gross_oos")
    return t.join(o, ["side", "feature", "threshold"], "left")


_CDEF = {
    "rally_rsi": ("-1", "s_rsi70"), "rally_move": ("-1", "s_rally5"), "rally_streak": ("-1", "s_streak5"), "rally_rsi_move": ("-1", "s_rsi70 AND s_rally5"),
    "rally_dist2": ("-1", "dist_pct > 2 AND regime = 'Bear Trend'"), "hv_long": ("1", "vol_bucket = 'high' AND l_drop5"), "hv_rsi": ("1", "vol_bucket = 'high' AND l_rsi30"),
    "hv_short": ("-1", "vol_bucket = 'high' AND s_rally5"), "lv_long": ("1", "vol_bucket = 'low' AND l_drop5"),
}
_CT = {"n": "count(*)", "gross": "avg(g)", "net": "avg(g) - 0.05", "win": "avg(CASE WHEN g > 0 THEN 1e0 ELSE 0 END)", "break_even": "greatest(avg(g), 0)"}


@q(
    "conditional_signal_tables", "signal n:i gross:5 net:5 win:5 break_even:5",
    f"SELECT signal, {_cols(_CT)} FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS signal, {s} * fwd10_r AS g FROM rk WHERE fwd10_r IS NOT NULL AND {c}" for k, (s, c) in _CDEF.items()) + ") GROUP BY 1", "rk",
)
def conditional_signal_tables(spark, sf):
    items = ", ".join(f"'{k}', CASE WHEN {c} THEN {s} * fwd10_r END" for k, (s, c) in _CDEF.items())
    return S.agg(R(spark, sf).selectExpr(f"stack({len(_CDEF)}, {items}) AS (signal, g)").where("g IS NOT NULL"), ["signal"], _CT)


_COSTS = "(0.0), (0.05), (0.10), (0.15), (0.20), (0.30)"


@q(
    "cost_curve", "horizon:i cost:2 n:i gross:5 net:5 break_even:5",
    f"WITH e AS (SELECT horizon, count(*) AS n, avg(fwd) AS gross FROM pool WHERE long_score >= 2 GROUP BY 1) SELECT horizon, cost, n, gross, gross - cost AS net, greatest(gross, 0) AS break_even FROM e, (VALUES {_COSTS}) v(cost)", "pool",
)
def cost_curve(spark, sf):
    e = S.agg(pool(spark, sf).where("long_score >= 2"), ["horizon"], {"n": "count(*)", "gross": "avg(fwd)"})
    return e.selectExpr("*", "explode(array(0.0D, 0.05D, 0.10D, 0.15D, 0.20D, 0.30D)) AS cost").selectExpr("*", "gross - cost AS net", "greatest(gross, 0) AS break_even")


_CONF = {"reject_candle": "close > (high + low) / 2", "momentum_flip": "macd_hist > 0", "inside_band": "bb_pct_b BETWEEN 0 AND 1"}
_ANYL, _ANYS = "(l_rsi30 OR l_drop5 OR l_streak5)", "(s_rsi70 OR s_rally5 OR s_streak5)"


@q(
    "confirmation_filters", "side filter_name n:i gross:5 net:5 win:5 break_even:5",
    f"SELECT side, filter_name, {_cols(_CT)} FROM (" + " UNION ALL ".join(
        f"SELECT 'long' AS side, '{k}' AS filter_name, fwd10_r AS g FROM rk WHERE {_ANYL} AND {c} AND fwd10_r IS NOT NULL UNION ALL SELECT 'short', '{k}', -fwd10_r FROM rk WHERE {_ANYS} AND {'NOT (' + c + ')' if k != 'inside_band' else c} AND fwd10_r IS NOT NULL" for k, c in _CONF.items()
    ) + ") GROUP BY 1, 2", "rk",
)
def confirmation_filters(spark, sf):
    items = ", ".join(
        f"'long', '{k}', CASE WHEN {_ANYL} AND {c} THEN fwd10_r END, 'short', '{k}', CASE WHEN {_ANYS} AND {'NOT (' + c + ')' if k != 'inside_band' else c} THEN -fwd10_r END" for k, c in _CONF.items()
    )
    return S.agg(R(spark, sf).selectExpr(f"stack({2 * len(_CONF)}, {items}) AS (side, filter_name, g)").where("g IS NOT NULL"), ["side", "filter_name"], _CT)


# rule events: the two-of-three long rule with its forward return; r is the ten-bar R
_EVT = "long_score >= 2 AND fwd10_r IS NOT NULL"


def events(spark, sf):
    return R(spark, sf).where(_EVT).selectExpr("*", "fwd10_r AS r", "fwd10_r - 0.05 AS net")


cte("evt", f"SELECT *, fwd10_r AS r, fwd10_r - 0.05 AS net FROM rk WHERE {_EVT}", "rk")
_SS = S.series_stats("r")
_SSQ = _cols({k: v.replace("1.0D", "1.0").replace("0.0D", "0.0") for k, v in _SS.items()})
_SSP = "n:i mean:5 win:5 pf:5 sharpe:5 total:4"

q("trade_series_stats", f"symbol {_SSP}", f"SELECT symbol, {_SSQ} FROM evt GROUP BY 1", "evt")(lambda spark, sf: S.agg(events(spark, sf), ["symbol"], _SS))
q("untouched_window", _SSP, f"SELECT {_SSQ} FROM evt WHERE ts >= DATE '2000-07-01'", "evt")(lambda spark, sf: S.agg(events(spark, sf).where("ts >= DATE '2000-07-01'"), [], _SS))
_FOLDS = [("f1", "1995-01-01", "1998-01-01", "1999-01-01"), ("f2", "1995-01-01", "1999-01-01", "2000-01-01"), ("f3", "1995-01-01", "2000-01-01", "2001-01-01")]
_FSQL = ", ".join(f"('{n}', DATE '{a}', DATE '{b}', DATE '{c}')" for n, a, b, c in _FOLDS)


@q(
    "walk_forward_windows", f"fold part {_SSP}",
    f"""SELECT fold, part, {_SSQ} FROM (SELECT fold, CASE WHEN ts < te THEN 'train' ELSE 'test' END AS part, r FROM evt JOIN (VALUES {_FSQL}) v(fold, tr0, te, tend)
    ON (ts >= tr0 AND ts < te - INTERVAL 20 DAY) OR (ts >= te AND ts < tend)) GROUP BY 1, 2""", "evt",
)
def walk_forward_windows(spark, sf):
    """Train/test windows with a 20-day embargo; the fold table is a literal of three rows."""
    from pyspark.sql import functions as F

    folds = spark.createDataFrame(_FOLDS, "fold string, a string, b string, c string").selectExpr("fold", "date(a) AS tr", "date(b) AS te", "date(c) AS tend")
    d = events(spark, sf).join(F.broadcast(folds), F.expr("(ts >= tr AND ts < date_sub(te, 20)) OR (ts >= te AND ts < tend)"))
    return S.agg(d.selectExpr("fold", "CASE WHEN ts < te THEN 'train' ELSE 'test' END AS part", "r"), ["fold", "part"], _SS)


q("temporal_cohorts", f"cohort:i {_SSP}", f"SELECT year(ts) AS cohort, {_SSQ} FROM evt GROUP BY 1", "evt")(lambda spark, sf: S.agg(events(spark, sf).selectExpr("year(ts) AS cohort", "r"), ["cohort"], _SS))
_LBL = "CASE WHEN grouping({0}) = 1 THEN 'ALL' ELSE coalesce({0}, 'none') END AS {0}"


@q("regime_vol_matrix", f"regime vol_bucket {_SSP}", f"SELECT {_LBL.format('regime')}, {_LBL.format('vol_bucket')}, {_SSQ} FROM (SELECT regime, coalesce(vol_bucket, 'none') AS vol_bucket, r FROM evt) GROUP BY CUBE (regime, vol_bucket)", "evt")
def regime_vol_matrix(spark, sf):
    d = events(spark, sf).selectExpr("regime", "coalesce(vol_bucket, 'none') AS vol_bucket", "r")
    return S.grouping_sets(d, [["regime", "vol_bucket"], ["regime"], ["vol_bucket"], []], _SS)


_MB = {
    "vol_quintile": "concat('q', cast(cast(least(floor(coalesce(vol_pct, 0) * 5), 4) + 1 as int) as {s}))", "drop": "CASE WHEN move5 < -2 THEN 'deep' WHEN move5 < -1 THEN 'mid' ELSE 'shallow' END",
    "streak": "concat('s', cast(cast(streak5n as int) as {s}))", "leg": "substr(symbol, 1, 1)",
}


@q(
    "mechanism_buckets", f"bucket_kind bucket {_SSP}",
    f"SELECT bucket_kind, bucket, {_SSQ} FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS bucket_kind, {e.format(s='varchar')} AS bucket, r FROM evt" for k, e in _MB.items()) + ") GROUP BY 1, 2", "evt",
)
def mechanism_buckets(spark, sf):
    items = ", ".join(f"'{k}', {e.format(s='string')}" for k, e in _MB.items())
    return S.agg(events(spark, sf).selectExpr("r", f"stack({len(_MB)}, {items}) AS (bucket_kind, bucket)"), ["bucket_kind", "bucket"], _SS)


@q("leave_one_out", "symbol n:i mean:5 mean_without:5", "SELECT symbol, n, s / n AS mean, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS mean_without FROM (SELECT symbol, count(*) AS n, sum(r) AS s FROM evt GROUP BY 1)", "evt")
def leave_one_out(spark, sf):
    return S.leave_one_out(events(spark, sf), "symbol", "r")


_CL = "explode(array(substr(symbol, 1, 1), substr(symbol, 2, 1)))"
cte("cle", "SELECT substr(symbol, 1, 1) AS cluster, * FROM evt UNION ALL SELECT substr(symbol, 2, 1), * FROM evt", "evt")


@q("leave_one_cluster_out", "cluster n:i mean:5 mean_without:5", "SELECT c.cluster, c.n, c.s / c.n AS mean, (t.s - c.s) / (t.n - c.n) AS mean_without FROM (SELECT cluster, count(*) AS n, sum(r) AS s FROM cle GROUP BY 1) c, (SELECT count(*) AS n, sum(r) AS s FROM evt) t", "cle", "evt")
def leave_one_cluster_out(spark, sf):
    from pyspark.sql import functions as F

    e = events(spark, sf)
    c = S.agg(e.selectExpr("r", f"{_CL} AS cluster"), ["cluster"], {"n": "count(*)", "s": "sum(r)"})
    t = S.agg(e, [], {"tn": "count(*)", "tsum": "sum(r)"})
    return c.crossJoin(F.broadcast(t)).selectExpr("cluster", "n", "s / n AS mean", "(tsum - s) / (tn - n) AS mean_without")


@q("concentration", "n_keys:i hhi:5 top1:5 top2:5 top10pct:5", "WITH a AS (SELECT symbol, abs(sum(net)) AS v FROM evt GROUP BY 1), s AS (SELECT symbol, v / sum(v) OVER () AS sh, row_number() OVER (ORDER BY v DESC, symbol) AS k, count(*) OVER () AS m FROM a) SELECT count(*) AS n_keys, sum(sh * sh) AS hhi, sum(sh) FILTER (WHERE k <= 1) AS top1, sum(sh) FILTER (WHERE k <= 2) AS top2, sum(sh) FILTER (WHERE k <= greatest(1, ceil(m * 0.1))) AS top10pct FROM s", "evt")
def concentration(spark, sf):
    return S.concentration(events(spark, sf), "symbol", "net")


@q("effective_sample", "raw_n:i days:i day_clusters:i", "SELECT (SELECT count(*) FROM evt) AS raw_n, (SELECT count(DISTINCT ts) FROM evt) AS days, (SELECT sum(least(n, c)) FROM (SELECT ts, count(DISTINCT symbol) AS n, count(DISTINCT cluster) AS c FROM cle GROUP BY 1)) AS day_clusters", "evt", "cle")
def effective_sample(spark, sf):
    """Raw rows, distinct days, and bets per day capped by the clusters that fired (never above the raw count)."""
    d = S.agg(events(spark, sf).selectExpr("ts", "symbol", f"{_CL} AS cluster"), ["ts"], {"n": "count(distinct symbol)", "c": "count(distinct cluster)", "rows": "count(*) / 2"})
    return S.agg(d, [], {"raw_n": "sum(rows)", "days": "count(*)", "day_clusters": "sum(least(n, c))"})


@q("cluster_statistics", "cluster n:i days:i win:5 mean:5 best_mean:5", "SELECT cluster, count(*) AS n, count(DISTINCT ts) AS days, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0 END) AS win, avg(r) AS mean, (SELECT avg(b) FROM (SELECT c2.ts, arg_max(r, (long_score, symbol)) AS b FROM cle c2 WHERE c2.cluster = cle.cluster GROUP BY 1)) AS best_mean FROM cle GROUP BY 1", "cle")
def cluster_statistics(spark, sf):
    """Per cluster statistics and the mean of one bet per day, picked by score (not by outcome)."""
    d = events(spark, sf).selectExpr("ts", "symbol", "r", "long_score", f"{_CL} AS cluster")
    day = S.agg(d, ["cluster", "ts"], {"_n": "count(*)", "_w": "sum(CASE WHEN r > 0 THEN 1 ELSE 0 END)", "_s": "sum(r)", "_b": "max_by(r, struct(long_score, symbol))"})
    return S.agg(day, ["cluster"], {"n": "sum(_n)", "days": "count(*)", "win": "sum(_w) / sum(_n)", "mean": "sum(_s) / sum(_n)", "best_mean": "avg(_b)"})


@q(
    "co_signal_overlap", "max_concurrent:i flat_share:5 multi_share:5 pair_days:i",
    "WITH d AS (SELECT ts, sum(CASE WHEN long_score >= 2 THEN 1 ELSE 0 END) AS k FROM rk GROUP BY 1) SELECT max(k) AS max_concurrent, avg(CASE WHEN k = 0 THEN 1e0 ELSE 0 END) AS flat_share, avg(CASE WHEN k > 1 THEN 1e0 ELSE 0 END) AS multi_share, sum(k * (k - 1) / 2) AS pair_days FROM d", "rk",
)
def co_signal_overlap(spark, sf):
    d = S.agg(R(spark, sf), ["ts"], {"k": "sum(CASE WHEN long_score >= 2 THEN 1 ELSE 0 END)"})
    return S.agg(d, [], {"max_concurrent": "max(k)", "flat_share": "avg(CASE WHEN k = 0 THEN 1e0 ELSE 0 END)", "multi_share": "avg(CASE WHEN k > 1 THEN 1e0 ELSE 0 END)", "pair_days": "sum(k * (k - 1) / 2)"})


# variant -> R of the same signal; delays read the return that starts later
_VAR = {"as_is": "r0", "inverted": "-r0", "delay1": "r1", "delay2": "r2", "adverse_fill": "r0 - 0.1", "cost_x2": "r0 - 0.10", "cost_x3": "r0 - 0.15", "cost_x5": "r0 - 0.25"}
cte("var0", "SELECT *, fwd10_r AS r0, lead(fwd10_r, 1) OVER w AS r1, lead(fwd10_r, 2) OVER w AS r2 FROM rk WINDOW w AS (PARTITION BY symbol ORDER BY rn)", "rk")


@q("execution_sensitivity", f"variant {_SSP}", f"SELECT variant, {_SSQ} FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, {e} AS r FROM var0 WHERE {_EVT}" for k, e in _VAR.items()) + ") WHERE r IS NOT NULL GROUP BY 1", "var0")
def execution_sensitivity(spark, sf):
    h = P.with_halo(R(spark, sf).selectExpr("symbol", "rn", "long_score", "fwd10_r", "fwd10_r AS r0"), 0, 2)
    h = P.own_rows(P.add(h, {"r1": P.lag("fwd10_r", -1), "r2": P.lag("fwd10_r", -2)})).where(_EVT)
    items = ", ".join(f"'{k}', {e}" for k, e in _VAR.items())
    return S.agg(h.selectExpr(f"stack({len(_VAR)}, {items}) AS (variant, r)").where("r IS NOT NULL"), ["variant"], _SS)


_ADV = {"without_best_symbol": "symbol <> best_symbol", "without_best_regime": "regime <> best_regime", "without_rsi": "l_drop5 AND l_streak5", "without_drop": "l_rsi30 AND l_streak5", "without_streak": "l_rsi30 AND l_drop5"}


@q(
    "adversarial_variants", f"variant {_SSP}",
    f"""WITH b AS (SELECT (SELECT arg_max(symbol, s) FROM (SELECT symbol, sum(r) AS s FROM evt GROUP BY 1)) AS best_symbol, (SELECT arg_max(regime, s) FROM (SELECT regime, sum(r) AS s FROM evt GROUP BY 1)) AS best_regime)
    SELECT variant, {_SSQ} FROM (""" + " UNION ALL ".join(f"SELECT '{k}' AS variant, r FROM evt, b WHERE {c}" for k, c in _ADV.items()) + ") GROUP BY 1", "evt",
)
def adversarial_variants(spark, sf):
    from pyspark.sql import functions as F

    e = events(spark, sf)
    tot = S.grouping_sets(e, [["symbol"], ["regime"]], {"s": "sum(r)"})
    best = S.agg(tot, [], {"best_symbol": "max_by(symbol, s) FILTER (WHERE symbol <> 'ALL')", "best_regime": "max_by(regime, s) FILTER (WHERE regime <> 'ALL')"})
    d = e.crossJoin(F.broadcast(best))
    items = ", ".join(f"'{k}', CASE WHEN {c} THEN r END" for k, c in _ADV.items())
    return S.agg(d.selectExpr(f"stack({len(_ADV)}, {items}) AS (variant, r)").where("r IS NOT NULL"), ["variant"], _SS)


_XG = [(t, h) for t in (0.75, 1.0, 1.5) for h in (5, 10, 20)]


@q(
    "exit_selection", "tp_r:2 horizon:i n_train:i mean_train:5 n_oos:i mean_oos:5",
    f"""WITH e AS (SELECT symbol, rn, ts, close, atr_14 FROM rk WHERE long_score >= 2 AND atr_14 > 0), g AS (SELECT * FROM (VALUES {', '.join(f'(CAST({t} AS DOUBLE), {h})' for t, h in _XG)}) v(tp_r, horizon)),
    h AS (SELECT e.symbol, e.rn, tp_r, horizon, min(CASE WHEN low <= close - 1.25 * atr_14 THEN i END) AS s_at, min(CASE WHEN high >= close + tp_r * 1.25 * atr_14 THEN i END) AS t_at, arg_max(cx, i) AS cl FROM e JOIN fx USING (symbol, rn) JOIN g ON i <= horizon GROUP BY ALL),
    r AS (SELECT tp_r, horizon, CASE WHEN {_TRAIN} THEN 'train' ELSE 'oos' END AS part, CASE WHEN s_at <= coalesce(t_at, 999) THEN -1.0 WHEN t_at IS NOT NULL THEN tp_r ELSE (cl - close) / (1.25 * atr_14) END AS r FROM e JOIN h USING (symbol, rn)),
    a AS (SELECT tp_r, horizon, part, count(*) AS n, avg(r) AS m FROM r GROUP BY 1, 2, 3), t AS (SELECT * FROM a WHERE part = 'train' ORDER BY m DESC, tp_r, horizon LIMIT 1)
    SELECT t.tp_r, t.horizon, t.n AS n_train, t.m AS mean_train, o.n AS n_oos, o.m AS mean_oos FROM t JOIN (SELECT * FROM a WHERE part = 'oos') o USING (tp_r, horizon)""", "rk", "fx",
)
def exit_selection(spark, sf):
    """Target and horizon grid chosen on all training events, reported out of sample."""
    ev = R(spark, sf).where("long_score >= 2").select("symbol", "rn")
    d = _paths(spark, sf).join(ev, ["symbol", "rn"]).where("size(path) > 0")
    items = ", ".join(f"named_struct('tp_r', {t}D, 'horizon', {h}, 'r', {O.first_touch_r('long', t, h)})" for t, h in _XG)
    d = d.selectExpr(f"CASE WHEN {_TRAIN} THEN 'train' ELSE 'oos' END AS part", f"inline(array({items}))")
    a = S.agg(d, ["tp_r", "horizon", "part"], {"n": "count(r)", "m": "avg(r)"})
    t = S.agg(a.where("part = 'train'"), [], {"b": "min_by(struct(tp_r, horizon, n, m), struct(-m, tp_r, horizon))"}).selectExpr("b.tp_r AS tp_r", "b.horizon AS horizon", "b.n AS n_train", "b.m AS mean_train")
    return t.join(a.where("part = 'oos'").selectExpr("tp_r", "horizon", "n AS n_oos", "m AS mean_oos"), ["tp_r", "horizon"])


@q(
    "target_probability_ev", "family n:i p_tp:5 p_sl:5 p_time:5 ev:5",
    f"""WITH o AS (SELECT symbol, rn, CASE WHEN s_at <= coalesce(t_at, 999) THEN 'sl' WHEN t_at IS NOT NULL THEN 'tp' ELSE 'time' END AS o, CASE WHEN s_at <= coalesce(t_at, 999) THEN -1.0 WHEN t_at IS NOT NULL THEN 1.0 ELSE (cl - c0) / (1.25 * atr) END AS r FROM (
      SELECT symbol, rn, any_value(c0) AS c0, any_value(atr) AS atr, min(CASE WHEN low <= c0 - 1.25 * atr THEN i END) AS s_at, min(CASE WHEN high >= c0 + 1.25 * atr THEN i END) AS t_at, arg_max(cx, i) AS cl FROM fx WHERE atr > 0 GROUP BY 1, 2)),
    e AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS family, symbol, rn FROM rk WHERE {' AND '.join(v)}" for k, v in X.FAMILIES.items()) + """)
    SELECT family, count(*) AS n, avg(CASE WHEN o = 'tp' THEN 1e0 ELSE 0 END) AS p_tp, avg(CASE WHEN o = 'sl' THEN 1e0 ELSE 0 END) AS p_sl, avg(CASE WHEN o = 'time' THEN 1e0 ELSE 0 END) AS p_time, avg(r) AS ev FROM e JOIN o USING (symbol, rn) GROUP BY 1""", "rk", "fx",
)
def target_probability_ev(spark, sf):
    fam = ", ".join(f"'{k}', {' AND '.join(v)}" for k, v in X.FAMILIES.items())
    ev = R(spark, sf).selectExpr("symbol", "rn", f"stack({len(X.FAMILIES)}, {fam}) AS (family, on_)").where("on_").select("symbol", "rn", "family")
    d = P.add(_paths(spark, sf).where("atr_14 > 0 AND size(path) > 0"), {"r": O.first_touch_r("long", 1.0, 20), "s": O.first(O.touch("long", "stop", O.level("long", "(-1.25)"))), "t": O.first(O.touch("long", "target", O.level("long", "(1.0 * 1.25)")))})
    d = d.selectExpr("symbol", "rn", "r", "CASE WHEN s IS NOT NULL AND s <= coalesce(t, 999) THEN 'sl' WHEN t IS NOT NULL THEN 'tp' ELSE 'time' END AS o").join(ev, ["symbol", "rn"])
    return S.agg(d, ["family"], {"n": "count(*)", **{f"p_{k}": f"avg(CASE WHEN o = '{k}' THEN 1e0 ELSE 0 END)" for k in ("tp", "sl", "time")}, "ev": "avg(r)"})


# ---- census -----------------------------------------------------------------------------------
cte(
    "cand",
    """SELECT h.symbol, h.rn, h.ts, h.setup_family AS family, h.direction AS side, h.regime, u.u AS u, m.mb AS mb, h.confidence,
  CASE h.direction WHEN 'long' THEN r.fwd5_r ELSE -r.fwd5_r END AS f5, CASE h.direction WHEN 'long' THEN r.fwd10_r ELSE -r.fwd10_r END AS f10, CASE h.direction WHEN 'long' THEN r.fwd20_r ELSE -r.fwd20_r END AS f20, r.vol_bucket
 FROM hist h LEFT JOIN (SELECT symbol, rn, 'long' AS side, u_long AS u FROM u_long UNION ALL SELECT symbol, rn, 'short', u_short FROM u_short) u ON u.symbol = h.symbol AND u.rn = h.rn AND u.side = h.direction
 LEFT JOIN (SELECT symbol, rn, 'long' AS side, mb_long AS mb FROM mb_long UNION ALL SELECT symbol, rn, 'short', mb_short FROM mb_short) m ON m.symbol = h.symbol AND m.rn = h.rn AND m.side = h.direction
 LEFT JOIN rk r ON r.symbol = h.symbol AND r.rn = h.rn WHERE h.direction <> 'flat' AND h.confidence >= 0.45""",
    "hist", "u_long", "u_short", "mb_long", "mb_short", "rk",
)


def history(spark, sf):
    """Setup verdicts, stored once per application."""
    cols = ["symbol", "rn", "ts", "regime", "setup_family", "direction", "confidence", "long_score", "short_score"]
    return stored(spark, "history", sf, lambda: U.classify_history(D.panel_d(spark, sf)).select(*cols))


def bar_outcomes(spark, sf):
    """Uniform and first-touch outcomes of both sides on every bar, stored once per application."""

    def build():
        o = P.add(_paths(spark, sf), {f"u_{s}": O.uniform_r(s) for s in O.SIDES})
        for s in O.SIDES:
            o = O.multi_barrier(o, s, f"mb_{s}")
        return o.select("symbol", "rn", "u_long", "u_short", "mb_long", "mb_short")

    return stored(spark, "bar_outcomes", sf, build)


def candidates(spark, sf):
    """Classified bars with their uniform outcome, first-touch outcome and signed forward returns."""

    def build():
        h = history(spark, sf).where("direction <> 'flat' AND confidence >= 0.45")
        h = h.selectExpr("symbol", "rn", "ts", "setup_family AS family", "direction AS side", "regime", "confidence")
        o = bar_outcomes(spark, sf)
        r = R(spark, sf).select("symbol", "rn", "fwd5_r", "fwd10_r", "fwd20_r", "vol_bucket")
        d = h.join(o, ["symbol", "rn"]).join(r, ["symbol", "rn"])
        sg = "CASE side WHEN 'long' THEN 1 ELSE -1 END"
        return d.selectExpr(
            "symbol", "rn", "ts", "family", "side", "regime", "confidence", "vol_bucket", "CASE side WHEN 'long' THEN u_long ELSE u_short END AS u",
            "CASE side WHEN 'long' THEN mb_long ELSE mb_short END AS mb", f"{sg} * fwd5_r AS f5", f"{sg} * fwd10_r AS f10", f"{sg} * fwd20_r AS f20",
        )

    return stored(spark, "candidates", sf, build)


_CE = {"candidates": "count(*)", "resolved": "count(u)", "wins": "sum(CASE WHEN u > 0 THEN 1 ELSE 0 END)", "win_rate": "sum(CASE WHEN u > 0 THEN 1e0 ELSE 0 END) / nullif(count(u), 0)", "sum_r": "coalesce(sum(u), 0)", "expectancy": "avg(u)"}
_CEP = "candidates:i resolved:i wins:i win_rate:5 sum_r:3 expectancy:5"


@q("opportunity_census", f"side family symbol regime {_CEP}", f"SELECT {', '.join(_LBL.format(k) for k in ('side', 'family', 'symbol', 'regime'))}, {_cols(_CE)} FROM cand GROUP BY GROUPING SETS ((side), (family), (symbol, side), (side, regime))", "cand")
def opportunity_census(spark, sf):
    return S.grouping_sets(candidates(spark, sf), [["side"], ["family"], ["symbol", "side"], ["side", "regime"]], _CE)


_FTD = {"n": "count(*)", **{f"p_{k}": f"avg(CASE WHEN mb = '{k}' THEN 1e0 ELSE 0 END)" for k in ("tp1", "tp2", "tp3", "sl")}, "p_none": "avg(CASE WHEN mb IS NULL THEN 1e0 ELSE 0 END)"}
_FTP = "n:i p_tp1:5 p_tp2:5 p_tp3:5 p_sl:5 p_none:5"


@q(
    "first_touch_distribution", f"side family cost:2 {_FTP} ev:5",
    f"SELECT *, p_tp1 + 2 * p_tp2 + 3 * p_tp3 - p_sl - cost AS ev FROM (SELECT {_LBL.format('side')}, {_LBL.format('family')}, {_cols(_FTD)} FROM cand GROUP BY GROUPING SETS ((side), (side, family))), (VALUES (0.0), (0.05), (0.10), (0.15)) v(cost)", "cand",
)
def first_touch_distribution(spark, sf):
    """Outcome shares per side and family at four costs; unresolved bars count as ``p_none``."""
    d = S.grouping_sets(candidates(spark, sf), [["side"], ["side", "family"]], _FTD)
    return d.selectExpr("*", "explode(array(0.0D, 0.05D, 0.10D, 0.15D)) AS cost").selectExpr("*", "p_tp1 + 2 * p_tp2 + 3 * p_tp3 - p_sl - cost AS ev")


@q("conditional_tp_tables", f"side regime vol_bucket {_FTP}", f"SELECT side, {_LBL.format('regime')}, {_LBL.format('vol_bucket')}, {_cols(_FTD)} FROM (SELECT side, regime, coalesce(vol_bucket, 'none') AS vol_bucket, mb FROM cand) GROUP BY GROUPING SETS ((side, vol_bucket), (side, regime), (side, regime, vol_bucket))", "cand")
def conditional_tp_tables(spark, sf):
    d = candidates(spark, sf).selectExpr("side", "regime", "coalesce(vol_bucket, 'none') AS vol_bucket", "mb")
    return S.grouping_sets(d, [["side", "vol_bucket"], ["side", "regime"], ["side", "regime", "vol_bucket"]], _FTD)


_AT = {"n": "count(*)", "win": "sum(CASE WHEN u > 0 THEN 1e0 ELSE 0 END) / nullif(count(u), 0)", "expectancy": "avg(u)", "mean_f10": "avg(f10)", "t_f10": TS.format("f10")}


@q("attribution", "family symbol n:i win:5 expectancy:5 mean_f10:5 t_f10:4", f"SELECT {_LBL.format('family')}, {_LBL.format('symbol')}, {_cols(_AT)} FROM cand GROUP BY GROUPING SETS ((family), (symbol))", "cand")
def attribution(spark, sf):
    return S.grouping_sets(candidates(spark, sf), [["family"], ["symbol"]], _AT)


@q(
    "fixed_horizon_edge", "side family regime horizon:i n:i mean:5 t:4",
    f"SELECT side, family, regime, horizon, count(f) AS n, avg(f) AS mean, {TS.format('f')} AS t FROM (SELECT side, family, regime, 5 AS horizon, f5 AS f FROM cand UNION ALL SELECT side, family, regime, 10, f10 FROM cand UNION ALL SELECT side, family, regime, 20, f20 FROM cand) WHERE f IS NOT NULL GROUP BY 1, 2, 3, 4", "cand",
)
def fixed_horizon_edge(spark, sf):
    d = candidates(spark, sf).selectExpr("side", "family", "regime", "stack(3, 5, f5, 10, f10, 20, f20) AS (horizon, f)").where("f IS NOT NULL")
    return S.agg(d, ["side", "family", "regime", "horizon"], {"n": "count(f)", "mean": "avg(f)", "t": TS.format("f")})


@q(
    "ratio_dispersion", "n:i p25:5 median:5 p75:5 min_symbol max_symbol most_skewed",
    "WITH r AS (SELECT symbol, sum(CASE WHEN side = 'long' THEN 1e0 ELSE 0 END) / sum(CASE WHEN side = 'short' THEN 1 ELSE 0 END) AS q FROM cand GROUP BY 1) SELECT count(*) AS n, quantile_cont(q, 0.25) AS p25, quantile_cont(q, 0.5) AS median, quantile_cont(q, 0.75) AS p75, arg_min(symbol, (q, symbol)) AS min_symbol, arg_max(symbol, (q, symbol)) AS max_symbol, arg_max(symbol, (abs(ln(q)), symbol)) AS most_skewed FROM r", "cand",
)
def ratio_dispersion(spark, sf):
    """Long/short candidate ratio per symbol; one row per symbol reaches the final aggregate."""
    r = S.agg(candidates(spark, sf), ["symbol"], {"q": "sum(CASE WHEN side = 'long' THEN 1e0 ELSE 0 END) / nullif(sum(CASE WHEN side = 'short' THEN 1 ELSE 0 END), 0)"})
    return S.agg(r, [], {"n": "count(*)", "p25": "percentile(q, 0.25)", "median": "percentile(q, 0.5)", "p75": "percentile(q, 0.75)", "min_symbol": "min_by(symbol, struct(q, symbol))", "max_symbol": "max_by(symbol, struct(q, symbol))", "most_skewed": "max_by(symbol, struct(abs(ln(q)), symbol))"})


# ---- probabilities: confidence as the score, uniform win as the label -----------------------------
cte("pr", "SELECT symbol, ts, CASE WHEN u > 0 THEN 1 ELSE 0 END AS y, confidence AS p FROM cand WHERE u IS NOT NULL", "cand")


def probs(spark, sf):
    return candidates(spark, sf).where("u IS NOT NULL").selectExpr("symbol", "ts", "CASE WHEN u > 0 THEN 1 ELSE 0 END AS y", "confidence AS p")


_QC = "greatest(least(p, 1 - 1e-6), 1e-6)"
q("calibration_bins", "bin:i n:i p_mean:5 y_rate:5", "SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS p_mean, avg(y) AS y_rate FROM pr GROUP BY 1", "pr")(lambda spark, sf: S.calibration_bins(probs(spark, sf), "y", "p"))
q(
    "calibration_metrics", "n:i brier:6 log_loss:6 slope:5 intercept:5 ece:5 mce:5",
    f"WITH b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS pm, avg(y) AS yr FROM pr GROUP BY 1) SELECT * FROM (SELECT count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(-(y * ln({_QC}) + (1 - y) * ln(1 - {_QC}))) AS log_loss, regr_slope(y, p) AS slope, regr_intercept(y, p) AS intercept FROM pr), (SELECT sum(n * abs(pm - yr)) / sum(n) AS ece, max(abs(pm - yr)) AS mce FROM b)", "pr",
)(lambda spark, sf: S.calibration_metrics(probs(spark, sf), "y", "p"))
q(
    "classification_metrics", "n:i base_rate:5 log_loss:6 accuracy:5 precision_:5 recall:5 auc:6",
    f"""WITH r AS (SELECT *, {_AVGR.format(g='1', x='p')} AS rk FROM pr) SELECT count(*) AS n, avg(y) AS base_rate, avg(-(y * ln({_QC}) + (1 - y) * ln(1 - {_QC}))) AS log_loss, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1e0 ELSE 0 END) AS accuracy,
    sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) / sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS precision_, sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) / sum(y) AS recall, (sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r""", "pr",
)(lambda spark, sf: S.classification_metrics(probs(spark, sf), "y", "p"))
q(
    "decile_report", "decile:i n:5 p_mean:5 win_rate:5 lift:5",
    """WITH v AS (SELECT p, count(*) AS eq, sum(y) AS w FROM pr GROUP BY 1), c AS (SELECT *, sum(eq) OVER (ORDER BY p) - eq AS lt, sum(eq) OVER () AS n FROM v),
    s AS (SELECT d AS bin, p, w / eq AS w, least(lt + eq, floor((d + 1) * n / 10)) - greatest(lt, floor(d * n / 10)) AS m FROM c, range(0, 10) t(d))
    SELECT bin + 1 AS decile, sum(m) AS n, sum(m * p) / sum(m) AS p_mean, sum(m * w) / sum(m) AS win_rate, sum(m * w) / sum(m) / (SELECT avg(y) FROM pr) AS lift FROM s WHERE m > 0 GROUP BY bin""", "pr",
)(lambda spark, sf: S.decile_report(probs(spark, sf), "y", "p"))


@q("filter_gate", "n:i median_p:5 win_high:5 win_low:5 lift:5", "WITH m AS (SELECT median(p) AS m FROM pr) SELECT count(*) AS n, any_value(m) AS median_p, avg(CASE WHEN p > m THEN y END) AS win_high, avg(CASE WHEN p <= m THEN y END) AS win_low, avg(CASE WHEN p > m THEN y END) - avg(CASE WHEN p <= m THEN y END) AS lift FROM pr, m", "pr")
def filter_gate(spark, sf):
    from pyspark.sql import functions as F

    d = probs(spark, sf)
    d = d.crossJoin(F.broadcast(K.quantiles(d, [], "p", {"m": 0.5})))
    return S.agg(d, [], {"n": "count(*)", "median_p": "max(m)", "win_high": "avg(CASE WHEN p > m THEN y END)", "win_low": "avg(CASE WHEN p <= m THEN y END)", "lift": "avg(CASE WHEN p > m THEN y END) - avg(CASE WHEN p <= m THEN y END)"})


q("bh_fdr", "symbol horizon:i n:i p:5 q_adj:5 bh_pass:b", f"""WITH a AS (SELECT symbol, horizon, count(*) AS n, {TS.format('fwd')} AS t FROM pool GROUP BY 1, 2), p AS (SELECT *, {S.two_sided_p('t')} AS p FROM a), k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p),
    z AS (SELECT *, least(min(p * m / r) OVER (ORDER BY p, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_adj FROM k) SELECT *, q_adj <= 0.10 AS bh_pass FROM z""", "pool")(
    lambda spark, sf: S.bh_fdr(P.add(S.agg(pool(spark, sf), ["symbol", "horizon"], {"n": "count(*)", "t": TS.format("fwd")}), {"p": S.two_sided_p("t")}))
)
