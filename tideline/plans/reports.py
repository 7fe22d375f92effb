"""Queries: latest-bar engines, rating, feature matrix, gates, order audits, set operations, small tables."""

from pyspark.sql import functions as F

from ..operators import hygiene as H
from ..operators import indicators as I
from ..operators import panel as P
from ..operators import rating as Q
from ..operators import risk as K
from ..operators import signals as G
from ..operators import stats as S
from ..operators import structure as T
from ..operators import text as X
from ..sources import derive as D
from . import sql_base  # noqa: F401
from .hygiene import counts, macro_joined
from .levels import clustered
from .outcomes import trades
from .registry import cte, query, show
from .decisions import _EVQ
from .sql_base import BIAS  # noqa: F401
from .statistics import _FTD, _SS, _SSP, _SSQ, R, candidates, history, q

q("directional_bias", "symbol ts:d bias_score:i label", f"SELECT symbol, ts, bias_score, {I.BIAS_LABEL} AS label FROM f", "f")(lambda spark, sf: P.add(D.panel_d(spark, sf), {"label": I.BIAS_LABEL}))


@query("continuation_patterns")
def continuation_patterns(spark, sf):
    return show(T.continuation_patterns(D.panel_d(spark, sf)), "symbol name side breakout:4 status confidence:1")


@query("pattern_union")
def pattern_union(spark, sf):
    """All detectors, strongest first per symbol."""
    p = D.panel_d(spark, sf)
    u = T.reversal_patterns(p).unionByName(T.continuation_patterns(p))
    return show(u.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, name) AS rank"), "symbol rank:i name side confidence:1")


# ---- latest-bar engines against clustered levels -------------------------------------------------
cte("nl", "SELECT symbol, max(price) FILTER (WHERE price < close) AS nearest_support, min(price) FILTER (WHERE price > close) AS nearest_resistance FROM clu GROUP BY 1", "clu")
_LD = {
    "depth": "(up_leg_hi - close) / up_leg_hi",
    "at_sup": "close <= nearest_support + greatest(atr_14, tol)",
    "fib": "up_leg_hi > up_leg_lo AND close BETWEEN up_leg_hi - 0.786 * (up_leg_hi - up_leg_lo) AND up_leg_hi - 0.382 * (up_leg_hi - up_leg_lo)",
}
_LSC = I.yes("close > sma_200", "sma_20 > sma_50 AND sma_50 > sma_200", "adx >= 20", "depth BETWEEN 0.005 AND 0.15", "rsi_14 BETWEEN 30 AND 55", "at_sup", "fib", I.yes("hist_rising", "rsi_rising", "close > open") + " >= 2")
_LST = "CASE WHEN NOT (close > sma_200 AND bias_score >= 0) THEN 'No Uptrend' WHEN close < nearest_support - atr_14 THEN 'Support Broken' WHEN depth > 0.15 THEN 'Deep Pullback' WHEN score >= 6 AND depth BETWEEN 0.005 AND 0.15 THEN 'Confirmed' WHEN score >= 4 THEN 'In Pullback' ELSE 'Not a Dip' END"
_RD = {
    "depth": "(close - down_leg_lo) / down_leg_lo",
    "at_res": "close >= nearest_resistance - greatest(atr_14, tol)",
    "fib": "down_leg_hi > down_leg_lo AND close BETWEEN down_leg_hi - 0.786 * (down_leg_hi - down_leg_lo) AND down_leg_hi - 0.382 * (down_leg_hi - down_leg_lo)",
}
_RSC = I.yes("close < sma_200", "sma_20 < sma_50 AND sma_50 < sma_200", "adx >= 20", "depth BETWEEN 0.005 AND 0.15", "rsi_14 >= 60", "at_res", "fib", I.yes("hist_falling", "rsi_falling", "close < open") + " >= 2")
_RST = "CASE WHEN NOT (close < sma_200 AND bias_score <= 0) THEN 'No Downtrend' WHEN close > nearest_resistance + atr_14 THEN 'Resistance Broken' WHEN depth > 0.15 THEN 'Deep Rally' WHEN score >= 6 AND depth BETWEEN 0.005 AND 0.15 THEN 'Confirmed' WHEN score >= 4 THEN 'In Rally' ELSE 'Not a Rally' END"


def _live(name, parts, score, stage):
    sql = f"SELECT *, {stage} AS stage FROM (SELECT *, {score} AS score FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in parts.items())} FROM last1 JOIN nl USING (symbol)))"

    @q(name, "symbol score:i stage depth:5 nearest_support:4 nearest_resistance:4", sql, "last1", "nl")
    def run(spark, sf):
        d = P.latest(D.panel_d(spark, sf)).join(clustered(spark, sf).select("symbol", "tolerance", "nearest_support", "nearest_resistance"), "symbol")
        return P.add(P.add(P.add(d.withColumnRenamed("tolerance", "tol"), parts), {"score": score}), {"stage": stage})


_live("live_dip_engine", _LD, _LSC, _LST)
_live("live_rally_engine", _RD, _RSC, _RST)

# ---- rating --------------------------------------------------------------------------------------
_SCQ = ", ".join(f"{v} AS {k}" for k, v in Q.SCORES.items())
_BSS = "greatest(least((sum(volume_delta) + sum(clvv)) / coalesce(nullif(sum(volume), 0), 1) * 50, 100), -100)"


@q(
    "quant_rating", "symbol prob_pct:4 label trend:4 momentum:4 flow:4 macro:4",
    f"""SELECT *, {Q.LABEL} AS label FROM (SELECT *, {Q.PROB} AS prob_pct FROM (SELECT *, {_SCQ} FROM (SELECT l.*, v.buyer_seller_score, m.bias, NULL::DOUBLE AS composite FROM last1 l
    JOIN (SELECT symbol, {_BSS} AS buyer_seller_score FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) <= 20) GROUP BY 1) v USING (symbol)
    JOIN (SELECT symbol, bias FROM mbj QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1) m USING (symbol))))""", "last1", "f", "mbj",
)
def quant_rating(spark, sf):
    p = D.panel_d(spark, sf)
    d = P.latest(p).join(I.volume_flow(p).select("symbol", "buyer_seller_score"), "symbol").join(P.latest(macro_joined(spark, sf)).select("symbol", "bias"), "symbol")
    d = P.add(P.add(d, {"composite": "cast(null as double)"}), Q.SCORES)
    return P.add(P.add(d, {"prob_pct": Q.PROB}), {"label": Q.LABEL})


# ---- model feature matrix with calendar, interaction and macro columns -----------------------------
_FM = {
    "month": "month(ts)", "month_end": "CASE WHEN day(ts) >= 25 THEN 1 ELSE 0 END", "mid_month": "CASE WHEN day(ts) BETWEEN 13 AND 17 THEN 1 ELSE 0 END",
    "rsi_x_adx": "rsi_14 * adx / 100", "atr_pct": "atr_14 / close", "dxy_s": "coalesce(dxy_score, 0)", "vix_s": "coalesce(vix_score, 0)", "bias_m": "coalesce(bias, 0)",
}
_FMS = "symbol ts:d weekday:i month:i month_end:i mid_month:i rsi_x_adx:5 atr_pct:7 dxy_s:0 vix_s:0 bias_m:4 dist_pct:5 ret_5:6"


@q("feature_matrix", _FMS, f"SELECT r.symbol, r.ts, isodow(r.ts) - 1 AS weekday, {', '.join(f'{v} AS {k}' for k, v in _FM.items()).replace('(ts)', '(r.ts)')}, dist_pct, ret_5 FROM rk r JOIN (SELECT symbol, rn, dxy_score, vix_score, bias FROM mbj) m USING (symbol, rn) WHERE rn >= 260", "rk", "mbj")
def feature_matrix(spark, sf):
    m = macro_joined(spark, sf).select("symbol", "rn", "dxy_score", "vix_score", "bias")
    return P.add(R(spark, sf).where("rn >= 260").join(m, ["symbol", "rn"]), {"weekday": "weekday(ts)", **_FM})


@q("gated_comparison", f"gated:i {_SSP}", f"SELECT gated, {_SSQ} FROM (SELECT t.r, v.gated FROM trades_long t JOIN mbj m ON m.symbol = t.symbol AND m.rn = t.rn, (VALUES (0), (1)) v(gated) WHERE v.gated = 0 OR m.long_gate = 1) GROUP BY 1", "trades_long", "mbj")
def gated_comparison(spark, sf):
    """The same long trades with and without the macro gate."""
    t = trades(spark, sf).where("side = 'long'").select("symbol", "rn", "r").join(macro_joined(spark, sf).select("symbol", "rn", "long_gate"), ["symbol", "rn"])
    return S.agg(t.selectExpr("r", "explode(CASE WHEN long_gate = 1 THEN array(0, 1) ELSE array(0) END) AS gated"), ["gated"], _SS)


# ---- order audits: orders = classified candidates priced by their family's own outcome masses ---------
cte("fst", f"SELECT family, {', '.join(f'{v} AS {k}' for k, v in _FTD.items())} FROM cand GROUP BY 1", "cand")
_ST = "CASE WHEN n IS NULL THEN 'UNVALIDATED' WHEN ev_ladder > 0.05 THEN 'PROMISING' WHEN ev_ladder > 0 THEN 'SHADOW' ELSE 'FALSIFIED' END"
_E0 = {"ev_ladder": K.target_level_ev("p_tp1", "p_tp2", "p_tp3", "p_sl", "0"), "ev_alloc": K.allocation_ev("p_tp1", "p_tp2", "p_tp3", "p_sl", "0")}
cte("fce", f"SELECT *, {_ST} AS status FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _E0.items())} FROM fst)", "fst")


def family_table(spark, sf):
    return P.add(P.add(S.agg(candidates(spark, sf), ["family"], _FTD), _E0), {"status": _ST})


q("family_census", "family n:i p_tp1:5 p_sl:5 ev_ladder:5 status", "SELECT * FROM fce", "fce")(family_table)
_OE = {"net_alloc": "ev_alloc - 0.05", "verdict": "CASE WHEN ev_alloc - 0.05 > 0 THEN 'accept' ELSE 'reject' END", "headline": "CASE WHEN ev_ladder > 0 AND ev_alloc <= 0 THEN 1 ELSE 0 END"}
q("order_economics", "verdict family n:i net_alloc:5 headline:i", f"SELECT verdict, family, count(*) AS n, any_value(net_alloc) AS net_alloc, any_value(headline) AS headline FROM (SELECT c.family, {', '.join(f'{v} AS {k}' for k, v in _OE.items())} FROM cand c JOIN fce USING (family)) GROUP BY 1, 2", "cand", "fce")(
    lambda spark, sf: S.agg(P.add(candidates(spark, sf).select("family").join(F.broadcast(family_table(spark, sf)), "family"), _OE), ["verdict", "family"], {"n": "count(*)", "net_alloc": "max(net_alloc)", "headline": "max(headline)"})
)
q("order_trace", "symbol ts:d side family status verdict", f"SELECT c.symbol, c.ts, c.side, c.family, status, {_OE['verdict']} AS verdict FROM cand c JOIN fce USING (family)", "cand", "fce")(
    lambda spark, sf: P.add(candidates(spark, sf).select("symbol", "ts", "side", "family").join(F.broadcast(family_table(spark, sf).select("family", "status", "ev_alloc")), "family"), {"verdict": _OE["verdict"]})
)
_AR = "concat(side, ' ', family, ': ', status)"
q("order_arbitration", "reason n:i", f"SELECT {_AR} AS reason, count(*) AS n FROM cand JOIN (SELECT family, status FROM fce) USING (family) GROUP BY 1", "cand", "fce")(
    lambda spark, sf: S.agg(candidates(spark, sf).select("side", "family").join(F.broadcast(family_table(spark, sf).select("family", "status")), "family").selectExpr(f"{_AR} AS reason"), ["reason"], {"n": "count(*)"})
)
q("backtest_rows", f"symbol side {_SSP}", f"SELECT symbol, side, {_SSQ} FROM trades GROUP BY 1, 2", "trades")(lambda spark, sf: S.agg(trades(spark, sf), ["symbol", "side"], _SS))

# ---- set operations and small keyed tables ---------------------------------------------------------
q("symbol_sets", "kind symbol", "SELECT 'core' AS kind, symbol FROM (SELECT DISTINCT symbol FROM dc WHERE grp = 'main' INTERSECT SELECT DISTINCT symbol FROM dc WHERE grp = 'staged') UNION ALL SELECT 'left_out', symbol FROM (SELECT DISTINCT symbol FROM dc WHERE timeframe = 'H1' EXCEPT SELECT DISTINCT symbol FROM dc WHERE timeframe = 'D1')", "dc")(
    lambda spark, sf: (lambda c: c.where("grp = 'main'").select("symbol").intersect(c.where("grp = 'staged'").select("symbol")).selectExpr("'core' AS kind", "symbol").unionByName(
        c.where("timeframe = 'H1'").select("symbol").subtract(c.where("timeframe = 'D1'").select("symbol")).selectExpr("'left_out' AS kind", "symbol")))(counts(spark, sf))
)
q("pooled_union", "symbol n:i kinds:i", "SELECT symbol, count(*) AS n, count(spread) AS kinds FROM (SELECT symbol, close, NULL AS spread FROM b UNION ALL SELECT symbol, close, 1 FROM bh) GROUP BY 1", "b", "bh")(
    lambda spark, sf: S.agg(D.bars_d(spark, sf).select("symbol", "close").unionByName(D.bars_h(spark, sf).selectExpr("symbol", "close", "1 AS spread"), allowMissingColumns=True), ["symbol"], {"n": "count(*)", "kinds": "count(spread)"})
)
q("fundamentals_upsert", "symbol:i pe:4", "SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 50 ELSE s_acctbal / 100 END AS pe FROM supplier")(
    lambda spark, sf: (lambda s: H.upsert(s.selectExpr("s_suppkey AS symbol", "s_acctbal / 100 AS pe"), s.where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS symbol", "s_acctbal / 50 AS pe"), ("symbol",)))(D.table(spark, sf, "supplier"))
)
q("latest_per_key_ledger", "o_custkey:i o_orderkey:i o_totalprice:2", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")(
    lambda spark, sf: S.agg(D.table(spark, sf, "orders"), ["o_custkey"], {"b": "max_by(struct(o_orderkey, o_totalprice), struct(o_orderdate, o_orderkey))"}).selectExpr("o_custkey", "b.o_orderkey AS o_orderkey", "b.o_totalprice AS o_totalprice")
)


@q("positioning_reports", "market ts:d net:0", "SELECT market, ts, arg_max(lng - sht, event_id) AS net FROM (SELECT event_type AS market, CAST(ts AS DATE) AS ts, event_id, round(value * 10) AS lng, user_id AS sht FROM events WHERE value IS NOT NULL AND event_type IN ('click', 'view')) GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY market) >= 20")
def positioning_reports(spark, sf):
    """Report rows: exact market names, last row per date, net position, markets with enough dates."""
    e = D.table(spark, sf, "events").where("value IS NOT NULL AND event_type IN ('click', 'view')").selectExpr("event_type AS market", "to_date(ts) AS ts", "event_id", "round(value * 10) - user_id AS net")
    d = S.agg(e, ["market", "ts"], {"net": "max_by(net, event_id)"})
    return d.join(F.broadcast(S.agg(d, ["market"], {"m": "count(*)"}).where("m >= 20").select("market")), "market", "left_semi")


q("composite_sentiment", "lang score:4", "SELECT n.lang, CASE WHEN s.sc IS NULL THEN n.sc ELSE 0.6 * n.sc + 0.4 * s.sc END AS score FROM (SELECT lang, avg(" + X.band("pos", "neg") + ") AS sc FROM sent WHERE doc_id % 2 = 0 GROUP BY 1) n LEFT JOIN (SELECT lang, avg(" + X.band("pos", "neg") + ") AS sc FROM sent WHERE doc_id % 2 = 1 AND lang <> 'en' GROUP BY 1) s USING (lang)", "sent")(
    lambda spark, sf: (lambda d: S.agg(d, ["lang"], {"n": "avg(CASE WHEN doc_id % 2 = 0 THEN sc END)", "s": "avg(CASE WHEN doc_id % 2 = 1 AND lang <> 'en' THEN sc END)"}).selectExpr("lang", "CASE WHEN s IS NULL THEN n ELSE 0.6 * n + 0.4 * s END AS score"))(P.add(X.hits(D.table(spark, sf, "documents")), {"sc": X.band("pos", "neg")}))
)
q("intraday_trigger_join", "symbol source ts:t close:2", "WITH h4 AS (SELECT symbol, '4h' AS source, 1 AS pri, max(ts) AS ts FROM (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01') AS ts FROM bh WHERE symbol <> 'view') GROUP BY 1), u AS (SELECT symbol, source, pri, ts, (SELECT arg_max(close, x.ts) FROM bh x WHERE x.symbol = h4.symbol) AS close FROM h4 UNION ALL SELECT symbol, '1h', 2, max(ts), arg_max(close, ts) FROM bh GROUP BY 1) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pri) = 1", "bh")(
    lambda spark, sf: (lambda b: S.agg(
        S.agg(b.where("symbol <> 'view'"), ["symbol"], {"ts": "max(date_trunc('hour', ts) - make_interval(0, 0, 0, 0, int(hour(ts) % 4)))", "close": "max_by(close, ts)"}).selectExpr("symbol", "'4h' AS source", "1 AS pri", "ts", "close").unionByName(
            S.agg(b, ["symbol"], {"t": "max(ts)", "close": "max_by(close, ts)"}).selectExpr("symbol", "'1h' AS source", "2 AS pri", "t AS ts", "close")
        ), ["symbol"], {"x": "min_by(struct(source, ts, close), pri)"}).select("symbol", "x.*"))(D.bars_h(spark, sf))
)
