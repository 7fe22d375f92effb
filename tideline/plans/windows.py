"""Queries: indicators, regimes, swings and per-bar signals."""

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import panel as P
from ..operators import regime as R
from ..operators import signals as G
from ..operators import structure as S
from ..sources import derive as D
from .registry import query, sel, show, sql_with
from . import sql_base  # noqa: F401  (registers the shared CTEs)

KEYS = "symbol ts:d"


def _per_bar(name, spec, build, *deps, where=""):
    spec = f"{KEYS} {spec}"

    @query(name, sql_with(f"SELECT {sel(spec)} FROM {deps[-1]} {where}", *deps))
    def run(spark, sf):
        return show(build(D.bars_d(spark, sf)), spec)

    return run


_per_bar("bar_scan", "open:2 high:2 low:2 close:2 volume:0 rn:i", P.index_panel, "b")
_per_bar("sma", "sma_20:4 sma_50:4 sma_100:5 sma_200:5", lambda b: I.bounded(b, ["sma_20", "sma_50", "sma_100", "sma_200"], 200), "i2")
_per_bar("ema", "ema_20:4 ema_50:4 ema_100:4 ema_200:4", I.ema, "irec")
_per_bar("rsi", "rsi_14:4", I.rsi, "irec")
_per_bar("macd", "macd:4 macd_signal:4 macd_hist:4", I.macd, "irec")
_per_bar(
    "bollinger", "bb_mid:4 bb_upper:4 bb_lower:4 bb_width:6 bb_pct_b:6",
    lambda b: I.bounded(b, ["bb_width", "bb_pct_b"], 20), "i4",
)
_per_bar("atr", "atr_14:4", lambda b: I.bounded(b, ["atr_14"], 15), "i2")
_per_bar("adx", "adx:5 plus_di:5 minus_di:5", lambda b: I.bounded(b, ["adx"], 30), "i4")
_per_bar("ad_line", "obv:0 ad_line:3", I.ad_line, "i4")
_per_bar(
    "indicator_bundle",
    "sma_20:4 sma_200:5 ema_20:4 ema_200:4 rsi_14:4 macd_hist:4 bb_pct_b:6 atr_14:4 adx:5 returns:6 log_returns:6 "
    "volatility_20:5 volume_sma_20:3 relative_volume:5 obv:0 ad_line:3 volume_delta:0",
    I.indicators, "irec",
)
_per_bar("regression_slope", "slope_20:4", lambda b: I.bounded(b, ["slope_20"], 20), "i2")
_per_bar("regime_rule", "regime regime_confidence:2 slope_pct_20:5 price_vs_200sma:6 atr_ratio:6", R.regimes, "ireg")

_SW = "symbol ts:d kind price:2"


@query(
    "swings",
    sql_with(
        f"SELECT {sel(_SW)} FROM (SELECT symbol, ts, 'high' AS kind, high AS price FROM sw WHERE is_high "
        "UNION ALL SELECT symbol, ts, 'low', low FROM sw WHERE is_low)", "sw",
    ),
)
def swings(spark, sf):
    return show(S.swings(D.walk_d(spark, sf)), _SW)


_SM = "symbol rn:i last_swing_high:2 last_swing_low:2 up_leg_hi:2 up_leg_lo:2 down_leg_hi:2 down_leg_lo:2"


@query("swing_memory", sql_with(f"SELECT {sel(_SM)} FROM swm", "swm"))
def swing_memory(spark, sf):
    return show(S.swing_memory(D.walk_d(spark, sf)), _SM)


_DIP = (
    f"{KEYS} score:i stage bias_score:i above_sma200:b ma_stack:b trend:b pullback:b cooled:b at_support:b fib_zone:b "
    "trigger:b dip_depth_pct:3 entry_lo:6 entry_hi:6 invalidation:4 resistance:2"
)
_RALLY = (
    f"{KEYS} score:i stage bias_score:i below_sma200:b ma_stack:b trend:b rally:b stretched:b at_resistance:b fib_zone:b "
    "trigger:b rally_depth_pct:3 entry_lo:6 entry_hi:6 invalidation:4 target:2"
)


@query("dip_signals", sql_with(f"SELECT {sel(_DIP)} FROM dip", "dip"))
def dip_signals(spark, sf):
    return show(G.dip_signals(G.feature_panel(D.walk_d(spark, sf))), _DIP)


@query("rally_signals", sql_with(f"SELECT {sel(_RALLY)} FROM rally", "rally"))
def rally_signals(spark, sf):
    return show(G.rally_signals(D.panel_d(spark, sf)), _RALLY)


_FLOW = "symbol volume_delta_20:0 obv_slope:5 ad_line_slope:5 relative_volume:4 buyer_seller_score:4 buyer_seller_label obv_trend ad_trend"


@query(
    "volume_flow",
    sql_with(
        f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM i4 QUALIFY k <= 20),
        g AS (SELECT symbol, sum(volume_delta) AS volume_delta_20, max_by(relative_volume, ts) AS relative_volume,
          regr_slope(obv, -k) / coalesce(nullif(avg(abs(obv)), 0), 1) AS obv_slope,
          regr_slope(ad_line, -k) / coalesce(nullif(avg(abs(ad_line)), 0), 1) AS ad_line_slope,
          greatest(least((sum(volume_delta) + sum(clvv)) / coalesce(nullif(sum(volume), 0), 1) * 50, 100), -100) AS buyer_seller_score
          FROM t GROUP BY symbol)
        SELECT {sel(_FLOW)} FROM (SELECT *, CASE WHEN buyer_seller_score >= 30 THEN 'Strong Accumulation' WHEN buyer_seller_score >= 10 THEN 'Accumulation'
          WHEN buyer_seller_score <= -30 THEN 'Strong Distribution' WHEN buyer_seller_score <= -10 THEN 'Distribution' ELSE 'Neutral' END AS buyer_seller_label,
          CASE WHEN obv_slope > 0.005 THEN 'Up' WHEN obv_slope < -0.005 THEN 'Down' ELSE 'Flat' END AS obv_trend,
          CASE WHEN ad_line_slope > 0.005 THEN 'Up' WHEN ad_line_slope < -0.005 THEN 'Down' ELSE 'Flat' END AS ad_trend FROM g)""",
        "i4",
    ),
)
def volume_flow(spark, sf):
    return show(I.volume_flow(I.indicators(D.bars_d(spark, sf))), _FLOW)


_RIB = "symbol gap_atr:4 cross_direction cross_prob:4 ribbon_width_pct:4 ribbon_slope:6 ribbon_alignment:1 signal"


@query(
    "ma_ribbon",
    sql_with(
        f"""WITH g AS (SELECT *, coalesce((sma_50 - sma_200) / nullif(atr_14, 0), 0) AS gap, sign(sma_50 - sma_200) AS sg FROM w2 WHERE rn >= 199),
        x AS (SELECT *, CASE WHEN sg <> lag(sg) OVER (PARTITION BY symbol ORDER BY rn) THEN 1 ELSE 0 END AS x FROM g),
        ah AS (SELECT *, max(x) OVER fw AS crossed, count(x) OVER fw AS ahead FROM x WINDOW fw AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
        now AS (SELECT symbol, gap AS gap_atr, 100 * (greatest(sma_20, sma_50, sma_100, sma_200) - least(sma_20, sma_50, sma_100, sma_200)) / close AS ribbon_width_pct,
          CASE WHEN sma_20 >= sma_50 AND sma_50 >= sma_100 AND sma_100 >= sma_200 THEN 1.0 WHEN sma_20 <= sma_50 AND sma_50 <= sma_100 AND sma_100 <= sma_200 THEN -1.0 ELSE 0.0 END AS ribbon_alignment
          FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1),
        pr AS (SELECT ah.symbol, avg(crossed) AS p FROM ah JOIN now USING (symbol) WHERE ahead = 20 AND (abs(gap) <= abs(gap_atr) OR (gap_atr = 0 AND abs(gap) <= 0.5)) GROUP BY 1),
        sl AS (SELECT symbol, regr_slope(r, rn) / avg(abs(r)) AS ribbon_slope FROM (SELECT symbol, rn, (sma_20 + sma_50 + sma_100 + sma_200) / 4 AS r FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) <= 20) GROUP BY 1)
        SELECT {sel(_RIB)} FROM (SELECT *, CASE WHEN gap_atr > 0 THEN 'golden' ELSE 'death' END AS cross_direction,
          CASE WHEN gap_atr > 0 AND cross_prob < 0.5 THEN 'Bullish' WHEN gap_atr < 0 AND cross_prob < 0.5 THEN 'Bearish' ELSE 'Neutral' END AS signal
          FROM (SELECT now.*, coalesce(p, 0) AS cross_prob, ribbon_slope FROM now LEFT JOIN pr USING (symbol) LEFT JOIN sl USING (symbol)))""",
        "w2",
    ),
)
def ma_ribbon(spark, sf):
    return show(I.ma_ribbon(D.panel_d(spark, sf)), _RIB)


_RF = f"{KEYS} slope_20:5 adx:5 vs200:5 atr_ratio:5"


@query(
    "regime_features",
    sql_with(
        f"""SELECT {sel(_RF)} FROM (SELECT symbol, ts, (slope_20 - avg(slope_20) OVER s) / stddev_samp(slope_20) OVER s AS slope_20,
        (adx - avg(adx) OVER s) / stddev_samp(adx) OVER s AS adx,
        (price_vs_200sma * 100 - avg(price_vs_200sma * 100) OVER s) / stddev_samp(price_vs_200sma * 100) OVER s AS vs200,
        (atr_ratio - avg(atr_ratio) OVER s) / stddev_samp(atr_ratio) OVER s AS atr_ratio FROM wreg WINDOW s AS (PARTITION BY symbol))""",
        "wreg",
    ),
)
def regime_features(spark, sf):
    return show(R.standardized(D.panel_d(spark, sf)), _RF)


# weekly and monthly bars of the walk, stacked with the daily ones under "symbol|timeframe"
from .registry import cte  # noqa: E402

cte(
    "mtb",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM (
 SELECT symbol || '|D' AS symbol, ts, open, high, low, close, volume FROM wb
 UNION ALL SELECT symbol || '|W', CAST(date_trunc('week', ts) AS DATE), arg_min(open, ts), max(high), min(low), arg_max(close, ts), sum(volume) FROM wb GROUP BY symbol, date_trunc('week', ts)
 UNION ALL SELECT symbol || '|M', CAST(date_trunc('month', ts) AS DATE), arg_min(open, ts), max(high), min(low), arg_max(close, ts), sum(volume) FROM wb GROUP BY symbol, date_trunc('month', ts))""",
    "wb",
)
sql_base.bounded_ctes("mtb", "m")
_MT = "symbol timeframe regime adx:4 price_vs_200sma:6 slope_pct_20:5 regime_confidence:2 consensus"


@query(
    "multi_timeframe_regime",
    sql_with(
        f"""WITH l AS (SELECT * REPLACE (split_part(symbol, '|', 1) AS symbol), split_part(symbol, '|', 2) AS timeframe FROM mreg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1),
        v AS (SELECT symbol, regime AS consensus FROM (SELECT symbol, regime, count(*) AS n FROM l GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, list_position(['Bull Trend', 'Bear Trend', 'Range / Chop', 'High Volatility'], regime)) = 1)
        SELECT {sel(_MT)} FROM l JOIN v USING (symbol)""",
        "mreg",
    ),
)
def multi_timeframe_regime(spark, sf):
    return show(R.multi_timeframe(D.walk_d(spark, sf)), _MT)


_RANK = "symbol ts:d close:2 bias_score:i bias_label adx:4 rank:i"


@query(
    "universe_ranking",
    sql_with(
        f"""SELECT {sel(_RANK)} FROM (SELECT *, {I.BIAS_LABEL} AS bias_label, row_number() OVER (ORDER BY bias_score DESC, adx DESC, symbol) AS rank
        FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1))""",
        "f",
    ),
)
def universe_ranking(spark, sf):
    """Latest bar per symbol, bias score, rank by bias then ADX."""
    last = P.add(P.latest(I.indicators(D.walk_d(spark, sf))), {"bias_score": I.BIAS})
    ranked = P.add(last, {"bias_label": I.BIAS_LABEL, "rank": "row_number() OVER (ORDER BY bias_score DESC, adx DESC, symbol)"})
    return show(ranked, _RANK)
