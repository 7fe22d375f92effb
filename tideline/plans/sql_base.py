"""Oracle-side building blocks: the same tables written as plain per-symbol SQL windows."""

from .registry import cte

cte(
    "b",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM (
 SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS ts,
  arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS open,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS close,
  CAST(sum(l_quantity) AS DOUBLE) AS volume
 FROM lineitem GROUP BY 1, 2)""",
)
cte(
    "bh",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM (
 SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM events GROUP BY event_type, date_trunc('hour', ts))""",
)


def ma(col, n, start=0, fn="avg"):
    return (
        f"CASE WHEN rn >= {n - 1 + start} THEN {fn}({col}) OVER (PARTITION BY symbol ORDER BY rn "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    )


def scan_sql(x, d):
    """Decayed running total as one weighted cumulative sum."""
    return f"pow({d}, rn) * sum(({x}) * pow({d}, -rn)) OVER (PARTITION BY symbol ORDER BY rn)"


def ema_sql(x, n, first="x0"):
    a = f"(2.0e0/{n + 1})"
    return f"({a} * {scan_sql(x, f'(1-{a})')} + pow(1-{a}, rn + 1) * {first})"


def bounded_ctes(src: str, p: str):
    """Indicator CTEs over the bar CTE ``src``; names are prefixed with ``p``."""
    W = "WINDOW w AS (PARTITION BY symbol ORDER BY rn)"
    cte(
        f"{p}1",
        f"""SELECT *, lag(close) OVER w AS pc, close - lag(close) OVER w AS d1,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
  high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
  close / nullif(lag(close) OVER w, 0) - 1 AS returns, first_value(close) OVER w AS x0,
  CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS clvv
 FROM {src} {W}""",
        src,
    )
    cte(
        f"{p}2",
        f"""SELECT *, {ma('close', 20)} AS sma_20, {ma('close', 50)} AS sma_50, {ma('close', 100)} AS sma_100,
  {ma('close', 200)} AS sma_200, {ma('tr', 14)} AS atr_14, {ma('close', 20, fn='stddev_samp')} AS sd,
  {ma('volume', 20)} AS volume_sma_20, {ma('returns', 20, 1, 'stddev_samp')} * sqrt(252) AS volatility_20,
  {ma('CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END', 14)} AS pdm,
  {ma('CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END', 14)} AS mdm,
  CASE WHEN rn >= 19 THEN regr_slope(close, rn) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS slope_20,
  coalesce(sign(d1), 0) * volume AS volume_delta, ln(close / nullif(pc, 0)) AS log_returns
 FROM {p}1""",
        f"{p}1",
    )
    cte(
        f"{p}3",
        f"""SELECT *, 100 * pdm / nullif(atr_14, 0) AS plus_di, 100 * mdm / nullif(atr_14, 0) AS minus_di,
  100 * abs(100 * pdm / nullif(atr_14, 0) - 100 * mdm / nullif(atr_14, 0)) / nullif(100 * pdm / nullif(atr_14, 0) + 100 * mdm / nullif(atr_14, 0), 0) AS dx,
  sma_20 AS bb_mid, sma_20 + 2 * sd AS bb_upper, sma_20 - 2 * sd AS bb_lower,
  {ma('atr_14', 100, 13, 'median')} AS atr_med, close / nullif(sma_200, 0) - 1 AS price_vs_200sma,
  volume / nullif(volume_sma_20, 0) AS relative_volume,
  sum(volume_delta) OVER (PARTITION BY symbol ORDER BY rn) AS obv,
  sum(clvv) OVER (PARTITION BY symbol ORDER BY rn) AS ad_line
 FROM {p}2""",
        f"{p}2",
    )
    cte(
        f"{p}4",
        f"""SELECT *, (bb_upper - bb_lower) / nullif(bb_mid, 0) AS bb_width, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct_b,
  CASE WHEN count(dx) OVER d14 = 14 THEN avg(dx) OVER d14 END AS adx, atr_14 / nullif(atr_med, 0) AS atr_ratio,
  100 * slope_20 / nullif(close, 0) AS slope_pct_20
 FROM {p}3 WINDOW d14 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
        f"{p}3",
    )
    cte(
        f"{p}reg",
        f"""SELECT *, CASE WHEN adx >= 25 AND close > sma_200 AND slope_20 > 0 THEN 'Bull Trend'
   WHEN adx >= 25 AND close < sma_200 AND slope_20 < 0 THEN 'Bear Trend'
   WHEN atr_ratio > 1.8 THEN 'High Volatility' ELSE 'Range / Chop' END AS regime,
  CASE WHEN adx > 40 THEN 0.85 WHEN adx > 25 THEN 0.70 ELSE 0.55 END AS regime_confidence
 FROM {p}4""",
        f"{p}4",
    )
    g, lo = "CASE WHEN d1 > 0 THEN d1 ELSE 0.0 END", "CASE WHEN d1 < 0 THEN -d1 ELSE 0.0 END"
    d = "(13.0e0/14)"
    cte(
        f"{p}rec",
        f"""SELECT *, macd - macd_signal AS macd_hist FROM (
 SELECT *, {ema_sql('macd', 9, '0.0')} AS macd_signal FROM (
 SELECT *, ema_12 - ema_26 AS macd,
  CASE WHEN rn < 13 THEN NULL WHEN sl_ > 0 THEN 100 - 100 / (1 + sg_ / sl_) WHEN sg_ > 0 THEN 100.0 END AS rsi_14
 FROM (SELECT *, {ema_sql('close', 12)} AS ema_12, {ema_sql('close', 26)} AS ema_26, {ema_sql('close', 20)} AS ema_20,
  {ema_sql('close', 50)} AS ema_50, {ema_sql('close', 100)} AS ema_100, {ema_sql('close', 200)} AS ema_200,
  {scan_sql(g, d)} AS sg_, {scan_sql(lo, d)} AS sl_ FROM {p}reg)))""",
        f"{p}reg",
    )


cte(
    "wb",
    """SELECT symbol, ts, open, greatest(open, close) + hi AS high, least(open, close) - lo AS low, close, volume,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn
 FROM (SELECT *, 20000 + sum(step) OVER w - step AS open, 20000 + sum(step) OVER w AS close FROM (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS ts,
   CAST(sum(l_quantity) - 25.5 * count(*) AS DOUBLE) AS step, max(l_quantity) / 2 AS hi,
   25.5 - min(l_quantity) / 2 AS lo, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
)
bounded_ctes("b", "i")
bounded_ctes("wb", "w")

# swings: confirmed two rows later; equal neighbours keep the first bar
cte(
    "sw",
    """SELECT * EXCLUDE (fh, fl), fh AND NOT coalesce(lag(fh) OVER w, false) AS is_high, fl AND NOT coalesce(lag(fl) OVER w, false) AS is_low FROM (
 SELECT *, count(*) OVER c5 = 5 AND high = max(high) OVER c5 AS fh, count(*) OVER c5 = 5 AND low = min(low) OVER c5 AS fl
 FROM wb WINDOW c5 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
 WINDOW w AS (PARTITION BY symbol ORDER BY rn)""",
    "wb",
)
cte(
    "swm",
    """SELECT symbol, rn, sh, sl, lh AS last_swing_high, ll AS last_swing_low,
  last_value(CASE WHEN sh THEN hp END IGNORE NULLS) OVER w AS up_leg_hi,
  list_extract(last_value(CASE WHEN sh THEN [prev_l] END IGNORE NULLS) OVER w, 1) AS up_leg_lo,
  list_extract(last_value(CASE WHEN sl THEN [prev_h] END IGNORE NULLS) OVER w, 1) AS down_leg_hi,
  last_value(CASE WHEN sl THEN lp END IGNORE NULLS) OVER w AS down_leg_lo
 FROM (SELECT *, lag(lh) OVER w AS prev_h, lag(ll) OVER w AS prev_l FROM (
  SELECT *, last_value(CASE WHEN sh THEN hp END IGNORE NULLS) OVER w AS lh, last_value(CASE WHEN sl THEN lp END IGNORE NULLS) OVER w AS ll FROM (
   SELECT symbol, rn, coalesce(lag(is_high, 2) OVER w, false) AS sh, coalesce(lag(is_low, 2) OVER w, false) AS sl,
    lag(high, 2) OVER w AS hp, lag(low, 2) OVER w AS lp FROM sw WINDOW w AS (PARTITION BY symbol ORDER BY rn))
  WINDOW w AS (PARTITION BY symbol ORDER BY rn)) WINDOW w AS (PARTITION BY symbol ORDER BY rn))
 WINDOW w AS (PARTITION BY symbol ORDER BY rn)""",
    "sw",
)


def bi(*conds):
    return " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conds)


BIAS = (
    "(" + bi("close > sma_200", "rsi_14 > 50", "macd_hist > 0", "adx > 25 AND plus_di > minus_di")
    + " - (" + bi("close < sma_200", "rsi_14 < 50", "macd_hist < 0", "adx > 25 AND minus_di > plus_di") + "))"
)
cte(
    "f",
    f"""SELECT *, {BIAS} AS bias_score, coalesce(macd_hist > lag(macd_hist) OVER w, false) AS hist_rising,
  coalesce(macd_hist < lag(macd_hist) OVER w, false) AS hist_falling,
  coalesce(rsi_14 > lag(rsi_14, 3) OVER w + 1e-9, false) AS rsi_rising, coalesce(rsi_14 < lag(rsi_14, 3) OVER w - 1e-9, false) AS rsi_falling,
  greatest(0.35 * atr_14, 0.001 * close) AS tol
,
  lag(rsi_14) OVER w AS rsi_prev FROM wrec JOIN swm USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY rn)""",
    "wrec",
    "swm",
)

DIP_PARTS = {
    "above_sma200": "close > sma_200",
    "ma_stack": "sma_20 > sma_50 AND sma_50 > sma_200",
    "trend": "adx >= 20",
    "pullback": "depth BETWEEN 0.005 AND 0.15",
    "cooled": "rsi_14 BETWEEN 30 AND 55",
    "at_support": "atr_14 IS NOT NULL AND last_swing_low <= close AND close <= last_swing_low + greatest(atr_14, tol)",
    "fib_zone": "close >= up_leg_hi - 0.786 * (up_leg_hi - up_leg_lo) AND close <= up_leg_hi - 0.382 * (up_leg_hi - up_leg_lo) AND up_leg_hi > up_leg_lo",
    "trigger": "(" + bi("hist_rising", "rsi_rising", "close > open") + ") >= 2",
}
RALLY_PARTS = {
    "below_sma200": "close < sma_200",
    "ma_stack": "sma_20 < sma_50 AND sma_50 < sma_200",
    "trend": "adx >= 20",
    "rally": "depth BETWEEN 0.005 AND 0.15",
    "stretched": "rsi_14 >= 60",
    "at_resistance": "atr_14 IS NOT NULL AND last_swing_high - greatest(atr_14, tol) <= close AND close <= last_swing_high",
    "fib_zone": "close >= down_leg_hi - 0.786 * (down_leg_hi - down_leg_lo) AND close <= down_leg_hi - 0.382 * (down_leg_hi - down_leg_lo) AND down_leg_hi > down_leg_lo",
    "trigger": "(" + bi("hist_falling", "rsi_falling", "close < open") + ") >= 2",
}


def _parts(p):
    return ", ".join(f"coalesce({v}, false) AS {k}" for k, v in p.items())


def dip_cte(name, confirm=6, watch=4):
    cte(
        name,
        f"""SELECT *, stage = 'Confirmed' AS confirmed FROM (
 SELECT *, CASE WHEN NOT bullish_structure THEN 'No Uptrend' WHEN close < invalidation THEN 'Support Broken'
  WHEN depth > 0.15 THEN 'Deep Pullback' WHEN score >= {confirm} AND pullback THEN 'Confirmed'
  WHEN score >= {watch} THEN 'In Pullback' ELSE 'Not a Dip' END AS stage FROM (
 SELECT *, above_sma200 AND bias_score >= 0 AS bullish_structure, ({bi(*DIP_PARTS)}) AS score, depth * 100 AS dip_depth_pct,
  CASE WHEN atr_14 IS NOT NULL THEN last_swing_low - atr_14 END AS invalidation,
  CASE WHEN atr_14 IS NOT NULL THEN last_swing_low - 0.5 * tol END AS entry_lo,
  CASE WHEN atr_14 IS NOT NULL AND last_swing_low IS NOT NULL THEN greatest(last_swing_low - 0.5 * tol, least(close, last_swing_low + 0.5 * tol)) END AS entry_hi,
  CASE WHEN last_swing_high > close THEN last_swing_high END AS resistance FROM (
 SELECT *, {_parts(DIP_PARTS)} FROM (SELECT *, CASE WHEN last_swing_high > 0 THEN (last_swing_high - close) / last_swing_high END AS depth FROM f))))""",
        "f",
    )


def rally_cte(name, confirm=6, watch=4):
    cte(
        name,
        f"""SELECT *, stage = 'Confirmed' AS confirmed FROM (
 SELECT *, CASE WHEN NOT bearish_structure THEN 'No Downtrend' WHEN close > invalidation THEN 'Resistance Broken'
  WHEN depth > 0.15 THEN 'Deep Rally' WHEN score >= {confirm} AND rally THEN 'Confirmed'
  WHEN score >= {watch} THEN 'In Rally' ELSE 'Not a Rally' END AS stage FROM (
 SELECT *, below_sma200 AND bias_score <= 0 AS bearish_structure, ({bi(*RALLY_PARTS)}) AS score, depth * 100 AS rally_depth_pct,
  CASE WHEN atr_14 IS NOT NULL THEN last_swing_high + atr_14 END AS invalidation,
  CASE WHEN atr_14 IS NOT NULL THEN last_swing_high + 0.5 * tol END AS entry_hi,
  CASE WHEN atr_14 IS NOT NULL AND last_swing_high IS NOT NULL THEN least(last_swing_high + 0.5 * tol, greatest(close, last_swing_high - 0.5 * tol)) END AS entry_lo,
  CASE WHEN last_swing_low < close THEN last_swing_low END AS target FROM (
 SELECT *, {_parts(RALLY_PARTS)} FROM (SELECT *, CASE WHEN last_swing_low > 0 THEN (close - last_swing_low) / last_swing_low END AS depth FROM f))))""",
        "f",
    )


dip_cte("dip")
rally_cte("rally")
# the given tables rarely reach six points, so the outcome queries run the same rules at four
dip_cte("dip4", 4, 3)
rally_cte("rally4", 4, 3)
