"""Windowed indicators on an indexed bar panel (columns symbol, ts, open, high, low, close, volume, rn)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel as P
from .panel import add, lag, over, put, rolling

# rows of history a bounded indicator can reach: SMA200 plus the 100-row ATR median and the lags
HALO = 230

_UP, _DN = f"(high - {lag('high')})", f"({lag('low')} - low)"
_D = f"(close - {lag('close')})"
_SD = rolling("stddev_samp(close)", 20)
_DX = "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)"

# name -> (level, inputs, expression); the columns of one level share a single Window pass
FEATURES: dict[str, tuple[int, tuple[str, ...], str]] = {
    # greatest skips the null previous close of the first bar
    "tr": (0, (), f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"),
    "_pdm": (0, (), f"CASE WHEN {_UP} > {_DN} AND {_UP} > 0 THEN {_UP} ELSE 0.0D END"),
    "_mdm": (0, (), f"CASE WHEN {_DN} > {_UP} AND {_DN} > 0 THEN {_DN} ELSE 0.0D END"),
    "_gain": (0, (), f"CASE WHEN {_D} > 0 THEN {_D} ELSE 0.0D END"),
    "_loss": (0, (), f"CASE WHEN {_D} < 0 THEN -{_D} ELSE 0.0D END"),
    "returns": (0, (), f"close / nullif({lag('close')}, 0) - 1"),
    "log_returns": (0, (), f"ln(close / nullif({lag('close')}, 0))"),
    "volume_delta": (0, (), f"coalesce(signum({_D}) * volume, 0.0D)"),
    "_clv_vol": (0, (), "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0D) * coalesce(volume, 0.0D)"),
    "_cum": (0, (), f"sum(close) {over(None)}"),
    "bb_mid": (1, (), rolling("avg(close)", 20)),
    "bb_upper": (1, (), f"{rolling('avg(close)', 20)} + 2 * {_SD}"),
    "bb_lower": (1, (), f"{rolling('avg(close)', 20)} - 2 * {_SD}"),
    "bb_width": (2, ("bb_mid", "bb_upper", "bb_lower"), "(bb_upper - bb_lower) / nullif(bb_mid, 0)"),
    "bb_pct_b": (2, ("bb_upper", "bb_lower"), "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)"),
    "atr_14": (1, ("tr",), rolling("avg(tr)", 14)),
    "plus_di": (1, ("tr", "_pdm"), f"100 * {rolling('avg(_pdm)', 14)} / nullif({rolling('avg(tr)', 14)}, 0)"),
    "minus_di": (1, ("tr", "_mdm"), f"100 * {rolling('avg(_mdm)', 14)} / nullif({rolling('avg(tr)', 14)}, 0)"),
    "adx": (2, ("plus_di", "minus_di"), f"CASE WHEN count({_DX}) {over(13)} = 14 THEN avg({_DX}) {over(13)} END"),
    "volatility_20": (1, ("returns",), f"{rolling('stddev_samp(returns)', 20, 1)} * sqrt(252)"),
    "volume_sma_20": (1, (), rolling("avg(volume)", 20)),
    "relative_volume": (2, ("volume_sma_20",), "volume / nullif(volume_sma_20, 0)"),
    "slope_20": (1, (), rolling("regr_slope(close, rn)", 20)),
    "slope_pct_20": (2, ("slope_20",), "100 * slope_20 / nullif(close, 0)"),
    "price_vs_200sma": (2, ("sma_200",), "close / nullif(sma_200, 0) - 1"),
    "atr_ratio": (2, ("atr_14",), f"atr_14 / nullif({rolling('percentile(atr_14, 0.5)', 100, 13)}, 0)"),
    # a five-bar extreme two rows back is confirmed on this row; neighbouring flagged bars share
    # the extreme value, so keeping the first of a plateau means "flagged and the bar before was not"
    "sh": (
        0, (), f"coalesce(rn >= 4 AND {lag('high', 2)} = max(high) {over(4)} AND NOT coalesce(rn >= 5 AND {lag('high', 3)} = max(high) {over(5, -1)}, false), false)",
    ),
    "sl": (
        0, (), f"coalesce(rn >= 4 AND {lag('low', 2)} = min(low) {over(4)} AND NOT coalesce(rn >= 5 AND {lag('low', 3)} = min(low) {over(5, -1)}, false), false)",
    ),
    "sh_price": (0, (), lag("high", 2)),
    "sl_price": (0, (), lag("low", 2)),
    "swing_ts": (0, (), lag("ts", 2)),
}
for _n in (20, 50, 100, 200):
    # chunk-local prefix sums: O(1) per row instead of re-adding the frame
    FEATURES[f"sma_{_n}"] = (1, ("_cum",), f"CASE WHEN rn >= {_n - 1} THEN (_cum - coalesce({lag('_cum', _n)}, 0.0D)) / {_n} END")

SWINGS = ["sh", "sl", "sh_price", "sl_price"]
BUNDLE = [
    "sma_20", "sma_50", "sma_100", "sma_200", "bb_upper", "bb_mid", "bb_lower", "bb_width", "bb_pct_b", "atr_14", "adx",
    "plus_di", "minus_di", "returns", "log_returns", "volatility_20", "volume_sma_20", "relative_volume", "volume_delta",
]
SCAN_INPUTS = ["_gain", "_loss", "_clv_vol"]
REGIME_INPUTS = ["slope_20", "slope_pct_20", "price_vs_200sma", "atr_ratio", "adx"]


def with_features(h: DataFrame, names: list[str]) -> DataFrame:
    """Add the named bounded indicators (and their inputs) to a haloed panel, level by level."""
    want: set[str] = set()

    def need(n):
        if n not in want:
            want.add(n)
            for m in FEATURES[n][1]:
                need(m)

    for n in names:
        need(n)
    for level in range(3):
        cols = {n: d[2] for n, d in FEATURES.items() if n in want and d[0] == level}
        if cols:
            h = add(h, cols)
    return h.drop("_cum", "_pdm", "_mdm")


def bounded(bars: DataFrame, names: list[str], back: int = HALO) -> DataFrame:
    """Bounded-window indicators of a bar table."""
    return P.own_rows(with_features(P.chunked(bars, back), names)).drop("_c")


def add_recursive(
    seg: DataFrame,
    spans=(20, 50, 100, 200),
    rsi_n: int | None = 14,
    macd: tuple[int, int, int] | None = (12, 26, 9),
    flow: bool = False,
    keep: int = 0,
    **extra,
) -> DataFrame:
    """EMA, Wilder RSI, MACD and running volume totals from ONE decayed-total scan.

    With S_d the total decayed by d = 1 - a and x0 the first close, the seeded recurrence is
    ema_t = a S_d(t) + d^(t+1) x0. The signal line is an EMA of a difference of two EMAs; as both
    filters are linear it is a combination of the same totals, so it needs no second pass.
    """
    al = {n: 2 / (n + 1) for n in (*spans, *(macd or ()))}
    # the first close travels with the scan as a running total of "close at rn 0"
    need = {"_x0": ("CASE WHEN rn = 0 THEN close END", 1.0)}
    need |= {f"_s{n}": ("close", 1 - a) for n, a in al.items()}
    if rsi_n:
        need |= {"_sg": ("_gain", 1 - 1 / rsi_n), "_sl": ("_loss", 1 - 1 / rsi_n)}
    if flow:
        need |= {"obv": ("volume_delta", 1.0), "ad_line": ("_clv_vol", 1.0)}
    df = P.scan(seg, need, keep=keep, **extra)

    def ema_of(n):
        return f"({al[n]!r}D * _s{n} + pow({1 - al[n]!r}D, rn + 1) * _x0)"

    out = {f"ema_{n}": ema_of(n) for n in spans}
    if macd:
        fast, slow, sig = macd
        b = al[sig]
        db = f"{1 - b!r}D"

        def smoothed(n):
            """EMA(sig) of EMA(n), both seeded with the first close."""
            a = al[n]
            yb = f"({a!r}D * _s{sig} + {1 - a!r}D * pow({db}, rn) * _x0)"
            return f"(pow({db}, rn + 1) * _x0 + {b!r}D * ({1 - a!r}D * {ema_of(n)} - {db} * {yb}) / {b - a!r}D)"

        line, signal = f"({ema_of(fast)} - {ema_of(slow)})", f"({smoothed(fast)} - {smoothed(slow)})"
        out |= {"macd": line, "macd_signal": signal, "macd_hist": f"CASE WHEN rn = 0 THEN 0.0D ELSE {line} - {signal} END"}
    if rsi_n:
        # the 1/n factor cancels in the ratio; the first bar counts as a zero move
        out[f"rsi_{rsi_n}"] = (
            f"CASE WHEN rn < {rsi_n - 1} THEN NULL WHEN _sl > 0 THEN 100 - 100 / (1 + _sg / _sl) WHEN _sg > 0 THEN 100.0D END"
        )
    return add(df, out).drop(*[c for c in need if c.startswith("_")])


def indicators(bars: DataFrame) -> DataFrame:
    """The full indicator bundle, one shuffle of the bars by (symbol, chunk)."""
    h = P.own_rows(with_features(P.chunked(bars, HALO), BUNDLE + SCAN_INPUTS))
    return add_recursive(h, flow=True).drop(*SCAN_INPUTS, "_c", "tr")


def ema(bars: DataFrame, spans=(20, 50, 100, 200)) -> DataFrame:
    return add_recursive(P.own_rows(P.chunked(bars)), spans=spans, rsi_n=None, macd=None).drop("_c")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    h = P.own_rows(with_features(P.chunked(bars, 1), ["_gain", "_loss"]))
    return add_recursive(h, spans=(), rsi_n=n, macd=None).drop("_c", "_gain", "_loss")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return add_recursive(P.own_rows(P.chunked(bars)), spans=(), rsi_n=None, macd=(fast, slow, signal)).drop("_c")


def ad_line(bars: DataFrame) -> DataFrame:
    h = P.own_rows(with_features(P.chunked(bars, 1), ["volume_delta", "_clv_vol"]))
    return P.scan(h, {"obv": ("volume_delta", 1.0), "ad_line": ("_clv_vol", 1.0)}).drop("_c", "_clv_vol")


def tail_slope(panel: DataFrame, cols: list[str], n: int = 20, min_n: int = 5) -> DataFrame:
    """Per symbol slope of the last n values over their mean absolute value (0 when short)."""
    t = P.last_n(panel.select("symbol", "ts", *cols), n)
    aggs = [
        F.expr(
            f"CASE WHEN count({c}) >= {min_n} THEN regr_slope({c}, -k) / coalesce(nullif(avg(abs({c})), 0), 1) ELSE 0.0D END AS {c}_slope"
        )
        for c in cols
    ]
    return t.groupBy("symbol").agg(*aggs)


def volume_flow(ind: DataFrame, lookback: int = 20) -> DataFrame:
    """OBV and A/D slopes, net flow over ``lookback`` bars in [-100, 100] and its label."""
    tail = add(P.last_n(ind, lookback), {"_ad": FEATURES["_clv_vol"][2]})
    agg = tail.groupBy("symbol").agg(
        F.expr("sum(volume_delta) AS volume_delta_20"),
        F.expr("sum(_ad) AS _ad"),
        F.expr("sum(volume) AS _vol"),
        F.expr("max_by(relative_volume, ts) AS relative_volume"),
    )
    out = agg.join(tail_slope(ind, ["obv", "ad_line"], lookback), "symbol")
    out = add(out, {"buyer_seller_score": "greatest(least((volume_delta_20 + _ad) / coalesce(nullif(_vol, 0), 1) * 50, 100), -100)"})
    return add(
        out,
        {
            "buyer_seller_label": """CASE WHEN buyer_seller_score >= 30 THEN 'Strong Accumulation'
                WHEN buyer_seller_score >= 10 THEN 'Accumulation' WHEN buyer_seller_score <= -30 THEN 'Strong Distribution'
                WHEN buyer_seller_score <= -10 THEN 'Distribution' ELSE 'Neutral' END""",
            "obv_trend": "CASE WHEN obv_slope > 0.005 THEN 'Up' WHEN obv_slope < -0.005 THEN 'Down' ELSE 'Flat' END",
            "ad_trend": "CASE WHEN ad_line_slope > 0.005 THEN 'Up' WHEN ad_line_slope < -0.005 THEN 'Down' ELSE 'Flat' END",
        },
    ).drop("_ad", "_vol")


def ma_ribbon(ind: DataFrame, horizon: int = 20) -> DataFrame:
    """Latest SMA50/200 gap in ATR, empirical cross probability, ribbon width, slope, alignment.

    The history is compared with each symbol's own latest gap through a join on symbol, so the
    count is a plain aggregate that combines on the map side. Alignment tests the unsorted order.
    """
    ready = ind.where("sma_50 IS NOT NULL AND sma_200 IS NOT NULL AND atr_14 IS NOT NULL").select(
        "symbol", "ts", "rn", "close", "sma_20", "sma_50", "sma_100", "sma_200", "atr_14"
    )
    h = P.with_halo(ready, 1, horizon)
    h = add(h, {"gap": "coalesce((sma_50 - sma_200) / nullif(atr_14, 0), 0.0D)", "_sg": "signum(sma_50 - sma_200)"})
    h = add(h, {"_x": f"coalesce(int(_sg <> {lag('_sg')}), 0)"})
    h = P.own_rows(add(h, {"_cross": f"max(_x) {over(-1, horizon)}", "_left": f"count(_x) {over(-1, horizon)}"}))
    now = add(
        P.latest(h),
        {
            "ribbon_width_pct": "100 * (greatest(sma_20, sma_50, sma_100, sma_200) - least(sma_20, sma_50, sma_100, sma_200)) / close",
            "ribbon_alignment": """CASE WHEN sma_20 >= sma_50 AND sma_50 >= sma_100 AND sma_100 >= sma_200 THEN 1.0D
                WHEN sma_20 <= sma_50 AND sma_50 <= sma_100 AND sma_100 <= sma_200 THEN -1.0D ELSE 0.0D END""",
        },
    ).selectExpr("symbol", "gap AS gap_atr", "ribbon_width_pct", "ribbon_alignment")
    prob = (
        h.join(now.select("symbol", "gap_atr"), "symbol")
        .where(f"_left = {horizon} AND (abs(gap) <= abs(gap_atr) OR (gap_atr = 0 AND abs(gap) <= 0.5))")
        .groupBy("symbol")
        .agg(F.expr("avg(_cross) AS _p"))
    )
    mean = add(h, {"ribbon": "(sma_20 + sma_50 + sma_100 + sma_200) / 4"})
    out = now.join(prob, "symbol", "left").join(tail_slope(mean, ["ribbon"]), "symbol", "left")
    out = add(out, {"cross_prob": "coalesce(_p, 0.0D)"}).drop("_p")
    return add(
        out,
        {
            "cross_direction": "CASE WHEN gap_atr > 0 THEN 'golden' ELSE 'death' END",
            "signal": """CASE WHEN gap_atr > 0 AND cross_prob < 0.5 THEN 'Bullish'
                WHEN gap_atr < 0 AND cross_prob < 0.5 THEN 'Bearish' ELSE 'Neutral' END""",
        },
    )


def yes(*conds: str) -> str:
    """Number of predicates that hold; unknown counts as false."""
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conds) + ")"


# -4..+4: close vs SMA200, RSI vs 50, MACD histogram sign, DI direction when ADX > 25
BIAS = (
    yes("close > sma_200", "rsi_14 > 50", "macd_hist > 0", "adx > 25 AND plus_di > minus_di")
    + " - "
    + yes("close < sma_200", "rsi_14 < 50", "macd_hist < 0", "adx > 25 AND minus_di > plus_di")
)
BIAS_LABEL = """CASE WHEN bias_score >= 3 THEN 'Strong Bullish' WHEN bias_score >= 2 THEN 'Bullish'
    WHEN bias_score >= 1 THEN 'Mild Bullish' WHEN bias_score <= -3 THEN 'Strong Bearish'
    WHEN bias_score <= -2 THEN 'Bearish' WHEN bias_score <= -1 THEN 'Mild Bearish' ELSE 'Neutral' END"""
