"""Causal per-bar pullback (long) and rally (short) signals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import indicators as I
from . import panel as P
from . import regime as R
from . import structure as S
from .indicators import yes
from .panel import add, lag

# fixed values: thresholds of the setup rules
DIP_DEPTH = RALLY_DEPTH = (0.005, 0.15)
COOLED_RSI = (30, 55)
STRETCHED_RSI = 60
TREND_ADX = 20
CONFIRM, WATCH = 6, 4


def feature_panel(bars: DataFrame, price_at: str = "extreme") -> DataFrame:
    """Indicators, regime, swing memory and bias for every bar.

    One haloed shuffle serves all of it; the recursive values are exact on three halo rows so
    their lags need no further exchange.
    """
    names = I.BUNDLE + I.REGIME_INPUTS + I.SCAN_INPUTS + I.SWINGS
    h = I.with_features(P.chunked(bars, I.HALO), names)
    h = S.add_swing_locals(P.segment(h, keep=3), price_at)
    d = I.add_recursive(h, flow=True, keep=3, **S.CARRIED)
    d = add(
        d,
        {
            "hist_rising": f"coalesce(macd_hist > {lag('macd_hist')}, false)",
            "hist_falling": f"coalesce(macd_hist < {lag('macd_hist')}, false)",
            "rsi_rising": f"coalesce(rsi_14 > {lag("rsi_14", 3)} + 1e-9, false)",
            "rsi_falling": f"coalesce(rsi_14 < {lag("rsi_14", 3)} - 1e-9, false)",
            "rsi_prev": lag("rsi_14"),
        },
    )
    d = S.finish_swing_memory(P.own_rows(d))
    d = add(d, {"regime": R.REGIME, "regime_confidence": R.CONFIDENCE, "bias_score": I.BIAS})
    return d.drop("_gain", "_loss", "_clv_vol", "_c")


TOL = "greatest(0.35 * atr_14, 0.001 * close)"


def dip_signals(panel: DataFrame, confirm: int = CONFIRM, watch: int = WATCH) -> DataFrame:
    """Eight long-side components, score, stage, entry zone, invalidation and resistance per bar."""
    lo, hi = DIP_DEPTH
    rng = "(up_leg_hi - up_leg_lo)"
    parts = {
        "above_sma200": "close > sma_200",
        "ma_stack": "sma_20 > sma_50 AND sma_50 > sma_200",
        "trend": f"adx >= {TREND_ADX}",
        "pullback": f"depth BETWEEN {lo} AND {hi}",
        "cooled": f"rsi_14 BETWEEN {COOLED_RSI[0]} AND {COOLED_RSI[1]}",
        "at_support": f"atr_14 IS NOT NULL AND last_swing_low <= close AND close <= last_swing_low + greatest(atr_14, {TOL})",
        "fib_zone": f"{rng} > 0 AND close BETWEEN up_leg_hi - 0.786 * {rng} AND up_leg_hi - 0.382 * {rng}",
        "trigger": yes("hist_rising", "rsi_rising", "close > open") + " >= 2",
    }
    d = add(panel, {"depth": "CASE WHEN last_swing_high > 0 THEN (last_swing_high - close) / last_swing_high END"})
    d = add(d, {k: f"coalesce({v}, false)" for k, v in parts.items()})
    # greatest/least skip nulls, so the warm-up guard is explicit
    ok = "last_swing_low IS NOT NULL AND atr_14 IS NOT NULL"
    d = add(
        d,
        {
            "score": yes(*parts),
            "bullish_structure": "above_sma200 AND bias_score >= 0",
            "dip_depth_pct": "depth * 100",
            "invalidation": f"CASE WHEN {ok} THEN last_swing_low - atr_14 END",
            "entry_lo": f"CASE WHEN {ok} THEN last_swing_low - 0.5 * {TOL} END",
            "entry_hi": f"CASE WHEN {ok} THEN greatest(last_swing_low - 0.5 * {TOL}, least(close, last_swing_low + 0.5 * {TOL})) END",
            "resistance": "CASE WHEN last_swing_high > close THEN last_swing_high END",
        },
    )
    stage = f"""CASE WHEN NOT bullish_structure THEN 'No Uptrend' WHEN close < invalidation THEN 'Support Broken'
        WHEN depth > {hi} THEN 'Deep Pullback' WHEN score >= {confirm} AND pullback THEN 'Confirmed'
        WHEN score >= {watch} THEN 'In Pullback' ELSE 'Not a Dip' END"""
    return add(add(d, {"stage": stage}), {"confirmed": "stage = 'Confirmed'"})


def rally_signals(panel: DataFrame, confirm: int = CONFIRM, watch: int = WATCH) -> DataFrame:
    """Short-side mirror of :func:`dip_signals`."""
    lo, hi = RALLY_DEPTH
    rng = "(down_leg_hi - down_leg_lo)"
    parts = {
        "below_sma200": "close < sma_200",
        "ma_stack": "sma_20 < sma_50 AND sma_50 < sma_200",
        "trend": f"adx >= {TREND_ADX}",
        "rally": f"depth BETWEEN {lo} AND {hi}",
        "stretched": f"rsi_14 >= {STRETCHED_RSI}",
        "at_resistance": f"atr_14 IS NOT NULL AND last_swing_high - greatest(atr_14, {TOL}) <= close AND close <= last_swing_high",
        "fib_zone": f"{rng} > 0 AND close BETWEEN down_leg_hi - 0.786 * {rng} AND down_leg_hi - 0.382 * {rng}",
        "trigger": yes("hist_falling", "rsi_falling", "close < open") + " >= 2",
    }
    d = add(panel, {"depth": "CASE WHEN last_swing_low > 0 THEN (close - last_swing_low) / last_swing_low END"})
    d = add(d, {k: f"coalesce({v}, false)" for k, v in parts.items()})
    ok = "last_swing_high IS NOT NULL AND atr_14 IS NOT NULL"
    d = add(
        d,
        {
            "score": yes(*parts),
            "bearish_structure": "below_sma200 AND bias_score <= 0",
            "rally_depth_pct": "depth * 100",
            "invalidation": f"CASE WHEN {ok} THEN last_swing_high + atr_14 END",
            "entry_hi": f"CASE WHEN {ok} THEN last_swing_high + 0.5 * {TOL} END",
            "entry_lo": f"CASE WHEN {ok} THEN least(last_swing_high + 0.5 * {TOL}, greatest(close, last_swing_high - 0.5 * {TOL})) END",
            "target": "CASE WHEN last_swing_low < close THEN last_swing_low END",
        },
    )
    stage = f"""CASE WHEN NOT bearish_structure THEN 'No Downtrend' WHEN close > invalidation THEN 'Resistance Broken'
        WHEN depth > {hi} THEN 'Deep Rally' WHEN score >= {confirm} AND rally THEN 'Confirmed'
        WHEN score >= {watch} THEN 'In Rally' ELSE 'Not a Rally' END"""
    return add(add(d, {"stage": stage}), {"confirmed": "stage = 'Confirmed'"})
