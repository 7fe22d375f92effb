"""Research features on the panel: distances, triggers, forward returns, causal volatility bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import panel as P
from .panel import add, lag, over, rolling

HORIZONS = (1, 3, 5, 10, 20)
# reversal triggers; the five-bar move is in ATR units so that symbols are comparable
TRIGGERS = {
    "s_rsi70": "regime IN ('Bear Trend', 'Range / Chop') AND rsi_14 > 70",
    "s_rally5": "regime IN ('Bear Trend', 'Range / Chop') AND move5 > 0.8",
    "s_streak5": "regime IN ('Bear Trend', 'Range / Chop') AND streak5p >= 5",
    "l_rsi30": "rsi_14 < 30",
    "l_drop5": "move5 < -0.8",
    "l_streak5": "streak5n >= 5",
    "l_crash": "dist_pct < -8",
}
LONG3, SHORT3 = ["l_rsi30", "l_drop5", "l_streak5"], ["s_rsi70", "s_rally5", "s_streak5"]
# signal families: every listed trigger must hold
FAMILIES = {
    "A_rsi30": ["l_rsi30"], "B_streak": ["l_streak5"], "C_crash": ["l_crash"], "D_AB": ["l_rsi30", "l_streak5"],
    "E_AC": ["l_rsi30", "l_crash"], "F_BC": ["l_streak5", "l_crash"], "G_ABC": ["l_rsi30", "l_streak5", "l_crash"],
}
VOL_BUCKET = "CASE WHEN vol_pct <= 0.33 THEN 'low' WHEN vol_pct <= 0.66 THEN 'med' WHEN vol_pct <= 1 THEN 'high' END"
KEEP = ["symbol", "ts", "rn", "open", "high", "low", "close", "atr_14", "rsi_14", "macd_hist", "sma_20", "sma_200", "adx", "regime", "bb_pct_b", "bias_score", "volume"]


def kofn(names: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {n} THEN 1 ELSE 0 END" for n in names) + ")"


def research_panel(panel: DataFrame) -> DataFrame:
    h = P.with_halo(panel.select(*KEEP), 275, max(HORIZONS))
    h = add(
        h,
        {
            "dist": "close - sma_200",
            "_up": f"CASE WHEN close > {lag('close')} THEN 1 ELSE 0 END",
            "_dn": f"CASE WHEN close < {lag('close')} THEN 1 ELSE 0 END",
            "_atr20": f"CASE WHEN count(atr_14) {over(19)} = 20 THEN round(avg(atr_14) {over(19)}, 9) END",
            "ret_5": f"close / {lag('close', 5)} - 1",
            "ret_10": f"close / {lag('close', 10)} - 1",
            "ret_20": f"close / {lag('close', 20)} - 1",
            "move5": f"(close - {lag('close', 5)}) / nullif(atr_14, 0)",
            **{f"fwd{k}_r": f"({lag('close', -k)} - close) / nullif(1.25 * atr_14, 0)" for k in HORIZONS},
        },
    )
    h = add(
        h,
        {
            "streak5p": rolling("sum(_up)", 5),
            "streak5n": rolling("sum(_dn)", 5),
            "_sd100": f"CASE WHEN count(dist) {over(99)} >= 60 THEN stddev_samp(dist) {over(99)} END",
            "_d250": f"collect_list(dist) {over(249)}",
            "_v250": f"collect_list(_atr20) {over(249)}",
        },
    )
    h = add(
        P.own_rows(h),
        {
            "dist_pct": "(close / nullif(sma_200, 0) - 1) * 100",
            "dist_atr": "dist / nullif(atr_14, 0)",
            "dist_z": "dist / nullif(_sd100, 0)",
            # the share of the whole window, so rows before the first SMA200 count as "not below"
            "dist_rank": "CASE WHEN size(_d250) >= 150 AND dist IS NOT NULL THEN size(filter(_d250, v -> v <= dist)) / least(rn + 1, 250) END",
            # average rank among ties
            "vol_pct": """CASE WHEN size(_v250) = 250 THEN
                (size(filter(_v250, v -> v < _atr20)) + (size(filter(_v250, v -> v = _atr20)) + 1) / 2.0D) / 250 END""",
            "sma20_gap": "(close / nullif(sma_20, 0) - 1) * 100",
        },
    )
    h = add(h, {"vol_bucket": VOL_BUCKET, **{k: f"coalesce({v}, false)" for k, v in TRIGGERS.items()}})
    h = add(h, {"long_score": kofn(LONG3), "short_score": kofn(SHORT3)})
    return h.drop("_c", "_up", "_dn", "_atr20", "_sd100", "_d250", "_v250")


def pooled(rp: DataFrame, extra=(), horizons=HORIZONS) -> DataFrame:
    """Long form: one row per (bar, horizon) with the forward return ``fwd``."""
    n = len(horizons)
    items = ", ".join(f"{h}, fwd{h}_r" for h in horizons)
    return rp.selectExpr("symbol", "ts", "rn", "regime", *extra, f"stack({n}, {items}) AS (horizon, fwd)").where("fwd IS NOT NULL")


def risk_proxy(panel: DataFrame, window: int = 5) -> DataFrame:
    """ATR-normalised return over the last bars."""
    h = P.with_halo(panel.select("symbol", "ts", "rn", "close", "atr_14"), window)
    return P.own_rows(add(h, {"risk": f"(close - {lag('close', window)}) / nullif(atr_14, 0)"})).drop("_c")
