"""Setup families: evidence flags per bar, weighted scores, direction verdict, expected value."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import panel as P
from .panel import add, lag, over

BREAK_WINDOW, RETEST_WINDOW, OBV_LAG = 60, 10, 9
MIN_EVIDENCE = 0.35

# inputs that need neighbouring bars; a haloed panel provides them
CONTEXT = {
    "prior_high": f"max(high) {over(BREAK_WINDOW - 1, -1)}",
    "prior_low": f"min(low) {over(BREAK_WINDOW - 1, -1)}",
    "recent_max": f"max(close) {over(RETEST_WINDOW, -1)}",
    "recent_min": f"min(close) {over(RETEST_WINDOW, -1)}",
    "obv_move": f"obv - {lag('obv', OBV_LAG)}",
}
# one evidence flag per entry; every expression is plain SQL over the panel columns
EVIDENCE = {
    "above200": "close > sma_200",
    "bull_stack": "sma_20 > sma_50 AND sma_50 > sma_200",
    "bear_stack": "sma_20 < sma_50 AND sma_50 < sma_200",
    "strong": "adx >= 25",
    "di_long": "plus_di > minus_di",
    "di_short": "minus_di > plus_di",
    "macd_pos": "macd_hist > 0",
    "macd_neg": "macd_hist < 0",
    "macd_rising": "hist_rising",
    # a flat close leaves RSI unchanged up to rounding noise
    "rsi_rising1": "rsi_14 > rsi_prev + 1e-9",
    "oversold": "rsi_14 <= 30",
    "overbought": "rsi_14 >= 70",
    "rsi_gt50": "rsi_14 > 50",
    "rsi_lt50": "rsi_14 < 50",
    "rsi_le55": "rsi_14 <= 55",
    "rsi_ge60": "rsi_14 >= 60",
    "bb_low": "bb_pct_b <= 0.05",
    "bb_high": "bb_pct_b >= 0.95",
    "z_low": "(close - bb_mid) / nullif((bb_upper - bb_lower) / 4, 0) < -2",
    "z_high": "(close - bb_mid) / nullif((bb_upper - bb_lower) / 4, 0) > 2",
    "breakout": "close > prior_high",
    "breakdown": "close < prior_low",
    "recent_hi": "recent_max > prior_high",
    "recent_lo": "recent_min < prior_low",
    "retest_hi": "recent_max > prior_high AND abs(close - prior_high) <= greatest(atr_14, close * 0.005)",
    "retest_lo": "recent_min < prior_low AND abs(close - prior_low) <= greatest(atr_14, close * 0.005)",
    "obv_up": "obv_move > 0",
    "obv_down": "obv_move < 0",
    "busy": "relative_volume > 1",
    "bull_regime": "regime = 'Bull Trend'",
    "bear_regime": "regime = 'Bear Trend'",
    "range_regime": "regime = 'Range / Chop'",
}
# evidence known only on the latest bar (levels, divergences, patterns); absent means false
STRUCTURE = ["at_sup", "at_res", "bull_div", "bear_div", "bull_pattern", "bear_pattern"]

# family -> [(condition over the flags, weight)]
FAMILIES: dict[str, list[tuple[str, float]]] = {
    "LONG_TREND_CONTINUATION": [
        ("bull_stack OR (above200 AND macd_pos)", 1.0), ("strong AND di_long", 1.0), ("macd_pos AND macd_rising", 0.8),
        ("rsi_gt50", 0.5), ("obv_up", 0.5),
    ],
    "LONG_BUY_DIP": [
        ("above200 OR bull_stack", 1.0), ("rsi_le55", 0.8), ("at_sup", 1.0), ("bb_low", 0.6), ("macd_rising OR rsi_rising1", 0.8),
    ],
    "LONG_BREAKOUT": [
        ("breakout", 2.0), ("macd_pos", 0.8), ("rsi_gt50", 0.6), ("busy", 0.8), ("above200 OR bull_regime OR range_regime", 0.6),
    ],
    "LONG_BREAKOUT_RETEST": [
        ("recent_hi", 1.5), ("retest_hi", 1.5), ("NOT overbought", 0.6), ("macd_rising OR rsi_rising1", 0.8), ("NOT breakdown", 0.6),
    ],
    "LONG_REVERSAL": [
        ("bull_div", 1.5), ("recent_lo AND NOT breakdown", 1.2), ("oversold AND rsi_rising1", 0.8), ("NOT above200", 0.4),
        ("bull_pattern", 0.8),
    ],
    "LONG_MEAN_REVERSION": [("oversold", 1.2), ("bb_low", 1.0), ("z_low", 0.8), ("range_regime", 0.6), ("NOT strong", 0.6)],
    "SHORT_TREND_CONTINUATION": [
        ("bear_stack OR (NOT above200 AND macd_neg)", 1.0), ("strong AND di_short", 1.0), ("macd_neg AND NOT macd_rising", 0.8),
        ("rsi_lt50", 0.5), ("obv_down", 0.5),
    ],
    "SHORT_SELL_RALLY": [
        ("NOT above200 OR bear_stack", 1.0), ("rsi_ge60", 0.8), ("at_res", 1.0), ("bb_high", 0.6), ("NOT macd_rising", 0.8),
    ],
    "SHORT_BREAKDOWN": [
        ("breakdown", 2.0), ("macd_neg", 0.8), ("rsi_lt50", 0.6), ("busy", 0.8), ("NOT above200 OR bear_regime OR range_regime", 0.6),
    ],
    "SHORT_BREAKDOWN_RETEST": [
        ("recent_lo", 1.5), ("retest_lo", 1.5), ("NOT oversold", 0.6), ("NOT macd_rising", 0.8), ("NOT breakout", 0.6),
    ],
    "SHORT_REVERSAL": [
        ("bear_div", 1.5), ("recent_hi AND NOT breakout", 1.2), ("overbought AND NOT rsi_rising1", 0.8), ("above200", 0.4),
        ("bear_pattern", 0.8),
    ],
    "SHORT_MEAN_REVERSION": [("overbought", 1.2), ("bb_high", 1.0), ("z_high", 0.8), ("range_regime", 0.6), ("NOT strong", 0.6)],
}
LONG = [f for f in FAMILIES if f.startswith("LONG")]
SHORT = [f for f in FAMILIES if f.startswith("SHORT")]


def score_sql(family: str) -> str:
    """Matched weight over total weight, three decimals."""
    parts = FAMILIES[family]
    hit = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in parts)
    return f"round(CAST({hit} AS DOUBLE) / {sum(w for _, w in parts):.1f}, 3)"


def best_sql(families: list[str]) -> str:
    """Name of the best family; the first listed wins a tie."""
    top = f"greatest({', '.join(families)})"
    return "CASE " + " ".join(f"WHEN {f} = {top} THEN '{f}'" for f in families) + " END"


def context_panel(panel: DataFrame, fwd: int = 0) -> DataFrame:
    """Panel with the break/retest context; keeps ``fwd`` look-ahead rows for outcome columns."""
    return add(P.with_halo(panel, BREAK_WINDOW, fwd), CONTEXT)


def add_flags(ctx: DataFrame, known: list[str] = ()) -> DataFrame:
    df = add(ctx, {k: f"coalesce({v}, false)" for k, v in EVIDENCE.items()})
    return add(df, {k: "false" for k in STRUCTURE if k not in known})


VERDICT = {
    "direction": f"""CASE WHEN long_score >= {MIN_EVIDENCE} AND long_score > short_score THEN 'long'
        WHEN short_score >= {MIN_EVIDENCE} AND short_score > long_score THEN 'short' ELSE 'flat' END""",
    "setup_family": f"""CASE WHEN long_score >= {MIN_EVIDENCE} AND long_score > short_score THEN best_long
        WHEN short_score >= {MIN_EVIDENCE} AND short_score > long_score THEN best_short END""",
    "confidence": "greatest(long_score, short_score)",
}
# engine outputs confirm or veto the matching pullback family
BOOST = {
    "LONG_BUY_DIP": """CASE WHEN dip_stage = 'No Uptrend' THEN least(CASE WHEN dip_confirmed THEN 1.0 WHEN dip_score >= 4 THEN greatest(LONG_BUY_DIP, 0.6) ELSE LONG_BUY_DIP END, 0.25)
        WHEN dip_confirmed THEN 1.0 WHEN dip_score >= 4 THEN greatest(LONG_BUY_DIP, 0.6) ELSE LONG_BUY_DIP END""",
    "SHORT_SELL_RALLY": """CASE WHEN rally_stage = 'No Downtrend' THEN least(CASE WHEN rally_confirmed THEN 1.0 WHEN rally_score >= 4 THEN greatest(SHORT_SELL_RALLY, 0.6) ELSE SHORT_SELL_RALLY END, 0.25)
        WHEN rally_confirmed THEN 1.0 WHEN rally_score >= 4 THEN greatest(SHORT_SELL_RALLY, 0.6) ELSE SHORT_SELL_RALLY END""",
}


def family_scores(flags: DataFrame) -> DataFrame:
    return add(flags, {f: score_sql(f) for f in FAMILIES})


def verdict(scores: DataFrame, boost: bool = False) -> DataFrame:
    """Best family per side and the direction; evidence must reach the minimum and beat the other side."""
    if boost:
        scores = P.put(scores, {k: f"CAST({v} AS DOUBLE)" for k, v in BOOST.items()})
    d = add(
        scores,
        {
            "long_score": f"greatest({', '.join(LONG)})",
            "short_score": f"greatest({', '.join(SHORT)})",
            "best_long": best_sql(LONG),
            "best_short": best_sql(SHORT),
        },
    )
    return add(d, VERDICT)


EVIDENCE_TEXT = [
    ("bull_stack", "'bullish MA stack (20>50>200)'"),
    ("bear_stack", "'bearish MA stack (20<50<200)'"),
    ("strong", "concat('strong trend ADX ', cast(cast(round(adx, 0) as int) as string))"),
    ("oversold", "concat('RSI oversold (', cast(cast(round(rsi_14, 0) as int) as string), ')')"),
    ("overbought", "concat('RSI overbought (', cast(cast(round(rsi_14, 0) as int) as string), ')')"),
    ("breakout", "'close above prior 60-bar high (breakout)'"),
    ("breakdown", "'close below prior 60-bar low (breakdown)'"),
    ("recent_hi AND NOT breakout", "'recent upside break - retest candidate'"),
    ("recent_lo AND NOT breakdown", "'recent downside break - retest candidate'"),
    ("at_sup", "'price at confluence support'"),
    ("at_res", "'price at confluence resistance'"),
    ("bull_div", "'regular bullish divergence'"),
    ("bear_div", "'regular bearish divergence'"),
    ("bull_regime", "'Bull Trend regime'"),
    ("bear_regime", "'Bear Trend regime'"),
]


def with_evidence_text(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All texts of the evidence that holds; ``limit`` keeps the first so many for a report."""
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in EVIDENCE_TEXT)
    texts = f"array_compact(array({items}))"
    return add(df, {"evidence": texts if limit is None else f"slice({texts}, 1, {limit})"})


def classify_history(panel: DataFrame, step: int = 3, warmup: int = 260) -> DataFrame:
    """Verdict of every ``step``-th bar after warm-up from causal evidence only."""
    flags = add_flags(P.own_rows(context_panel(panel)).where(f"rn >= {warmup} AND (rn - {warmup}) % {step} = 0"))
    return verdict(family_scores(flags))


def expected_value(p: str, win: str, loss: str = "-1.0", cost: str = "0.0") -> str:
    """p * win + (1 - p) * loss - cost in R; null without a probability."""
    q = f"greatest(least({p}, 1), 0)"
    return f"CASE WHEN {p} IS NOT NULL THEN {q} * {win} + (1 - {q}) * {loss} - {cost} END"


def probability_weighted_rr(ladder: str, p: str, cost: str = "0.0") -> str:
    """Reward over an array of RR rungs, each rung reached 0.6 times as often as the one before."""
    q = f"greatest(least({p}, 1), 0)"
    reach = f"aggregate(transform({ladder}, (r, i) -> {q} * pow(0.6D, i) * r), 0.0D, (a, x) -> a + x)"
    return f"CASE WHEN {p} IS NOT NULL AND size({ladder}) > 0 THEN {reach} - (1 - {q}) - {cost} END"
