"""Quant rating: signed factor scores, weights, label bands."""

from __future__ import annotations

WEIGHTS = {"trend": 0.35, "momentum": 0.25, "flow": 0.15, "macro": 0.20, "sentiment": 0.05}


def clip1(e: str) -> str:
    return f"greatest(-1, least(1, {e}))"


# inputs: panel columns, buyer_seller_score, macro bias, sentiment composite
SCORES = {
    "trend": clip1(
        "0.6 * CASE WHEN close > sma_200 THEN 1 ELSE -1 END + 0.4 * coalesce((plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0) * CASE WHEN adx >= 25 THEN 1 WHEN adx >= 15 THEN 0.5 ELSE 0 END"
    ),
    "momentum": clip1("0.5 * (rsi_14 - 50) / 50 + 0.3 * sign(macd_hist) + 0.2 * " + clip1("(bb_pct_b - 0.5) * 2")),
    "flow": clip1("coalesce(buyer_seller_score, 0) / 100"),
    "macro": clip1("coalesce(bias, 0) / 2"),
    "sentiment": clip1("coalesce(composite, 0)"),
}
NET = " + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())
PROB = f"greatest(1, least(99, 50 + 40 * ({NET})))"
LABEL = "CASE WHEN prob_pct >= 85 THEN 'Strong Buy' WHEN prob_pct >= 70 THEN 'Buy' WHEN prob_pct >= 50 THEN 'Neutral' WHEN prob_pct >= 30 THEN 'Sell' ELSE 'Strong Sell' END"
