"""Market regime per bar and on coarser calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import indicators as I
from . import panel as P
from .panel import add

REGIMES = ["Bull Trend", "Bear Trend", "Range / Chop", "High Volatility"]
# first matching rule wins; an unknown input does not match
REGIME = """CASE WHEN adx >= 25 AND close > sma_200 AND slope_20 > 0 THEN 'Bull Trend'
    WHEN adx >= 25 AND close < sma_200 AND slope_20 < 0 THEN 'Bear Trend'
    WHEN atr_ratio > 1.8 THEN 'High Volatility' ELSE 'Range / Chop' END"""
#: Rows that the regime of one bar depends on, with some to spare.
LOOKBACK = 330
CONFIDENCE = "CASE WHEN adx > 40 THEN 0.85D WHEN adx > 25 THEN 0.70D ELSE 0.55D END"


def regimes(bars: DataFrame) -> DataFrame:
    """Regime per bar; needs only bounded windows, so one shuffle."""
    return add(I.bounded(bars, I.REGIME_INPUTS), {"regime": REGIME, "regime_confidence": CONFIDENCE}).drop("tr")


def standardized(reg: DataFrame) -> DataFrame:
    """Per-symbol z-scores (sample deviation) of slope, ADX, distance and ATR ratio.

    Moments come from a map-side-combined aggregate joined back on symbol.
    """
    cols = ["slope_20", "adx", "vs200", "atr_ratio"]
    f = reg.selectExpr("symbol", "ts", "rn", "regime", "slope_20", "adx", "price_vs_200sma * 100 AS vs200", "atr_ratio")
    m = f.groupBy("symbol").agg(*[F.expr(f"{fn}({n}) AS _{fn}_{n}") for n in cols for fn in ("avg", "stddev_samp")])
    z = [f"({n} - _avg_{n}) / coalesce(nullif(_stddev_samp_{n}, 0), 1) AS {n}" for n in cols]
    return f.join(m, "symbol").selectExpr("symbol", "ts", "rn", "regime", *z)


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars by calendar unit ('week', 'month'), labelled by the period start."""
    b = bars.selectExpr("symbol", f"to_date(date_trunc('{unit}', ts)) AS ts", "ts AS _t", "open", "high", "low", "close", "volume")
    return b.groupBy("symbol", "ts").agg(
        *[F.expr(e) for e in ("min_by(open, _t) AS open", "max(high) AS high", "min(low) AS low", "max_by(close, _t) AS close", "sum(volume) AS volume")]
    )


def multi_timeframe(bars: DataFrame) -> DataFrame:
    """Latest regime on daily, weekly and monthly bars and the consensus across them.

    All three calendars run as one panel whose key also names the timeframe. A tie is decided by
    the fixed priority of ``REGIMES``.
    """
    all_tf = None
    for tf, b in (("D", bars), ("W", resample(bars, "week")), ("M", resample(bars, "month"))):
        p = b.selectExpr(f"concat(symbol, '|{tf}') AS symbol", "ts", "open", "high", "low", "close", "volume")
        all_tf = p if all_tf is None else all_tf.unionByName(p)
    # bounded windows of the latest bar reach back fewer rows than this, so older bars are numbered but not computed
    numbered = P.index_panel(all_tf)
    newest = numbered.groupBy("symbol").agg(F.expr("max(rn) AS _n"))
    recent = numbered.join(newest, "symbol").where(f"rn > _n - {LOOKBACK}").drop("_n")
    last = P.put(
        P.latest(regimes(recent)), {"timeframe": "substring_index(symbol, '|', -1)", "symbol": "substring_index(symbol, '|', 1)"}
    )
    order = "array_position(array({}), regime)".format(", ".join(f"'{r}'" for r in REGIMES))
    votes = last.groupBy("symbol", "regime").agg(F.expr("count(*) AS n"), F.expr(f"min({order}) AS o"))
    return last.join(votes.groupBy("symbol").agg(F.expr("max_by(regime, struct(n, -o)) AS consensus")), "symbol")
