"""Queries: levels, volume profile, divergences and reversal patterns on the latest bar."""

from ..operators import panel as P
from ..operators import structure as S
from ..sources import derive as D
from ..sources import store
from . import sql_base  # noqa: F401
from .registry import cte, query, show
from .statistics import q

cte("last1", "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1", "f")
_R = "((pv.high + pv.low + pv.close) / 3)"
_PIV = [(_R, "pivot"), (f"2 * {_R} - pv.low", "pivot_r1"), (f"{_R} + (pv.high - pv.low)", "pivot_r2"), (f"pv.high + 2 * ({_R} - pv.low)", "pivot_r3"), (f"2 * {_R} - pv.high", "pivot_s1"), (f"{_R} - (pv.high - pv.low)", "pivot_s2"), (f"pv.low - 2 * (pv.high - {_R})", "pivot_s3")]
_FIB = []
for _s in ("up", "down"):
    _h, _l = f"{_s}_leg_hi", f"{_s}_leg_lo"
    _FIB += [(_s, f"{_h} - {r} * ({_h} - {_l})" if _s == "up" else f"{_l} + {r} * ({_h} - {_l})", f"fib_{_s}_{r:.3f}") for r in S.FIB_RETRACEMENT]
    _FIB += [(_s, f"{_h} + {r} * ({_h} - {_l})" if _s == "up" else f"{_l} - {r} * ({_h} - {_l})", f"fib_{_s}_ext_{r:.3f}") for r in S.FIB_EXTENSION]
cte(
    "lvl",
    "SELECT symbol, high AS price, 'swing_high' AS tag FROM (SELECT * FROM sw WHERE is_high QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) <= 12) UNION ALL "
    "SELECT symbol, low, 'swing_low' FROM (SELECT * FROM sw WHERE is_low QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) <= 12) UNION ALL "
    + " UNION ALL ".join(f"SELECT symbol, {e}, '{t}' FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 2) pv" for e, t in _PIV)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT symbol, {e}, '{t}' FROM last1 WHERE {s}_leg_hi > {s}_leg_lo" for s, e, t in _FIB),
    "sw", "f", "last1",
)
_LV = "SELECT * FROM lvl"


def clustered(spark, sf):
    return store.stored(spark, "clusters", sf, lambda: S.cluster(S.level_inputs(D.panel_d(spark, sf))).select("symbol", "ts", "close", "atr_14", "tolerance", "levels", "clusters", "nearest_support", "nearest_resistance", "up_leg_hi", "up_leg_lo", "down_leg_hi", "down_leg_lo"))


q("candidate_levels", "symbol tag price:5", _LV, "lvl")(lambda spark, sf: clustered(spark, sf).selectExpr("symbol", "inline(levels)"))
_CLU = """WITH RECURSIVE o AS (SELECT l.symbol, l.price, l.tag, x.tol, x.close, row_number() OVER (PARTITION BY l.symbol ORDER BY l.price, l.tag) AS k FROM lvl l JOIN last1 x ON x.symbol = l.symbol),
  r AS (SELECT symbol, k, price, tag, tol, close, price AS s, 1 AS n, 1 AS c FROM o WHERE k = 1 UNION ALL
   SELECT o.symbol, o.k, o.price, o.tag, o.tol, o.close, CASE WHEN abs(o.price - r.s / r.n) <= o.tol THEN r.s + o.price ELSE o.price END, CASE WHEN abs(o.price - r.s / r.n) <= o.tol THEN r.n + 1 ELSE 1 END,
    CASE WHEN abs(o.price - r.s / r.n) <= o.tol THEN r.c ELSE r.c + 1 END FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1)
  SELECT symbol, c, sum(price) / count(*) AS price, count(*) AS score, list_aggregate(list_sort(list_distinct(list(tag))), 'string_agg', ',') AS tags, any_value(close) AS close FROM r GROUP BY symbol, c"""
cte("clu", _CLU, "lvl", "last1")
q("level_clusters", "symbol price:4 score:i strength tags", "SELECT *, CASE WHEN score >= 3 THEN 'Strong' WHEN score = 2 THEN 'Medium' ELSE 'Weak' END AS strength FROM clu", "clu")(
    lambda spark, sf: P.put(clustered(spark, sf).selectExpr("symbol", "inline(clusters)"), {"strength": "CASE WHEN score >= 3 THEN 'Strong' WHEN score = 2 THEN 'Medium' ELSE 'Weak' END", "tags": "array_join(tags, ',')"})
)
q("nearest_levels", "symbol nearest_support:4 nearest_resistance:4", "SELECT symbol, max(price) FILTER (WHERE price < close) AS nearest_support, min(price) FILTER (WHERE price > close) AS nearest_resistance FROM clu GROUP BY 1", "clu")(clustered)
q("top_zones", "symbol rank:i price:4 score:i", "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, price) AS rank, price, score FROM clu WHERE abs(price - close) <= 0.15 * close QUALIFY rank <= 6", "clu")(lambda spark, sf: S.top_zones(clustered(spark, sf)))
_FM = " UNION ALL ".join(
    f"SELECT symbol, '{s}' AS side, '{n}' AS level, " + ((f"{s}_leg_hi - {r} * ({s}_leg_hi - {s}_leg_lo)" if t else f"{s}_leg_hi + {r} * ({s}_leg_hi - {s}_leg_lo)") if s == "up" else (f"{s}_leg_lo + {r} * ({s}_leg_hi - {s}_leg_lo)" if t else f"{s}_leg_lo - {r} * ({s}_leg_hi - {s}_leg_lo)"))
    + f" AS price, tol FROM last1 WHERE {s}_leg_hi > {s}_leg_lo" for s in ("up", "down") for n, r, t in S.FIB_MAP
)
q("fibonacci_map", "symbol side level price:4 confluence:4", f"SELECT m.symbol, side, level, m.price, (SELECT count(*) FROM (SELECT DISTINCT symbol, price, tag FROM lvl) l WHERE l.symbol = m.symbol AND abs(l.price - m.price) <= m.tol) / 3.0 + 1 AS confluence FROM ({_FM}) m", "lvl", "last1")(
    lambda spark, sf: S.fibonacci_map(clustered(spark, sf))
)
q(
    "volume_profile", "symbol bin:i price:4 volume_pct:4 is_high_volume:b",
    """WITH l AS (SELECT *, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM wb WHERE volume > 0), g AS (SELECT symbol, greatest(1, least(20, CAST(ceil((close - lo) / ((hi - lo) / 20)) AS INT))) AS bin, sum(volume) AS v, any_value(lo) AS lo, any_value(hi) AS hi FROM l GROUP BY 1, 2)
    SELECT symbol, bin, lo + (bin - 0.5) * (hi - lo) / 20 AS price, 100 * v / sum(v) OVER (PARTITION BY symbol) AS volume_pct, v >= 1.5 * avg(v) OVER (PARTITION BY symbol) AS is_high_volume FROM g""", "wb",
)(lambda spark, sf: S.volume_profile(D.walk_d(spark, sf)))
q("anchored_vwap", "symbol vwap:4 n:i", "SELECT symbol, sum((high + low + close) / 3 * volume) / sum(volume) AS vwap, count(*) AS n FROM wb WHERE ts >= DATE '1999-01-01' AND volume > 0 GROUP BY 1", "wb")(lambda spark, sf: S.anchored_vwap(D.walk_d(spark, sf), "1999-01-01"))
cte(
    "pvt",
    """SELECT p.symbol, kind, p.rn AS prn, p.price, f.rsi_14, f.macd_hist, f.volume, row_number() OVER (PARTITION BY p.symbol, kind ORDER BY p.rn DESC) AS k
    FROM (SELECT symbol, rn, 'high' AS kind, high AS price FROM sw WHERE is_high UNION ALL SELECT symbol, rn, 'low', low FROM sw WHERE is_low) p JOIN f ON f.symbol = p.symbol AND f.rn = p.rn""", "sw", "f",
)
q("recent_pivots", "symbol kind k:i prn:i price:2 rsi_14:4", "SELECT * FROM pvt WHERE k <= 3", "pvt")(lambda spark, sf: S.recent_pivots(D.panel_d(spark, sf)))
_PW = ", ".join(f"max({c}) FILTER (WHERE k = {i}) AS {c}{i}" for c in ("prn", "price", "rsi_14", "macd_hist") for i in (1, 2, 3))
q(
    "divergences", "symbol osc name confidence:1",
    f"""WITH w AS (SELECT p.symbol, kind, {_PW} FROM pvt p GROUP BY 1, 2), d AS (SELECT w.*, atr_14 FROM w JOIN last1 USING (symbol)),
    o AS (SELECT *, 'rsi_14' AS osc, rsi_141 AS o1, rsi_142 AS o2 FROM d UNION ALL SELECT *, 'macd_hist', macd_hist1, macd_hist2 FROM d),
    c AS (SELECT symbol, osc, CASE WHEN kind = 'high' AND price1 > price2 AND o1 < o2 THEN 'regular bearish' WHEN kind = 'low' AND price1 < price2 AND o1 > o2 THEN 'regular bullish' WHEN kind = 'low' AND price1 > price2 AND o1 < o2 THEN 'hidden bullish' WHEN kind = 'high' AND price1 < price2 AND o1 > o2 THEN 'hidden bearish' END AS name,
     least(95, 45 + CASE WHEN abs(price1 - price2) >= 1.5 * atr_14 THEN 15 WHEN abs(price1 - price2) >= atr_14 THEN 10 ELSE 5 END + CASE WHEN abs(o1 - o2) >= 15 THEN 15 WHEN abs(o1 - o2) >= 8 THEN 10 ELSE 5 END + CASE WHEN prn1 - prn2 >= 6 THEN 10 WHEN prn1 - prn2 >= 3 THEN 5 ELSE 0 END) AS confidence FROM o
     UNION ALL SELECT symbol, 'rsi_14', CASE WHEN kind = 'high' AND rsi_143 > 70 AND ((rsi_142 > rsi_143 AND rsi_141 < rsi_143) OR (rsi_142 <= rsi_143 AND rsi_141 < rsi_142)) THEN 'failure swing bearish' WHEN kind = 'low' AND rsi_143 < 30 AND ((rsi_142 < rsi_143 AND rsi_141 > rsi_143) OR (rsi_142 >= rsi_143 AND rsi_141 > rsi_142)) THEN 'failure swing bullish' END, 70 FROM d)
    SELECT * FROM c WHERE name IS NOT NULL AND confidence >= 65""", "pvt", "last1",
)(lambda spark, sf: S.divergences(D.panel_d(spark, sf)))


@query("reversal_patterns")
def reversal_patterns(spark, sf):
    return show(S.reversal_patterns(D.panel_d(spark, sf)), "symbol name side breakout:4 status confidence:1")
