"""Swing points, levels, volume profile and chart structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import indicators as I
from . import panel as P
from .panel import add, over

# fixed values: ratio sets of the level study
FIB_RETRACEMENT = [0.236, 0.382, 0.5, 0.618, 0.786]
FIB_EXTENSION = [1.272, 1.618, 2.0, 2.618]
MAX_SWINGS = 12

MEMORY = ["_h", "_l", "_up", "_dn"]


def add_swing_locals(seg: DataFrame, price_at: str = "extreme") -> DataFrame:
    """Swing memory inside one segment; completed by :func:`finish_swing_memory`.

    ``price_at='confirmation'`` reads the price on the confirmation row instead of the extreme.
    """
    hp, lp = ("sh_price", "sl_price") if price_at == "extreme" else ("high", "low")
    h, lo = f"CASE WHEN sh THEN {hp} END", f"CASE WHEN sl THEN {lp} END"
    seg = add(
        seg,
        {
            "_h": f"last({h}, true) {over(None)}",
            "_l": f"last({lo}, true) {over(None)}",
            "_hb": f"last({h}, true) {over(None, -1)}",
            "_lb": f"last({lo}, true) {over(None, -1)}",
        },
    )
    return add(
        seg,
        {
            "_up": f"last(CASE WHEN sh THEN named_struct('hi', {hp}, 'lo', _lb) END, true) {over(None)}",
            "_dn": f"last(CASE WHEN sl THEN named_struct('hi', _hb, 'lo', {lp}) END, true) {over(None)}",
        },
    ).drop("_hb", "_lb")


# a leg opened in a segment without an opposite swing takes the one known before that segment
SWING_LEVELS = (
    {"_pl": P.last_seen("_l"), "_ph": P.last_seen("_h")},
    {
        "_upx": "CASE WHEN _up IS NOT NULL THEN named_struct('hi', _up.hi, 'lo', coalesce(_up.lo, _pl)) END",
        "_dnx": "CASE WHEN _dn IS NOT NULL THEN named_struct('hi', coalesce(_dn.hi, _ph), 'lo', _dn.lo) END",
    },
)
SWING_CARRY = {"_kh": "_ph", "_kl": "_pl", "_kup": P.last_seen("_upx"), "_kdn": P.last_seen("_dnx")}
CARRIED = {"extra_ends": MEMORY, "extra_levels": SWING_LEVELS, "extra_carry": SWING_CARRY}


def finish_swing_memory(df: DataFrame) -> DataFrame:
    """Last confirmed swing high/low and the last up/down leg on every bar.

    A leg pairs the newest swing with the newest opposite swing known on the row before it.
    """
    return add(
        df,
        {
            "last_swing_high": "coalesce(_h, _kh)",
            "last_swing_low": "coalesce(_l, _kl)",
            "up_leg_hi": "CASE WHEN _up IS NOT NULL THEN _up.hi ELSE _kup.hi END",
            "up_leg_lo": "CASE WHEN _up IS NOT NULL THEN coalesce(_up.lo, _kl) ELSE _kup.lo END",
            "down_leg_hi": "CASE WHEN _dn IS NOT NULL THEN coalesce(_dn.hi, _kh) ELSE _kdn.hi END",
            "down_leg_lo": "CASE WHEN _dn IS NOT NULL THEN _dn.lo ELSE _kdn.lo END",
        },
    ).drop(*MEMORY, *SWING_CARRY)


def swing_memory(bars: DataFrame, price_at: str = "extreme") -> DataFrame:
    h = P.own_rows(I.with_features(P.chunked(bars, 5), I.SWINGS))
    seg = add_swing_locals(P.segment(h), price_at)
    return finish_swing_memory(P.scan(seg, {}, **CARRIED)).drop("_c")


def swings(bars: DataFrame) -> DataFrame:
    """One row per confirmed swing: symbol, kind, ordinal and time of the extreme bar, price."""
    h = P.own_rows(I.with_features(P.chunked(bars, 5), [*I.SWINGS, "swing_ts"])).where("sh OR sl")
    return h.selectExpr(
        "symbol", "rn - 2 AS rn", "swing_ts AS ts",
        """inline(filter(array(CASE WHEN sh THEN named_struct('kind', 'high', 'price', sh_price) END,
            CASE WHEN sl THEN named_struct('kind', 'low', 'price', sl_price) END), x -> x IS NOT NULL))""",
    )


LEVEL = "struct<price:double,tag:string>"


def _lv(price: str, tag: str) -> str:
    return f"named_struct('price', cast({price} AS double), 'tag', '{tag}')"


def pivot_items() -> str:
    """Classical pivots of the previous bar (prev.high, prev.low, prev.close) as an array of levels."""
    h, lo, p = "prev.high", "prev.low", "((prev.high + prev.low + prev.close) / 3)"
    rows = [
        (p, "pivot"), (f"2 * {p} - {lo}", "pivot_r1"), (f"{p} + ({h} - {lo})", "pivot_r2"), (f"{h} + 2 * ({p} - {lo})", "pivot_r3"),
        (f"2 * {p} - {h}", "pivot_s1"), (f"{p} - ({h} - {lo})", "pivot_s2"), (f"{lo} - 2 * ({h} - {p})", "pivot_s3"),
    ]
    return "array(" + ", ".join(_lv(a, b) for a, b in rows) + ")"


def fib_items(side: str) -> str:
    """Retracements and extensions of the last leg of one side; empty without a leg."""
    hi, lo = f"{side}_leg_hi", f"{side}_leg_lo"
    rng = f"({hi} - {lo})"
    rows = []
    for r in FIB_RETRACEMENT:
        rows.append((f"{hi} - {r} * {rng}" if side == "up" else f"{lo} + {r} * {rng}", f"fib_{side}_{r:.3f}"))
    for r in FIB_EXTENSION:
        rows.append((f"{hi} + {r} * {rng}" if side == "up" else f"{lo} - {r} * {rng}", f"fib_{side}_ext_{r:.3f}"))
    return f"CASE WHEN {rng} > 0 THEN array({', '.join(_lv(a, b) for a, b in rows)}) ELSE cast(array() AS array<{LEVEL}>) END"


def level_inputs(panel: DataFrame) -> DataFrame:
    """Latest row per symbol with the previous bar, both last legs and the array of candidate levels.

    A symbol contributes at most 12 + 12 swings, 7 pivots and 18 Fibonacci levels.
    """
    def recent(flag, price, tag):
        s = P.last_n(panel.where(flag).select("symbol", "ts", price), MAX_SWINGS)
        return s.groupBy("symbol").agg(F.expr(f"collect_list(named_struct('price', {price}, 'tag', '{tag}')) AS _{tag}"))

    prev = P.last_n(panel.select("symbol", "ts", "high", "low", "close"), 2).where("k = 2").selectExpr("symbol", "struct(high, low, close) AS prev")
    d = P.latest(panel).join(prev, "symbol", "left")
    d = d.join(recent("sh", "sh_price", "swing_high"), "symbol", "left").join(recent("sl", "sl_price", "swing_low"), "symbol", "left")
    none = f"cast(array() AS array<{LEVEL}>)"
    d = add(d, {"_piv": f"CASE WHEN prev IS NOT NULL THEN {pivot_items()} ELSE {none} END", "_fu": fib_items("up"), "_fd": fib_items("down")})
    return add(
        d,
        {
            "tolerance": "greatest(0.35 * atr_14, 0.001 * close)",
            "levels": f"array_sort(concat(coalesce(_swing_high, {none}), coalesce(_swing_low, {none}), _piv, _fu, _fd))",
        },
    )


def cluster(levels: DataFrame) -> DataFrame:
    """Greedy confluence clusters: a level joins while it is within tolerance of the running mean."""
    done = "array<struct<price:double,score:int,tags:array<string>>>"
    close_out = "named_struct('price', a.s / a.n, 'score', a.n, 'tags', array_sort(array_distinct(a.tags)))"
    fold = f"""aggregate(levels, named_struct('done', cast(array() AS {done}), 's', 0.0D, 'n', 0, 'tags', cast(array() AS array<string>)),
        (a, x) -> CASE WHEN a.n = 0 THEN named_struct('done', a.done, 's', x.price, 'n', 1, 'tags', array(x.tag))
          WHEN abs(x.price - a.s / a.n) <= tolerance THEN named_struct('done', a.done, 's', a.s + x.price, 'n', a.n + 1, 'tags', concat(a.tags, array(x.tag)))
          ELSE named_struct('done', concat(a.done, array({close_out})), 's', x.price, 'n', 1, 'tags', array(x.tag)) END,
        a -> CASE WHEN a.n = 0 THEN a.done ELSE concat(a.done, array({close_out})) END)"""
    d = add(levels, {"clusters": fold})
    return add(
        d,
        {
            "nearest_support": "array_max(filter(transform(clusters, c -> c.price), p -> p < close))",
            "nearest_resistance": "array_min(filter(transform(clusters, c -> c.price), p -> p > close))",
        },
    )


def top_zones(clustered: DataFrame, max_distance: float = 0.15, n: int = 6) -> DataFrame:
    """Strongest clusters within 15% of the close, at most six per symbol."""
    near = f"filter(clusters, c -> abs(c.price - close) <= {max_distance} * close)"
    keyed = f"array_sort(transform({near}, c -> named_struct('o', -c.score, 'price', c.price, 'score', c.score)))"
    return clustered.selectExpr("symbol", f"posexplode(slice({keyed}, 1, {n})) AS (pos, z)").selectExpr("symbol", "pos + 1 AS rank", "z.price AS price", "z.score AS score")


# fixed values: rows of the ratio map
FIB_MAP = [("38.2%", 0.382, 1), ("50.0%", 0.5, 1), ("61.8%", 0.618, 1), ("78.6%", 0.786, 1), ("127.2%", 1.272, 0), ("161.8%", 1.618, 0)]


def fibonacci_map(levels: DataFrame) -> DataFrame:
    """Ratio rows of both last legs with the number of candidate levels within tolerance (count / 3 + 1)."""
    items = []
    for side in ("up", "down"):
        hi, lo = f"{side}_leg_hi", f"{side}_leg_lo"
        for name, r, retr in FIB_MAP:
            px = (f"{hi} - {r} * ({hi} - {lo})" if retr else f"{hi} + {r} * ({hi} - {lo})") if side == "up" else (f"{lo} + {r} * ({hi} - {lo})" if retr else f"{lo} - {r} * ({hi} - {lo})")
            items.append(f"named_struct('side', '{side}', 'level', '{name}', 'price', CASE WHEN {hi} > {lo} THEN {px} END)")
    d = levels.selectExpr("symbol", "close", "tolerance", "levels", f"inline(array({', '.join(items)}))").where("price IS NOT NULL")
    return d.selectExpr("symbol", "side", "level", "price", "size(filter(array_distinct(levels), x -> abs(x.price - price) <= tolerance)) / 3 + 1 AS confluence")


def volume_profile(bars: DataFrame, n_bins: int = 20, mult: float = 1.5) -> DataFrame:
    """Volume share of equal-width price bins per symbol (right-closed); a bin at least 1.5 times the occupied mean is a node."""
    b = bars.where("volume > 0")
    lim = b.groupBy("symbol").agg(F.expr("min(low) AS lo"), F.expr("max(high) AS hi"))
    d = b.join(lim.where("hi > lo"), "symbol").selectExpr("symbol", "lo", "hi", "volume", f"greatest(1, least({n_bins}, int(ceil((close - lo) / ((hi - lo) / {n_bins}))))) AS bin")
    g = d.groupBy("symbol", "bin").agg(F.expr("sum(volume) AS vol"), F.expr("max(lo) AS lo"), F.expr("max(hi) AS hi"))
    t = g.groupBy("symbol").agg(F.expr("sum(vol) AS _t"), F.expr("avg(vol) AS _a"))
    return g.join(t, "symbol").selectExpr("symbol", "bin", f"lo + (bin - 0.5) * (hi - lo) / {n_bins} AS price", "100 * vol / _t AS volume_pct", f"vol >= {mult} * _a AS is_high_volume")


def anchored_vwap(bars: DataFrame, anchor: str) -> DataFrame:
    """Volume-weighted typical price per symbol from the anchor date on."""
    return bars.where(f"ts >= DATE '{anchor}' AND volume > 0").groupBy("symbol").agg(F.expr("sum((high + low + close) / 3 * volume) / sum(volume) AS vwap"), F.expr("count(*) AS n"))


def recent_pivots(panel: DataFrame, n: int = 3) -> DataFrame:
    """Last n confirmed pivots of each kind per symbol with oscillators and volume at the pivot bar, newest first (k = 1)."""
    pts = None
    for kind, flag, px in (("high", "sh", "sh_price"), ("low", "sl", "sl_price")):
        x = P.last_n(panel.where(flag).selectExpr("symbol", "ts", "rn - 2 AS prn", f"{px} AS price", f"'{kind}' AS kind"), n)
        pts = x if pts is None else pts.unionByName(x)
    bars = panel.selectExpr("symbol", "rn AS prn", "rsi_14", "macd_hist", "volume")
    return pts.join(bars, ["symbol", "prn"])


def divergences(panel: DataFrame, min_conf: float = 65) -> DataFrame:
    """Regular and hidden divergences of the last two pivots and RSI failure swings of the last three."""
    p = recent_pivots(panel)
    cols = ["prn", "price", "rsi_14", "macd_hist"]
    wide = p.groupBy("symbol", "kind").agg(*[F.expr(f"max(CASE WHEN k = {i} THEN {c} END) AS {c}_{i}") for i in (1, 2, 3) for c in cols])
    d = wide.join(P.latest(panel).selectExpr("symbol", "atr_14"), "symbol")
    o = d.selectExpr("*", "stack(2, 'rsi_14', rsi_14_1, rsi_14_2, 'macd_hist', macd_hist_1, macd_hist_2) AS (osc, o1, o2)")
    conf = """least(95, 45 + CASE WHEN abs(price_1 - price_2) >= 1.5 * atr_14 THEN 15 WHEN abs(price_1 - price_2) >= atr_14 THEN 10 ELSE 5 END
        + CASE WHEN abs(o1 - o2) >= 15 THEN 15 WHEN abs(o1 - o2) >= 8 THEN 10 ELSE 5 END + CASE WHEN prn_1 - prn_2 >= 6 THEN 10 WHEN prn_1 - prn_2 >= 3 THEN 5 ELSE 0 END)"""
    typ = """CASE WHEN kind = 'high' AND price_1 > price_2 AND o1 < o2 THEN 'regular bearish' WHEN kind = 'low' AND price_1 < price_2 AND o1 > o2 THEN 'regular bullish'
        WHEN kind = 'low' AND price_1 > price_2 AND o1 < o2 THEN 'hidden bullish' WHEN kind = 'high' AND price_1 < price_2 AND o1 > o2 THEN 'hidden bearish' END"""
    div = o.selectExpr("symbol", "osc", f"{typ} AS name", f"double({conf}) AS confidence").where("name IS NOT NULL")
    r1, r2, r3 = "rsi_14_3", "rsi_14_2", "rsi_14_1"
    fail = d.selectExpr(
        "symbol", "'rsi_14' AS osc",
        f"""CASE WHEN kind = 'high' AND (({r1} > 70 AND {r2} > {r1} AND {r3} < {r1}) OR ({r1} > 70 AND {r2} <= {r1} AND {r3} < {r2})) THEN 'failure swing bearish'
        WHEN kind = 'low' AND (({r1} < 30 AND {r2} < {r1} AND {r3} > {r1}) OR ({r1} < 30 AND {r2} >= {r1} AND {r3} > {r2})) THEN 'failure swing bullish' END AS name""",
        "70.0D AS confidence",
    ).where("name IS NOT NULL")
    return div.unionByName(fail).where(f"confidence >= {min_conf}")


def reversal_patterns(panel: DataFrame, base: float = 45, cap: float = 95, forming_cap: float = 85, min_p: float = 65) -> DataFrame:
    """Double top/bottom and head and shoulders (both directions) from the last pivots, with a structural score."""
    p = recent_pivots(panel, 12)
    now = P.latest(panel).selectExpr("symbol", "close", "atr_14", "greatest(0.35 * atr_14, 0.001 * close) AS tol")
    ext = p.where("k <= 3").groupBy("symbol", "kind").agg(*[F.expr(f"max(CASE WHEN k = {i} THEN {c} END) AS {c}_{i}") for i in (1, 2, 3) for c in ("prn", "price", "volume")])
    opp = p.selectExpr("symbol", "CASE kind WHEN 'high' THEN 'low' ELSE 'high' END AS kind", "prn", "price")
    j = ext.join(opp, ["symbol", "kind"], "left")
    inside2, inside3 = "prn > prn_2 AND prn < prn_1", "prn > prn_3 AND prn < prn_1"
    g = j.groupBy("symbol", "kind", *[f"{c}_{i}" for i in (1, 2, 3) for c in ("prn", "price", "volume")]).agg(
        F.expr(f"CASE kind WHEN 'high' THEN min(CASE WHEN {inside2} THEN price END) ELSE max(CASE WHEN {inside2} THEN price END) END AS neck2"),
        F.expr(f"count(CASE WHEN {inside3} THEN 1 END) AS n3"),
        F.expr(f"min_by(price, prn) FILTER (WHERE {inside3}) AS na"), F.expr(f"max_by(price, prn) FILTER (WHERE {inside3}) AS nb"),
    )
    d = add(g.join(now, "symbol"), {"sg": "CASE kind WHEN 'high' THEN 1 ELSE -1 END", "neck3": "CASE kind WHEN 'high' THEN least(na, nb) ELSE greatest(na, nb) END"})
    vol = "CASE WHEN volume_{0} > 0 AND (CASE kind WHEN 'high' THEN volume_1 < volume_{0} ELSE volume_1 > volume_{0} END) THEN 8 ELSE 0 END"
    near = "CASE WHEN sg * (close - {0}) < 0 THEN 10 WHEN {1} <= atr_14 THEN 5 ELSE 0 END"
    two = d.where("prn_1 - prn_2 >= 3 AND neck2 IS NOT NULL AND abs(price_1 - price_2) <= tol").selectExpr(
        "*", "CASE kind WHEN 'high' THEN least(price_1, price_2) - neck2 ELSE neck2 - greatest(price_1, price_2) END AS depth"
    ).where("depth >= 0.75 * atr_14").selectExpr(
        "symbol", "CASE kind WHEN 'high' THEN 'Double Top' ELSE 'Double Bottom' END AS name", "sg", "neck2 AS breakout", "close",
        f"{base} + CASE WHEN abs(price_1 - price_2) <= 0.4 * tol THEN 10 ELSE 5 END + CASE WHEN depth >= 1.5 * atr_14 THEN 10 ELSE 5 END + {vol.format(2)} + {near.format('neck2', 'sg * (close - neck2)')} AS p",
    )
    three = d.where("sg * (price_2 - price_3) > 0 AND sg * (price_2 - price_1) > 0 AND abs(price_3 - price_1) <= tol AND n3 >= 2").selectExpr(
        "*", "abs(price_2 - greatest(price_3, price_1)) AS prom"
    ).where("prom >= 0.5 * atr_14").selectExpr(
        "symbol", "CASE kind WHEN 'high' THEN 'Head & Shoulders' ELSE 'Inverse Head & Shoulders' END AS name", "sg", "neck3 AS breakout", "close",
        f"{base} + CASE WHEN abs(price_3 - price_1) <= 0.4 * tol THEN 10 ELSE 5 END + CASE WHEN prom >= 1.5 * atr_14 THEN 10 ELSE 5 END + CASE WHEN abs(na - nb) <= 0.25 * atr_14 THEN 5 ELSE 0 END + {vol.format(3)} + {near.format('neck3', 'abs(close - neck3)')} AS p",
    )
    u = add(two.unionByName(three), {"status": "CASE WHEN sg * (close - breakout) < 0 THEN 'Confirmed' ELSE 'Forming' END"})
    u = add(u, {"confidence": f"double(greatest(0, least(p, CASE status WHEN 'Confirmed' THEN {cap} ELSE {forming_cap} END)))", "side": "CASE sg WHEN 1 THEN 'bearish' ELSE 'bullish' END"})
    return u.where(f"confidence >= {min_p}").select("symbol", "name", "side", "breakout", "status", "confidence")


def continuation_patterns(panel: DataFrame, base: float = 45, cap: float = 95, forming_cap: float = 85, min_p: float = 65) -> DataFrame:
    """Triangles, flags or pennants, and cup with handle from the newest confirmed pivots.

    Only the last pivots of a symbol are needed, so the pivot lists are group-limited before the
    shuffle; trend lines are regression aggregates over the last eight pivots.
    """
    p = recent_pivots(panel, 12)
    now = P.latest(panel).selectExpr("symbol", "rn AS now_rn", "close", "atr_14", "greatest(0.35 * atr_14, 0.001 * close) AS tol")
    last8 = p.selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY prn DESC, kind) AS j").where("j <= 8")

    def line(k, fn):
        return f"{fn}(CASE WHEN kind = '{k}' THEN price END, CASE WHEN kind = '{k}' THEN prn END)"

    t = last8.groupBy("symbol").agg(
        F.expr("max(prn) AS x1"), F.expr("min(prn) AS x0"), F.expr("count(*) AS touches"),
        *[F.expr(f"{line(k, 'regr_slope')} AS {n}s") for k, n in (("high", "h"), ("low", "l"))],
        *[F.expr(f"{line(k, 'regr_intercept')} AS {n}i") for k, n in (("high", "h"), ("low", "l"))],
    ).join(now, "symbol")
    t = add(t, {"flat": "0.5 * atr_14 / greatest(1, x1 - x0)", "h1": "hs * x1 + hi", "l1": "ls * x1 + li", "w0": "hs * x0 + hi - ls * x0 - li"})
    t = add(
        t,
        {
            "name": """CASE WHEN abs(hs) <= flat AND ls > flat THEN 'Ascending Triangle' WHEN abs(ls) <= flat AND hs < -flat THEN 'Descending Triangle'
                WHEN hs < -flat AND ls > flat THEN 'Symmetric Triangle' END""",
            "side": """CASE WHEN abs(hs) <= flat AND ls > flat THEN 'bullish' WHEN abs(ls) <= flat AND hs < -flat THEN 'bearish'
                WHEN abs(close - h1) <= abs(close - l1) THEN 'bearish' ELSE 'bullish' END""",
            "breakout": """CASE WHEN abs(hs) <= flat AND ls > flat THEN h1 WHEN abs(ls) <= flat AND hs < -flat THEN l1
                WHEN abs(close - h1) <= abs(close - l1) THEN h1 ELSE l1 END""",
            "w1": "h1 - l1",
        },
    ).where("name IS NOT NULL AND w0 > 0 AND w1 > 0 AND w1 < w0")
    tri = t.selectExpr(
        "symbol", "name", "side", "breakout", "close",
        f"{base} + CASE WHEN touches >= 5 THEN 10 ELSE 5 END + CASE WHEN w1 <= 0.6 * w0 THEN 10 ELSE 5 END + CASE WHEN abs(close - breakout) <= atr_14 THEN 5 ELSE 0 END AS p0",
    )
    two = last8.where("j <= 2").groupBy("symbol").agg(*[F.expr(f"max(CASE WHEN j = {i} THEN {c} END) AS {c}{i}") for i in (1, 2) for c in ("prn", "price", "kind")])
    two = add(two.join(now, "symbol").where("kind1 <> kind2 AND prn1 - prn2 > 2"), {"pole": "CASE kind1 WHEN 'high' THEN price1 - price2 ELSE price2 - price1 END"}).where("pole >= 3 * atr_14")
    cons = panel.selectExpr("symbol AS s", "rn", "high", "low")
    fl = two.join(cons, F.expr("s = symbol AND rn BETWEEN prn1 + 1 AND prn1 + 10")).groupBy("symbol", "kind1", "pole", "close", "atr_14").agg(
        F.expr("count(*) AS n"), F.expr("max(high) AS ch"), F.expr("min(low) AS cl")
    ).where("n >= 3 AND (ch - cl) / pole <= 0.6 AND ch - cl <= 0.75 * atr_14")
    flag = fl.selectExpr(
        "symbol", "CASE WHEN n >= 5 THEN 'Flag' ELSE 'Pennant' END AS name", "CASE kind1 WHEN 'high' THEN 'bullish' ELSE 'bearish' END AS side",
        "CASE kind1 WHEN 'high' THEN ch + 0.5 * atr_14 ELSE cl - 0.5 * atr_14 END AS breakout", "close",
        f"{base} + CASE WHEN pole >= 4 * atr_14 THEN 10 ELSE 5 END + CASE WHEN (ch - cl) / pole <= 0.4 THEN 10 ELSE 5 END + CASE WHEN n >= 5 THEN 5 ELSE 0 END AS p0",
    )
    piv = p.groupBy("symbol").agg(F.expr("array_sort(collect_list(CASE WHEN kind = 'high' THEN struct(prn, price) END)) AS hs"), F.expr("array_sort(collect_list(CASE WHEN kind = 'low' THEN struct(prn, price) END)) AS ls")).join(now, "symbol")
    # the bottom is the newest low that still has a right rim and a handle low after it
    cup = piv.selectExpr("symbol", "close", "atr_14", "tol", "hs", "ls", "element_at(filter(ls, b -> exists(hs, h -> h.prn > b.prn) AND exists(ls, q -> q.prn > b.prn AND q.price > b.price)), -1) AS b").where("b IS NOT NULL")
    cup = add(cup, {"l": "try_element_at(filter(hs, h -> h.prn < b.prn), -1)", "r": "try_element_at(filter(hs, h -> h.prn > b.prn), 1)"}).where("l IS NOT NULL AND r.prn - l.prn >= 5 AND abs(l.price - r.price) <= tol")
    cup = add(cup, {"rim": "greatest(l.price, r.price)", "handle": "try_element_at(filter(ls, q -> q.prn > r.prn AND q.price > b.price), 1).price"})
    cup = add(cup, {"rise": "rim - b.price", "depth": "r.price - handle"}).where("rise >= 1.5 * atr_14 AND depth <= 0.382 * rise")
    cup = cup.selectExpr(
        "symbol", "'Cup & Handle' AS name", "'bullish' AS side", "rim AS breakout", "close",
        f"{base} + CASE WHEN abs(l.price - r.price) <= 0.4 * tol THEN 10 ELSE 5 END + CASE WHEN rise >= 3 * atr_14 THEN 10 ELSE 5 END + CASE WHEN depth <= 0.25 * rise THEN 10 ELSE 5 END + CASE WHEN close <= rim AND rim - close <= atr_14 THEN 5 ELSE 0 END AS p0",
    )
    u = add(tri.unionByName(flag).unionByName(cup), {"confirmed": "CASE side WHEN 'bullish' THEN close > breakout ELSE close < breakout END"})
    u = add(u, {"status": "CASE WHEN confirmed THEN 'Confirmed' ELSE 'Forming' END", "confidence": f"double(least(p0 + CASE WHEN confirmed THEN 10 ELSE 0 END, CASE WHEN confirmed THEN {cap} ELSE {forming_cap} END))"})
    return u.where(f"confidence >= {min_p}").select("symbol", "name", "side", "breakout", "status", "confidence")
