"""Queries: ladders, opportunity book, plans, alerts, decision log, integrity, promotion."""

from pyspark.sql import functions as F

from ..operators import decisions as C
from ..operators import panel as P
from ..operators import resampling as B
from ..operators import risk as K
from ..operators import setups as U
from ..operators import signals as G
from ..operators import stats as S
from ..sources import derive as D
from ..sources import store
from . import sql_base  # noqa: F401
from .hygiene import macro_joined
from .levels import clustered
from .outcomes import signals4
from .registry import cte, query, show
from .risk import positions
from .statistics import _FTD, bar_outcomes, candidates, q

cte("ldr0", "SELECT p.*, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg FROM posn p", "posn")
cte(
    "ldr",
    """SELECT symbol, side, entry, stop, CASE WHEN len(lv) > 0 THEN lv ELSE [entry + sg * abs(entry - stop), entry + sg * 2 * abs(entry - stop), entry + sg * 3 * abs(entry - stop)] END AS t, CASE WHEN len(lv) > 0 THEN 'levels' ELSE 'multiples' END AS source, sg
    FROM (SELECT l.*, coalesce((SELECT list(price ORDER BY sg * price) FROM (SELECT round(c.price, 9) AS price FROM clu c WHERE c.symbol = l.symbol AND l.sg * (c.price - l.entry) > 0.5 * abs(l.entry - l.stop) ORDER BY l.sg * c.price LIMIT 3)), []) AS lv FROM ldr0 l)""", "ldr0", "clu",
)


def ladders(spark, sf):
    return C.target_ladder(positions(spark, sf).join(clustered(spark, sf).select("symbol", "clusters"), "symbol"))


@q("target_ladder", "symbol side source rung:i target:4 rr:5", "SELECT symbol, side, source, i AS rung, t[i] AS target, sg * (t[i] - entry) / abs(entry - stop) AS rr FROM ldr, range(1, 4) r(i) WHERE i <= len(t)", "ldr")
def target_ladder(spark, sf):
    return ladders(spark, sf).selectExpr("symbol", "side", "source", "posexplode(arrays_zip(targets, rrs)) AS (pos, z)").selectExpr("symbol", "side", "source", "pos + 1 AS rung", "z.targets AS target", "z.rrs AS rr")


# first-touch masses per side over all bars price each candidate side
cte("tpp", "SELECT side, count(*) AS n, " + ", ".join(f"avg(CASE WHEN mb = '{k}' THEN 1e0 ELSE 0 END) AS p_{k}" for k in ("tp1", "tp2", "tp3", "sl")) + " FROM (SELECT 'long' AS side, mb_long AS mb FROM f LEFT JOIN mb_long USING (symbol, rn) WHERE atr_14 IS NOT NULL UNION ALL SELECT 'short', mb_short FROM f LEFT JOIN mb_short USING (symbol, rn) WHERE atr_14 IS NOT NULL) GROUP BY 1", "f", "mb_long", "mb_short")


def tp_probs(spark, sf):
    o = bar_outcomes(spark, sf).where("rn >= 13").selectExpr("stack(2, 'long', mb_long, 'short', mb_short) AS (side, mb)")
    return S.agg(o, ["side"], {k: v for k, v in _FTD.items() if k != "p_none"})


_EVQ = {"ev_ladder": K.target_level_ev("p_tp1", "p_tp2", "p_tp3", "p_sl", "0.05"), "ev_alloc": K.allocation_ev("p_tp1", "p_tp2", "p_tp3", "p_sl", "0.05")}
q("target_probability_table", "side n:i p_tp1:5 p_tp2:5 p_tp3:5 p_sl:5 ev_ladder:5 ev_alloc:5", f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in _EVQ.items())} FROM tpp", "tpp")(lambda spark, sf: P.add(tp_probs(spark, sf), _EVQ))
# the gate of the setup's side by the macro bias that was known the day before; without a bias there is none
cte("gates", "SELECT symbol, ts, CASE WHEN bias IS NOT NULL THEN bias >= -0.5 END AS long_ok, CASE WHEN bias IS NOT NULL THEN bias <= 0.5 END AS short_ok FROM mbj", "mbj")
# first-touch masses: of a family with thirty candidates or more, else of the side
cte("tpx", """SELECT side, CAST(NULL AS VARCHAR) AS family, p_tp1 AS a, p_tp2 AS b, p_tp3 AS c, p_sl AS s FROM tpp
    UNION ALL SELECT side, family, avg(CASE WHEN mb = 'tp1' THEN 1e0 ELSE 0 END), avg(CASE WHEN mb = 'tp2' THEN 1e0 ELSE 0 END), avg(CASE WHEN mb = 'tp3' THEN 1e0 ELSE 0 END), avg(CASE WHEN mb = 'sl' THEN 1e0 ELSE 0 END) FROM cand GROUP BY 1, 2 HAVING count(*) >= 30""", "tpp", "cand")
cte("obk", """WITH z AS (
      SELECT h.symbol, h.ts, 'long' AS side, h.close, h.atr_14 AS atr, h.best_long AS family, CASE WHEN h.long_score >= 0.35 THEN h.long_score END AS prob, d.confirmed, d.score AS es, d.entry_lo AS e0, d.invalidation AS stop, d.resistance AS tg, g.long_ok AS gate FROM hist h JOIN dip4 d ON d.symbol = h.symbol AND d.rn = h.rn LEFT JOIN gates g ON g.symbol = h.symbol AND g.ts = h.ts
      UNION ALL SELECT h.symbol, h.ts, 'short', h.close, h.atr_14, h.best_short, CASE WHEN h.short_score >= 0.35 THEN h.short_score END, d.confirmed, d.score, d.entry_hi, d.invalidation, d.target, g.short_ok FROM hist h JOIN rally4 d ON d.symbol = h.symbol AND d.rn = h.rn LEFT JOIN gates g ON g.symbol = h.symbol AND g.ts = h.ts),
    y AS (SELECT *, CASE WHEN market AND close <> stop THEN close ELSE e0 END AS entry FROM (SELECT *, coalesce(atr > 0 AND abs(e0 - close) <= 0.25 * atr, false) AS market FROM z)),
    x AS (SELECT *, nullif(abs(entry - stop), 0) AS risk, e0 + 0.5 * (tg - e0) AS l1, tg AS l2, e0 + 1.5 * (tg - e0) AS l3 FROM y),
    w AS (SELECT *, abs(tg - entry) / risk AS rr, list_sort(list_filter([abs(l1 - entry) / risk, abs(l2 - entry) / risk, abs(l3 - entry) / risk], lambda q: q IS NOT NULL)) AS rs, CASE WHEN 0.03 * atr > 0 AND risk IS NOT NULL THEN 0.03 * atr / risk ELSE 0.05 END AS cost FROM x),
    v AS (SELECT w.*, coalesce(f.a, p.a) AS a, coalesce(f.b, p.b) AS b, coalesce(f.c, p.c) AS c, coalesce(f.s, p.s) AS s, coalesce(list_max(rs), rr) AS best, coalesce(rs[1], 0) AS r1, coalesce(rs[2], 0) AS r2, coalesce(rs[3], 0) AS r3
      FROM w LEFT JOIN (SELECT * FROM tpx WHERE family IS NOT NULL) f ON f.side = w.side AND f.family = w.family LEFT JOIN (SELECT * FROM tpx WHERE family IS NULL) p ON p.side = w.side)
    SELECT *, CASE WHEN prob IS NOT NULL AND a + b + c + s > 0 AND a + b + c + s <= 1.001 THEN a * r1 / 3 + b * (r1 + r2) / 3 + c * (r1 + r2 + r3) / 3 - s - cost END AS ev_alloc, prob * CASE WHEN best >= 1 THEN best ELSE rr END - (1 - prob) - cost AS ev_rank FROM v""", "hist", "dip4", "rally4", "gates", "tpx")
cte("obv", """SELECT *, coalesce(ev_alloc, ev_rank) AS ev, coalesce(family = 'SHORT_REVERSAL', false) AS dead, coalesce(len(rs) > 0 AND best < 1.0, false) AS low, coalesce(NOT gate, false) AS shut,
    concat_ws('; ', CASE WHEN family = 'SHORT_REVERSAL' THEN 'family falsified' END, CASE WHEN len(rs) > 0 AND best < 1.0 THEN 'rr floor' END, CASE WHEN NOT gate THEN 'macro gate' END, CASE WHEN family IS NULL THEN 'no family' END,
      CASE WHEN prob IS NULL THEN 'no probability' END, CASE WHEN prob IS NOT NULL AND rr IS NULL AND best IS NULL THEN 'no payoff' END, CASE WHEN ev_rank <= 0 THEN 'ranking ev' END) AS why FROM obk""", "obk")


def candidate_sides(spark, sf):
    """Both sides of every classified bar: the engines' zone, stop and target, a ladder half way to the target, at it and half again beyond."""
    h = U.classify_history(D.panel_d(spark, sf)).select("symbol", "rn", "ts", "close", "atr_14", "best_long", "best_short", "long_score", "short_score")
    out = None
    for side, entry, target in (("long", "entry_lo", "resistance"), ("short", "entry_hi", "target")):
        e = signals4(spark, sf, side).selectExpr("symbol", "rn", "confirmed", "score AS engine_score", f"{entry} AS entry", "invalidation AS stop", f"{target} AS target")
        d = h.selectExpr("symbol", "rn", "ts", "close", "atr_14 AS atr", f"best_{side} AS family", f"CASE WHEN {side}_score >= 0.35 THEN {side}_score END AS prob", f"'{side}' AS side").join(e, ["symbol", "rn"])
        d = P.add(d, {"ladder": "array(entry + 0.5D * (target - entry), target, entry + 1.5D * (target - entry))", "spread": "0.02D * atr", "slip": "0.005D * atr"})
        out = d if out is None else out.unionByName(d)
    return gated(out, spark, sf)


def tp_tables(spark, sf):
    """First-touch masses of each side, and of each family with thirty candidates or more."""
    side = tp_probs(spark, sf).selectExpr("side", "CAST(NULL AS STRING) AS family", "p_tp1 AS tp1", "p_tp2 AS tp2", "p_tp3 AS tp3", "p_sl AS sl")
    own = S.agg(candidates(spark, sf), ["side", "family"], {k: f"avg(CASE WHEN mb = '{k}' THEN 1e0 ELSE 0 END)" for k in ("tp1", "tp2", "tp3", "sl")} | {"n": "count(*)"})
    return side.unionByName(own.where("n >= 30").drop("n"))


@q(
    "opportunity_book", "symbol ts:d path direction status ev_long:5 ev_short:5 entry_type_long entry_type_short cost_r_long:5 cost_r_short:5 best_rr_long:5 best_rr_short:5 why_long why_short",
    """SELECT *, CASE WHEN direction = 'flat' THEN 'FLAT' WHEN path = 'rule' THEN 'CONFIRMED' ELSE 'TRADE' END AS status FROM (
    SELECT l.symbol, l.ts, CASE WHEN l.ev IS NULL AND s.ev IS NULL THEN 'rule' ELSE 'ev' END AS path, l.ev AS ev_long, s.ev AS ev_short, CASE WHEN l.market THEN 'market' ELSE 'limit' END AS entry_type_long, CASE WHEN s.market THEN 'market' ELSE 'limit' END AS entry_type_short,
      l.cost AS cost_r_long, s.cost AS cost_r_short, l.best AS best_rr_long, s.best AS best_rr_short, l.why AS why_long, s.why AS why_short,
      CASE WHEN l.ev IS NULL AND s.ev IS NULL THEN CASE WHEN l.confirmed AND NOT (s.confirmed AND s.es > l.es) THEN CASE WHEN l.dead THEN 'flat' ELSE 'long' END WHEN s.confirmed THEN CASE WHEN s.dead THEN 'flat' ELSE 'short' END ELSE 'flat' END
        WHEN l.ev > 0 AND (s.ev IS NULL OR l.ev >= s.ev) THEN CASE WHEN l.dead OR l.low OR l.shut THEN 'flat' ELSE 'long' END WHEN s.ev > 0 THEN CASE WHEN s.dead OR s.low OR s.shut THEN 'flat' ELSE 'short' END ELSE 'flat' END AS direction
    FROM (SELECT * FROM obv WHERE side = 'long') l JOIN (SELECT * FROM obv WHERE side = 'short') s ON s.symbol = l.symbol AND s.ts = l.ts)""", "obv",
)
def opportunity_book(spark, sf):
    """Both sides of every classified bar priced from their ladders, the verdict, and what each side failed."""
    return C.opportunity_book(C.price_sides(candidate_sides(spark, sf), tp_tables(spark, sf), 1.0), 0.0)


_TP = "CASE WHEN stage = 'Confirmed' THEN 'CONFIRMED' WHEN stage IN ('In Pullback', 'In Rally') THEN 'WATCH' ELSE 'NO_SETUP' END AS status"
_PLAN = "SELECT s.*, CASE side WHEN 'long' THEN long_ok ELSE short_ok END AS gate FROM (SELECT symbol, ts, rn, stage, close, entry_lo, entry_hi, 'long' AS side FROM dip4 UNION ALL SELECT symbol, ts, rn, stage, close, entry_lo, entry_hi, 'short' FROM rally4) s LEFT JOIN gates g ON g.symbol = s.symbol AND g.ts = s.ts"


def gated(rows, spark, sf):
    """Adds the macro gate of each row's side."""
    g = macro_joined(spark, sf).selectExpr("symbol", "ts", "CASE WHEN bias IS NOT NULL THEN long_gate = 1 END AS _l", "CASE WHEN bias IS NOT NULL THEN short_gate = 1 END AS _s")
    return P.add(rows.join(g, ["symbol", "ts"], "left"), {"gate": "CASE side WHEN 'long' THEN _l ELSE _s END"}).drop("_l", "_s")


@q(
    "trade_plan", "side status order_type n:i",
    f"""SELECT side, status, order_type, count(*) AS n FROM (SELECT *, {_TP}, CASE WHEN NOT gate THEN 'WAIT-MACRO' WHEN stage = 'Confirmed' AND side = 'long' THEN CASE WHEN close > entry_hi THEN 'BUY-LIMIT' ELSE 'BUY-ZONE' END
    WHEN stage = 'Confirmed' THEN CASE WHEN close < entry_lo THEN 'SELL-LIMIT' ELSE 'SELL-ZONE' END WHEN stage IN ('In Pullback', 'In Rally') THEN 'WAIT-CONFIRM' ELSE 'NONE' END AS order_type FROM ({_PLAN})) GROUP BY 1, 2, 3""", "dip4", "rally4", "gates",
)
def trade_plan(spark, sf):
    cols = ["symbol", "ts", "rn", "stage", "close", "entry_lo", "entry_hi"]
    u = signals4(spark, sf, "long").selectExpr(*cols, "'long' AS side").unionByName(signals4(spark, sf, "short").selectExpr(*cols, "'short' AS side"))
    return S.agg(C.trade_plan(gated(u, spark, sf)), ["side", "status", "order_type"], {"n": "count(*)"})


# ---- alerts -------------------------------------------------------------------------------------
cte("alr", "SELECT symbol, ts, rn, score, 'long' AS side, entry_lo, entry_hi, bias_score, printf('%s:%.6f-%.6f', symbol, entry_lo, entry_hi) AS key FROM dip4 WHERE confirmed UNION ALL SELECT symbol, ts, rn, score, 'short', entry_lo, entry_hi, bias_score, printf('%s:%.6f-%.6f', symbol, entry_lo, entry_hi) FROM rally4 WHERE confirmed", "dip4", "rally4")


def alerts(spark, sf):
    cols = ["symbol", "ts", "rn", "score", "entry_lo", "entry_hi", "bias_score"]
    u = signals4(spark, sf, "long").where("confirmed").selectExpr(*cols, "'long' AS side").unionByName(signals4(spark, sf, "short").where("confirmed").selectExpr(*cols, "'short' AS side"))
    return P.add(u, {"key": C.setup_key()})


q("setup_keys", "symbol ts:d side key", "SELECT * FROM alr", "alr")(alerts)
# probability: the evidence score of the side on classified bars
cte("alx", """SELECT a.*, CASE side WHEN 'long' THEN h.long_score ELSE h.short_score END AS prob, CASE side WHEN 'long' THEN long_ok ELSE short_ok END AS gate FROM (
    SELECT symbol, ts, rn, score, 'long' AS side, (entry_lo + entry_hi) / 2 AS mid, invalidation AS stop, resistance AS target, bias_score FROM dip4 WHERE confirmed
    UNION ALL SELECT symbol, ts, rn, score, 'short', (entry_lo + entry_hi) / 2, invalidation, target, bias_score FROM rally4 WHERE confirmed) a
    LEFT JOIN gates g ON g.symbol = a.symbol AND g.ts = a.ts LEFT JOIN hist h ON h.symbol = a.symbol AND h.rn = a.rn""", "dip4", "rally4", "gates", "hist")


@q(
    "live_filters", "symbol ts:d side score:i prob:4 gate:b rr:4",
    """SELECT * FROM (SELECT *, CASE WHEN side = 'long' AND mid > stop THEN (target - mid) / (mid - stop) WHEN side = 'short' AND stop > mid THEN (mid - target) / (stop - mid) END AS rr FROM alx)
    WHERE score >= 5 AND (bias_score IS NULL OR (side = 'long' AND bias_score >= 0) OR (side = 'short' AND bias_score <= 0)) AND (prob IS NULL OR prob >= 0.3) AND (gate IS NULL OR gate) AND (rr IS NULL OR rr >= 0.5)""", "alx",
)
def live_filters(spark, sf):
    """Confirmed setups after the score, bias, probability, macro and reward floors."""
    from .statistics import history

    cols = ["symbol", "ts", "rn", "score", "entry_lo", "entry_hi", "bias_score", "invalidation AS stop"]
    u = signals4(spark, sf, "long").where("confirmed").selectExpr(*cols, "resistance AS target", "'long' AS side").unionByName(signals4(spark, sf, "short").where("confirmed").selectExpr(*cols, "target", "'short' AS side"))
    u = gated(u, spark, sf).join(history(spark, sf).select("symbol", "rn", "long_score", "short_score"), ["symbol", "rn"], "left")
    return C.live_filters(P.add(u, {"prob": "CASE side WHEN 'long' THEN long_score ELSE short_score END"}), 5, 0, 0.3, 0.5)


q("seen_key_exclusion", "symbol ts:d side key", "SELECT * FROM alr a WHERE NOT EXISTS (SELECT 1 FROM alr s WHERE s.key = a.key AND s.ts < a.ts AND date_diff('day', s.ts, a.ts) <= 10)", "alr")(
    lambda spark, sf: C.unseen(alerts(spark, sf), alerts(spark, sf).selectExpr("key", "ts AS sent_at"))
)
q("dual_fire_merge", "symbol ts:d side score:i", "WITH m AS (SELECT *, date_trunc('month', ts) AS mon FROM alr), g AS (SELECT symbol, mon, max(score) FILTER (WHERE side = 'long') AS l, max(score) FILTER (WHERE side = 'short') AS s FROM m GROUP BY 1, 2) SELECT m.* FROM m JOIN g USING (symbol, mon) WHERE l IS NULL OR s IS NULL OR (side = 'long' AND l > s) OR (side = 'short' AND s > l)", "alr")(
    lambda spark, sf: C.merge_dual_fire(P.add(alerts(spark, sf), {"mon": "trunc(ts, 'MM')"}), ["symbol", "mon"])
)

# ---- decision log: classified candidates as records, a few defects planted by row number ------------
_U = {"long": "u_long", "short": "u_short"}
_REC = {
    "recorded_at": "concat(CAST(ts AS {s}), CASE WHEN rn % 401 = 0 THEN ' late' ELSE ' 18:00:00' END)", "date": "ts", "protocol": "CASE WHEN rn % 211 = 0 THEN 'none' ELSE '{h}' END",
    "cost_r": "CASE WHEN rn % 307 = 0 THEN NULL ELSE 0.05 END", "cf_long": "CASE WHEN rn % 503 = 0 THEN NULL ELSE coalesce(u_long, 0) END", "cf_short": "coalesce(u_short, 0)",
    "taken_r": "CASE side WHEN 'long' THEN coalesce(u_long, 0) ELSE coalesce(u_short, 0) END + CASE WHEN rn % 601 = 0 THEN 0.5 ELSE 0 END", "n_open": "rn % 8",
}
_HASH = "0123456789abcdef" * 4
cte("rec", "SELECT c.symbol, c.rn, c.family, c.side, c.regime, " + ", ".join(f"{v.format(s='VARCHAR', h=_HASH)} AS {k}" for k, v in _REC.items()).replace("ts", "c.ts").replace("rn %", "c.rn %") + ", c.ts + INTERVAL 21 DAY AS resolved_on FROM cand c LEFT JOIN u_long USING (symbol, rn) LEFT JOIN u_short USING (symbol, rn)", "cand", "u_long", "u_short")


def records(spark, sf):
    o = bar_outcomes(spark, sf).select("symbol", "rn", "u_long", "u_short")
    d = candidates(spark, sf).select("symbol", "rn", "ts", "family", "side", "regime").join(o, ["symbol", "rn"])
    return d.selectExpr("symbol", "rn", "family", "side", "regime", *[f"{v.format(s='STRING', h=_HASH)} AS {k}" for k, v in _REC.items()], "date_add(ts, 21) AS resolved_on")


_DK = {
    "protocol_hash_shape": "NOT regexp_full_match(protocol, '[0-9a-f]{64}')", "timestamp_parseable": "try_cast(recorded_at AS TIMESTAMP) IS NULL", "recorded_near_bar": "abs(date_diff('day', date, CAST(try_cast(recorded_at AS TIMESTAMP) AS DATE))) > 5",
}
_CK = " UNION ALL ".join(f"SELECT '{k}' AS check_name, sum(CASE WHEN {_DK.get(k, c)} THEN 1 ELSE 0 END) AS bad, '{lv}' AS level FROM rec" for k, (c, lv) in C.CHECKS.items())
_CK += " UNION ALL SELECT 'duplicate_recorded_at', count(*) FILTER (WHERE n > 1), 'FAIL' FROM (SELECT count(*) AS n FROM rec GROUP BY recorded_at, symbol) UNION ALL SELECT 'repeated_date_symbol', count(*) FILTER (WHERE n > 1), 'WARN' FROM (SELECT count(*) AS n FROM rec GROUP BY date, symbol)"
q("integrity_battery", "check_name bad:i status", f"SELECT *, CASE WHEN bad > 0 THEN level ELSE 'PASS' END AS status FROM ({_CK})", "rec")(lambda spark, sf: C.integrity(records(spark, sf)))
q("protocol_eligibility", "family n:i", f"SELECT family, count(*) AS n FROM rec WHERE protocol = '{_HASH}' GROUP BY 1", "rec")(
    lambda spark, sf: S.agg(records(spark, sf).join(F.broadcast(spark.range(1).selectExpr(f"'{_HASH}' AS protocol")), "protocol", "left_semi"), ["family"], {"n": "count(*)"})
)
q("record_resolution_join", "family n:i resolved:i mean_r:5", "WITH a AS (SELECT r.*, s.taken_r AS ra FROM rec r LEFT JOIN rec s ON s.recorded_at = r.recorded_at AND s.symbol = r.symbol AND s.rn % 5 <> 0) SELECT family, count(*) AS n, count(coalesce(ra, CASE WHEN rn % 10 <> 0 OR rn % 5 <> 0 THEN taken_r END)) AS resolved, avg(coalesce(ra, CASE WHEN rn % 10 <> 0 OR rn % 5 <> 0 THEN taken_r END)) AS mean_r FROM a GROUP BY 1", "rec")(
    lambda spark, sf: (
        lambda r: S.agg(
            C.join_resolutions(
                r.selectExpr("concat(recorded_at, symbol) AS recorded_at", "date", "symbol", "family"),
                r.where("rn % 10 <> 0 OR rn % 5 <> 0").selectExpr("CASE WHEN rn % 5 <> 0 THEN concat(recorded_at, symbol) END AS recorded_at", "date", "symbol", "taken_r AS r", "rn AS res_seq"),
            ), ["family"], {"n": "count(*)", "resolved": "count(r)", "mean_r": "avg(r)"},
        )
    )(records(spark, sf))
)
_PA = {"n": "count(*)", "taken": "avg(taken_r - coalesce(cost_r, 0))", "cf_long_mean": "avg(cf_long)", "cf_short_mean": "avg(cf_short)", "over_restricted": "avg(CASE WHEN greatest(cf_long, cf_short) > taken_r THEN 1e0 ELSE 0 END)", "flat_missed": "sum(CASE WHEN taken_r <= 0 AND greatest(cf_long, cf_short) > 0 THEN 1 ELSE 0 END)"}
q("prospective_accumulation", "family n:i taken:5 cf_long_mean:5 cf_short_mean:5 over_restricted:5 flat_missed:i", f"SELECT family, {', '.join(f'{v} AS {k}' for k, v in _PA.items())} FROM rec GROUP BY 1", "rec")(lambda spark, sf: S.agg(records(spark, sf), ["family"], _PA))


_ROW_ID = "CAST(conv(substr(md5(concat(symbol, ' ', rn)), 1, 11), 16, 10) AS BIGINT)"
GATE_REPS = 1000
cte("gs_draw", f"""SELECT family, quantile_cont(stat, 0.025) AS ci_lower, (1 + count(*) FILTER (WHERE flipped >= observed - 1e-9)) / {GATE_REPS + 1}.0 AS p_flip FROM (
    SELECT family, rep, sum(w * taken_r) / nullif(sum(w), 0) AS stat, avg(sg * taken_r) AS flipped, avg(taken_r) AS observed FROM (
      SELECT family, rep, taken_r, {B.poisson1(B.unit('rep', 'uid', 42))} AS w, CASE WHEN {B.unit('rep', 'uid', 7)} < 0.5 THEN -1 ELSE 1 END AS sg
      FROM (SELECT family, taken_r, CAST('0x' || substr(md5(symbol || ' ' || rn), 1, 11) AS BIGINT) AS uid FROM rec WHERE taken_r IS NOT NULL), range(1, {GATE_REPS + 1}) t(rep)) GROUP BY 1, 2) GROUP BY 1""", "rec")
cte("gs", """WITH b AS (SELECT family, count(taken_r) AS n, sum(taken_r) AS total, count(DISTINCT date) AS n_days, min(date) AS d0, date_diff('day', min(date), max(date)) AS span_days, avg(taken_r) AS mean_r FROM rec GROUP BY 1),
    wf AS (SELECT family, count(*) FILTER (WHERE m > 0) AS n_positive_folds FROM (SELECT r.family, floor(5 * date_diff('day', d0, date) / (span_days + 1)) AS fold, avg(taken_r) AS m FROM rec r JOIN b USING (family) GROUP BY 1, 2) GROUP BY 1),
    rg AS (SELECT family, count(*) FILTER (WHERE m > 0) AS n_regimes FROM (SELECT family, regime, avg(taken_r) AS m FROM rec GROUP BY 1, 2) GROUP BY 1),
    ex AS (SELECT family, s AS without, avg(taken_r) FILTER (WHERE symbol <> s) AS m FROM rec, (SELECT DISTINCT symbol AS s FROM rec) GROUP BY 1, 2),
    lo AS (SELECT e.family, count(*) AS n_symbols, min(m) AS worst_without_symbol FROM ex e WHERE EXISTS (SELECT 1 FROM rec r WHERE r.family = e.family AND r.symbol = e.without) GROUP BY 1),
    sh AS (SELECT family, max(v) / sum(v) AS max_symbol_share FROM (SELECT family, symbol, count(*) AS v FROM rec GROUP BY 1, 2) GROUP BY 1),
    cl AS (SELECT family, max(v) / (sum(v) / 2) AS max_cluster_share FROM (SELECT family, c, count(*) AS v FROM (SELECT family, substr(symbol, 1, 1) AS c FROM rec UNION ALL SELECT family, substr(symbol, 2, 1) FROM rec) GROUP BY 1, 2) GROUP BY 1),
    al AS (SELECT avg(t) / nullif(stddev_pop(t), 0) AS sharpe_all FROM (SELECT date, sum(taken_r) AS t FROM rec GROUP BY 1)),
    wo AS (SELECT f.family, avg(t) / nullif(stddev_pop(t), 0) AS sharpe_without FROM (SELECT k.family, r.date, coalesce(sum(r.taken_r) FILTER (WHERE r.family <> k.family), 0) AS t FROM rec r, (SELECT DISTINCT family FROM rec) k GROUP BY 1, 2) f GROUP BY 1),
    dd AS (SELECT family, min(e - p) AS max_dd FROM (SELECT family, e, greatest(max(e) OVER (PARTITION BY family ORDER BY date, symbol), 0) AS p FROM (SELECT family, date, symbol, sum(taken_r) OVER (PARTITION BY family ORDER BY date, symbol) AS e FROM rec WHERE taken_r IS NOT NULL)) GROUP BY 1)
    SELECT b.*, n_positive_folds, n_regimes, n_symbols, worst_without_symbol, max_symbol_share, max_cluster_share, ci_lower, p_flip, sharpe_all, sharpe_without, max_dd
    FROM b LEFT JOIN wf USING (family) LEFT JOIN rg USING (family) LEFT JOIN lo USING (family) LEFT JOIN sh USING (family) LEFT JOIN cl USING (family) LEFT JOIN gs_draw USING (family) LEFT JOIN wo USING (family) LEFT JOIN dd USING (family) CROSS JOIN al""", "rec", "gs_draw")
# the gates once more, by hand
cte("gp", """SELECT family, 1 AS no, 'min_effective_n' AS gate, n_days >= 50 AS ok FROM gs UNION ALL SELECT family, 2, 'independent_window', span_days >= 90 FROM gs
    UNION ALL SELECT family, 3, 'walk_forward', n_positive_folds > 2 FROM gs UNION ALL SELECT family, 4, 'cost_robustness', mean_r > 0.15 FROM gs
    UNION ALL SELECT family, 5, 'permutation_test', p_flip < 0.05 FROM gs UNION ALL SELECT family, 6, 'bootstrap_ci', ci_lower >= 0.05 FROM gs
    UNION ALL SELECT family, 7, 'loso', n_symbols > 1 AND worst_without_symbol > 0 FROM gs UNION ALL SELECT family, 8, 'regime_stability', n_regimes > 1 FROM gs
    UNION ALL SELECT family, 9, 'concentration_limits', max_symbol_share <= 0.4 AND max_cluster_share <= 0.6 FROM gs
    UNION ALL SELECT family, 10, 'portfolio_contribution', sharpe_all > sharpe_without FROM gs UNION ALL SELECT family, 11, 'drawdown_limits', -max_dd <= 12 FROM gs""", "gs")
_PG = "family n_days:i mean_r:5 n_positive_folds:i p_flip:5 ci_lower:5 worst_without_symbol:5 n_regimes:i max_symbol_share:5 sharpe_all:6 sharpe_without:6 max_dd:4 failed level"


def gate_statistics(spark, sf):
    return C.gate_statistics(records(spark, sf), "array(substr(symbol, 1, 1), substr(symbol, 2, 1))", _ROW_ID, GATE_REPS)


@q("promotion_gates", _PG, "SELECT gs.*, failed, CASE WHEN failed = '' THEN 'L3' WHEN n_days > 0 THEN 'L2' ELSE 'L0' END AS level FROM gs JOIN (SELECT family, coalesce(string_agg(gate, ',' ORDER BY no) FILTER (WHERE NOT coalesce(ok, false)), '') AS failed FROM gp GROUP BY 1) USING (family)", "gs", "gp")
def promotion_gates(spark, sf):
    """All eleven gates of every family with the statistics they read."""
    return P.put(C.promotion(gate_statistics(spark, sf)), {"failed": "array_join(failed, ',')"})


@q("gate_scoreboard", "gate_no:i gate n_pass:i n_fail:i n_unresolved:i status", """SELECT *, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_unresolved > 0 THEN 'UNRESOLVED' ELSE 'PASS' END AS status FROM (
    SELECT no AS gate_no, gate, count(*) FILTER (WHERE ok) AS n_pass, count(*) FILTER (WHERE NOT ok) AS n_fail, count(*) FILTER (WHERE ok IS NULL) AS n_unresolved FROM gp GROUP BY 1, 2)""", "gp")
def gate_scoreboard(spark, sf):
    return C.scoreboard(gate_statistics(spark, sf))


# ---- resolution of recorded decisions --------------------------------------------------------------
# limit a quarter ATR away, or at the close where the evidence is strong; three rungs, or one target of 2R where it is weak
def _side(sg: int, score: str) -> str:
    entry, stop = f"CASE WHEN {score} >= 0.5 THEN close ELSE close - {sg} * 0.25D * atr_14 END", f"close - {sg} * 1.5D * atr_14"
    rungs = f"transform(array(1, 2, 3), k -> ({entry}) + {sg} * k * abs(({entry}) - ({stop})))"
    return (
        f"named_struct('entry', {entry}, 'stop', {stop}, 'target', ({entry}) + {sg} * 2 * abs(({entry}) - ({stop})), 'cost_r', 0.05D, 'entry_type', CASE WHEN {score} >= 0.5 THEN 'market' ELSE 'limit' END, "
        f"'rungs', CASE WHEN {score} >= 0.3 THEN {rungs} END, 'rrs', CASE WHEN {score} >= 0.3 THEN array(1.0D, 2.0D, 3.0D) END)"
    )


def recorded_decisions(spark, sf):
    """Every classified bar as a decision with both candidate sides."""
    from .statistics import history

    h = history(spark, sf).select("symbol", "rn", "ts", "direction", "long_score", "short_score")
    d = h.join(D.panel_d(spark, sf).select("symbol", "rn", "close", "atr_14"), ["symbol", "rn"]).where("atr_14 IS NOT NULL")
    return d.selectExpr("symbol", "rn", "ts", "direction", f"{_side(1, 'long_score')} AS long", f"{_side(-1, 'short_score')} AS short")


cte("rs_leg", """SELECT *, abs(entry - stop) AS risk, sg * (entry + sg * 1 * abs(entry - stop) - entry) AS g1, sg * (entry + sg * 2 * abs(entry - stop) - entry) AS g2, sg * (entry + sg * 3 * abs(entry - stop) - entry) AS g3 FROM (
    SELECT symbol, rn, ts, direction, 'long' AS side, 1 AS sg, long_score >= 0.5 AS market, long_score >= 0.3 AS ladder, CASE WHEN long_score >= 0.5 THEN close ELSE close - 0.25 * atr_14 END AS entry, close - 1.5 * atr_14 AS stop FROM hist WHERE atr_14 IS NOT NULL
    UNION ALL SELECT symbol, rn, ts, direction, 'short', -1, short_score >= 0.5, short_score >= 0.3, CASE WHEN short_score >= 0.5 THEN close ELSE close + 0.25 * atr_14 END, close + 1.5 * atr_14 FROM hist WHERE atr_14 IS NOT NULL)""", "hist")
cte("rs_bar", """SELECT l.symbol, l.rn, l.side, l.market, l.ladder, l.risk, l.g1, l.g2, l.g3, x.rn - l.rn AS i, x.ts AS day_at, CASE WHEN sg = 1 THEN x.high - entry ELSE entry - x.low END AS fav, CASE WHEN sg = 1 THEN entry - x.low ELSE x.high - entry END AS adv
    FROM rs_leg l JOIN f x ON x.symbol = l.symbol AND x.rn > l.rn AND x.rn <= l.rn + 20""", "rs_leg", "f")
cte("rs_open", "SELECT * FROM (SELECT *, min(CASE WHEN market OR adv >= 0 THEN i END) OVER (PARTITION BY symbol, rn, side) AS filled FROM rs_bar) WHERE filled IS NULL OR i >= filled", "rs_bar")
cte("rs_stop", "SELECT *, min(CASE WHEN filled IS NOT NULL AND adv >= risk THEN i END) OVER (PARTITION BY symbol, rn, side) AS stopped FROM rs_open", "rs_open")
cte("rs_end", """SELECT symbol, rn, side, any_value(filled) AS filled, any_value(stopped) AS stopped, any_value(ladder) AS ladder, max(i) AS n_bars, max(day_at) AS last_at,
    coalesce(bool_or(ok AND fav >= g1), false) AS h1, coalesce(bool_or(ok AND fav >= g2), false) AS h2, coalesce(bool_or(ok AND fav >= g3), false) AS h3, max(CASE WHEN upto THEN fav / risk END) AS best, max(CASE WHEN upto THEN adv / risk END) AS worst,
    min(CASE WHEN i = stopped THEN day_at END) AS closed_at
    FROM (SELECT *, filled IS NOT NULL AND (stopped IS NULL OR i < stopped) AS ok, filled IS NOT NULL AND (stopped IS NULL OR i <= stopped) AS upto FROM rs_stop) GROUP BY 1, 2, 3""", "rs_stop")
cte("rs_side", """SELECT *, CASE WHEN filled IS NULL THEN 'non_fill' WHEN stopped IS NOT NULL THEN 'sl' WHEN hits > 0 THEN 'tp' ELSE 'time' END AS what,
    CASE WHEN filled IS NULL THEN 0 ELSE CASE WHEN ladder THEN (h1::INT * 1.0 + h2::INT * 2.0 + h3::INT * 3.0) / 3.0 ELSE h2::INT * 2.0 END - CASE WHEN stopped IS NULL THEN 0 WHEN ladder THEN 1 - hits / 3.0 ELSE 1 - hits END - 0.05 END AS r,
    CASE WHEN filled IS NULL THEN 0 ELSE greatest(coalesce(best, 0), 0) END AS mfe, CASE WHEN filled IS NULL THEN 0 ELSE greatest(coalesce(worst, 0), 0) END AS mae, filled IS NOT NULL AND stopped IS NULL AND hits < CASE WHEN ladder THEN 3 ELSE 1 END AS timed
    FROM (SELECT *, CASE WHEN ladder THEN h1::INT + h2::INT + h3::INT ELSE h2::INT END AS hits FROM rs_end)""", "rs_end")
cte("rs_all", """SELECT d.symbol, d.ts, d.direction, CASE d.direction WHEN 'long' THEN l.what WHEN 'short' THEN s.what ELSE 'flat' END AS outcome, CASE d.direction WHEN 'long' THEN l.r WHEN 'short' THEN s.r ELSE 0 END AS r,
    l.what AS long_outcome, l.r AS long_r, l.hits AS long_hits, l.mfe AS long_mfe, l.timed AS long_timed, s.what AS short_outcome, s.r AS short_r, s.hits AS short_hits, s.mae AS short_mae, s.timed AS short_timed,
    l.n_bars, l.last_at, greatest(l.closed_at, s.closed_at) AS both_at, l.closed_at IS NOT NULL AND s.closed_at IS NOT NULL AS both_closed
    FROM (SELECT DISTINCT symbol, rn, ts, direction FROM rs_leg) d LEFT JOIN rs_side l ON l.symbol = d.symbol AND l.rn = d.rn AND l.side = 'long' LEFT JOIN rs_side s ON s.symbol = d.symbol AND s.rn = d.rn AND s.side = 'short'""", "rs_leg", "rs_side")
_RES = "symbol ts:d direction outcome r:5 long_outcome long_r:5 long_hits:i long_mfe:4 long_timed:b short_outcome short_r:5 short_hits:i short_mae:4 short_timed:b"
_LEGS = ["cf_long.outcome AS long_outcome", "cf_long.realized_r AS long_r", "cf_long.n_hit AS long_hits", "cf_long.mfe_r AS long_mfe", "cf_long.time_exit AS long_timed"]
_LEGS += ["cf_short.outcome AS short_outcome", "cf_short.realized_r AS short_r", "cf_short.n_hit AS short_hits", "cf_short.mae_r AS short_mae", "cf_short.time_exit AS short_timed"]


@q("resolve_decisions", _RES, "SELECT * FROM rs_all WHERE outcome IS NOT NULL", "rs_all")
def resolve_decisions(spark, sf):
    """Taken outcome of every recorded decision and both counterfactuals."""
    d = C.resolve_decisions(recorded_decisions(spark, sf), D.panel_d(spark, sf))
    return d.selectExpr("symbol", "ts", "direction", "outcome", "r", *_LEGS)


@q("stream_resolution", _RES, "SELECT * FROM rs_all, (SELECT max(ts) - INTERVAL 2 DAY AS wm FROM f) WHERE outcome IS NOT NULL AND ((n_bars = 20 AND last_at <= wm) OR (both_closed AND both_at <= wm) OR ts + INTERVAL 120 DAY <= wm)", "rs_all", "f")
def stream_resolution(spark, sf):
    """The same from two streams: decisions are resolved once the watermark has passed the bars that settle them (both stops or 20 bars), or
    120 days after them."""
    from ..streaming import jobs as J

    d = recorded_decisions(spark, sf).selectExpr("symbol", "cast(ts AS timestamp) AS ts", "direction", "long", "short")
    b = D.panel_d(spark, sf).selectExpr("symbol", "cast(ts AS timestamp) AS ts", "high", "low")
    read = lambda name, t: spark.readStream.schema(t.schema).parquet(store.written(spark, name, sf, lambda: t))
    out = J.run_available(J.decision_resolution(read("resolution_decisions", d), read("resolution_bars", b)), "resolution")
    return out.selectExpr("symbol", "ts", "direction", "outcome", "r", *_LEGS)


@q("decision_log", "rows:i corrupt:i symbols:i", "SELECT count(*) + 2 AS rows, 2 AS corrupt, count(DISTINCT symbol) AS symbols FROM rec", "rec")
def decision_log(spark, sf):
    """Append snapshots as JSON lines, plant two broken lines, read back tolerantly."""
    path = f"{store.root(spark)}/log-{abs(hash(sf))}"
    leg = "named_struct('family', family, 'entry', 1.0D, 'stop', 0.5D, 'target', 2.0D, 'cost_r', double(cost_r), 'entry_type', 'limit')"
    snap = records(spark, sf).selectExpr(
        "recorded_at", "cast(date as string) AS date", "symbol", "named_struct('version', 'v1', 'sha256', protocol) AS protocol", "named_struct('direction', side, 'family', family) AS decision",
        "int(n_open) AS n_open", f"named_struct('long', {leg}, 'short', {leg}) AS sides",
    )
    snap.write.mode("overwrite").json(path)
    spark.range(2).selectExpr("concat('{\"broken\": ', id) AS value").write.mode("append").text(path)
    log = C.read_log(spark, path).cache()
    return S.agg(log, [], {"rows": "count(*)", "corrupt": "sum(CASE WHEN _corrupt IS NOT NULL THEN 1 ELSE 0 END)", "symbols": "count(distinct symbol)"})


@q("keyed_snapshot_sink", "symbol ts:d family n_seen:i", "SELECT symbol, ts, arg_max(family, rn) AS family, count(*) AS n_seen FROM (SELECT symbol, date_trunc('month', date) AS ts, family, rn FROM rec) GROUP BY 1, 2", "rec")
def keyed_snapshot_sink(spark, sf):
    """Newest record per (symbol, month) key, as an upsert keeps it."""
    r = records(spark, sf).selectExpr("symbol", "trunc(date, 'MM') AS ts", "family", "rn")
    return S.agg(r, ["symbol", "ts"], {"family": "max_by(family, rn)", "n_seen": "count(*)"})


@q(
    "order_portfolio_view", "ts:d leg n_orders:i n_symbols:i long_notional:2 short_notional:2 net:2 share:6 concentration:6 shared:b",
    """WITH o AS (SELECT ts, symbol, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg FROM cand), l AS (SELECT ts, symbol, substr(symbol, 1, 1) AS leg, 100000.0 * sg AS x FROM o UNION ALL SELECT ts, symbol, substr(symbol, 2, 1), -100000.0 * sg FROM o),
    g AS (SELECT ts, leg, count(*) AS n_orders, count(DISTINCT symbol) AS n_symbols, coalesce(sum(x) FILTER (WHERE x > 0), 0) AS long_notional, coalesce(-sum(x) FILTER (WHERE x < 0), 0) AS short_notional FROM l GROUP BY 1, 2)
    SELECT *, long_notional - short_notional AS net, (long_notional + short_notional) / sum(long_notional + short_notional) OVER (PARTITION BY ts) AS share, abs(long_notional - short_notional) / (long_notional + short_notional) AS concentration,
      n_symbols > 1 AND (long_notional = 0 OR short_notional = 0) AS shared FROM g""", "cand",
)
def order_portfolio_view(spark, sf):
    """Legs that the orders of a day share: several symbols on one side of a leg are one bet."""
    o = candidates(spark, sf).selectExpr("ts", "symbol", "side", "1.0D AS entry", "0.0D AS stop", "substr(symbol, 1, 1) AS base", "substr(symbol, 2, 1) AS quote")
    return K.order_portfolio(o, ["ts"])


@q("order_distribution", "regime long:i short:i", "SELECT regime, count(*) FILTER (WHERE side = 'long') AS long, count(*) FILTER (WHERE side = 'short') AS short FROM cand GROUP BY 1", "cand")
def order_distribution(spark, sf):
    return candidates(spark, sf).groupBy("regime").pivot("side", ["long", "short"]).count().na.fill(0)


@q("directional_win_probability", "symbol ts:d p:3", "SELECT symbol, ts, CASE direction WHEN 'long' THEN long_score WHEN 'short' THEN short_score END AS p FROM hist", "hist")
def directional_win_probability(spark, sf):
    from .statistics import history

    return P.add(history(spark, sf), {"p": "CASE direction WHEN 'long' THEN long_score WHEN 'short' THEN short_score END"})


@q("frozen_parameters", "protocol_id records:i", """SELECT sha256('{"horizon":20,"max_concurrent":6,"max_heat":0.04,"max_per_cluster":1,"min_ev":0.0,"stop_mult":1.25,"version":"v1"}') AS protocol_id, count(*) AS records FROM rec""", "rec")
def frozen_parameters(spark, sf):
    """Parameter table joined to the records of its protocol version."""
    n = S.agg(records(spark, sf), [], {"records": "count(*)"})
    return C.parameter_table(spark).crossJoin(n).select("protocol_id", "records")


@query("symbol_report")
def symbol_report(spark, sf):
    """Latest bar of every symbol with its parts as optional structs; a missing part is null."""
    last = P.latest(D.panel_d(spark, sf))
    base = last.selectExpr("symbol", "ts", "struct(regime, adx, regime_confidence) AS regime", "struct(sma_20, sma_50, sma_200) AS averages", "struct(rsi_14, macd_hist, bias_score) AS momentum")
    lv = clustered(spark, sf).selectExpr("symbol", "struct(nearest_support, nearest_resistance, size(clusters) AS n) AS levels")
    dip = G.dip_signals(last).selectExpr("symbol", "struct(score, stage, entry_lo, entry_hi) AS dip")
    rally = G.rally_signals(last).selectExpr("symbol", "struct(score, stage, entry_lo, entry_hi) AS rally")
    rep = base.join(lv, "symbol", "left").join(dip, "symbol", "left").join(rally, "symbol", "left")
    return rep.selectExpr("symbol", "cast(ts as string) AS ts", "to_json(struct(regime, averages, momentum, levels, dip, rally)) AS report")
