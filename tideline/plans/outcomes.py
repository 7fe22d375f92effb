"""Queries: setup evidence, classification, and what happened after each bar or signal."""

from ..operators import outcomes as O
from ..operators import panel as P
from ..operators import setups as U
from ..operators import signals as G
from ..sources import derive as D
from . import sql_base  # noqa: F401
from .registry import cte, query, sel, show, sql_with

W = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
cte(
    "ev",
    f"""SELECT *, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in U.EVIDENCE.items())}, {', '.join(f'false AS {k}' for k in U.STRUCTURE)} FROM (
 SELECT *, max(high) {W.format(59)} AS prior_high, min(low) {W.format(59)} AS prior_low, max(close) {W.format(10)} AS recent_max,
  min(close) {W.format(10)} AS recent_min, obv - lag(obv, 9) OVER (PARTITION BY symbol ORDER BY rn) AS obv_move FROM f)""",
    "f",
)
cte("fam", f"SELECT *, {', '.join(f'{U.score_sql(f)} AS {f}' for f in U.FAMILIES)} FROM ev", "ev")
cte(
    "vd",
    f"""SELECT *, {', '.join(f'{v} AS {k}' for k, v in U.VERDICT.items())} FROM (SELECT *, greatest({', '.join(U.LONG)}) AS long_score,
 greatest({', '.join(U.SHORT)}) AS short_score, {U.best_sql(U.LONG)} AS best_long, {U.best_sql(U.SHORT)} AS best_short FROM fam)""",
    "fam",
)
cte("hist", "SELECT * FROM vd WHERE rn >= 260 AND (rn - 260) % 3 = 0", "vd")
# every bar with each of its next 20 bars
cte(
    "fx",
    """SELECT s.symbol, s.rn, i, s.close AS c0, s.atr_14 AS atr, x.high, x.low, x.close AS cx, x.rsi_14 AS rsi
 FROM f s CROSS JOIN range(1, 21) t(i) JOIN f x ON x.symbol = s.symbol AND x.rn = s.rn + t.i""",
    "f",
)


def _lv(side, m):
    return f"(c0 {'+' if side == 'long' else '-'} {m} * atr)"


def _stop(side, lv):
    return f"low <= {lv}" if side == "long" else f"high >= {lv}"


def _tgt(side, lv):
    return f"high >= {lv}" if side == "long" else f"low <= {lv}"


def uni(side):
    s, t = _stop(side, _lv(side, "(-1.25)")), _tgt(side, _lv(side, "0.75"))
    return f"""SELECT symbol, rn, CASE WHEN s_at <= coalesce(t_at, 999) THEN -1.0 WHEN t_at IS NOT NULL THEN 0.6 END AS u_{side} FROM (
      SELECT symbol, rn, min(CASE WHEN {s} THEN i END) AS s_at, min(CASE WHEN {t} THEN i END) AS t_at FROM fx WHERE i <= 10 GROUP BY 1, 2)"""


def mb(side):
    s, t = _stop(side, _lv(side, "(-1.25)")), [_tgt(side, _lv(side, f"({k} * 1.25)")) for k in (1, 2, 3)]
    return f"""SELECT symbol, rn, CASE o WHEN 0 THEN 'sl' WHEN 1 THEN 'tp1' WHEN 2 THEN 'tp2' WHEN 3 THEN 'tp3' END AS mb_{side} FROM (
      SELECT symbol, rn, min_by(o, i) AS o FROM (SELECT symbol, rn, i, CASE WHEN {s} THEN 0 WHEN {t[2]} THEN 3 WHEN {t[1]} THEN 2 WHEN {t[0]} THEN 1 END AS o FROM fx)
      WHERE o IS NOT NULL GROUP BY 1, 2)"""


for _s in O.SIDES:
    cte(f"u_{_s}", uni(_s), "fx")
    cte(f"mb_{_s}", mb(_s), "fx")

_EV = "symbol ts:d " + " ".join(f"{k}:b" for k in U.EVIDENCE)


@query("evidence_contexts", sql_with(f"SELECT {sel(_EV)} FROM ev", "ev"))
def evidence_contexts(spark, sf):
    return show(U.add_flags(P.own_rows(U.context_panel(D.panel_d(spark, sf)))), _EV)


_FS = "symbol ts:d " + " ".join(f"{k}:3" for k in U.FAMILIES)


@query("family_scores", sql_with(f"SELECT {sel(_FS)} FROM fam WHERE rn >= 260", "fam"))
def family_scores(spark, sf):
    ctx = P.own_rows(U.context_panel(D.panel_d(spark, sf))).where("rn >= 260")
    return show(U.family_scores(U.add_flags(ctx)), _FS)


_HI = "symbol ts:d direction setup_family long_score:3 short_score:3 confidence:3"


@query("setup_history", sql_with(f"SELECT {sel(_HI)} FROM hist", "hist"))
def setup_history(spark, sf):
    return show(U.classify_history(D.panel_d(spark, sf)), _HI)


_VB = "symbol ts:d direction setup_family long_score:3 short_score:3"
_BOOST = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in U.BOOST.items())


@query(
    "setup_verdict",
    sql_with(
        f"""WITH e AS (SELECT fam.* REPLACE ({_BOOST}) FROM fam JOIN (SELECT symbol, rn, stage AS dip_stage, score AS dip_score, confirmed AS dip_confirmed FROM dip) USING (symbol, rn)
          JOIN (SELECT symbol, rn, stage AS rally_stage, score AS rally_score, confirmed AS rally_confirmed FROM rally) USING (symbol, rn)),
        v AS (SELECT *, greatest({', '.join(U.LONG)}) AS long_score, greatest({', '.join(U.SHORT)}) AS short_score, {U.best_sql(U.LONG)} AS best_long, {U.best_sql(U.SHORT)} AS best_short FROM e)
        SELECT {sel(_VB)} FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in U.VERDICT.items())} FROM v) WHERE rn >= 260""",
        "fam", "dip", "rally",
    ),
)
def setup_verdict(spark, sf):
    """Verdict with the engine boost and veto on every bar after warm-up."""
    ctx = P.own_rows(U.context_panel(D.panel_d(spark, sf))).where("rn >= 260")
    d = G.dip_signals(ctx).withColumnsRenamed({"stage": "dip_stage", "score": "dip_score", "confirmed": "dip_confirmed"})
    d = d.drop("depth", "ma_stack", "trend", "fib_zone", "trigger", "invalidation", "entry_lo", "entry_hi")
    d = G.rally_signals(d).withColumnsRenamed({"stage": "rally_stage", "score": "rally_score", "confirmed": "rally_confirmed"})
    return show(U.verdict(U.family_scores(U.add_flags(d)), boost=True), _VB)


_EX = "symbol ts:d ev:4 pw_rr:4"


@query(
    "expected_value",
    sql_with(
        f"SELECT {sel(_EX)} FROM (SELECT *, confidence * 1.5 + (1 - confidence) * -1.0 - 0.05 AS ev, "
        "confidence * (1 + 0.6 * 2 + 0.36 * 3) - (1 - confidence) - 0.05 AS pw_rr FROM hist)", "hist",
    ),
)
def expected_value(spark, sf):
    h = U.classify_history(D.panel_d(spark, sf))
    return show(
        P.add(h, {"ev": U.expected_value("confidence", "1.5", cost="0.05"), "pw_rr": U.probability_weighted_rr("array(1.0D, 2.0D, 3.0D)", "confidence", "0.05")}),
        _EX,
    )


def _paths(spark, sf, fields=("high", "low", "close")):
    return O.paths(D.panel_d(spark, sf).select("symbol", "ts", "rn", "high", "low", "close", "atr_14", "rsi_14", "regime"), O.HOLD, fields)


_UR = "symbol ts:d u_long:2 u_short:2"


@query(
    "uniform_outcome",
    sql_with(f"SELECT {sel(_UR)} FROM f LEFT JOIN u_long USING (symbol, rn) LEFT JOIN u_short USING (symbol, rn)", "f", "u_long", "u_short"),
)
def uniform_outcome(spark, sf):
    return show(P.add(_paths(spark, sf), {f"u_{s}": O.uniform_r(s) for s in O.SIDES}), _UR)


_MB = "symbol ts:d mb_long mb_short"


@query(
    "multi_barrier_outcome",
    sql_with(f"SELECT {sel(_MB)} FROM f LEFT JOIN mb_long USING (symbol, rn) LEFT JOIN mb_short USING (symbol, rn)", "f", "mb_long", "mb_short"),
)
def multi_barrier_outcome(spark, sf):
    d = _paths(spark, sf)
    for s in O.SIDES:
        d = O.multi_barrier(d, s, f"mb_{s}")
    return show(d, _MB)


def _tb_sql(side):
    s, t, up = (
        ("lo <= close - 1.25 * atr_14", "hi >= close + 0.75 * atr_14", "cf > close") if side == "long"
        else ("hi >= close + 1.25 * atr_14", "lo <= close - 0.75 * atr_14", "cf < close")
    )
    return f"""SELECT symbol, ts, CASE WHEN s THEN 0 WHEN t THEN 1 WHEN cf IS NOT NULL THEN CAST({up} AS INT) END AS label,
      NOT s AND NOT t AND cf IS NOT NULL AS censored FROM (SELECT *, coalesce({s}, false) AS s, NOT coalesce({s}, false) AND coalesce({t}, false) AS t FROM (
      SELECT *, min(low) OVER fw AS lo, max(high) OVER fw AS hi, lead(close, 10) OVER (PARTITION BY symbol ORDER BY rn) AS cf FROM f
      WINDOW fw AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)))"""


_TB = "symbol ts:d label:0 censored:b"
for _s in O.SIDES:
    query(f"triple_barrier_{_s}", sql_with(f"SELECT {sel(_TB)} FROM ({_tb_sql(_s)})", "f"))(
        lambda spark, sf, s=_s: show(O.triple_barrier(D.panel_d(spark, sf), side=s), _TB)
    )

_XP = "symbol ts:d tp1_only:2 tp2_only:2 tp3_only:2 partial:2 trailing_stop:2 timestop:5"


def _xp_sql(side):
    r = "(1.25 * atr)"
    fav = f"((high - c0) / {r})" if side == "long" else f"((c0 - low) / {r})"
    adv = f"((low - c0) / {r})" if side == "long" else f"((c0 - high) / {r})"
    sgn = "cx - c0" if side == "long" else "c0 - cx"
    return f"""WITH k AS (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY symbol, rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
       last_value(g IGNORE NULLS) OVER (PARTITION BY symbol, rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin
       FROM (SELECT *, CASE WHEN {fav} >= 3 THEN 3 WHEN {fav} >= 2 THEN 2 WHEN {fav} >= 1 THEN 1 END AS g FROM fx WHERE atr IS NOT NULL)),
     tr AS (SELECT symbol, rn, coalesce(min_by(CASE WHEN prev >= 1 THEN prev - 1 ELSE -1 END, i) FILTER (WHERE {adv} <= CASE WHEN prev IS NULL THEN -1 WHEN prev = 1 THEN 0 ELSE 1 END), any_value(coalesce(fin, 0))) AS trailing_stop,
       max(CASE WHEN i = 20 THEN ({sgn}) / {r} END) AS timestop FROM k GROUP BY 1, 2)
    SELECT {sel(_XP)} FROM (SELECT f.symbol, f.ts, CASE m WHEN 'tp1' THEN 1 WHEN 'sl' THEN -1 END AS tp1_only, CASE m WHEN 'tp2' THEN 2 WHEN 'sl' THEN -1 END AS tp2_only,
      CASE m WHEN 'tp3' THEN 3 WHEN 'sl' THEN -1 END AS tp3_only, CASE m WHEN 'tp1' THEN 0.5 WHEN 'tp2' THEN 1.5 WHEN 'tp3' THEN 1.5 WHEN 'sl' THEN -1 END AS partial,
      CASE WHEN atr_14 IS NOT NULL THEN coalesce(trailing_stop, 0) END AS trailing_stop, timestop
      FROM f LEFT JOIN (SELECT symbol, rn, mb_{side} AS m FROM mb_{side}) USING (symbol, rn) LEFT JOIN tr USING (symbol, rn))"""


for _s in O.SIDES:
    query(f"exit_policies_{_s}", sql_with(_xp_sql(_s), "f", "fx", f"mb_{_s}"))(
        lambda spark, sf, s=_s: show(O.exit_policies(_paths(spark, sf), s), _XP)
    )

_FT = "symbol ts:d r_long:5 r_short:5"


def _ft(side):
    s, t = _stop(side, _lv(side, "(-1.25)")), _tgt(side, _lv(side, "(1.5 * 1.25)"))
    d = "cl - close" if side == "long" else "close - cl"
    return f"""LEFT JOIN (SELECT symbol, rn, min(CASE WHEN {s} THEN i END) AS s_{side}, min(CASE WHEN {t} THEN i END) AS t_{side} FROM fx WHERE i <= 15 GROUP BY 1, 2) USING (symbol, rn)""", (
        f"CASE WHEN atr_14 > 0 THEN CASE WHEN s_{side} <= coalesce(t_{side}, 999) THEN -1.0 WHEN t_{side} IS NOT NULL THEN 1.5 ELSE ({d}) / (1.25 * atr_14) END END AS r_{side}"
    )


_fl, _fs = _ft("long"), _ft("short")


@query(
    "first_touch_time_exit",
    sql_with(
        f"SELECT {sel(_FT)} FROM (SELECT symbol, ts, {_fl[1]}, {_fs[1]} FROM (SELECT *, last_value(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS cl FROM f) {_fl[0]} {_fs[0]})",
        "f", "fx",
    ),
)
def first_touch_time_exit(spark, sf):
    return show(P.add(_paths(spark, sf), {f"r_{s}": O.first_touch_r(s, 1.5, 15) for s in O.SIDES}), _FT)


_MM = "symbol ts:d mfe:4 mae:4 t_mfe:i t_mae:i"


@query(
    "mfe_mae",
    sql_with(
        f"""SELECT {sel(_MM)} FROM (SELECT symbol, ts, (hh - close) / (1.25 * atr_14) AS mfe, (close - ll) / (1.25 * atr_14) AS mae, t_mfe, t_mae FROM f JOIN (
        SELECT symbol, rn, count(*) AS n, max(high) AS hh, min(low) AS ll, arg_max(i, (high, -i)) AS t_mfe, arg_min(i, (low, i)) AS t_mae FROM fx GROUP BY 1, 2) USING (symbol, rn)
        WHERE n >= 3 AND atr_14 > 0)""",
        "f", "fx",
    ),
)
def mfe_mae(spark, sf):
    return show(O.mfe_mae(_paths(spark, sf)), _MM)


_RSI30 = "rsi_14 < 35"
_XF = "symbol ts:d family param:1 r:5"


@query(
    "exit_families",
    sql_with(
        f"""WITH s AS (SELECT fx.*, 1.25 * atr AS risk, last_value(cx) OVER (PARTITION BY fx.symbol, fx.rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastc,
          greatest(c0, max(high) OVER (PARTITION BY fx.symbol, fx.rn ORDER BY i)) AS best FROM fx JOIN (SELECT symbol, rn FROM f WHERE {_RSI30}) USING (symbol, rn) WHERE atr > 0),
        g AS (SELECT * FROM (VALUES {', '.join(f"('{a}', CAST({b} AS DOUBLE))" for a, b in O.EXIT_FAMILIES)}) v(family, param)),
        e AS (SELECT symbol, rn, family, param, any_value((lastc - c0) / risk) AS lr,
          bool_or(high >= c0 + risk * param) AS tps, bool_or(low <= c0 - risk * param) AS sls,
          min_by((best - risk * param - c0) / risk, i) FILTER (WHERE low <= best - risk * param) AS trl,
          min_by((cx - c0) / risk, i) FILTER (WHERE rsi > 35) AS rv, min_by((cx - c0) / risk, i) FILTER (WHERE cx >= c0) AS rm FROM s CROSS JOIN g GROUP BY ALL)
        SELECT {sel(_XF)} FROM (SELECT e.symbol, f.ts, family, param, CASE family WHEN 'time' THEN lr WHEN 'atr_target' THEN CASE WHEN tps THEN param ELSE lr END
          WHEN 'atr_stop' THEN CASE WHEN sls THEN -param ELSE lr END WHEN 'trailing' THEN coalesce(trl, lr) WHEN 'signal_reversal' THEN coalesce(rv, lr) ELSE coalesce(rm, lr) END AS r
          FROM e JOIN (SELECT symbol, rn, ts FROM f) f USING (symbol, rn))""",
        "f", "fx",
    ),
)
def exit_families(spark, sf):
    """Exit families on the bars whose RSI is stretched down."""
    d = _paths(spark, sf, ("high", "low", "close", "rsi_14")).where(_RSI30)
    return show(O.exit_family_r(d), _XF)


def signals4(spark, sf, side):
    """The signal rules at a four-point threshold, so that the small tables hold trades."""
    p = D.panel_d(spark, sf)
    return G.dip_signals(p, 4, 3) if side == "long" else G.rally_signals(p, 4, 3)


_SIG = {"long": ("dip4", "entry_lo", "resistance"), "short": ("rally4", "entry_hi", "target")}
_RR = "symbol ts:d score:i r:5"
_ML = "symbol ts:d fill:i label:0"
_TR = "symbol signal_ts:d entry_ts:d exit_ts:d entry:6 exit:6 stop:4 target:6 reason bars_held:i r:5"


def _sig_sql(side, extra="true"):
    t, e, g = _SIG[side]
    return f"SELECT symbol, rn, ts, close AS c0, score, regime, {e} AS entry, invalidation AS stop, {g} AS tg FROM {t} WHERE confirmed AND {extra}"


def _rr_sql(side):
    d = "tg - entry" if side == "long" else "entry - tg"
    return f"""WITH e AS ({_sig_sql(side)}), h AS (SELECT e.symbol, e.rn, min(CASE WHEN {_stop(side, 'stop').replace('low', 'x.low').replace('high', 'x.high')} THEN x.rn END) AS s_at,
        min(CASE WHEN {_tgt(side, 'tg').replace('low', 'x.low').replace('high', 'x.high')} THEN x.rn END) AS t_at
        FROM e JOIN f x ON x.symbol = e.symbol AND x.rn BETWEEN e.rn + 1 AND e.rn + 20 GROUP BY 1, 2)
      SELECT {sel(_RR)} FROM (SELECT symbol, ts, score, CASE WHEN s_at <= coalesce(t_at, 1e9) THEN -1.0 WHEN t_at IS NOT NULL THEN ({d}) / abs(entry - stop) END AS r
        FROM e LEFT JOIN h USING (symbol, rn) WHERE entry > 0 AND stop > 0 AND tg IS NOT NULL AND entry <> stop)"""


def _fill_sql(side, valid=3):
    good = "stop < entry AND entry < c0" if side == "long" else "stop > entry AND entry > c0"
    better = "tg > entry" if side == "long" else "tg < entry"
    hit = "x.low <= entry" if side == "long" else "x.high >= entry"
    return f"""e AS (SELECT *, CASE WHEN {better} THEN tg ELSE entry + 2.0 * (entry - stop) END AS target FROM ({_sig_sql(side)}) WHERE {good}),
      fl AS (SELECT e.symbol, e.rn, min(x.rn) AS frn FROM e JOIN f x ON x.symbol = e.symbol AND x.rn BETWEEN e.rn + 1 AND e.rn + {valid} WHERE {hit} GROUP BY 1, 2)"""


def _x(side, kind, lv):
    return (_stop if kind == "stop" else _tgt)(side, lv).replace("low", "x.low").replace("high", "x.high")


def _ml_sql(side):
    return f"""WITH {_fill_sql(side)}, h AS (SELECT e.symbol, e.rn, min(CASE WHEN {_x(side, 'stop', 'stop')} THEN x.rn END) AS s_at, min(CASE WHEN {_x(side, 'tgt', 'target')} THEN x.rn END) AS t_at
        FROM e JOIN fl USING (symbol, rn) JOIN f x ON x.symbol = e.symbol AND x.rn BETWEEN frn AND frn + 19 GROUP BY 1, 2)
      SELECT {sel(_ML)} FROM (SELECT symbol, ts, frn - rn AS fill, CASE WHEN s_at <= coalesce(t_at, 1e9) THEN 0 WHEN t_at IS NOT NULL THEN 1 END AS label
        FROM e LEFT JOIN fl USING (symbol, rn) LEFT JOIN h USING (symbol, rn)) WHERE fill IS NOT NULL"""


def tr_cte(side):
    d = "exit - entry" if side == "long" else "entry - exit"
    return f"""WITH {_fill_sql(side)}, h AS (SELECT e.symbol, e.rn, any_value(frn) AS frn, min(CASE WHEN {_x(side, 'stop', 'stop')} THEN x.rn END) AS s_at, min(CASE WHEN {_x(side, 'tgt', 'target')} THEN x.rn END) AS t_at,
        max(CASE WHEN x.rn = frn + 20 THEN x.close END) AS c20 FROM e JOIN fl USING (symbol, rn) JOIN f x ON x.symbol = e.symbol AND x.rn BETWEEN frn + 1 AND frn + 20 GROUP BY 1, 2),
      q AS (SELECT e.*, frn, CASE WHEN s_at <= coalesce(t_at, 1e9) THEN 'stop' WHEN t_at IS NOT NULL THEN 'target' WHEN c20 IS NOT NULL THEN 'time' END AS reason,
        coalesce(least(s_at, t_at) - frn, 20) AS bars_held, CASE WHEN s_at <= coalesce(t_at, 1e9) THEN stop WHEN t_at IS NOT NULL THEN target ELSE c20 END AS exit FROM e JOIN h USING (symbol, rn))
      SELECT q.*, '{side}' AS side, q.ts AS signal_ts, a.ts AS entry_ts, b.ts AS exit_ts, ({d}) / abs(entry - stop) AS r
      FROM q JOIN f a ON a.symbol = q.symbol AND a.rn = frn JOIN f b ON b.symbol = q.symbol AND b.rn = frn + bars_held WHERE reason IS NOT NULL"""


for _s in O.SIDES:
    _t = _SIG[_s][0]
    cte(f"trades_{_s}", tr_cte(_s), _t, "f")
    query(f"realized_r_{_s}", sql_with(_rr_sql(_s), _t, "f"))(
        lambda spark, sf, s=_s: show(O.realized_r(signals4(spark, sf, s), D.panel_d(spark, sf), s), _RR)
    )
    query(f"meta_labels_{_s}", sql_with(_ml_sql(_s), _t, "f"))(
        lambda spark, sf, s=_s: show(O.meta_labels(signals4(spark, sf, s), D.panel_d(spark, sf), s).where("fill IS NOT NULL"), _ML)
    )
    query(f"resolved_trades_{_s}", sql_with(f"SELECT {sel(_TR)} FROM trades_{_s}", f"trades_{_s}"))(
        lambda spark, sf, s=_s: show(O.resolve_trades(signals4(spark, sf, s), D.panel_d(spark, sf), s), _TR)
    )
cte("trades", "SELECT * FROM trades_long UNION ALL BY NAME SELECT * FROM trades_short", "trades_long", "trades_short")


def trades(spark, sf):
    """Resolved long and short trades, stored once per application."""
    from ..sources.store import stored

    def build():
        p = D.panel_d(spark, sf)
        both = [O.resolve_trades(signals4(spark, sf, s), p, s) for s in O.SIDES]
        return both[0].unionByName(both[1])

    return stored(spark, "trades", sf, build)


_LD = "symbol ts:d side outcome n_hit:i realized_r:5 mfe_r:4 mae_r:4 time_exit:b"


@query(
    "counterfactual_ladder",
    sql_with(
        f"""WITH s AS (SELECT symbol, rn, ts, close, atr_14, side, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg FROM f CROSS JOIN (VALUES ('long'), ('short')) v(side) WHERE atr_14 IS NOT NULL),
        e0 AS (SELECT *, close - sg * 0.25 * atr_14 AS entry, close - sg * 1.5 * atr_14 AS stop FROM s),
        e AS (SELECT *, abs(entry - stop) AS risk, sg * (entry + sg * 1 * 1.25 * atr_14 - entry) AS t1, sg * (entry + sg * 2 * 1.25 * atr_14 - entry) AS t2, sg * (entry + sg * 3 * 1.25 * atr_14 - entry) AS t3 FROM e0),
        b AS (SELECT e.symbol, e.rn, side, x.rn - e.rn AS i, sg, entry, risk, t1, t2, t3, CASE WHEN sg = 1 THEN x.high - entry ELSE entry - x.low END AS fav, CASE WHEN sg = 1 THEN entry - x.low ELSE x.high - entry END AS adv
          FROM e JOIN f x ON x.symbol = e.symbol AND x.rn BETWEEN e.rn + 1 AND e.rn + 20),
        fl AS (SELECT symbol, rn, side, min(CASE WHEN adv >= 0 THEN i END) AS fi FROM b GROUP BY ALL),
        st AS (SELECT b.symbol, b.rn, b.side, min(CASE WHEN adv >= risk THEN i END) AS si FROM b JOIN fl USING (symbol, rn, side) WHERE i >= fi GROUP BY ALL),
        h AS (SELECT b.symbol, b.rn, b.side, max(CASE WHEN i < coalesce(si, 999) AND fav >= t1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN i < coalesce(si, 999) AND fav >= t2 THEN 1 ELSE 0 END) AS h2,
          max(CASE WHEN i < coalesce(si, 999) AND fav >= t3 THEN 1 ELSE 0 END) AS h3, max(CASE WHEN i <= coalesce(si, 999) THEN fav / risk END) AS mf, max(CASE WHEN i <= coalesce(si, 999) THEN adv / risk END) AS ma
          FROM b JOIN fl USING (symbol, rn, side) LEFT JOIN st USING (symbol, rn, side) WHERE i >= fi GROUP BY ALL),
        r AS (SELECT e.symbol, e.ts, e.side, fi, si, coalesce(h1 + h2 + h3, 0) AS n_hit, coalesce(h1 * 1.0 + h2 * 2.0 + h3 * 3.0, 0) / 3.0 AS pay, greatest(coalesce(mf, 0), 0) AS mfe_r, greatest(coalesce(ma, 0), 0) AS mae_r
          FROM e JOIN fl USING (symbol, rn, side) LEFT JOIN st USING (symbol, rn, side) LEFT JOIN h USING (symbol, rn, side))
        SELECT {sel(_LD)} FROM (SELECT *, CASE WHEN fi IS NULL THEN 'non_fill' WHEN si IS NOT NULL THEN 'sl' WHEN n_hit > 0 THEN 'tp' ELSE 'time' END AS outcome,
          CASE WHEN fi IS NULL THEN 0 ELSE pay - CASE WHEN si IS NOT NULL THEN 1 - n_hit / 3.0 ELSE 0 END - 0.05 END AS realized_r, fi IS NOT NULL AND si IS NULL AND n_hit < 3 AS time_exit FROM r)""",
        "f",
    ),
)
def counterfactual_ladder(spark, sf):
    """Both sides of a decision on every bar: limit a quarter ATR away, three equal rungs at 1R/2R/3R."""
    p = D.panel_d(spark, sf)
    e = p.where("atr_14 IS NOT NULL").selectExpr(
        "symbol", "rn", "ts", "close", "atr_14", "inline(array(named_struct('side', 'long', 'sg', 1), named_struct('side', 'short', 'sg', -1)))"
    )
    e = P.add(e, {"entry": "close - sg * 0.25 * atr_14", "stop": "close - sg * 1.5 * atr_14"})
    e = P.add(
        e,
        {
            "rungs": "transform(array(1, 2, 3), k -> entry + sg * k * 1.25 * atr_14)", "rrs": "array(1.0D, 2.0D, 3.0D)",
            "cost_r": "0.05D", "entry_type": "'limit'",
        },
    )
    return show(O.ladder_resolution(e, p), _LD)
