"""What happened after a bar: barriers, labels, exits, excursions, trade resolution.

Dense outcomes (every bar) read a bounded look-ahead array collected over the haloed chunk, so no
join is needed. Sparse signals are expanded to their next bars and equi-joined on
(symbol, rn), which spreads a hot symbol over all tasks. The stop is checked before the target
inside one bar everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel as P
from .panel import add, lag, over

STOP_MULT, TARGET_MULT, LABEL_HORIZON = 1.25, 0.75, 10
HOLD = 20
SIDES = ("long", "short")


def with_path(h: DataFrame, horizon: int = HOLD, fields=("high", "low", "close")) -> DataFrame:
    """Array of the next ``horizon`` bars of every row of a haloed panel (needs that many look-ahead rows)."""
    items = ", ".join(f"'{f}', {f}" for f in fields)
    return add(h, {"path": f"collect_list(named_struct({items})) {over(-1, horizon)}"})


def paths(panel: DataFrame, horizon: int = HOLD, fields=("high", "low", "close")) -> DataFrame:
    return P.own_rows(with_path(P.with_halo(panel.drop("_c"), 0, horizon), horizon, fields)).drop("_c")


def first(cond: str, path: str = "path") -> str:
    """1-based position of the first bar ``x`` of the path that satisfies ``cond``, else null."""
    return f"nullif(array_position(transform({path}, x -> {cond}), true), 0)"


def touch(side: str, kind: str, level: str) -> str:
    """Condition on bar x: did it reach the stop or target level of this side?"""
    below = (side == "long") == (kind == "stop")
    return f"x.low <= {level}" if below else f"x.high >= {level}"


def signed(side: str, a: str, b: str) -> str:
    """Price move from b to a in the direction of the side."""
    return f"({a} - {b})" if side == "long" else f"({b} - {a})"


def level(side: str, mult: str) -> str:
    """close +/- mult * ATR in the favourable direction."""
    return f"(close {'+' if side == 'long' else '-'} {mult} * atr_14)"


def uniform_r(side: str) -> str:
    """+0.6 / -1 / null: 0.75 ATR target against a 1.25 ATR stop within 10 bars."""
    near = f"slice(path, 1, {LABEL_HORIZON})"
    s = first(touch(side, "stop", level(side, f"(-{STOP_MULT})")), near)
    t = first(touch(side, "target", level(side, str(TARGET_MULT))), near)
    return f"CASE WHEN {s} IS NOT NULL AND {s} <= coalesce({t}, 999) THEN -1.0D WHEN {t} IS NOT NULL THEN {TARGET_MULT / STOP_MULT}D END"


def multi_barrier(df: DataFrame, side: str, name: str) -> DataFrame:
    """sl / tp1 / tp2 / tp3 / null: the first bar that touches anything decides, stop first, highest rung of that bar."""
    stop, tps = level(side, f"(-{STOP_MULT})"), [level(side, f"({k} * {STOP_MULT})") for k in (1, 2, 3)]
    df = add(df, {"_s": first(touch(side, "stop", stop)), "_t": first(touch(side, "target", tps[0]))})
    bar = "element_at(path, int(_t))"

    def reached(tp):
        return f"{bar}.high >= {tp}" if side == "long" else f"{bar}.low <= {tp}"

    return add(
        df,
        {
            name: f"""CASE WHEN _s IS NOT NULL AND _s <= coalesce(_t, 999) THEN 'sl' WHEN _t IS NULL THEN NULL
            WHEN {reached(tps[2])} THEN 'tp3' WHEN {reached(tps[1])} THEN 'tp2' ELSE 'tp1' END"""
        },
    ).drop("_s", "_t")


def triple_barrier(panel: DataFrame, horizon: int = LABEL_HORIZON, stop: float = STOP_MULT, target: float = TARGET_MULT, side: str = "long") -> DataFrame:
    """0/1 label from forward extremes; any stop inside the horizon wins even after an earlier target.

    A bar that touches neither is censored and labelled by the sign of the forward close.
    """
    h = P.with_halo(panel, 0, horizon)
    h = P.own_rows(
        add(h, {"_lo": f"min(low) {over(-1, horizon)}", "_hi": f"max(high) {over(-1, horizon)}", "_cf": lag("close", -horizon)})
    )
    if side == "long":
        s, t, up = f"_lo <= close - {stop} * atr_14", f"_hi >= close + {target} * atr_14", "_cf > close"
    else:
        s, t, up = f"_hi >= close + {stop} * atr_14", f"_lo <= close - {target} * atr_14", "_cf < close"
    h = add(h, {"_stop": f"coalesce({s}, false)", "_tgt": f"coalesce(NOT coalesce({s}, false) AND {t}, false)"})
    h = add(h, {"censored": "NOT _stop AND NOT _tgt AND _cf IS NOT NULL"})
    return add(
        h, {"label": f"CASE WHEN _stop THEN 0.0D WHEN _tgt THEN 1.0D WHEN censored THEN cast({up} AS double) END"}
    ).drop("_lo", "_hi", "_cf", "_stop", "_tgt", "_c")


def exit_policies(df: DataFrame, side: str) -> DataFrame:
    """R of fixed targets, a 50/50 partial, a ratcheting stop and a time stop on the same entries."""
    r = f"({STOP_MULT} * atr_14)"
    df = multi_barrier(df, side, "_mb")
    sg = "" if side == "long" else "-"
    fav = f"({sg}(x.high - close) / {r})" if side == "long" else f"((close - x.low) / {r})"
    adv = f"((x.low - close) / {r})" if side == "long" else f"((close - x.high) / {r})"
    # state: rung reached so far, stop in R, result once stopped; a bar that stops is checked before its high
    step = f"""CASE WHEN a.r IS NOT NULL THEN a
        WHEN {adv} <= a.stop THEN named_struct('best', a.best, 'stop', a.stop, 'r', CASE WHEN a.best >= 1 THEN a.best - 1.0D ELSE -1.0D END)
        WHEN {fav} >= 3 THEN named_struct('best', 3.0D, 'stop', 1.0D, 'r', a.r)
        WHEN {fav} >= 2 THEN named_struct('best', 2.0D, 'stop', 1.0D, 'r', a.r)
        WHEN {fav} >= 1 THEN named_struct('best', 1.0D, 'stop', 0.0D, 'r', a.r) ELSE a END"""
    return add(
        df,
        {
            "tp1_only": "CASE _mb WHEN 'tp1' THEN 1.0D WHEN 'sl' THEN -1.0D END",
            "tp2_only": "CASE _mb WHEN 'tp2' THEN 2.0D WHEN 'sl' THEN -1.0D END",
            "tp3_only": "CASE _mb WHEN 'tp3' THEN 3.0D WHEN 'sl' THEN -1.0D END",
            "partial": "CASE _mb WHEN 'tp1' THEN 0.5D WHEN 'tp2' THEN 1.5D WHEN 'tp3' THEN 1.5D WHEN 'sl' THEN -1.0D END",
            "trailing_stop": f"""CASE WHEN atr_14 IS NOT NULL THEN aggregate(path, named_struct('best', 0.0D, 'stop', -1.0D, 'r', cast(null as double)),
                (a, x) -> {step}, a -> coalesce(a.r, a.best)) END""",
            "timestop": f"CASE WHEN size(path) = {HOLD} THEN {signed(side, f'element_at(path, {HOLD}).close', 'close')} / {r} END",
        },
    ).drop("_mb")


def first_touch_r(side: str, tp_r: float, horizon: int) -> str:
    """tp_r, -1 or the R at the horizon close (last available close near the end of the data)."""
    p = f"slice(path, 1, {horizon})"
    s = first(touch(side, "stop", level(side, f"(-{STOP_MULT})")), p)
    t = first(touch(side, "target", level(side, f"({tp_r} * {STOP_MULT})")), p)
    last = f"coalesce(try_element_at({p}, -1).close, close)"
    return f"""CASE WHEN atr_14 > 0 THEN CASE WHEN {s} IS NOT NULL AND {s} <= coalesce({t}, 999) THEN -1.0D
        WHEN {t} IS NOT NULL THEN {tp_r}D ELSE {signed(side, last, 'close')} / ({STOP_MULT} * atr_14) END END"""


# long-side exit families and the parameter values that are compared
EXIT_FAMILIES = [
    ("time", 0.0), ("atr_target", 1.0), ("atr_target", 1.5), ("atr_stop", 1.0), ("atr_stop", 1.5), ("trailing", 1.0), ("trailing", 1.5),
    ("signal_reversal", 0.0), ("return_mean", 0.0),
]


def exit_family_r(df: DataFrame, horizon: int = 20) -> DataFrame:
    """One row per (signal, exit family, parameter) with the long-side R; needs rsi_14 in the path."""
    grid = ", ".join(f"named_struct('family', '{f}', 'param', {p}D)" for f, p in EXIT_FAMILIES)
    d = df.selectExpr("*", f"slice(path, 1, {horizon}) AS p", f"{STOP_MULT} * atr_14 AS risk").where("risk > 0 AND size(p) > 0")
    d = d.selectExpr("*", f"inline(array({grid}))")
    d = add(d, {"_last": "(element_at(p, -1).close - close) / risk"})
    trail = """aggregate(p, named_struct('best', close, 'r', cast(null as double)), (a, x) -> CASE WHEN a.r IS NOT NULL THEN a ELSE
        named_struct('best', greatest(a.best, x.high), 'r', CASE WHEN x.low <= greatest(a.best, x.high) - risk * param
          THEN (greatest(a.best, x.high) - risk * param - close) / risk END) END, a -> coalesce(a.r, _last))"""
    at_close = "(element_at(p, int({0})).close - close) / risk"
    rev, mean = first("x.rsi_14 > 35", "p"), first("x.close >= close", "p")
    return add(
        d,
        {
            "r": f"""CASE family WHEN 'time' THEN _last
            WHEN 'atr_target' THEN CASE WHEN exists(p, x -> x.high >= close + risk * param) THEN param ELSE _last END
            WHEN 'atr_stop' THEN CASE WHEN exists(p, x -> x.low <= close - risk * param) THEN -param ELSE _last END
            WHEN 'trailing' THEN {trail}
            WHEN 'signal_reversal' THEN coalesce(CASE WHEN {rev} IS NOT NULL THEN {at_close.format(rev)} END, _last)
            ELSE coalesce(CASE WHEN {mean} IS NOT NULL THEN {at_close.format(mean)} END, _last) END"""
        },
    ).drop("_last", "p")


def mfe_mae(df: DataFrame) -> DataFrame:
    """Largest favourable and adverse excursion in R and the bar that reached each (earliest on ties)."""
    r = f"({STOP_MULT} * atr_14)"
    d = df.where("atr_14 > 0 AND size(path) >= 3")
    d = add(d, {"_hh": "array_max(transform(path, x -> x.high))", "_ll": "array_min(transform(path, x -> x.low))"})
    return add(
        d,
        {
            "mfe": f"(_hh - close) / {r}",
            "mae": f"(close - _ll) / {r}",
            "t_mfe": "array_position(transform(path, x -> x.high), _hh)",
            "t_mae": "array_position(transform(path, x -> x.low), _ll)",
        },
    ).drop("_hh", "_ll")


def forward_rows(events: DataFrame, panel: DataFrame, horizon: int, fields=("high", "low", "close", "open", "ts")) -> DataFrame:
    """Attach ``path`` (next ``horizon`` bars in order) to sparse events by an equi-join on (symbol, rn).

    Each event reads at most ``horizon`` bars, so the regrouped arrays are bounded.
    """
    step = events.selectExpr("symbol", "rn AS _ev", f"explode(sequence(1, {horizon})) AS i").distinct()
    step = step.selectExpr("symbol", "_ev", "i", "_ev + i AS rn")
    bars = panel.select("symbol", "rn", *fields)
    items = ", ".join(["i", *fields])
    got = (
        step.join(bars, ["symbol", "rn"])
        .groupBy("symbol", "_ev")
        .agg(F.expr(f"array_sort(collect_list(struct({items}))) AS path"))
        .withColumnRenamed("_ev", "rn")
    )
    return events.join(got, ["symbol", "rn"], "left")


def realized_r(signals: DataFrame, panel: DataFrame, side: str) -> DataFrame:
    """First-touch R of confirmed signals over the next 20 bars; unresolved stays null."""
    entry, target = ("entry_lo", "resistance") if side == "long" else ("entry_hi", "target")
    ev = signals.where("confirmed").selectExpr(
        "symbol", "rn", "ts", "score", "regime", f"{entry} AS entry", "invalidation AS stop", f"{target} AS target"
    ).where("entry > 0 AND stop > 0 AND target IS NOT NULL AND entry <> stop")
    d = forward_rows(ev, panel, HOLD)
    d = add(d, {"_s": first(touch(side, "stop", "stop")), "_t": first(touch(side, "target", "target"))})
    return add(
        d,
        {
            "r": f"CASE WHEN _s IS NOT NULL AND _s <= coalesce(_t, 999) THEN -1.0D WHEN _t IS NOT NULL THEN {signed(side, 'target', 'entry')} / abs(entry - stop) END"
        },
    ).drop("_s", "_t", "path")


def meta_labels(signals: DataFrame, panel: DataFrame, side: str = "long", valid: int = 3, horizon: int = 20, rr: float = 2.0) -> DataFrame:
    """Limit fill within 3 bars, then first touch over 20 bars counted from and including the fill bar."""
    entry, target = ("entry_lo", "resistance") if side == "long" else ("entry_hi", "target")
    order = "stop < entry AND entry < close" if side == "long" else "stop > entry AND entry > close"
    ev = signals.where("confirmed").selectExpr(
        "symbol", "rn", "ts", "close", f"{entry} AS entry", "invalidation AS stop", f"{target} AS _tg"
    ).where(order)
    better = "_tg > entry" if side == "long" else "_tg < entry"
    ev = add(ev, {"target": f"CASE WHEN {better} THEN _tg ELSE entry + {rr} * (entry - stop) END"})
    d = forward_rows(ev, panel, valid + horizon)
    d = add(d, {"fill": first("x.low <= entry" if side == "long" else "x.high >= entry", f"slice(path, 1, {valid})")})
    d = add(d, {"_p": f"CASE WHEN fill IS NOT NULL THEN slice(path, int(fill), {horizon}) END"})
    d = add(d, {"_s": first(touch(side, "stop", "stop"), "_p"), "_t": first(touch(side, "target", "target"), "_p")})
    return add(d, {"label": "CASE WHEN _s IS NOT NULL AND _s <= coalesce(_t, 999) THEN 0.0D WHEN _t IS NOT NULL THEN 1.0D END"}).drop(
        "_s", "_t", "_p", "path", "_tg"
    )


def resolve_trades(
    signals: DataFrame, panel: DataFrame, side: str = "long", valid: int = 3, hold: int = 20, slippage: float = 0.0,
    rr: float = 2.0, market: bool = False, min_risk: float = 0.001,
) -> DataFrame:
    """One resolved trade per confirmed signal: fill, exit reason, exit price and R.

    A limit order rests for ``valid`` bars; exits are checked from the bar after the fill. Signals
    are independent rows: nothing is carried from one trade to the next.
    """
    lvl, target = ("entry_lo", "resistance") if side == "long" else ("entry_hi", "target")
    ev = signals.where("confirmed").selectExpr(
        "symbol", "rn", "ts AS signal_ts", "close", "score", "regime", f"{'close' if market else lvl} AS level",
        "invalidation AS stop", f"{target} AS _tg",
    )
    if market:
        ev = ev.where(f"{signed(side, 'level', 'stop')} > {min_risk} * level")
    else:
        ev = ev.where("stop < level AND level < close" if side == "long" else "stop > level AND level > close")
    better = "_tg > level" if side == "long" else "_tg < level"
    ev = add(ev, {"target": f"CASE WHEN {better} THEN _tg ELSE level + {rr} * (level - stop) END"})
    d = forward_rows(ev, panel, valid + hold)
    hit = "true" if market else ("x.low <= level" if side == "long" else "x.high >= level")
    d = add(d, {"fill": first(hit, f"slice(path, 1, {1 if market else valid})")}).where("fill IS NOT NULL")
    s = "+" if side == "long" else "-"
    px = "element_at(path, int(fill)).open" if market else "level"
    d = add(d, {"entry": f"{px} * (1 {s} {slippage})", "_p": f"slice(path, int(fill) + 1, {hold})", "entry_ts": "element_at(path, int(fill)).ts"})
    d = add(d, {"_s": first(touch(side, "stop", "stop"), "_p"), "_t": first(touch(side, "target", "target"), "_p")})
    d = add(
        d,
        {
            "reason": f"""CASE WHEN _s IS NOT NULL AND _s <= coalesce(_t, 999) THEN 'stop' WHEN _t IS NOT NULL THEN 'target'
                WHEN size(_p) = {hold} THEN 'time' END""",
            "bars_held": f"CASE WHEN _s IS NOT NULL OR _t IS NOT NULL THEN least(coalesce(_s, 999), coalesce(_t, 999)) ELSE {hold} END",
        },
    ).where("reason IS NOT NULL")
    t = "-" if side == "long" else "+"
    d = add(
        d,
        {
            "exit": f"(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE element_at(_p, {hold}).close END) * (1 {t} {slippage})",
            "exit_ts": "element_at(_p, int(bars_held)).ts",
        },
    )
    return add(d, {"side": f"'{side}'", "r": f"{signed(side, 'exit', 'entry')} / nullif(abs(entry - stop), 0)"}).drop("_s", "_t", "_p", "path", "_tg")


def ladder_resolution(sides: DataFrame, panel: DataFrame, horizon: int = HOLD) -> DataFrame:
    """Resolve decision sides with a target ladder as if taken.

    ``sides``: symbol, rn (decision bar), side, entry, stop, rungs array<double>, rrs array<double>,
    cost_r, entry_type. A limit entry must be touched first; each rung exits an equal share; the
    open remainder loses 1R at the stop and nothing at the time exit. MFE/MAE include the stop bar.
    """
    d = forward_rows(sides, panel, horizon, ("high", "low")).where("path IS NOT NULL AND entry IS NOT NULL AND stop <> entry")
    sg = "CASE WHEN side = 'long' THEN 1 ELSE -1 END"
    # express both sides as one: favourable and adverse extreme in R from the entry
    d = add(
        d,
        {
            "_risk": "abs(entry - stop)",
            "_fill": f"CASE WHEN entry_type = 'market' THEN 1 ELSE {first('CASE WHEN side = ' + chr(39) + 'long' + chr(39) + ' THEN x.low <= entry ELSE x.high >= entry END')} END",
        },
    )
    d = add(
        d,
        {
            "_seq": f"""CASE WHEN _fill IS NOT NULL THEN transform(slice(path, int(_fill), {horizon}), x -> named_struct(
                'fav', CASE WHEN side = 'long' THEN x.high - entry ELSE entry - x.low END,
                'adv', CASE WHEN side = 'long' THEN entry - x.low ELSE x.high - entry END)) END"""
        },
    )
    d = add(d, {"_stop_at": first("x.adv >= _risk", "_seq")})
    d = add(
        d,
        {
            "_live": "CASE WHEN _stop_at IS NULL THEN _seq ELSE slice(_seq, 1, int(_stop_at) - 1) END",
            "_all": "CASE WHEN _stop_at IS NULL THEN _seq ELSE slice(_seq, 1, int(_stop_at)) END",
        },
    )
    d = add(d, {"hits": f"transform(rungs, p -> exists(_live, x -> x.fav >= {sg} * (p - entry)))"})
    d = add(d, {"n_hit": "size(filter(hits, h -> h))", "filled": "_fill IS NOT NULL", "sl_hit": "_stop_at IS NOT NULL"})
    paid = "aggregate(zip_with(hits, rrs, (h, q) -> CASE WHEN h THEN q ELSE 0.0D END), 0.0D, (a, x) -> a + x) / size(rungs)"
    return add(
        d,
        {
            "outcome": "CASE WHEN NOT filled THEN 'non_fill' WHEN sl_hit THEN 'sl' WHEN n_hit > 0 THEN 'tp' ELSE 'time' END",
            "realized_r": f"CASE WHEN NOT filled THEN 0.0D ELSE {paid} - CASE WHEN sl_hit THEN 1 - n_hit / size(rungs) ELSE 0 END - cost_r END",
            "mfe_r": "coalesce(greatest(array_max(transform(_all, x -> x.fav / _risk)), 0), 0.0D)",
            "mae_r": "coalesce(greatest(array_max(transform(_all, x -> x.adv / _risk)), 0), 0.0D)",
            "time_exit": "filled AND NOT sl_hit AND n_hit < size(rungs)",
        },
    ).drop("_risk", "_fill", "_seq", "_stop_at", "_live", "_all", "path")
