"""Target ladders, the opportunity book, alert filters, decision log and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resampling as B
from .outcomes import ladder_resolution
from .panel import add
from .stats import agg, drawdown

SNAPSHOT = (
    "recorded_at string, date string, symbol string, protocol struct<version:string,sha256:string>, "
    "decision struct<direction:string,family:string>, n_open int, "
    "sides struct<long:struct<family:string,entry:double,stop:double,target:double,cost_r:double,entry_type:string>,"
    "short:struct<family:string,entry:double,stop:double,target:double,cost_r:double,entry_type:string>>"
)

# frozen parameters: a canonical JSON of them names the protocol
PARAMETERS = {"horizon": 20, "stop_mult": 1.25, "min_ev": 0.0, "max_concurrent": 6, "max_per_cluster": 1, "max_heat": 0.04, "version": "v1"}


def parameter_table(spark: SparkSession) -> DataFrame:
    items = ", ".join(f"'{k}', {v!r}" for k, v in sorted(PARAMETERS.items()))
    return spark.sql(f"SELECT to_json(named_struct({items})) AS canonical").selectExpr("canonical", "sha2(canonical, 256) AS protocol_id")


def target_ladder(rows: DataFrame, n: int = 3, min_rr: float = 2.5) -> DataFrame:
    """Up to three targets beyond the entry from the level clusters, else 1R/2R/3R; first with RR >= 2.5.

    ``rows``: side, entry, stop, clusters.
    """
    sg = "CASE side WHEN 'long' THEN 1 ELSE -1 END"
    ahead = f"filter(transform(coalesce(clusters, array()), c -> c.price), p -> {sg} * (p - entry) > 0.5 * abs(entry - stop))"
    near = f"slice(transform(array_sort(transform({ahead}, p -> {sg} * p)), p -> {sg} * p), 1, {n})"
    d = add(rows, {"_lv": near})
    fixed = ", ".join(f"entry + {sg} * {k} * abs(entry - stop)" for k in range(1, n + 1))
    d = add(d, {"source": "CASE WHEN size(_lv) > 0 THEN 'levels' ELSE 'multiples' END", "targets": f"CASE WHEN size(_lv) > 0 THEN _lv ELSE array({fixed}) END"})
    d = add(d, {"rrs": f"transform(targets, t -> {sg} * (t - entry) / abs(entry - stop))"})
    return add(d, {"headline_rr": f"element_at(concat(filter(rrs, x -> x >= {min_rr}), array(array_max(rrs))), 1)"}).drop("_lv")


# fixed values: what research says of each family; all others are unvalidated
FAMILY_STATUS = {"LONG_REVERSAL": "PROMISING-SHADOW-ONLY", "SHORT_REVERSAL": "FALSIFIED"}
# fixed values: cost in R where none can be computed, and the share of an ATR within which an entry is at the market
DEFAULT_COST, MARKET_ATR = 0.05, 0.25


def price_sides(sides: DataFrame, probabilities: DataFrame, min_rr: float = 2.5) -> DataFrame:
    """Both candidate sides of a bar priced from their ladders: entry type, cost, expected values and what blocks or weakens them.

    ``sides``: symbol, ts, side, close, atr, family, prob, confirmed, engine_score, entry, stop, target, ladder (prices), gate, spread, slip.
    ``probabilities``: side, family (null: all of the side), tp1, tp2, tp3, sl; a family's own table goes before its side's. An entry near the
    close is a market order and is priced from the close. Without a probability, or without a payoff, there is no expected value.
    """
    d = add(sides, {"entry_type": f"CASE WHEN atr > 0 AND abs(entry - close) <= {MARKET_ATR} * atr THEN 'market' ELSE 'limit' END"})
    d = d.withColumn("entry", F.expr("CASE WHEN entry_type = 'market' AND close <> stop THEN close ELSE entry END"))
    d = add(d, {"risk": "nullif(abs(entry - stop), 0)", "status": "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_STATUS.items()) + " ELSE 'UNVALIDATED' END"})
    d = add(d, {"rrs": "array_sort(filter(transform(ladder, p -> abs(p - entry) / risk), q -> q IS NOT NULL))", "rr": "abs(target - entry) / risk"})
    d = add(d, {"best_rr": "coalesce(array_max(rrs), rr)", "cost_r": f"CASE WHEN spread + 2 * slip > 0 AND risk IS NOT NULL THEN (spread + 2 * slip) / risk ELSE {DEFAULT_COST}D END"})
    own = probabilities.where("family IS NOT NULL").selectExpr("side", "family", "struct(tp1, tp2, tp3, sl) AS _own")
    all_ = probabilities.where("family IS NULL").selectExpr("side", "struct(tp1, tp2, tp3, sl) AS _all")
    # one row a family and one a side
    d = d.join(F.broadcast(own), ["side", "family"], "left").join(F.broadcast(all_), "side", "left")
    d = add(d, {"_p": "coalesce(_own, _all)", "_r": "transform(array(1, 2, 3), k -> coalesce(get(rrs, k - 1), 0.0D))"})
    d = add(d, {"_fine": "prob IS NOT NULL AND _p.tp1 + _p.tp2 + _p.tp3 + _p.sl > 0 AND _p.tp1 + _p.tp2 + _p.tp3 + _p.sl <= 1.001"})
    gross = "(_p.tp1 * _r[0] + _p.tp2 * (_r[0] + _r[1]) + _p.tp3 * (_r[0] + _r[1] + _r[2])) / 3 - _p.sl"
    d = add(
        d,
        {
            "ev_target": "CASE WHEN _fine THEN _p.tp1 * _r[0] + _p.tp2 * _r[1] + _p.tp3 * _r[2] - _p.sl - cost_r END", "ev_alloc": f"CASE WHEN _fine THEN {gross} - cost_r END",
            "cost_break_even": f"CASE WHEN _fine THEN {gross} END", "expected_r": "prob * CASE WHEN best_rr >= 1 THEN best_rr ELSE rr END - (1 - prob) - cost_r",
        },
    )
    why = {
        "family falsified": "status = 'FALSIFIED'", "rr floor": f"size(rrs) > 0 AND best_rr < {min_rr}", "macro gate": "NOT gate", "no family": "family IS NULL", "no probability": "prob IS NULL",
        "no payoff": "prob IS NOT NULL AND rr IS NULL AND best_rr IS NULL", "ranking ev": "expected_r <= 0",
    }
    d = add(d, {"ev": "coalesce(ev_alloc, ev_target, expected_r)", "reasons": "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in why.items()) + "))"})
    return add(d, {"blocked": "arrays_overlap(reasons, array('family falsified', 'rr floor', 'macro gate'))"}).drop("_own", "_all", "_p", "_r", "_fine")


def opportunity_book(priced: DataFrame, min_ev: float = 0.2) -> DataFrame:
    """One verdict per (symbol, ts) from two priced sides.

    The side with the larger expected value above ``min_ev`` is taken, longs at a tie, unless a hard gate (family, reward floor, macro) blocks
    it. Where neither side has an expected value the confirmed engine of the higher score decides, and only a falsified family blocks.
    """
    cols = "ev, blocked, confirmed, engine_score, status, reasons, entry_type, cost_r, best_rr"
    g = priced.groupBy("symbol", "ts").agg(*[F.expr(f"any_value(CASE WHEN side = '{s}' THEN struct({cols}) END, true) AS {s}") for s in ("long", "short")])
    rule = """CASE WHEN long.confirmed AND NOT (coalesce(short.confirmed, false) AND short.engine_score > long.engine_score) THEN CASE WHEN long.status = 'FALSIFIED' THEN 'flat' ELSE 'long' END
        WHEN short.confirmed THEN CASE WHEN short.status = 'FALSIFIED' THEN 'flat' ELSE 'short' END ELSE 'flat' END"""
    pick = f"CASE WHEN long.ev > {min_ev} AND (short.ev IS NULL OR long.ev >= short.ev) THEN 'long' WHEN short.ev > {min_ev} THEN 'short' ELSE 'flat' END"
    d = add(g, {"path": "CASE WHEN long.ev IS NULL AND short.ev IS NULL THEN 'rule' ELSE 'ev' END", "_pick": pick})
    d = add(d, {"direction": f"CASE WHEN path = 'rule' THEN {rule} WHEN (_pick = 'long' AND long.blocked) OR (_pick = 'short' AND short.blocked) THEN 'flat' ELSE _pick END"})
    d = add(d, {"status": "CASE WHEN direction = 'flat' THEN 'FLAT' WHEN path = 'rule' THEN 'CONFIRMED' ELSE 'TRADE' END"})
    out = [f"{s}.{c} AS {c}_{s}" for s in ("long", "short") for c in ("ev", "entry_type", "cost_r", "best_rr")] + [f"array_join({s}.reasons, '; ') AS why_{s}" for s in ("long", "short")]
    return d.selectExpr("symbol", "ts", "path", "direction", "status", *out)


def trade_plan(rows: DataFrame) -> DataFrame:
    """Status and order type per setup: stage, zone and macro gate decide; missing gate data passes."""
    return add(
        rows,
        {
            "status": "CASE WHEN stage = 'Confirmed' THEN 'CONFIRMED' WHEN stage IN ('In Pullback', 'In Rally') THEN 'WATCH' ELSE 'NO_SETUP' END",
            "order_type": """CASE WHEN coalesce(NOT gate, false) THEN 'WAIT-MACRO' WHEN stage = 'Confirmed' AND side = 'long' THEN CASE WHEN close > entry_hi THEN 'BUY-LIMIT' ELSE 'BUY-ZONE' END
                WHEN stage = 'Confirmed' THEN CASE WHEN close < entry_lo THEN 'SELL-LIMIT' ELSE 'SELL-ZONE' END WHEN stage IN ('In Pullback', 'In Rally') THEN 'WAIT-CONFIRM' ELSE 'NONE' END""",
        },
    )


def reward_risk() -> str:
    """Of the middle of the entry zone to the target, against the stop; null where any is missing or the stop is on the wrong side."""
    sg, mid = "CASE side WHEN 'long' THEN 1 ELSE -1 END", "(entry_lo + entry_hi) / 2"
    return f"CASE WHEN {sg} * ({mid} - stop) > 0 THEN {sg} * (target - {mid}) / ({sg} * ({mid} - stop)) END"


def live_filters(rows: DataFrame, min_score: int = 5, bias: float = 4.0, min_prob: float | None = None, min_rr: float | None = None, need_macro: bool = True) -> DataFrame:
    """Confirmed setups that may be sent: score floor, trend bias on the setup's side, probability and reward floors, and the macro gate.

    ``rows``: side, score, bias_score, prob, gate, entry_lo, entry_hi, stop, target. Longs need a bias of at least minus ``bias``, shorts of at
    most ``bias``. A missing bias, probability, gate or reward removes nothing.
    """
    keep = [f"score >= {min_score}", f"coalesce(CASE side WHEN 'long' THEN bias_score >= -({bias}) ELSE bias_score <= {bias} END, true)"]
    keep += [f"coalesce(prob >= {min_prob}, true)"] * (min_prob is not None)
    keep += ["coalesce(gate, true)"] * need_macro
    d = add(rows, {"rr": reward_risk()})
    keep += [f"coalesce(rr >= {min_rr}, true)"] * (min_rr is not None)
    return d.where(" AND ".join(keep))


def setup_key() -> str:
    return "format_string('%s:%.6f-%.6f', symbol, entry_lo, entry_hi)"


def unseen(alerts: DataFrame, seen: DataFrame, max_age_days: int = 10) -> DataFrame:
    """Alerts whose key was not sent within the last ``max_age_days`` days."""
    s = seen.selectExpr("key AS _k", "sent_at")
    return alerts.join(s, F.expr(f"key = _k AND sent_at < ts AND datediff(ts, sent_at) <= {max_age_days}"), "left_anti")


def merge_dual_fire(alerts: DataFrame, by: list[str]) -> DataFrame:
    """A group that fires on both sides keeps the side of its verdict (larger score); a tie drops both."""
    g = alerts.groupBy(*by).agg(F.expr("max(CASE WHEN side = 'long' THEN score END) AS _l"), F.expr("max(CASE WHEN side = 'short' THEN score END) AS _s"))
    d = alerts.join(g, by)
    keep = "_l IS NULL OR _s IS NULL OR (side = 'long' AND _l > _s) OR (side = 'short' AND _s > _l)"
    return d.where(keep).drop("_l", "_s")


def write_log(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """Tolerant JSON-lines reader: unparsable lines stay as rows with ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def join_resolutions(records: DataFrame, resolutions: DataFrame) -> DataFrame:
    """By recorded_at, else by (date, symbol); the first resolution per key wins."""
    a = resolutions.groupBy("recorded_at").agg(F.expr("min_by(r, res_seq) AS _ra"))
    b = resolutions.groupBy("date", "symbol").agg(F.expr("min_by(r, res_seq) AS _rb"))
    return records.join(a, "recorded_at", "left").join(b, ["date", "symbol"], "left").selectExpr(*records.columns, "coalesce(_ra, _rb) AS r")


#: One candidate side of a decision; prices and reward multiples of the target ladder stand side by side.
SIDE = "struct<entry:double,stop:double,target:double,cost_r:double,entry_type:string,rungs:array<double>,rrs:array<double>>"
COUNTERFACTUAL = ["outcome", "realized_r", "n_hit", "mfe_r", "mae_r", "time_exit"]


def side_rows(decisions: DataFrame, keep: list[str]) -> DataFrame:
    """One row per decision and candidate side that can be resolved: a ladder of up to three rungs, or else the one target."""
    d = decisions.selectExpr(*keep, "inline(array(named_struct('side', 'long', 'o', long), named_struct('side', 'short', 'o', short)))")
    d = d.selectExpr(*keep, "side", "o.*").where("entry IS NOT NULL AND stop IS NOT NULL AND entry <> stop")
    d = add(d, {"_rung": "slice(filter(zip_with(coalesce(rungs, array()), coalesce(rrs, array()), (p, q) -> named_struct('p', p, 'q', q)), x -> x.p IS NOT NULL AND x.q IS NOT NULL), 1, 3)"})
    d = add(d, {"_ladder": "CASE WHEN size(_rung) > 0 THEN _rung WHEN target IS NOT NULL THEN array(named_struct('p', target, 'q', abs(target - entry) / abs(entry - stop))) END"})
    d = d.where("_ladder IS NOT NULL")
    return d.selectExpr(*keep, "side", "entry", "stop", "coalesce(cost_r, 0.0D) AS cost_r", "coalesce(entry_type, 'limit') AS entry_type", "_ladder.p AS rungs", "_ladder.q AS rrs")


def resolve_decisions(decisions: DataFrame, panel: DataFrame, horizon: int = 20) -> DataFrame:
    """What became of recorded decisions: taken outcome and R, and both sides as if they had been taken.

    ``decisions``: symbol, rn (decision bar), direction, long and short (SIDE), any other columns. A limit order that no later bar touches is a
    non-fill of 0R without cost; inside a bar the stop comes before the rungs; the rest exits at nothing after ``horizon`` bars. A flat
    (or missing) direction is 0R and keeps both counterfactuals. A taken side without levels or later bars gives no row.
    """
    legs = ladder_resolution(side_rows(decisions, ["symbol", "rn"]), panel, horizon)
    cf = f"struct({', '.join(COUNTERFACTUAL)})"
    both = legs.groupBy("symbol", "rn").agg(*[F.expr(f"any_value(CASE WHEN side = '{s}' THEN {cf} END, true) AS cf_{s}") for s in ("long", "short")])
    d = decisions.join(both, ["symbol", "rn"], "left").withColumn("direction", F.coalesce("direction", F.lit("flat")))
    d = add(d, {"_t": "CASE direction WHEN 'long' THEN cf_long WHEN 'short' THEN cf_short END"})
    d = add(d, {"outcome": "CASE WHEN direction = 'flat' THEN 'flat' ELSE _t.outcome END", "r": "CASE WHEN direction = 'flat' THEN 0.0D ELSE _t.realized_r END"})
    return d.where("outcome IS NOT NULL").drop("_t")


# check -> (condition that makes a row bad, level when any row is bad)
CHECKS = {
    "protocol_hash_shape": ("NOT (protocol RLIKE '^[0-9a-f]{64}$')", "FAIL"),
    "timestamp_parseable": ("try_to_timestamp(recorded_at) IS NULL", "FAIL"),
    "recorded_near_bar": ("abs(datediff(try_to_timestamp(recorded_at), date)) > 5", "WARN"),
    "both_sides_present": ("cf_long IS NULL OR cf_short IS NULL", "FAIL"),
    "cost_present": ("cost_r IS NULL OR cost_r < 0", "FAIL"),
    "r_range": ("abs(taken_r) > 10", "FAIL"),
    "taken_equals_counterfactual": ("abs(taken_r - CASE side WHEN 'long' THEN cf_long ELSE cf_short END) > 1e-6", "FAIL"),
    "portfolio_cap": ("n_open > 6", "WARN"),
    "resolved_after_decision": ("resolved_on < date", "FAIL"),
}


def integrity(records: DataFrame) -> DataFrame:
    """Every row check in one pass plus the two duplicate checks; SKIP on an empty log."""
    n = len(CHECKS)
    one = records.agg(F.expr("count(*) AS total"), *[F.expr(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS c{i}") for i, (c, _) in enumerate(CHECKS.values())])
    items = ", ".join(f"'{k}', c{i}, '{lv}'" for i, (k, (_, lv)) in enumerate(CHECKS.items()))
    rows = one.selectExpr("total", f"stack({n}, {items}) AS (check_name, bad, level)")
    dup = None
    for name, keys, lv in (("duplicate_recorded_at", ["recorded_at", "symbol"], "FAIL"), ("repeated_date_symbol", ["date", "symbol"], "WARN")):
        g = records.groupBy(*keys).count().agg(F.expr("coalesce(sum(count), 0) AS total"), F.expr("coalesce(sum(CASE WHEN count > 1 THEN 1 ELSE 0 END), 0) AS bad"))
        g = g.selectExpr("total", f"'{name}' AS check_name", "bad", f"'{lv}' AS level")
        dup = g if dup is None else dup.unionByName(g)
    return rows.unionByName(dup).selectExpr("check_name", "coalesce(bad, 0) AS bad", "CASE WHEN total = 0 THEN 'SKIP' WHEN coalesce(bad, 0) > 0 THEN level ELSE 'PASS' END AS status")


# fixed values: the eleven gates and their thresholds, as conditions over a family's statistics; a missing statistic leaves its gate open
GATES = {
    "min_effective_n": "n_days >= 50",
    "independent_window": "span_days >= 90",
    "walk_forward": "n_positive_folds >= 3",
    "cost_robustness": "mean_r - 0.05 > 0 AND mean_r - 0.15 > 0",
    "permutation_test": "p_flip < 0.05",
    "bootstrap_ci": "ci_lower >= 0.05",
    "loso": "n_symbols >= 2 AND worst_without_symbol > 0",
    "regime_stability": "n_regimes >= 2",
    "concentration_limits": "max_symbol_share <= 0.40 AND max_cluster_share <= 0.60",
    "portfolio_contribution": "sharpe_all > sharpe_without",
    "drawdown_limits": "max_dd >= -12.0",
}


def gate_statistics(records: DataFrame, clusters: str, row_id: str, reps: int = 1000, folds: int = 5) -> DataFrame:
    """Every statistic that the gates read, one row per family.

    ``records``: family, symbol, date, regime, taken_r; ``clusters`` is an array expression of the groups that a symbol belongs to, ``row_id`` an
    integer expression. Resampling is keyed: one pass expands rows by replicate inside the map tasks and shuffles one partial sum per
    (family, replicate) for the bootstrap and the sign flips together. Drawdowns are carried over chunk summaries, leave-one-out
    means and the portfolio without a family come from sums, so no family is gathered in one task.
    """
    base = agg(records, ["family"], {"n": "count(taken_r)", "total": "sum(taken_r)", "n_days": "count(distinct date)", "first": "min(date)", "span_days": "datediff(max(date), min(date))", "mean_r": "avg(taken_r)"})
    edge = F.broadcast(base.select("family", "first", "span_days"))  # one row a family, of which there are twelve
    walk = records.join(edge, "family").withColumn("fold", F.expr(f"int(floor({folds} * datediff(date, first) / (span_days + 1)))"))
    walk = agg(agg(walk, ["family", "fold"], {"m": "avg(taken_r)"}), ["family"], {"n_positive_folds": "count_if(m > 0)"})
    regimes = agg(agg(records, ["family", "regime"], {"m": "avg(taken_r)"}), ["family"], {"n_regimes": "count_if(m > 0)"})
    symbols = agg(records, ["family", "symbol"], {"v": "count(*)", "k": "count(taken_r)", "s": "sum(taken_r)"}).join(F.broadcast(base.select("family", "n", "total")), "family")
    symbols = agg(symbols, ["family"], {"n_symbols": "count(*)", "max_symbol_share": "max(v) / sum(v)", "worst_without_symbol": "min((total - s) / nullif(n - k, 0))"})
    groups = records.selectExpr("family", f"explode({clusters}) AS g")
    groups = agg(agg(groups, ["family", "g"], {"v": "count(*)"}), ["family"], {"max_cluster_share": "max(v) / (sum(v) / 2)"})
    drawn = B.replicates(records.where("taken_r IS NOT NULL").selectExpr("family", "taken_r", f"{row_id} AS uid"), reps)
    drawn = add(drawn, {"_w": B.poisson1(B.unit("rep", "uid", 42)), "_s": f"CASE WHEN {B.unit('rep', 'uid', 7)} < 0.5 THEN -1 ELSE 1 END"})
    drawn = agg(drawn, ["family", "rep"], {"stat": "sum(_w * taken_r) / nullif(sum(_w), 0)", "flipped": "avg(_s * taken_r)", "observed": "avg(taken_r)"})
    # one row for each replicate of a family
    drawn = agg(drawn, ["family"], {"ci_lower": "percentile(stat, 0.025)", "p_flip": f"(1 + count_if(flipped >= observed - 1e-9)) / {reps + 1}"})
    daily = agg(records, ["family", "date"], {"x": "sum(taken_r)"})
    days = agg(daily, ["date"], {"t": "sum(x)"})
    book = agg(days, [], {"d": "count(*)", "st": "sum(t)", "stt": "sum(t * t)"})
    part = agg(daily.join(days, "date"), ["family"], {"sx": "sum(x)", "sc": "sum(2 * t * x - x * x)"}).crossJoin(F.broadcast(book))
    sharpe = lambda s, ss: f"({s}) / d / nullif(sqrt(greatest(({ss}) / d - pow(({s}) / d, 2), 0)), 0)"
    part = part.selectExpr("family", f"{sharpe('st', 'stt')} AS sharpe_all", f"{sharpe('st - sx', 'stt - sc')} AS sharpe_without")
    falls = drawdown(records.where("taken_r IS NOT NULL").selectExpr("family", "date", "symbol", "taken_r"), "family", "taken_r", ["date", "symbol"], "date")
    out = base.drop("first")
    for one in (walk, regimes, symbols, groups, drawn, part, falls):
        out = out.join(one, "family", "left")
    return out


STATISTICS = ["n_days", "span_days", "n_positive_folds", "mean_r", "p_flip", "ci_lower", "n_symbols", "worst_without_symbol", "n_regimes", "max_symbol_share", "max_cluster_share", "sharpe_all", "sharpe_without", "max_dd"]


def promotion(stats: DataFrame) -> DataFrame:
    """``failed`` gates and the level of each family: all passed, some observations, or none. Statistics that ``stats`` lacks are missing."""
    stats = add(stats, {c: "CAST(NULL AS DOUBLE)" for c in STATISTICS if c not in stats.columns})
    flags = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in GATES.items())
    d = add(stats, {"failed": f"array_compact(array({flags}))"})
    return add(d, {"level": "CASE WHEN size(failed) = 0 THEN 'L3' WHEN n_days > 0 THEN 'L2' ELSE 'L0' END"})


def scoreboard(stats: DataFrame) -> DataFrame:
    """For each gate the families that pass, fail, or lack its statistic, and what that makes of the gate."""
    rows = ", ".join(f"{i}, '{k}', {c}" for i, (k, c) in enumerate(GATES.items(), 1))
    d = stats.selectExpr("family", f"stack({len(GATES)}, {rows}) AS (gate_no, gate, ok)")
    d = agg(d, ["gate_no", "gate"], {"n_pass": "count_if(ok)", "n_fail": "count_if(NOT ok)", "n_unresolved": "count_if(ok IS NULL)"})
    return add(d, {"status": "CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_unresolved > 0 THEN 'UNRESOLVED' ELSE 'PASS' END"})
