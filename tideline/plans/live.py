"""Queries: streaming jobs run over what is available, and MLlib models."""

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import outcomes as O
from ..operators import panel as P
from ..operators import regime as R
from ..operators import stats as S
from ..sources import derive as D
from ..sources import store
from ..streaming import jobs as J
from . import sql_base  # noqa: F401
from .decisions import alerts
from .registry import query, show
from .statistics import candidates, q

sql_base.bounded_ctes("bh", "h")
_WM = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@q("stream_bars", "symbol ts:t open:2 high:2 low:2 close:2 volume:i", f"SELECT * FROM bh WHERE ts + INTERVAL 1 HOUR <= {_WM}", "bh")
def stream_bars(spark, sf):
    return J.run_available(J.bars(J.read_events(spark, sf)), "bars")


@q("stream_sliding", "symbol ts:t n:i mean:6 hi:2", f"SELECT symbol, ts, count(*) AS n, avg(value) AS mean, max(value) AS hi FROM (SELECT event_type AS symbol, value, date_trunc('hour', ts) + INTERVAL 1 HOUR * k AS ts FROM events, range(1, 5) r(k)) WHERE ts <= {_WM} GROUP BY 1, 2")
def stream_sliding(spark, sf):
    return J.run_available(J.sliding(J.read_events(spark, sf)), "sliding")


@q(
    "stream_sessions", "user_id:i start_ts:t end_ts:t n:i",
    f"""WITH g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events))
    SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_WM}""",
)
def stream_sessions(spark, sf):
    return J.run_available(J.sessions(J.read_events(spark, sf)), "sessions")


@q("stream_feed_dedup", "event_id:i", "SELECT event_id FROM events")
def stream_feed_dedup(spark, sf):
    """The same rows delivered twice (an overlapping re-read) come out once."""
    e = J.read_events(spark, sf).selectExpr("event_id", "ts", "explode(array(0, 1)) AS copy")
    return J.run_available(J.deduplicated(e, ["event_id"]), "feed").select("event_id")


def _dir(spark, sf, name, build):
    return store.written(spark, name, sf, build)


@q("stream_alert_dedup", "key", "SELECT DISTINCT key FROM alr", "alr")
def stream_alert_dedup(spark, sf):
    path = _dir(spark, sf, "alerts", lambda: alerts(spark, sf).selectExpr("key", "cast(ts as timestamp) AS ts"))
    return J.run_available(J.deduplicated(spark.readStream.schema("key string, ts timestamp").parquet(path), ["key"]), "alerts").select("key")


@q("stream_indicator_state", "symbol ts:t ema:4 rsi:4", "SELECT symbol, ts, ema_20 AS ema, rsi_14 AS rsi FROM hrec", "hrec")
def stream_indicator_state(spark, sf):
    path = _dir(spark, sf, "bars_h", lambda: D.bars_h(spark, sf))
    s = spark.readStream.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double").parquet(path)
    return J.run_available(J.indicator_state(s), "state")


@q("stream_decision_bars", "symbol n:i decisions:i", "SELECT symbol, count(*) AS n, count(DISTINCT dt) AS decisions FROM (SELECT c.symbol, c.ts AS dt, w.ts FROM cand c JOIN wb w ON w.symbol = c.symbol AND w.ts > c.ts AND w.ts <= c.ts + INTERVAL 30 DAY) GROUP BY 1", "cand", "wb")
def stream_decision_bars(spark, sf):
    dp = _dir(spark, sf, "open_decisions", lambda: candidates(spark, sf).selectExpr("symbol", "cast(ts as timestamp) AS ts", "0.0D AS stop", "1.0D AS target"))
    bp = _dir(spark, sf, "walk_bars", lambda: D.walk_d(spark, sf).selectExpr("symbol", "cast(ts as timestamp) AS ts", "high", "low"))
    d = spark.readStream.schema("symbol string, ts timestamp, stop double, target double").parquet(dp)
    b = spark.readStream.schema("symbol string, ts timestamp, high double, low double").parquet(bp)
    return S.agg(J.run_available(J.pending_bars(d, b), "pending"), ["symbol"], {"n": "count(*)", "decisions": "count(distinct d_ts)"})


@q("stream_staleness", "symbol last_ts:t", """WITH b AS (SELECT symbol, ts FROM bh WHERE symbol <> 'error' OR ts < TIMESTAMP '2024-01-20')
    SELECT symbol, max(ts) AS last_ts FROM b GROUP BY 1 HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b)""", "bh")
def stream_staleness(spark, sf):
    """Symbols whose last bar lies more than six hours behind the watermark."""
    path = _dir(spark, sf, "bars_h", lambda: D.bars_h(spark, sf))
    s = spark.readStream.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double").parquet(path)
    return J.run_available(J.stale_symbols(s.where("NOT (symbol = 'error' AND ts >= TIMESTAMP '2024-01-20')"), 6 * 3600), "stale")


@q("stream_idempotent_sink", "symbol n:i", "SELECT symbol, count(*) AS n FROM bh GROUP BY 1", "bh")
def stream_idempotent_sink(spark, sf):
    """Two runs of the same stream into one keyed table leave each key once."""
    import uuid

    path = _dir(spark, sf, "bars_h", lambda: D.bars_h(spark, sf))
    out = f"{store.root(spark)}/sink-{uuid.uuid4().hex[:8]}"
    for i in range(2):
        s = spark.readStream.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double").parquet(path)
        s.writeStream.foreachBatch(J.keyed_sink(f"{out}/t", ["symbol", "ts"], "ts", f"run{i}")).option("checkpointLocation", f"{out}/c{i}").trigger(availableNow=True).start().awaitTermination()
    return S.agg(spark.read.parquet(f"{out}/t/data"), ["symbol"], {"n": "count(*)"})


# ---- models -------------------------------------------------------------------------------------
def _data(spark, sf):
    return store.stored(spark, "dataset", sf, lambda: M.dataset(D.research_d(spark, sf), O.triple_barrier(D.panel_d(spark, sf))))


_SPLIT = "2000-01-01"
_NN = " AND ".join(f"{f} IS NOT NULL" for f in M.FEATURES)


@q(
    "model_dataset", "symbol n:i pos:i weight:3",
    f"""SELECT symbol, count(*) AS n, sum(label) AS pos, sum({M.WEIGHT.replace('1.0D', '1.0').replace('0.3D', '0.3').replace('5.0D', '5.0').replace('0.25D', '0.25').replace('4.0D', '4.0').replace('0.01', '1e-2')}) AS weight FROM (SELECT *, CASE WHEN s THEN 0 WHEN t THEN 1 WHEN cf IS NOT NULL THEN CAST(cf > close AS INT) END AS label, NOT s AND NOT t AND cf IS NOT NULL AS censored FROM (
    SELECT *, coalesce(lo <= close - 1.25 * atr_14, false) AS s, NOT coalesce(lo <= close - 1.25 * atr_14, false) AND coalesce(hi >= close + 0.75 * atr_14, false) AS t FROM (SELECT *, min(low) OVER fw AS lo, max(high) OVER fw AS hi, lead(close, 10) OVER (PARTITION BY symbol ORDER BY rn) AS cf FROM rk
    WINDOW fw AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)))) WHERE label IS NOT NULL AND {_NN} GROUP BY 1""", "rk",
)
def model_dataset(spark, sf):
    return S.agg(_data(spark, sf), ["symbol"], {"n": "count(*)", "pos": "sum(label)", "weight": "sum(weight)"})


def _scored(spark, sf):
    def build():
        tr, te = M.chronological(_data(spark, sf), _SPLIT)
        return M.score(M.fit_gbt(tr), te).select("symbol", "ts", "rn", "label", "p", "dist_z", "adx", "bias_score")

    return store.stored(spark, "scored", sf, build)


query("model_scores")(lambda spark, sf: show(_scored(spark, sf), "symbol ts:d label:0 p:6"))


@query("model_evaluation")
def model_evaluation(spark, sf):
    return show(S.classification_metrics(_scored(spark, sf), "label", "p"), "n:i base_rate:5 log_loss:6 accuracy:5 precision_:5 recall:5 auc:6")


@query("model_calibration")
def model_calibration(spark, sf):
    """Raw, Platt and isotonic probabilities fitted on the first part of the test period, judged on the rest."""
    s = _scored(spark, sf)
    fit, late = s.where("ts < DATE '2001-01-01'"), s.where("ts >= DATE '2001-01-01'")
    parts = [late.selectExpr("'raw' AS method", "label", "p"), M.platt(fit, late).selectExpr("'platt' AS method", "label", "p_platt AS p"), M.isotonic(fit, late).selectExpr("'isotonic' AS method", "label", "p_iso AS p")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    b = S.agg(P.add(u, {"bin": "least(cast(floor(p * 10) as int), 9)"}), ["method", "bin"], {"n": "count(*)", "pm": "avg(p)", "yr": "avg(label)", "br": "sum((p - label) * (p - label))"})
    return show(S.agg(b, ["method"], {"n": "sum(n)", "brier": "sum(br) / sum(n)", "ece": "sum(n * abs(pm - yr)) / sum(n)"}), "method n:i brier:5 ece:5")


@query("model_feature_importance")
def model_feature_importance(spark, sf):
    tr, _ = M.chronological(_data(spark, sf), _SPLIT)
    imp = spark.createDataFrame(M.importance(M.fit_gbt(tr)), "feature string, grp string, gain double")
    return show(S.grouping_sets(imp, [["grp", "feature"], ["grp"]], {"gain": "sum(gain)"}), "grp feature gain:5")


@query("model_walk_forward")
def model_walk_forward(spark, sf):
    """Expanding folds of equal row counts over all days, each trained on what ends an embargo before it; one fit per fold."""
    d = _data(spark, sf)
    starts = d.agg(F.expr("approx_percentile(ts, array(0.4D, 0.55D, 0.7D, 0.85D))")).first()[0]
    out = []
    for start, end in zip(starts, [*starts[1:], None]):
        tr, te = M.chronological(d, str(start)[:10])
        out.append((str(start)[:10], M.auc(M.score(M.fit_gbt(tr), te if end is None else te.where(f"ts < DATE '{str(end)[:10]}'")))))
    return show(spark.createDataFrame(out, "fold string, auc double"), "fold auc:5")


@query("model_grid_search")
def model_grid_search(spark, sf):
    """Depth and rate are chosen on the last fifth of the training days; the test days see only the chosen pair."""
    tr, te = M.chronological(_data(spark, sf), _SPLIT)
    inner, held = M.chronological(tr, str(tr.agg(F.expr("approx_percentile(ts, 0.8D)")).first()[0])[:10])
    out = [(d, r, M.auc(M.score(M.fit_gbt(inner, depth=d, rate=r), held))) for d in (2, 3) for r in (0.05, 0.1, 0.2)]
    best = max(out, key=lambda x: x[2])
    test = M.auc(M.score(M.fit_gbt(tr, depth=best[0], rate=best[1]), te))
    rows = [(d, r, a, (d, r, a) == best, test if (d, r, a) == best else None) for d, r, a in out]
    return show(spark.createDataFrame(rows, "depth int, rate double, auc double, chosen boolean, test_auc double"), "depth:i rate:2 auc:5 chosen:b test_auc:5")


@query("model_group_ablation")
def model_group_ablation(spark, sf):
    tr, te = M.chronological(_data(spark, sf), _SPLIT)
    out = []
    for g in [None, *M.GROUPS]:
        names = [f for f in M.FEATURES if f not in M.GROUPS.get(g, [])]
        out.append((g or "none", M.auc(M.score(M.fit_gbt(tr, names=names), te, names))))
    return show(spark.createDataFrame(out, "dropped string, auc double"), "dropped auc:5")


@query("model_stacking")
def model_stacking(spark, sf):
    s = _scored(spark, sf)
    fit, late = s.where("ts < DATE '2001-01-01'"), s.where("ts >= DATE '2001-01-01'")
    t = M.stack(fit, late, ["p", "dist_z", "adx", "bias_score"])
    return show(spark.createDataFrame([("raw", M.auc(late)), ("stacked", M.auc(t, "p_stack"))], "method string, auc double"), "method auc:5")


def _regime_query(name, fn):
    @query(name)
    def run(spark, sf):
        z = R.standardized(D.panel_d(spark, sf))
        return show(S.agg(fn(z), ["regime", "label"], {"n": "count(*)"}), "regime label n:i")


_regime_query("regime_clusters", M.cluster_regimes)
_regime_query("regime_mixture", M.mixture_regimes)
