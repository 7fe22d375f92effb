"""Queries: ingestion hygiene, dataset routing, macro and calendar joins."""

from pyspark.sql import functions as F

from ..operators import hygiene as H
from ..operators import joins as J
from ..operators import panel as P
from ..operators import ranking as K
from ..operators import stats as S
from ..sources import bars as SB
from ..sources import derive as D
from ..sources import store
from . import sql_base  # noqa: F401
from .registry import cte, sel, sql_with
from .statistics import q

# raw vendor rows from the event stream: several rows per hour, some inconsistent, some without volume
_RAW = """event_type AS symbol, date_trunc('hour', ts) AS ts, event_id AS ord, value AS open, value + event_id % 7 - 1 AS high,
 value - event_id % 5 + 0.5 AS low, value AS close, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) END AS volume"""


def raw(spark, sf):
    return D.table(spark, sf, "events").selectExpr(*[f"{a} AS {b}" for a, b in (x.rsplit(" AS ", 1) for x in _split(_RAW))])


def _split(text):
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


@q(
    "bar_cleaning", "symbol ts:t open:2 high:2 low:2 close:2 volume:0",
    f"""SELECT symbol, ts, open, high, low, close, last_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS volume FROM (
    SELECT * FROM (SELECT {_RAW} FROM events) QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ord) = 1)
    WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND high >= open AND high >= close AND low <= open AND low <= close""",
)
def bar_cleaning(spark, sf):
    return H.clean_bars(raw(spark, sf))


_H4 = "symbol ts:t open:2 high:2 low:2 close:2 volume:0"


@q("resample_4h", _H4, "SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bh GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01')", "bh")
def resample_4h(spark, sf):
    b = D.bars_h(spark, sf).selectExpr("symbol", "ts AS t", "open", "high", "low", "close", "volume")
    g = b.groupBy("symbol", F.expr("window(t, '4 hours').start").alias("ts"))
    return g.agg(*[F.expr(e) for e in ("min_by(open, t) AS open", "max(high) AS high", "min(low) AS low", "max_by(close, t) AS close", "sum(volume) AS volume")])


for _u in ("week", "month"):
    q(f"resample_{_u}", "symbol ts:d open:2 high:2 low:2 close:2 volume:0", f"SELECT symbol, date_trunc('{_u}', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, date_trunc('{_u}', ts)", "b")(
        lambda spark, sf, u=_u: __import__("tideline.operators.regime", fromlist=["resample"]).resample(D.bars_d(spark, sf), u)
    )


@q("vendor_rows", "symbol ts:t open:2 high:2 low:2 close:2 volume:0 spread_points:i", f"SELECT symbol, date_trunc('second', ts) AS ts, open, high, low, close, coalesce(volume, 0) AS volume, 0 AS spread_points FROM (SELECT {_RAW} FROM events)")
def vendor_rows(spark, sf):
    r = raw(spark, sf).selectExpr("symbol", "unix_timestamp(ts) AS time", "open", "high", "low", "close", "volume AS tick_volume", "cast(null as int) AS spread")
    return H.normalise_rates(r)


@q("vendor_payload", "symbol ts:t open:2 high:2 low:2 close:2 volume:0", "SELECT * FROM bh WHERE open > 0 AND high > 0 AND low > 0 AND close > 0", "bh")
def vendor_payload(spark, sf):
    """One payload per symbol and day with parallel arrays, parsed back to rows."""
    b = D.bars_h(spark, sf).selectExpr("symbol", "to_date(ts) AS day", "struct(unix_timestamp(ts) AS timestamp, open, high, low, close, volume) AS r")
    g = b.groupBy("symbol", "day").agg(F.expr("array_sort(collect_list(r)) AS a"))
    p = g.selectExpr("symbol", "to_json(named_struct(" + ", ".join(f"'{c}', a.{c}" for c in ("timestamp", "open", "high", "low", "close", "volume")) + ")) AS payload")
    return H.parse_payload(p)


@q("processed_roundtrip", "symbol n:i first_close:2 last_close:2", "SELECT symbol, count(*) AS n, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close FROM b WHERE symbol IN ('AF', 'RO') GROUP BY 1", "b")
def processed_roundtrip(spark, sf):
    """Partitioned sink and partition-pruned reload."""
    path = f"{store.root(spark)}/bars-{abs(hash(sf))}"
    SB.write_bars(D.bars_d(spark, sf), path, "D1")
    return S.agg(SB.reload_bars(spark, path, "D1").where("symbol IN ('AF', 'RO')"), ["symbol"], {"n": "count(*)", "first_close": "min_by(close, ts)", "last_close": "max_by(close, ts)"})


_CUT, _NEW = "TIMESTAMP '2024-01-25 00:00:00'", "TIMESTAMP '2024-01-23 00:00:00'"


def _old_new(spark, sf):
    b = D.bars_h(spark, sf)
    old = b.where(f"ts < {_CUT} AND symbol <> 'error'").unionByName(b.where("symbol = 'view' AND ts >= TIMESTAMP '2024-01-25'"))
    return old, P.put(b.where(f"ts >= {_NEW}"), {"volume": "volume + 1000"}).select(*b.columns)


cte("oldb", f"SELECT * FROM bh WHERE (ts < {_CUT} AND symbol <> 'error') OR symbol = 'view'", "bh")
cte("newb", f"SELECT * REPLACE (volume + 1000 AS volume) FROM bh WHERE ts >= {_NEW}", "bh")


@q("incremental_upsert", "symbol ts:t close:2 volume:0", "SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.ts, o.ts) AS ts, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume FROM oldb o FULL JOIN newb n ON n.symbol = o.symbol AND n.ts = o.ts", "oldb", "newb")
def incremental_upsert(spark, sf):
    return H.upsert(*_old_new(spark, sf))


cte("upst", "SELECT n.symbol, count(*) FILTER (WHERE o.ts IS NULL) AS added, CASE WHEN n.symbol NOT IN (SELECT symbol FROM oldb) THEN 'created' WHEN count(*) FILTER (WHERE o.ts IS NULL) > 0 THEN 'updated' ELSE 'current' END AS status FROM newb n LEFT JOIN oldb o ON n.symbol = o.symbol AND n.ts = o.ts GROUP BY 1", "oldb", "newb")
q("update_status", "symbol added:i status", "SELECT * FROM upst", "upst")(lambda spark, sf: H.update_status(*_old_new(spark, sf)))
q("group_update_rollup", "status symbols:i added:i", "SELECT status, count(*) AS symbols, sum(added) AS added FROM upst GROUP BY 1", "upst")(
    lambda spark, sf: S.agg(H.update_status(*_old_new(spark, sf)), ["status"], {"symbols": "count(*)", "added": "sum(added)"})
)

# datasets: daily bars as two groups (one misses the last quarter), hourly bars as a third
cte("ds", "SELECT 'main' AS grp, 'D1' AS timeframe, symbol, ts::TIMESTAMP AS ts FROM b UNION ALL SELECT 'staged', 'D1', symbol, ts::TIMESTAMP FROM b WHERE ts >= DATE '1996-01-01' OR symbol = 'AF' UNION ALL SELECT 'events', 'H1', symbol, ts FROM bh", "b", "bh")
cte("dc", "SELECT grp, timeframe, symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ds GROUP BY 1, 2, 3", "ds")


def counts(spark, sf):
    b = D.bars_d(spark, sf).selectExpr("'main' AS grp", "'D1' AS timeframe", "symbol", "cast(ts as timestamp) AS ts")
    s = b.where("ts >= DATE '1996-01-01' OR symbol = 'AF'").selectExpr("'staged' AS grp", "timeframe", "symbol", "ts")
    return H.dataset_counts(b.unionByName(s).unionByName(D.bars_h(spark, sf).selectExpr("'events' AS grp", "'H1' AS timeframe", "symbol", "ts")))


q("dataset_discovery", "grp timeframe symbols:i bars:i", "SELECT grp, timeframe, count(*) AS symbols, sum(n) AS bars FROM dc GROUP BY 1, 2", "dc")(lambda spark, sf: S.agg(counts(spark, sf), ["grp", "timeframe"], {"symbols": "count(*)", "bars": "sum(n)"}))
q("longest_history", "timeframe symbol grp n:i", "SELECT timeframe, symbol, grp, n FROM dc QUALIFY row_number() OVER (PARTITION BY timeframe, symbol ORDER BY n DESC, grp DESC) = 1", "dc")(lambda spark, sf: H.longest_copy(counts(spark, sf)))
_MP = "CASE WHEN n_new IS NULL THEN 'keep' WHEN n_old IS NULL THEN 'move' WHEN n_new = 0 OR n_old = 0 THEN 'keep-both' WHEN n_new > n_old THEN 'move' ELSE 'skip-shorter' END"
q("merge_plan", "symbol timeframe action", f"SELECT symbol, timeframe, {_MP} AS action FROM (SELECT coalesce(s.symbol, m.symbol) AS symbol, coalesce(s.timeframe, m.timeframe) AS timeframe, s.n AS n_new, m.n AS n_old FROM (SELECT * FROM dc WHERE grp IN ('staged', 'events')) s FULL JOIN (SELECT * FROM dc WHERE grp = 'main') m ON s.symbol = m.symbol AND s.timeframe = m.timeframe)", "dc")(
    lambda spark, sf: H.merge_plan(counts(spark, sf).where("grp IN ('staged', 'events')"), counts(spark, sf).where("grp = 'main'"))
)
q("short_history_quarantine", "grp timeframe symbol n:i action", "SELECT *, CASE WHEN n < 1000 THEN 'archive' ELSE 'keep' END AS action FROM dc", "dc")(lambda spark, sf: P.add(counts(spark, sf), {"action": "CASE WHEN n < 1000 THEN 'archive' ELSE 'keep' END"}))
_EL = "n >= 500 AND first_ts < TIMESTAMP '1998-01-01' AND last_ts >= TIMESTAMP '2001-06-01'"
q("eligible_universe", "grp timeframe symbol n:i first_ts:t last_ts:t", f"SELECT * FROM dc WHERE {_EL}", "dc")(lambda spark, sf: counts(spark, sf).where(_EL))
_FST = "CASE WHEN n IS NULL THEN 'MISSING' WHEN age > CASE timeframe WHEN 'D1' THEN 4 ELSE 2 END THEN 'STALE' ELSE 'FRESH' END"
cte("fr", f"SELECT *, {_FST} AS status FROM (SELECT x.timeframe, x.symbol, n, date_diff('day', CAST(last_ts AS DATE), DATE '2001-11-05') AS age FROM (SELECT 'D1' AS timeframe, l_returnflag || l_linestatus AS symbol FROM lineitem GROUP BY ALL UNION ALL SELECT 'H1', r_name FROM region) x LEFT JOIN (SELECT * FROM dc WHERE grp <> 'staged') d ON d.timeframe = x.timeframe AND d.symbol = x.symbol)", "dc")


def fresh(spark, sf):
    want = D.daily_ticks(spark, sf).select("symbol").distinct().selectExpr("'D1' AS timeframe", "symbol").unionByName(D.table(spark, sf, "region").selectExpr("'H1' AS timeframe", "r_name AS symbol"))
    return H.freshness(counts(spark, sf).where("grp <> 'staged'"), want, "2001-11-05")


q("freshness_report", "timeframe symbol n:0 age:0 status", "SELECT * FROM fr", "fr")(fresh)
q("freshness_summary", "status datasets:i max_age:0", "SELECT status, count(*) AS datasets, max(age) AS max_age FROM fr GROUP BY 1", "fr")(lambda spark, sf: S.agg(fresh(spark, sf), ["status"], {"datasets": "count(*)", "max_age": "max(age)"}))

# symbol names spelled from the part table
_NAMES = "EURUSD USDJPY EURGBP XAUUSD XAGEUR XBRUSD USOIL BTCUSD SOLUSDT ADAUSD PEPEUSD US500 GER30 AAPL MSFT NAS100 USDTRY DXY".split()
_NM = "CASE p_partkey % 18 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
q("symbol_bucket", "symbol bucket n:i", f"""SELECT symbol, CASE WHEN starts_with(symbol, 'XAU') AND symbol = 'XAUUSD' OR symbol IN ('XAGUSD', 'XPTUSD', 'XPDUSD') THEN 'metal' WHEN symbol = 'BTCUSD' OR symbol = 'ETHUSD' THEN 'crypto'
    WHEN list_contains(['US500', 'US30', 'USTEC', 'NAS100', 'US100'], symbol) THEN 'index' WHEN regexp_full_match(symbol, '(EUR|GBP|USD|CHF|JPY|AUD|NZD|CAD){{2}}') THEN 'fx_major_cross' ELSE 'fx_exotic' END AS bucket, count(*) AS n FROM (SELECT {_NM} AS symbol FROM part) GROUP BY 1, 2""")(
    lambda spark, sf: S.agg(D.table(spark, sf, "part").selectExpr(f"{_NM} AS symbol").selectExpr("symbol", f"{H.symbol_bucket()} AS bucket"), ["symbol", "bucket"], {"n": "count(*)"})
)
for _n, _fn in (("symbol_classification", H.classify_sql), ("macro_symbol_class", H.macro_class_sql)):
    q(_n, "symbol cls n:i", f"SELECT symbol, {_fn(chr(39).join(['regexp_matches(symbol, ', '[0-9]', ')']), *([chr(39).join(['symbol = ', 'MSFT', ''])] if _n == 'symbol_classification' else []))} AS cls, count(*) AS n FROM (SELECT {_NM} AS symbol FROM part) GROUP BY 1, 2")(
        lambda spark, sf, fn=_fn, n=_n: S.agg(
            D.table(spark, sf, "part").selectExpr(f"{_NM} AS symbol").selectExpr("symbol", fn("symbol RLIKE '[0-9]'", *(["symbol = 'MSFT'"] if n == "symbol_classification" else [])) + " AS cls"),
            ["symbol", "cls"], {"n": "count(*)"},
        )
    )

# ---- macro ------------------------------------------------------------------------------------
_ROLES = {"AF": "dxy", "NO": "vix", "RO": "tnx"}
_VB = (19500, 20500, 100, 50)
cte(
    "mac",
    """SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, last_value(dxy IGNORE NULLS) OVER (ORDER BY ts) AS dxy, last_value(vix IGNORE NULLS) OVER (ORDER BY ts) AS vix, last_value(tnx IGNORE NULLS) OVER (ORDER BY ts) AS tnx FROM (
    SELECT ts, max(close) FILTER (WHERE symbol = 'AF') AS dxy, max(close) FILTER (WHERE symbol = 'NO') AS vix, max(close) FILTER (WHERE symbol = 'RO') AS tnx FROM wb WHERE symbol IN ('AF', 'NO', 'RO') GROUP BY 1)""", "wb",
)
_O = "OVER (ORDER BY rn ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
cte(
    "msc",
    f"""SELECT ts, dxy, vix, tnx, CASE WHEN m IS NOT NULL THEN greatest(-2, least(2, CAST(sign(dxy - m) AS INT) + CASE WHEN rsi > 50 THEN 1 WHEN rsi < 50 THEN -1 ELSE 0 END)) END AS dxy_score,
    CASE WHEN vc IS NOT NULL THEN greatest(-2, least(2, CASE WHEN vix < {_VB[0]} THEN 1 WHEN vix > {_VB[1]} THEN -1 ELSE 0 END + CASE WHEN vc < -{_VB[2]} THEN 1 WHEN vc > {_VB[2]} THEN -1 ELSE 0 END)) END AS vix_score,
    CASE WHEN tm IS NOT NULL THEN greatest(-2, least(2, CASE WHEN tnx > tm THEN 1 ELSE -1 END + CASE WHEN sl < -{_VB[3]} THEN 1 WHEN sl > {_VB[3]} THEN -1 ELSE 0 END)) END AS tnx_score
    FROM (SELECT *, CASE WHEN n = 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi FROM (
      SELECT *, CASE WHEN rn >= 199 THEN avg(dxy) {_O.format(199)} END AS m, CASE WHEN rn >= 199 THEN avg(tnx) {_O.format(199)} END AS tm, avg(greatest(d, 0)) FILTER (WHERE d IS NOT NULL) {_O.format(13)} AS g, avg(greatest(-d, 0)) FILTER (WHERE d IS NOT NULL) {_O.format(13)} AS l, count(d) {_O.format(13)} AS n,
       vix - lag(vix, 20) OVER (ORDER BY rn) AS vc, tnx - lag(tnx, 20) OVER (ORDER BY rn) AS sl FROM (SELECT *, dxy - lag(dxy) OVER (ORDER BY rn) AS d FROM mac)))""", "mac",
)


def macro(spark, sf):
    return J.macro_frame(D.walk_d(spark, sf), _ROLES)


def scores(spark, sf):
    return store.stored(spark, "macro_scores", sf, lambda: J.factor_scores(macro(spark, sf), *_VB))


q("macro_frame", "ts:d dxy:1 vix:1 tnx:1", "SELECT * FROM mac", "mac")(macro)
q("macro_factor_scores", "ts:d dxy_score:0 vix_score:0 tnx_score:0", "SELECT * FROM msc", "msc")(scores)
_RL = ", ".join(f"{v} AS {k}" for k, v in J.REGIME_LABELS.items())
q("macro_regime", "ts:d usd risk rates composite:4", f"SELECT ts, {_RL} FROM msc", "msc")(lambda spark, sf: P.add(scores(spark, sf), J.REGIME_LABELS))
_KIND = "CASE symbol WHEN 'AF' THEN 'fx_usd_quote' WHEN 'AO' THEN 'fx_usd_base' WHEN 'NF' THEN 'metal' WHEN 'NO' THEN 'crypto' WHEN 'RF' THEN 'index' ELSE 'equity' END"
_GATE = "CASE WHEN bias >= -0.5 THEN 1 ELSE 0 END"
cte("mbj", f"SELECT *, {J.MACRO_LABEL} AS label, {_GATE} AS long_gate, CASE WHEN bias <= 0.5 THEN 1 ELSE 0 END AS short_gate FROM (SELECT *, {J.MACRO_BIAS} AS bias FROM (SELECT w.symbol, w.ts, w.rn, {_KIND} AS kind, m.dxy_score, m.vix_score, m.tnx_score FROM wb w ASOF LEFT JOIN (SELECT ts + INTERVAL 1 DAY AS ts, dxy_score, vix_score, tnx_score FROM msc) m ON w.ts >= m.ts))", "wb", "msc")


def macro_joined(spark, sf):
    sc = ["dxy_score", "vix_score", "tnx_score"]
    j = J.asof(D.walk_d(spark, sf).select("symbol", "ts", "rn"), scores(spark, sf), sc)
    d = P.add(P.add(j, {"kind": _KIND}), {"bias": J.MACRO_BIAS})
    return P.add(d, {"label": J.MACRO_LABEL, "long_gate": _GATE, "short_gate": "CASE WHEN bias <= 0.5 THEN 1 ELSE 0 END"})


q("asof_macro_bias", "symbol ts:d dxy_score:0 vix_score:0 tnx_score:0 bias:4 label long_gate:i short_gate:i", "SELECT * FROM mbj", "mbj")(macro_joined)
q("macro_ranking", "symbol bias:4 label rank:i", "SELECT *, row_number() OVER (ORDER BY bias DESC, symbol) AS rank FROM (SELECT * FROM mbj QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1)", "mbj")(
    lambda spark, sf: P.add(P.latest(macro_joined(spark, sf)), {"rank": "row_number() OVER (ORDER BY bias DESC, symbol)"})
)
q("macro_snapshot", "ts:d usd risk rates composite:4", f"SELECT ts, {_RL} FROM msc ORDER BY ts DESC LIMIT 1", "msc")(
    lambda spark, sf: P.add(scores(spark, sf).agg(F.expr("max_by(struct(*), ts) AS r")).select("r.*"), J.REGIME_LABELS)
)
_MOM = "close / lag(close, {0}) OVER (PARTITION BY symbol ORDER BY rn) - 1"


@q(
    "cross_asset_join", "symbol ts:d risk_mom5:6 risk_mom20:6 gold_mom5:6 gold_mom20:6",
    f"""WITH m AS (SELECT symbol, ts, {_MOM.format(5)} AS m5, {_MOM.format(20)} AS m20 FROM wb), x AS (SELECT ts, avg(m5) FILTER (WHERE symbol IN ('AF', 'AO')) AS r5, avg(m20) FILTER (WHERE symbol IN ('AF', 'AO')) AS r20, max(m5) FILTER (WHERE symbol = 'NO') AS g5, max(m20) FILTER (WHERE symbol = 'NO') AS g20 FROM m WHERE symbol IN ('AF', 'AO', 'NO') GROUP BY 1)
    SELECT symbol, w.ts, coalesce(lag(r5) OVER p, 0) AS risk_mom5, coalesce(lag(r20) OVER p, 0) AS risk_mom20, coalesce(lag(g5) OVER p, 0) AS gold_mom5, coalesce(lag(g20) OVER p, 0) AS gold_mom20 FROM wb w LEFT JOIN x USING (ts) WINDOW p AS (PARTITION BY symbol ORDER BY rn)""", "wb",
)
def cross_asset_join(spark, sf):
    return J.cross_asset(D.walk_d(spark, sf), ["AF", "AO"], "NO")


# weekly positioning reports: the Friday volumes, ranked against all earlier ones
cte("cot", "SELECT symbol, ts, 100.0 * len(list_filter(list(volume) OVER (PARTITION BY symbol ORDER BY ts), lambda v: v <= volume)) / row_number() OVER (PARTITION BY symbol ORDER BY ts) AS percentile FROM wb WHERE isodow(ts) = 5", "wb")


def reports(spark, sf):
    """Expanding percentile of the Friday volumes, stored once per application."""
    weekly = store.stored(spark, "weekly_volumes", sf, lambda: D.walk_d(spark, sf).where("weekday(ts) = 4").select("symbol", "ts", "volume"))
    return store.stored(spark, "weekly_percentiles", sf, lambda: K.expanding_percentile(weekly, "volume"))


q("expanding_percentile", "symbol ts:d percentile:4", "SELECT * FROM cot", "cot")(reports)
q("positioning_join", "symbol ts:d pct:4", "SELECT symbol, ts, greatest(0, least(100, coalesce(last_value(lp IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn), 50))) AS pct FROM (SELECT w.symbol, w.ts, rn, lag(percentile) OVER (PARTITION BY w.symbol ORDER BY rn) AS lp FROM wb w LEFT JOIN cot c ON c.symbol = w.symbol AND c.ts = w.ts)", "wb", "cot")(
    lambda spark, sf: J.positioning(D.walk_d(spark, sf), reports(spark, sf))
)


@q(
    "macro_sensitivities", "symbol n:i corr_dxy:4 beta_dxy:4 corr_vix:4 beta_vix:4",
    """WITH fr AS (SELECT ts + INTERVAL 1 DAY AS ts, dxy / lag(dxy) OVER (ORDER BY rn) - 1 AS dxy, vix / lag(vix) OVER (ORDER BY rn) - 1 AS vix FROM mac), r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM wb),
    j AS (SELECT * FROM (SELECT r.symbol, r.ts, ret, dxy, vix FROM r JOIN fr USING (ts) WHERE ret IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 90)
    SELECT symbol, count(*) AS n, corr(ret, dxy) AS corr_dxy, covar_samp(ret, dxy) / var_samp(dxy) AS beta_dxy, corr(ret, vix) AS corr_vix, covar_samp(ret, vix) / var_samp(vix) AS beta_vix FROM j GROUP BY 1""", "mac", "wb",
)
def macro_sensitivities(spark, sf):
    """Returns on both sides; the macro series is one row per day."""
    h = P.with_halo(P.add(macro(spark, sf), {"symbol_": "symbol"}), 1)
    f = P.own_rows(P.put(h, {c: f"{c} / {P.lag(c)} - 1" for c in ("dxy", "vix")})).select("ts", "dxy", "vix")
    return J.sensitivities(D.walk_d(spark, sf), f, ["dxy", "vix"])


# hourly bars joined to the daily table of the same events
cte("mtfh", "SELECT symbol, CAST(ts AS DATE) AS d, arg_max(close, ts) AS close, count(*) AS n FROM bh GROUP BY 1, 2", "bh")


@q("mtf_join", "symbol d:d close:2 mom3:5 sma5:5", "SELECT symbol, d, close, close / lag(close, 3) OVER w - 1 AS mom3, CASE WHEN row_number() OVER w >= 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS sma5 FROM mtfh WINDOW w AS (PARTITION BY symbol ORDER BY d)", "mtfh")
def mtf_join(spark, sf):
    d = D.bars_h(spark, sf).selectExpr("symbol", "to_date(ts) AS d", "ts AS t", "close").groupBy("symbol", "d").agg(F.expr("max_by(close, t) AS close"))
    h = P.chunked(d.selectExpr("symbol", "d AS ts", "close"), 5)
    return P.own_rows(P.add(h, {"mom3": f"close / {P.lag('close', 3)} - 1", "sma5": P.rolling("avg(close)", 5), "d": "ts"}))
