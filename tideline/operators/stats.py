"""Aggregate statistics over outcomes, returns and probabilities. All aggregates combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel as P
from . import ranking as K
from .panel import add

T = "avg({0}) / nullif(stddev_samp({0}) / sqrt(count({0})), 0)"


def agg(df: DataFrame, by: list[str], cols: dict[str, str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.expr(f"{e} AS {n}") for n, e in cols.items()])


def grouping_sets(df: DataFrame, sets: list[list[str]], cols: dict[str, str], label: str = "ALL") -> DataFrame:
    """Aggregate over several groupings at once; a rolled-up key reads ``label``."""
    keys = sorted({k for s in sets for k in s})
    sets_sql = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    sel = ", ".join(
        [f"CASE WHEN grouping({k}) = 1 THEN '{label}' ELSE {k} END AS {k}" for k in keys] + [f"{e} AS {n}" for n, e in cols.items()]
    )
    return df.sparkSession.sql(
        f"SELECT {sel} FROM {{src}} GROUP BY GROUPING SETS ({sets_sql})", src=df
    )


def series_stats(x: str) -> dict[str, str]:
    return {
        "n": f"count({x})",
        "mean": f"avg({x})",
        "win": f"avg(CASE WHEN {x} > 0 THEN 1.0D WHEN {x} IS NOT NULL THEN 0.0D END)",
        "pf": f"sum(CASE WHEN {x} > 0 THEN {x} ELSE 0 END) / nullif(-sum(CASE WHEN {x} < 0 THEN {x} ELSE 0 END), 0)",
        "sharpe": f"avg({x}) / nullif(stddev_samp({x}), 0)",
        "total": f"sum({x})",
    }


def drawdown(trades: DataFrame, key: str, r: str, order: list[str], day: str = "signal_ts") -> DataFrame:
    """Largest fall of the running R total below its peak, per key; ``day`` is the time of a trade, the first of ``order``.

    The running total and its running peak use the chunked panel, so one long series is split.
    """
    o = ", ".join(order)
    # trade lists are indexed by time bucket and order, then scanned like any panel
    d = trades.selectExpr(f"{key} AS symbol", f"struct({o}) AS ts", f"to_date({day}) AS _day", f"{r} AS r")
    d = index_by(d, "_day", "ts")
    eq = P.scan(P.own_rows(P.with_halo(d)), {"equity": ("r", 1.0)})
    pk = P.running_max(eq, {"peak": "greatest(equity, 0)"})
    return pk.groupBy("symbol").agg(F.expr("min(equity - peak) AS max_dd")).withColumnRenamed("symbol", key)


def index_by(d: DataFrame, bucket: str, order: str) -> DataFrame:
    """Ordinal ``rn`` per symbol by (bucket, order): counted buckets plus a sort inside each bucket."""
    off = d.groupBy("symbol", bucket).count().selectExpr(
        "symbol", bucket,
        f"coalesce(sum(count) OVER (PARTITION BY symbol ORDER BY {bucket} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off",
    )
    loc = d.selectExpr("*", f"row_number() OVER (PARTITION BY symbol, {bucket} ORDER BY {order}) - 1 AS _i")
    return loc.join(off, ["symbol", bucket]).selectExpr("symbol", order, "r", "_off + _i AS rn")


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [0, 1] with mean prediction, hit rate and count."""
    d = add(df, {"bin": f"least(cast(floor({p} * {bins}) as int), {bins - 1})"})
    return agg(d, ["bin"], {"n": "count(*)", "p_mean": f"avg({p})", "y_rate": f"avg({y})"})


def calibration_metrics(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Brier, log loss, ECE, MCE, calibration slope and intercept over bin means weighted by rows."""
    q = f"greatest(least({p}, 1 - 1e-6), 1e-6)"
    one = agg(df, [], {"n": "count(*)", "brier": f"avg(({p} - {y}) * ({p} - {y}))", "log_loss": f"avg(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q})))", "slope": f"regr_slope({y}, {p})", "intercept": f"regr_intercept({y}, {p})"})
    b = calibration_bins(df, y, p, bins)
    two = agg(b, [], {"ece": "sum(n * abs(p_mean - y_rate)) / sum(n)", "mce": "max(abs(p_mean - y_rate))"})
    return one.crossJoin(F.broadcast(two))


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve from average-rank sums; counts per distinct probability, no row sort."""
    r = K.value_ranks(df, [], p).selectExpr(p, "lt + (eq + 1) / 2.0D AS rk")
    pos = df.groupBy(p).agg(F.expr(f"sum({y}) AS _pos"), F.expr("count(*) AS _m"))
    return agg(
        pos.join(r, p), [], {"auc": "(sum(_pos * rk) - sum(_pos) * (sum(_pos) + 1) / 2) / (sum(_pos) * (sum(_m) - sum(_pos)))"}
    )


def classification_metrics(df: DataFrame, y: str, p: str, cut: float = 0.5) -> DataFrame:
    hit = f"CASE WHEN {p} >= {cut} THEN 1 ELSE 0 END"
    q = f"greatest(least({p}, 1 - 1e-6), 1e-6)"
    m = agg(
        df, [],
        {
            "n": "count(*)", "base_rate": f"avg({y})", "log_loss": f"avg(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q})))",
            "accuracy": f"avg(CASE WHEN {hit} = {y} THEN 1.0D ELSE 0.0D END)",
            "precision_": f"sum({hit} * {y}) / nullif(sum({hit}), 0)", "recall": f"sum({hit} * {y}) / nullif(sum({y}), 0)",
        },
    )
    return m.crossJoin(F.broadcast(auc(df, y, p)))


def decile_report(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-count bins by probability: row k of n falls in the bin d with int(d n / bins) <= k.

    Rows that share a probability are spread over bins by count, so no row-level sort is needed:
    a distinct value covers ordinals lt .. lt + eq - 1 and its wins are shared evenly.
    """
    r = K.value_ranks(df, [], p)
    v = df.groupBy(p).agg(F.expr(f"sum({y}) AS _w"))
    d = r.join(v, p).selectExpr(
        "*",
        f"""explode(filter(transform(sequence(0, {bins - 1}), d -> named_struct('bin', d,
            'm', least(lt + eq, floor((d + 1) * n / {bins})) - greatest(lt, floor(d * n / {bins})))), s -> s.m > 0)) AS _s""",
    )
    out = agg(
        d.selectExpr("_s.bin AS bin", "_s.m AS m", f"{p} AS p", "_w / eq AS w"), ["bin"],
        {"n": "sum(m)", "p_mean": "sum(m * p) / sum(m)", "win_rate": "sum(m * w) / sum(m)"},
    )
    base = agg(df, [], {"base": f"avg({y})"})
    return out.crossJoin(F.broadcast(base)).selectExpr("bin + 1 AS decile", "n", "p_mean", "win_rate", "win_rate / base AS lift")


def bh_fdr(tests: DataFrame, p: str = "p", q: float = 0.10) -> DataFrame:
    """Benjamini-Hochberg adjusted q and pass flag over a table of tests.

    One row per test (rules x horizons), so a single ordered window is small.
    """
    d = tests.selectExpr("*", f"row_number() OVER (ORDER BY {p}) AS _r", "count(*) OVER () AS _m")
    d = d.selectExpr("*", f"least(min({p} * _m / _r) OVER (ORDER BY {p}, _r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0D) AS q_adj")
    return add(d, {"bh_pass": f"q_adj <= {q}"}).drop("_r", "_m")


def leave_one_out(df: DataFrame, key: str, x: str) -> DataFrame:
    """Mean of everything except one key, by subtraction from the totals."""
    s = agg(df.where(f"{x} IS NOT NULL"), [key], {"n_i": "count(*)", "s_i": f"sum({x})"})
    t = agg(s, [], {"n_all": "sum(n_i)", "s_all": "sum(s_i)"})
    return s.crossJoin(F.broadcast(t)).selectExpr(key, "n_i AS n", "s_i / n_i AS mean", "(s_all - s_i) / nullif(n_all - n_i, 0) AS mean_without")


def concentration(df: DataFrame, key: str, x: str) -> DataFrame:
    """Herfindahl index and top shares of the absolute net result per key."""
    s = agg(df, [key], {"net": f"sum({x})"})
    t = agg(s, [], {"_tot": "sum(abs(net))", "_m": "count(*)"})
    d = s.crossJoin(F.broadcast(t)).selectExpr("*", "abs(net) / nullif(_tot, 0) AS share")
    d = d.selectExpr("*", f"row_number() OVER (ORDER BY share DESC, {key}) AS _k")
    return agg(d, [], {"n_keys": "count(*)", "hhi": "sum(share * share)", "top1": "sum(CASE WHEN _k <= 1 THEN share ELSE 0 END)", "top2": "sum(CASE WHEN _k <= 2 THEN share ELSE 0 END)", "top10pct": "sum(CASE WHEN _k <= greatest(1, ceil(_m * 0.1)) THEN share ELSE 0 END)"})


NORM_TAIL_SQL = "exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * (0.319381530 * {t} - 0.356563782 * {t} * {t} + 1.781477937 * pow({t}, 3) - 1.821255978 * pow({t}, 4) + 1.330274429 * pow({t}, 5))"


def two_sided_p(t: str) -> str:
    """Two-sided normal tail of a t statistic (published polynomial, error < 1.5e-7); for n in the hundreds and up."""
    z = f"abs({t})"
    k = f"(1 / (1 + 0.2316419 * {z}))"
    return f"(2 * {NORM_TAIL_SQL.format(z=z, t=k)})"
