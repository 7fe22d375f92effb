"""Resampling with hash draws: stable on retry, map-side combined, one output row per replicate.

The bootstrap gives every row (or block, or symbol) a Poisson(1) weight per replicate. That needs no
draw-to-row join: rows are expanded by replicate inside the map task and only the partial sums of
each replicate are shuffled. Draws are integer arithmetic, so another engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking as K
from .panel import add

PRIME = 2147483647


def unit(rep: str, key: str, seed: int = 42) -> str:
    """Uniform [0, 1) from two integers: two squaring rounds modulo a prime."""
    rep, key = f"CAST({rep} AS BIGINT)", f"CAST({key} AS BIGINT)"
    a = f"((({rep}) * 69621 + ({key}) * 48271 + {seed}) % {PRIME})"
    b = f"(({a} * {a} + ({key}) % 65521 * 7919 + {seed}) % {PRIME})"
    return f"((({b} * {b} + ({rep}) * 16807 + 12345) % {PRIME}) / {PRIME}.0)"


def poisson1(u: str) -> str:
    """Poisson(1) count for a uniform number."""
    # fixed values: cumulative Poisson(1) probabilities
    cum = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    return "CASE " + " ".join(f"WHEN {u} < {c} THEN {k}" for k, c in enumerate(cum)) + " ELSE 7 END"


def replicates(df: DataFrame, reps: int) -> DataFrame:
    return df.selectExpr("*", f"explode(sequence(1, {reps})) AS rep")


def bootstrap(df: DataFrame, unit_id: str, x: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Mean per replicate; ``unit_id`` is the resampled unit (row, block or symbol hash, an integer)."""
    u = unit("rep", unit_id, seed)
    d = add(replicates(df, reps), {"_w": poisson1(u)})
    return d.groupBy("rep").agg(F.expr(f"sum(_w * {x}) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN _w END), 0) AS stat"))


def interval(stats: DataFrame, alpha: float = 0.05, x: str = "stat") -> DataFrame:
    """Percentile interval over the replicate rows (one row per replicate)."""
    return K.quantiles(stats, [], x, {"lo": alpha / 2, "mid": 0.5, "hi": 1 - alpha / 2})


def sign_flip(df: DataFrame, unit_id: str, x: str, reps: int = 300, seed: int = 7) -> DataFrame:
    """Observed mean and the share of random-sign replicates at least as far from zero."""
    d = replicates(df, reps)
    s = f"CASE WHEN {unit('rep', unit_id, seed)} < 0.5 THEN -1 ELSE 1 END"
    per = d.groupBy("rep").agg(F.expr(f"avg({s} * {x}) AS m"), F.expr(f"avg({x}) AS obs"))
    return per.agg(F.expr("max(obs) AS observed"), F.expr("avg(CASE WHEN abs(m) >= abs(obs) THEN 1.0D ELSE 0.0D END) AS p"))


def random_timing(events: DataFrame, pool: DataFrame, x: str, reps: int = 200, seed: int = 11) -> DataFrame:
    """Observed event mean against replicates that pick the same expected number of bars from the pool.

    Each pool row joins a replicate with probability n_events / n_pool, decided by its own hash.
    """
    n = events.agg(F.expr(f"count({x}) AS n_ev"), F.expr(f"avg({x}) AS obs"))
    m = pool.agg(F.expr(f"count({x}) AS n_pool"))
    d = replicates(pool.where(f"{x} IS NOT NULL").crossJoin(F.broadcast(n.crossJoin(m))), reps)
    d = d.where(f"{unit('rep', 'unit_id', seed)} < n_ev / n_pool")
    per = d.groupBy("rep").agg(F.expr(f"avg({x}) AS m"), F.expr("max(obs) AS obs"))
    return per.agg(
        F.expr("max(obs) AS observed"), F.expr("avg(m) AS null_mean"), F.expr("avg(CASE WHEN m >= obs THEN 1.0D ELSE 0.0D END) AS p")
    )


def block_drawdowns(trades: DataFrame, reps: int = 10_000, seed: int = 5, block: int = 10) -> DataFrame:
    """Per replicate: final R, largest drawdown and longest losing streak of resampled ten-trade blocks.

    ``trades`` carry ``k`` (0-based order) and ``r``. Blocks are summarised first (sum, lowest and
    highest prefix, inner drawdown, streaks), so a replicate folds over n / 10 summaries.
    """
    c = f"cast(floor(k / {block}) as int)"
    blk = trades.selectExpr(f"{c} AS b", "k", "r").groupBy("b").agg(F.expr("transform(array_sort(collect_list(struct(k, r))), s -> s.r) AS rs"))
    blk = add(
        blk,
        {
            "s": """aggregate(rs, named_struct('t', 0.0D, 'lo', 0.0D, 'hi', 0.0D, 'dd', 0.0D, 'all', true, 'pre', 0, 'run', 0, 'best', 0),
            (a, x) -> named_struct('t', a.t + x, 'lo', least(a.lo, a.t + x), 'hi', greatest(a.hi, a.t + x), 'dd', least(a.dd, a.t + x - greatest(a.hi, a.t + x)),
              'all', a.all AND x < 0, 'pre', CASE WHEN a.all AND x < 0 THEN a.pre + 1 ELSE a.pre END, 'run', CASE WHEN x < 0 THEN a.run + 1 ELSE 0 END,
              'best', greatest(a.best, CASE WHEN x < 0 THEN a.run + 1 ELSE 0 END)))"""
        },
    ).select("b", "s")
    nb = blk.agg(F.expr("count(*) AS nb"))
    draws = replicates(blk.select(F.expr("b AS pos")), reps).crossJoin(F.broadcast(nb))
    draws = add(draws, {"b": f"cast(floor({unit('rep', 'pos', seed)} * nb) as int)"})
    d = draws.join(blk, "b").groupBy("rep").agg(F.expr("array_sort(collect_list(struct(pos, s))) AS path"))
    fold = """aggregate(path, named_struct('t', 0.0D, 'hi', 0.0D, 'dd', 0.0D, 'run', 0, 'best', 0), (a, e) -> named_struct(
        't', a.t + e.s.t, 'hi', greatest(a.hi, a.t + e.s.hi), 'dd', least(a.dd, e.s.dd, a.t + e.s.lo - a.hi),
        'run', CASE WHEN e.s.all THEN a.run + e.s.run ELSE e.s.run END, 'best', greatest(a.best, e.s.best, a.run + e.s.pre)))"""
    return add(d, {"_f": fold}).selectExpr("rep", "_f.t AS final_r", "_f.dd AS max_dd", "_f.best AS losing_streak")
