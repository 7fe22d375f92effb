"""Ordered-panel primitives that never put a whole symbol into one task.

A panel is a bar table with a 0-based ordinal ``rn`` per symbol. One symbol may hold a third of
all rows, so windows are not partitioned by symbol alone. Rows are cut into chunks of ``CHUNK``
ordinals and windows run per (symbol, chunk):

* bounded frames get the neighbouring rows they need by copying a halo into the next chunk;
* unbounded frames (recurrences, running totals, last-known values) run inside a chunk and are
  completed by a carry computed over one summary row per chunk.

Every step is a deterministic function of the rows, so a lost executor only costs a recompute.
Expressions are SQL text: one call builds a whole column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2048
WIN = "PARTITION BY symbol, _c ORDER BY rn"


def add(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Append SQL-text columns in one projection."""
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in cols.items()])


def put(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Replace or append SQL-text columns in one projection."""
    keep = [c for c in df.columns if c not in cols]
    return df.selectExpr(*keep, *[f"{e} AS {n}" for n, e in cols.items()])


def index_panel(bars: DataFrame, ts: str = "ts", bucket: str = "year") -> DataFrame:
    """Add ``rn`` per symbol.

    Rows are numbered inside calendar buckets (bounded, because a symbol has one bar per time
    step) and shifted by the bar counts of the earlier buckets.
    """
    b = bars.selectExpr("*", f"date_trunc('{bucket}', {ts}) AS _b")
    offsets = (
        b.groupBy("symbol", "_b").count().selectExpr(
            "symbol", "_b",
            "coalesce(sum(count) OVER (PARTITION BY symbol ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off",
        )
    )
    local = b.selectExpr("*", f"row_number() OVER (PARTITION BY symbol, _b ORDER BY {ts}) - 1 AS _i")
    return local.join(offsets, ["symbol", "_b"]).selectExpr(*bars.columns, "_off + _i AS rn")


def with_halo(panel: DataFrame, back: int = 0, fwd: int = 0, chunk: int | None = None) -> DataFrame:
    """Assign rows to chunk ``_c`` and copy the ``back``/``fwd`` rows each chunk needs."""
    c = chunk or CHUNK
    spread = f"explode(sequence(greatest(floor((rn - {fwd}) / {c}), 0), floor((rn + {back}) / {c}))) AS _c"
    return panel.selectExpr("*", spread).selectExpr("*", f"_c = floor(rn / {c}) AS _own")


def chunked(bars: DataFrame, back: int = 0, fwd: int = 0) -> DataFrame:
    """Index a bar table if needed and cut it into haloed chunks."""
    return with_halo(bars if "rn" in bars.columns else index_panel(bars), back, fwd)


def own_rows(haloed: DataFrame) -> DataFrame:
    return haloed.where("_own").drop("_own")


def over(back: int | None, to: int = 0) -> str:
    """Frame of rows -back .. to inside the chunk; None reaches to the chunk start."""
    lo = "UNBOUNDED PRECEDING" if back is None else f"{back} PRECEDING" if back >= 0 else f"{-back} FOLLOWING"
    hi = f"{-to} PRECEDING" if to < 0 else f"{to} FOLLOWING" if to > 0 else "CURRENT ROW"
    return f"OVER ({WIN} ROWS BETWEEN {lo} AND {hi})"


def lag(col: str, n: int = 1) -> str:
    """Value n rows earlier; negative n looks ahead."""
    fn = "lag" if n >= 0 else "lead"
    return f"{fn}({col}, {abs(n)}) OVER ({WIN})"


def rolling(agg: str, n: int, start: int = 0) -> str:
    """Aggregate over the last n rows, null until n rows are there (first input at row ``start``)."""
    return f"CASE WHEN rn >= {n - 1 + start} THEN {agg} {over(n - 1)} END"


def segment(df: DataFrame, keep: int = 0, chunk: int | None = None) -> DataFrame:
    """Keep the rows of each chunk plus ``keep`` halo rows before it, with their position ``_pos``.

    The first ``chunk`` positions of all segments tile the panel, so a summary of those rows per
    segment can be carried forward, and the ``keep`` halo rows get exact carried values too.
    """
    c = chunk or CHUNK
    return df.selectExpr("*", f"rn - (_c * {c} - {keep}) AS _pos").where(f"_pos >= 0 AND _pos < {c + keep}")


_PRIOR = "OVER (PARTITION BY symbol ORDER BY _c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def last_seen(col: str) -> str:
    """Carried last non-null segment-end value, for ``extra_carry``."""
    return f"last({col}, true) {_PRIOR}"


def scan(
    df: DataFrame,
    specs: dict[str, tuple[str, float]],
    keep: int = 0,
    extra_ends: list[str] = (),
    extra_carry: dict[str, str] | None = None,
    extra_levels: tuple[dict[str, str], ...] = (),
    chunk: int | None = None,
) -> DataFrame:
    """Decayed running totals S_t = x_t + d * S_{t-1} for every {name: (expression, d)}.

    ``df`` is chunked. d = 1 is a plain running total. With chunk length L the carry is
    sum_k d^(L(k-1)) * end(c-k); terms below 1e-18 cannot change a double. ``extra_ends`` are
    further columns whose segment-end values the SQL in ``extra_carry`` turns into carried
    columns (``extra_levels`` are helper columns computed on the summary before that), so one
    summary and one join serve everything.
    """
    c = chunk or CHUNK
    if "_pos" not in df.columns:
        df = segment(df, keep, c)
    local, carry, done = {}, dict(extra_carry or {}), {}
    for name, (x, d) in specs.items():
        x = f"coalesce(cast({x} AS double), 0.0D)"
        step = c * -math.log(d) if d > 0 else math.inf
        if step > 690:
            # a short memory: the terms that can change a double are few, and all lie in this chunk or at the end of the last
            rows = min(c, max(1, math.ceil(42 / -math.log(d)))) if d > 0 else 1
            local[name] = f"aggregate(collect_list({x}) {over(rows - 1)}, 0.0D, (a, v) -> a * {d!r}D + v)"
            carry[f"_k_{name}"] = f"coalesce(lag({name}) OVER (PARTITION BY symbol ORDER BY _c), 0.0D)"
            done[name] = f"{name} + _k_{name} * pow({d!r}D, _pos + 1)"
        elif d == 1.0:
            local[name] = f"sum({x}) {over(None)}"
            carry[f"_k_{name}"] = f"coalesce(sum({name}) {_PRIOR}, 0.0D)"
            done[name] = f"{name} + _k_{name}"
        else:
            p = f"{d!r}D"
            local[name] = f"pow({p}, _pos) * sum({x} * pow({p}, -_pos)) {over(None)}"
            terms = [
                f"coalesce(lag({name}, {i}) OVER (PARTITION BY symbol ORDER BY _c), 0.0D) * {math.exp(-step * (i - 1))!r}D"
                for i in range(1, max(1, math.ceil(42 / step)) + 1)
            ]
            carry[f"_k_{name}"] = " + ".join(terms)
            done[name] = f"{name} + _k_{name} * pow({p}, _pos + 1)"
    df = add(df, local)
    names = ", ".join([*specs, *extra_ends])
    last_row = F.expr(f"max_by(struct({names}), rn) AS _e")
    ends = df.where(f"_pos < {c}").groupBy("symbol", "_c").agg(last_row).selectExpr("symbol", "_c", "_e.*")
    for level in extra_levels:
        ends = add(ends, level)
    out = df.join(ends.selectExpr("symbol", "_c", *[f"{e} AS {n}" for n, e in carry.items()]), ["symbol", "_c"])
    return put(out, done).drop("_pos", *[f"_k_{n}" for n in specs])


def running_max(own: DataFrame, specs: dict[str, str]) -> DataFrame:
    """Running maximum per symbol over chunked rows."""
    seg = add(segment(own), {n: f"max({e}) {over(None)}" for n, e in specs.items()})
    out = scan(seg, {}, extra_ends=list(specs), extra_carry={f"_m_{n}": f"max({n}) {_PRIOR}" for n in specs})
    return put(out, {n: f"greatest({n}, _m_{n})" for n in specs}).drop(*[f"_m_{n}" for n in specs])


def ffill(own: DataFrame, specs: dict[str, str]) -> DataFrame:
    """Last non-null value of each expression up to and including the row, over chunked rows."""
    seg = add(segment(own), {f"_f_{n}": f"last({e}, true) {over(None)}" for n, e in specs.items()})
    out = scan(seg, {}, extra_ends=[f"_f_{n}" for n in specs], extra_carry={f"_m_{n}": last_seen(f"_f_{n}") for n in specs})
    return put(out, {n: f"coalesce(_f_{n}, _m_{n})" for n in specs}).drop(*[f"{p}{n}" for n in specs for p in ("_f_", "_m_")])


def latest(panel: DataFrame, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """Latest row per symbol by a map-side-combined aggregate (no sort of the history)."""
    cols = ", ".join(panel.columns)
    return panel.groupBy(key).agg(F.expr(f"max_by(struct({cols}), {ts}) AS _r")).select("_r.*")


def last_n(panel: DataFrame, n: int, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """Last n rows per symbol, ``k`` = 1 for the newest; planned as a group limit before the shuffle."""
    return panel.selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY {ts} DESC) AS k").where(f"k <= {n}")
