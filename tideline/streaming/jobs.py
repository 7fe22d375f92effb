"""Structured Streaming versions of the live parts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import store

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stream over the event table."""
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is there into a written table, with its own checkpoint, and read it back."""
    import uuid

    spark = df.sparkSession
    base = f"{store.root(spark)}/stream-{name}-{uuid.uuid4().hex[:8]}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def bars(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars per symbol; a bar is emitted once the watermark has passed its end, later ticks are dropped."""
    e = events.withWatermark("ts", late).selectExpr("event_type AS symbol", "ts", "value", "struct(ts, event_id) AS o")
    g = e.groupBy(F.window("ts", size).alias("w"), "symbol").agg(
        *[F.expr(x) for x in ("min_by(value, o) AS open", "max(value) AS high", "min(value) AS low", "max_by(value, o) AS close", "count(*) AS volume")]
    )
    return g.selectExpr("symbol", "w.start AS ts", "open", "high", "low", "close", "volume")


def sliding(events: DataFrame, size: str = "4 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Trailing-window volume and price statistics."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), F.col("event_type").alias("symbol"))
    return g.agg(F.expr("count(*) AS n"), F.expr("avg(value) AS mean"), F.expr("max(value) AS hi")).selectExpr("symbol", "w.end AS ts", "n", "mean", "hi")


def deduplicated(rows: DataFrame, keys: list[str], ts: str = "ts", keep: str = "10 days") -> DataFrame:
    """First row per key; the key is forgotten when the watermark has passed it by ``keep``."""
    return rows.withWatermark(ts, keep).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of activity per user separated by a gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.expr("count(*) AS n")).selectExpr("user_id", "w.start AS start_ts", "w.end AS end_ts", "n")


def indicator_state(bars_: DataFrame, span: int = 20, rsi_n: int = 14) -> DataFrame:
    """EMA and Wilder RSI per symbol with the recurrences carried in keyed state across micro-batches.

    A recurrence is sequential per symbol; what reaches it are bars, already aggregated from ticks.
    """
    a, d = 2 / (span + 1), 1 / rsi_n

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, ema, gain, loss = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, close in zip(rows["ts"], rows["close"]):
            move = close - last if n else 0.0
            ema = a * close + (1 - a) * ema if n else close
            gain = d * max(move, 0.0) + (1 - d) * gain if n else 0.0
            loss = d * max(-move, 0.0) + (1 - d) * loss if n else 0.0
            n, last = n + 1, close
            rsi = None if n < rsi_n or (loss == 0 and gain == 0) else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            out.append((key[0], ts, float(ema), rsi))
        state.update((n, float(last), float(ema), float(gain), float(loss)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "ema", "rsi"])

    return bars_.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, ts timestamp, ema double, rsi double", "n bigint, last double, ema double, gain double, loss double", "append", GroupStateTimeout.NoTimeout
    )


def stale_symbols(bars_: DataFrame, limit_seconds: int, late: str = "1 hour") -> DataFrame:
    """Emit a symbol when the watermark is ``limit_seconds`` past its last bar."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"))], columns=["symbol", "last_ts"])
            return
        newest = max(int(f["ts"].max().timestamp() * 1000) for f in frames)
        newest = max(newest, state.get[0] if state.exists else 0)
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + limit_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["symbol", "last_ts"])

    return bars_.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(
        step, "symbol string, last_ts timestamp", "last_ms bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def pending_bars(decisions: DataFrame, bars_: DataFrame, horizon_days: int = 30, late: str = "2 days") -> DataFrame:
    """Decision x following bars as a stream-stream interval join.

    The equi-key carries the calendar month besides the symbol, so the join state of a hot symbol is
    spread over tasks; a decision is registered in every month its horizon touches.
    """
    d = decisions.selectExpr("symbol AS d_symbol", "ts AS d_ts", "stop", "target", f"explode(sequence(trunc(ts, 'MM'), trunc(ts + INTERVAL {horizon_days} DAYS, 'MM'), INTERVAL 1 MONTH)) AS d_month")
    b = bars_.selectExpr("symbol", "ts", "high", "low", "trunc(ts, 'MM') AS month")
    return d.withWatermark("d_ts", late).join(
        b.withWatermark("ts", late), F.expr(f"symbol = d_symbol AND month = d_month AND ts > d_ts AND ts <= d_ts + INTERVAL {horizon_days} DAYS")
    ).select("symbol", "d_ts", "ts", "stop", "target", "high", "low")


def resolve_side(side: str, o: dict | None, path: list[list[float]]) -> tuple[dict | None, bool]:
    """One side of a decision on its bars [high, low], and whether later bars can change nothing: a side that has met all its rungs still gains
    its best and worst, and a later stop."""
    if not o or o.get("entry") is None or o.get("stop") is None or o["entry"] == o["stop"]:
        return None, True
    sg, entry, risk = (1 if side == "long" else -1), o["entry"], abs(o["entry"] - o["stop"])
    rungs = [(p, q) for p, q in zip(o.get("rungs") or [], o.get("rrs") or []) if p is not None and q is not None][:3]
    if not rungs:
        if o.get("target") is None:
            return None, True
        rungs = [(o["target"], abs(o["target"] - entry) / risk)]
    filled, stopped, hit, mfe, mae = o.get("entry_type") == "market", False, [False] * len(rungs), 0.0, 0.0
    for high, low in path:
        fav, adv = (high - entry, entry - low) if sg == 1 else (entry - low, high - entry)
        filled = filled or adv >= 0
        if not filled:
            continue
        mfe, mae = max(mfe, fav / risk), max(mae, adv / risk)
        if adv >= risk:
            stopped = True
            break
        hit = [h or fav >= sg * (p - entry) for h, (p, _) in zip(hit, rungs)]
    paid = sum(q for h, (_, q) in zip(hit, rungs) if h) / len(rungs) - (1 - sum(hit) / len(rungs) if stopped else 0) - (o.get("cost_r") or 0.0)
    outcome = "non_fill" if not filled else "sl" if stopped else "tp" if any(hit) else "time"
    found = {"outcome": outcome, "realized_r": paid if filled else 0.0, "n_hit": sum(hit), "mfe_r": mfe, "mae_r": mae, "time_exit": filled and not stopped and not all(hit)}
    return found, stopped


_LEG = "outcome string, realized_r double, n_hit int, mfe_r double, mae_r double, time_exit boolean"
RESOLVED = "symbol string, ms bigint, direction string, outcome string, r double, " + ", ".join(f"cf_{s} struct<{_LEG.replace(' ', ':').replace(',:', ',')}>" for s in ("long", "short"))


def decision_resolution(decisions: DataFrame, bars_: DataFrame, horizon: int = 20, horizon_days: int = 120, late: str = "2 days") -> DataFrame:
    """Open decisions resolved as their bars arrive: what operators.decisions.resolve_decisions gives, once per decision.

    State is kept per (symbol, month of decision), and a bar goes to each month whose decisions may still be open, so a hot symbol is
    many keys and each holds a month's decisions and the bars that they can see. Only bars that the watermark has passed count:
    nothing can come before them any more, so any order or repetition of input gives the same rows. A decision closes when both of its
    sides have met their stop, after ``horizon`` bars, or when its timer fires ``horizon_days`` after it.

    ``decisions``: symbol, ts, direction, long, short; one for each symbol and time. ``bars_``: symbol, ts, high, low.
    """
    day = 86_400_000
    d = decisions.selectExpr("symbol", "ts", "trunc(ts, 'MM') AS month", "to_json(struct(direction, long, short)) AS decision", "cast(null AS double) AS high", "cast(null AS double) AS low")
    months = f"explode(sequence(trunc(ts - INTERVAL {horizon_days} DAYS, 'MM'), trunc(ts, 'MM'), INTERVAL 1 MONTH)) AS month"
    b = bars_.selectExpr("symbol", "ts", months, "cast(null AS string) AS decision", "high", "low")
    rows = d.unionByName(b).withWatermark("ts", late).selectExpr("symbol", "unix_millis(cast(month AS timestamp)) AS month", "ts", "unix_millis(ts) AS ms", "decision", "high", "low")

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = json.loads(state.get[0]) if state.exists else {"open": {}, "done": [], "bars": {}}
        held, done, seen = book["open"], set(book["done"]), book["bars"]
        for f in () if state.hasTimedOut else frames:
            for ms, decision, high, low in zip(f["ms"].tolist(), f["decision"], f["high"].tolist(), f["low"].tolist()):
                if decision is None:
                    seen.setdefault(str(ms), [high, low])
                elif ms not in done:
                    held.setdefault(str(ms), json.loads(decision))
        now = state.getCurrentWatermarkMs()
        passed = sorted(int(ms) for ms in seen if int(ms) <= now)
        out = []
        for name, one in list(held.items()):
            at, end = int(name), int(name) + horizon_days * day
            path = [seen[str(ms)] for ms in passed if at < ms <= end][:horizon]
            legs = {s: resolve_side(s, one.get(s), path) for s in ("long", "short")}
            if len(path) < horizon and now < end and not (path and legs["long"][1] and legs["short"][1]):
                continue
            cf = {s: legs[s][0] if path else None for s in legs}
            side = one.get("direction") or "flat"
            if side == "flat" or cf[side]:
                out.append((key[0], at, side, "flat" if side == "flat" else cf[side]["outcome"], 0.0 if side == "flat" else cf[side]["realized_r"], cf["long"], cf["short"]))
            del held[name]
            done.add(at)
        # decisions of this month can be new until the watermark leaves it
        over = max(int(key[1]) + 31 * day, max((int(n) + horizon_days * day for n in held), default=0))
        if now >= over:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps({"open": held, "done": sorted(done), "bars": seen}),))
            pending = [int(ms) for ms in seen if int(ms) > now] if held else []
            state.setTimeoutTimestamp(max(now + 1, min([*pending, over])))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ms", "direction", "outcome", "r", "cf_long", "cf_short"])

    found = rows.groupBy("symbol", "month").applyInPandasWithState(step, RESOLVED, "book string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.selectExpr("symbol", "timestamp_millis(ms) AS ts", "direction", "outcome", "r", "cf_long", "cf_short")


def _table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def keyed_sink(path: str, keys: list[str], ts: str, name: str = "stream"):
    """foreachBatch sink of a table with each key once, in ``path``/data by day of ``ts``, which belongs to the key.

    ``path``/ledger/<name>-<batch> is written after a batch's rows, with its days: a batch that stands there is not written again. A batch that
    does not, because it is new or the writer was lost between rows and ledger, is compared with the table's keys of its own days
    only, so a batch costs what it touches, however long the table is.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = f"{path}/ledger/{name}-{batch_id}"
        if _table(spark, mark, "text") is not None:
            return
        rows = batch.dropDuplicates(keys).withColumn("_day", F.to_date(ts)).persist()
        try:
            days = rows.groupBy("_day").count()
            span = days.agg(F.min("_day"), F.max("_day"), F.count("*")).first()
            there = _table(spark, f"{path}/data")
            if there is not None:
                # partitions are pruned by the span at once and by the days when they are known
                there = there.where(F.col("_day").between(span[0], span[1])).join(F.broadcast(days.select("_day")), "_day", "left_semi")
                rows_ = rows.join(there.select(*keys), keys, "left_anti")
            else:
                rows_ = rows
            rows_.write.mode("append").partitionBy("_day").parquet(f"{path}/data")
            days.coalesce(1).write.mode("overwrite").json(mark)
        finally:
            rows.unpersist()

    return sink
