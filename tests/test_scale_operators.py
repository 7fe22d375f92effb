"""Expanding ranks in blocks, the keyed stream sink and its ledger, and the latest regimes from the newest rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tideline.operators import panel as P
from tideline.operators import ranking as K
from tideline.operators import regime as R
from tideline.streaming import jobs as J

DAY = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize("values", ["spread", "few", "one", "rising", "falling"])
def test_expanding_percentile_against_counting(spark, monkeypatch, values):
    monkeypatch.setattr(P, "CHUNK", 32)
    rng = np.random.default_rng(1)
    rows = []
    for symbol, n in (("A", 700), ("B", 33), ("C", 1)):
        x = {"spread": rng.normal(size=n).round(3), "few": rng.integers(0, 4, n).astype(float), "one": np.full(n, 5.0), "rising": np.arange(n) * 1.0, "falling": -np.arange(n) * 1.0}[values]
        rows += [(symbol, DAY + dt.timedelta(days=7 * i), float(v)) for i, v in enumerate(x)]
    rows.append(("A", DAY + dt.timedelta(days=3), None))
    got = {(r.symbol, r.ts): r.percentile for r in K.expanding_percentile(spark.createDataFrame(rows, "symbol string, ts timestamp, volume double"), "volume").collect()}
    want = {}
    for symbol in "ABC":
        seen = []
        for s, ts, v in rows:
            if s == symbol and v is not None:
                seen.append(v)
                want[s, ts] = 100 * sum(u <= v for u in seen) / len(seen)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_no_window_of_the_expanding_percentile_covers_a_symbol(spark):
    d = spark.createDataFrame([("A", DAY, 1.0)], "symbol string, ts timestamp, volume double")
    plan = K.expanding_percentile(d, "volume")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "collect_list" in line]
    assert len(windows) == 2 and all("[symbol#" in w and (", c#" in w or ", b#" in w) for w in windows)


KEYED = "symbol string, ts timestamp, x int"


def batch(spark, days, x):
    return spark.createDataFrame([("A", DAY + dt.timedelta(days=d), x) for d in days], KEYED)


def table(spark, path):
    return sorted((r.ts, r.x) for r in spark.read.parquet(f"{path}/data").collect())


def test_sink_writes_each_key_once_and_knows_finished_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = J.keyed_sink(path, ["symbol", "ts"], "ts")
    sink(batch(spark, [0, 1, 1], 1), 0)
    sink(batch(spark, [1, 2], 2), 1)
    first = table(spark, path)
    assert [x for _, x in first] == [1, 1, 2]
    # a finished batch is not looked at again, even with other rows; an empty one leaves its mark
    sink(batch(spark, [9], 7), 1)
    sink(batch(spark, [], 7), 2)
    sink(batch(spark, [9], 7), 2)
    assert table(spark, path) == first
    # another stream into the same table has batches of its own
    J.keyed_sink(path, ["symbol", "ts"], "ts", "other")(batch(spark, [2, 3], 5), 0)
    assert [x for _, x in table(spark, path)] == [1, 1, 2, 5]


def test_crash_between_rows_and_ledger(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    path = str(tmp_path / "t")
    sink = J.keyed_sink(path, ["symbol", "ts"], "ts")
    sink(batch(spark, [0], 1), 0)

    def lost(self, *_a, **_k):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "json", lost)
        with pytest.raises(RuntimeError):
            sink(batch(spark, [1, 2], 2), 1)
    assert len(table(spark, path)) == 3
    sink(batch(spark, [1, 2], 2), 1)
    assert [x for _, x in table(spark, path)] == [1, 2, 2]
    assert spark.read.text(f"{path}/ledger/stream-1").count() == 2


def test_batch_of_old_and_new_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = J.keyed_sink(path, ["symbol", "ts"], "ts")
    sink(batch(spark, range(60), 1), 0)
    sink(batch(spark, [35, 36, 37, 70], 3), 1)
    got = table(spark, path)
    assert len(got) == 61 and sum(x == 3 for _, x in got) == 1


def test_latest_regimes_need_the_newest_rows_only(spark):
    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("A", 900), ("B", 250), ("C", 12)):
        close = 100 + np.cumsum(rng.normal(size=n))
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2019-01-01", periods=n).date, "open": close, "high": close + rng.random(n), "low": close - rng.random(n), "close": close, "volume": 1.0}))
    bars = spark.createDataFrame(pd.concat(frames))
    whole = {r.symbol: r for r in P.latest(R.regimes(bars)).collect()}
    for r in R.multi_timeframe(bars).where("timeframe = 'D'").collect():
        w = whole[r.symbol]
        for c in ("regime", "rn"):
            assert r[c] == w[c]
        for c in ("adx", "price_vs_200sma", "slope_pct_20", "atr_ratio"):
            assert r[c] == w[c] or r[c] == pytest.approx(w[c], abs=1e-9)
