"""Short memories, whole tables, ranks without constant joins, models that do not look ahead, shared tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import hygiene as H
from tideline.operators import indicators as I
from tideline.operators import models as M
from tideline.operators import ranking as K
from tideline.plans import ORACLE, QUERIES
from tideline.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(4)
    days = pd.date_range("2015-01-01", periods=700).date
    rows = []
    for symbol in ("A", "B"):
        close = 1000 + np.cumsum(rng.integers(-20, 21, 700)) * 0.5
        rows.append(pd.DataFrame({"symbol": symbol, "ts": days, "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0}))
    return pd.concat(rows, ignore_index=True)


@pytest.mark.parametrize("chunk", [2048, 300])
def test_short_memories(spark, bars, chunk, monkeypatch):
    from tideline.operators import panel

    monkeypatch.setattr(panel, "CHUNK", chunk)
    c = bars.query("symbol == 'A'")["close"].reset_index(drop=True)
    got = I.ema(spark.createDataFrame(bars), spans=(1, 2, 3, 5)).where("symbol = 'A'").orderBy("rn").toPandas()
    for n in (1, 2, 3, 5):
        assert np.allclose(got[f"ema_{n}"], c.ewm(span=n, adjust=False).mean(), rtol=1e-12)
    d = c.diff()
    for n in (2, 3):
        got = I.rsi(spark.createDataFrame(bars), n).where("symbol = 'A'").orderBy("rn").toPandas()[f"rsi_{n}"].astype(float)
        gain = d.where(d > 0, 0.0).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
        loss = (-d.where(d < 0, 0.0)).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
        want = 100 - 100 / (1 + gain / loss)
        both = got.notna() & want.notna() & (loss > 1e-9)
        assert both.sum() > 600 and np.allclose(got[both], want[both], atol=1e-6)


def test_currency_pairs(spark):
    names = {"USDAED": "full_fx", "EURUSD": "full_fx", "AMDEUR": "full_fx", "AOAUSD": "full_fx", "BTCAUD": "crypto", "XRPUSD": "crypto", "XAUUSD247": "metals", "US30_x10": "indices", "USOIL": "commodities"}
    d = spark.createDataFrame([(s,) for s in names], "symbol string")
    got = {r.symbol: r.kind for r in d.selectExpr("symbol", f"{H.classify_sql('symbol RLIKE ' + chr(39) + '[0-9]' + chr(39))} AS kind").collect()}
    assert got == names


def test_whole_ranking(spark):
    rows = QUERIES["equity_ranking"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").distinct().count()
    assert sorted(r["rank"] for r in rows) == list(range(1, n + 1)) and "LIMIT" not in ORACLE["equity_ranking"]
    by = sorted(rows, key=lambda r: r["rank"])
    assert all(a["composite"] >= b["composite"] for a, b in zip(by, by[1:]))


def test_row_numbers_and_ranks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.integers(0, 40, 900).astype(float), "k": range(900), "g": rng.integers(0, 3, 900)})
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = K.row_numbers(df, ["x DESC NULLS LAST", "k"]).toPandas().sort_values("rank")
    want = pdf.sort_values(["x", "k"], ascending=[False, True], na_position="last")
    assert list(got.k) == list(want.k) and list(got["rank"]) == list(range(1, 901))
    full = df.where("x IS NOT NULL")
    ranks = K.with_avg_rank(full, [], "x", "r").toPandas().sort_values("k")
    assert np.allclose(ranks.r, pdf.dropna().x.rank())
    ic = K.rank_corr(full, ["g"], "x", "k").toPandas().set_index("g")["ic"]
    for g, part in pdf.dropna().groupby("g"):
        assert abs(ic[g] - part.x.rank().corr(part.k.rank())) < 1e-12


@pytest.mark.parametrize("name", ["filter_gate", "factor_model", "classification_metrics", "equity_ranking"])
def test_no_cross_product_without_broadcast(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan


def test_labels_of_test_days_change_no_model(spark):
    rng = np.random.default_rng(6)
    days = pd.date_range("2015-01-01", periods=500).date
    pdf = pd.DataFrame(rng.normal(size=(500, len(M.FEATURES))), columns=M.FEATURES)
    pdf["ts"], pdf["weight"], pdf["symbol"], pdf["rn"] = days, 1.0, "A", range(500)
    pdf["label"] = (pdf[M.FEATURES[0]] + 0.3 * rng.normal(size=500) > 0).astype(float)
    turned = pdf.copy()
    turned.loc[400:, "label"] = 1 - turned.loc[400:, "label"]
    split = str(days[400])
    models = [M.fit_gbt(M.chronological(spark.createDataFrame(x), split)[0], rounds=8) for x in (pdf, turned)]
    assert models[0].toDebugString.split("\n", 1)[1] == models[1].toDebugString.split("\n", 1)[1]
    test = M.chronological(spark.createDataFrame(pdf), split)[1]
    assert M.auc(M.score(models[0], test)) > 0.85


def test_shared_tables_need_no_local_folder(spark, tmp_path, monkeypatch):
    made = []

    def build():
        made.append(1)
        return spark.range(10)

    assert store.stored(spark, "numbers", SF, build).count() == 10 and store.stored(spark, "numbers", SF, build).count() == 10 and len(made) == 1
    monkeypatch.setattr(store, "shared", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(store, "_ROOT", {})
    assert store.stored(spark, "others", SF, build).count() == 10 and list(tmp_path.glob("**/*.parquet"))
