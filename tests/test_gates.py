"""Promotion gates: statistics against direct computation, and what a missing statistic does."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tideline.operators import decisions as C

CLUSTERS, ROW = "array(substr(symbol, 1, 1), substr(symbol, 2, 1))", "bigint(k)"


def make(seed=4, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        family = str(rng.choice(["good", "bad", "one"], p=[0.5, 0.4, 0.1]))
        r = {"good": 0.5, "bad": -0.2, "one": 0.1}[family] + rng.normal()
        symbol = "AB" if family == "one" else str(rng.choice(["AB", "CD", "EF", "GH"]))
        rows.append((k, family, symbol, str(rng.choice(["up", "down", "flat"])), dt.date(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 700))), None if k % 97 == 0 else round(float(r), 3)))
    # one trade a day, symbol and family, as a record is
    return pd.DataFrame(rows, columns=["k", "family", "symbol", "regime", "date", "taken_r"]).drop_duplicates(["family", "symbol", "date"])


def direct(d):
    out = {}
    total = d.groupby("date").taken_r.sum()
    for family, f in d.groupby("family"):
        first, span = f.date.min(), (f.date.max() - f.date.min()).days
        folds = defaultdict(list)
        for date, r in zip(f.date, f.taken_r):
            folds[5 * (date - first).days // (span + 1)].append(r)
        without = d.assign(taken_r=d.taken_r.where(d.family != family, 0.0)).groupby("date").taken_r.sum()
        walk = f.dropna().sort_values(["date", "symbol"]).taken_r.cumsum()
        out[family] = {
            "n_positive_folds": sum(np.nanmean(x) > 0 for x in folds.values()), "n_symbols": f.symbol.nunique(),
            "worst_without_symbol": min((f.taken_r[f.symbol != s].mean() for s in f.symbol.unique()), key=lambda x: (np.isnan(x), x)),
            "max_symbol_share": f.symbol.value_counts(normalize=True).max(), "sharpe_all": total.mean() / total.std(ddof=0), "sharpe_without": without.mean() / without.std(ddof=0),
            "max_dd": (walk - walk.cummax().clip(lower=0)).min(), "n_regimes": (f.groupby("regime").taken_r.mean() > 0).sum(),
        }
    return out


def test_statistics_against_direct_computation(spark):
    d = make()
    got = {r.family: r.asDict() for r in C.gate_statistics(spark.createDataFrame(d.astype({"taken_r": object}).where(d.notna(), None)), CLUSTERS, ROW, reps=400).collect()}
    for family, want in direct(d).items():
        for name, value in want.items():
            have = got[family][name]
            assert (have is None and np.isnan(value)) or have == pytest.approx(value, abs=1e-9), (family, name)
        x = d.taken_r[d.family == family].dropna().to_numpy()
        # resampling: near the normal interval and the normal p value
        half = 1.96 * x.std() / np.sqrt(len(x))
        assert got[family]["ci_lower"] == pytest.approx(x.mean() - half, abs=0.4 * half)
    assert got["good"]["p_flip"] < 0.01 and got["bad"]["p_flip"] > 0.9


def test_levels_and_scoreboard(spark):
    stats = C.gate_statistics(spark.createDataFrame(make().dropna()), CLUSTERS, ROW, reps=400).cache()
    got = {r.family: r for r in C.promotion(stats).collect()}
    assert {"loso", "concentration_limits"} <= set(got["one"].failed) and got["one"].level == "L2"
    assert {"cost_robustness", "permutation_test", "bootstrap_ci"} <= set(got["bad"].failed)
    assert not {"walk_forward", "permutation_test", "bootstrap_ci", "loso", "portfolio_contribution"} & set(got["good"].failed)
    board = {r.gate: r for r in C.scoreboard(stats).collect()}
    assert list(C.GATES) == [r.gate for r in sorted(board.values(), key=lambda r: r.gate_no)]
    for r in board.values():
        assert r.n_pass + r.n_fail + r.n_unresolved == 3
    # nothing is left of `one` without its symbol: the comparison of symbols decides
    assert board["loso"].n_fail >= 1 and board["loso"].status == "FAIL"


def test_a_missing_statistic_fails_its_gate_only(spark):
    full = {"n_days": 99, "span_days": 400, "n_positive_folds": 5, "mean_r": 0.5, "p_flip": 0.01, "ci_lower": 0.2, "n_symbols": 4, "worst_without_symbol": 0.3, "n_regimes": 3, "max_symbol_share": 0.3, "max_cluster_share": 0.5, "sharpe_all": 0.3, "sharpe_without": 0.1, "max_dd": -3.0}
    of = {"n_days": "min_effective_n", "p_flip": "permutation_test", "ci_lower": "bootstrap_ci", "max_dd": "drawdown_limits", "sharpe_without": "portfolio_contribution", "worst_without_symbol": "loso", "n_positive_folds": "walk_forward"}
    rows = [{"family": "full", **full}] + [{"family": name, **full, name: None} for name in of]
    schema = "family string, " + ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in full.items())
    got = {r.family: r for r in C.promotion(spark.createDataFrame(rows, schema)).collect()}
    assert got["full"].level == "L3" and list(got["full"].failed) == []
    for name, gate in of.items():
        assert list(got[name].failed) == [gate] and got[name].level == ("L0" if name == "n_days" else "L2")
