"""Resolution of recorded decisions: worked cases, and the stream against the batch under any order of its input."""

import datetime as dt
import random

import pytest

from tideline.operators import decisions as C
from tideline.streaming import jobs as J

DECISION = f"symbol string, rn bigint, ts timestamp, direction string, long {C.SIDE}, short {C.SIDE}"
BAR = "symbol string, rn bigint, ts timestamp, high double, low double"
START = dt.datetime(2024, 1, 1)
LONG = (100.0, 99.0, 101.0, 0.01, "limit", [101.0, 102.0, 103.0], [1.0, 2.0, 3.0])
SHORT = (100.0, 101.0, 99.0, 0.01, "limit", [99.0, 98.0, 97.0], [1.0, 2.0, 3.0])
MARKET, SINGLE, NONE = (*LONG[:4], "market", *LONG[5:]), (*LONG[:5], [], None), (None, *LONG[1:])

# (bars as high, low after the decision) -> side, its order, outcome, R
CASES = [
    ([(101.5, 99.5), (102.5, 101.0), (103.5, 102.0)], "long", LONG, "tp", 1.99),
    ([(100.5, 98.5)], "long", LONG, "sl", -1.01),
    ([(101.5, 99.5), (100.0, 98.0)], "long", LONG, "sl", 1 / 3 - 2 / 3 - 0.01),
    ([(100.5, 99.5)] * 5, "long", LONG, "time", -0.01),
    ([(101.5, 98.5)], "long", LONG, "sl", -1.01),
    ([(100.5, 98.5), (99.0, 97.0), (98.0, 96.0)], "short", SHORT, "tp", 1.99),
    ([(110.0, 105.0)] * 3, "long", LONG, "non_fill", 0.0),
    ([(90.0, 85.0)] * 3, "short", SHORT, "non_fill", 0.0),
    ([(110.0, 105.0), (101.5, 99.5), (102.5, 101.0), (103.5, 102.0)], "long", LONG, "tp", 1.99),
    ([(110.0, 105.0)] * 3, "long", MARKET, "tp", 1.99),
    ([(101.5, 99.5)], "long", SINGLE, "tp", 0.99),
    ([(100.5, 99.5)] * 20 + [(90.0, 80.0)], "long", LONG, "time", -0.01),
]


def frames(spark, cases):
    decisions, bars = [], []
    for n, (path, side, order, *_) in enumerate(cases):
        legs = (order, SHORT) if side == "long" else (LONG, order)
        decisions.append((f"s{n}", 1, START, side, *legs))
        bars += [(f"s{n}", i + 1, START + dt.timedelta(days=i), h, lo) for i, (h, lo) in enumerate([(100.0, 100.0), *path])]
    return spark.createDataFrame(decisions, DECISION), spark.createDataFrame(bars, BAR)


def test_worked_cases(spark):
    d, b = frames(spark, CASES)
    got = {r.symbol: r for r in C.resolve_decisions(d, b).collect()}
    for n, (path, side, order, outcome, r) in enumerate(CASES):
        row = got[f"s{n}"]
        assert row.outcome == outcome and row.r == pytest.approx(r), n
        assert row[f"cf_{side}"].realized_r == row.r
        leg, _ = J.resolve_side(side, dict(zip(("entry", "stop", "target", "cost_r", "entry_type", "rungs", "rrs"), order)), [list(x) for x in path[:20]])
        assert leg["outcome"] == outcome and leg["realized_r"] == pytest.approx(r)


def test_best_and_worst_include_the_stop_bar(spark):
    d, b = frames(spark, CASES)
    got = {r.symbol: r for r in C.resolve_decisions(d, b).collect()}
    assert got["s0"].cf_long.mfe_r == pytest.approx(3.5) and got["s0"].cf_long.mae_r == pytest.approx(0.5)
    assert got["s5"].cf_short.mfe_r == pytest.approx(4.0) and got["s1"].cf_long.mae_r == pytest.approx(1.5)


def test_flat_keeps_both_counterfactuals_and_levels_may_be_missing(spark):
    d, b = frames(spark, [(CASES[0][0], "long", LONG)] * 5)
    rows = [
        ("s0", 1, START, "flat", LONG, SHORT), ("s1", 1, START, None, LONG, None), ("s2", 1, START, "long", NONE, SHORT),
        ("s3", 1, START, "long", (100.0, 100.0, 101.0, None, None, None, None), SHORT), ("nobars", 1, START, "long", LONG, SHORT), ("nobars", 2, START, "flat", LONG, SHORT),
    ]
    got = {(r.symbol, r.rn): r for r in C.resolve_decisions(spark.createDataFrame(rows, DECISION), b).collect()}
    assert set(got) == {("s0", 1), ("s1", 1), ("nobars", 2)}
    assert got["s0", 1].outcome == "flat" and got["s0", 1].r == 0 and got["s0", 1].cf_long.realized_r == pytest.approx(1.99) and got["s0", 1].cf_short.outcome == "sl"
    assert got["s1", 1].direction == "flat" and got["s1", 1].cf_short is None
    assert got["nobars", 2].cf_long is None
    assert C.resolve_decisions(d.limit(0), b).count() == 0


def walk(rng, days):
    at, out = 100.0, []
    for i in range(days):
        at += rng.choice([-0.5, 0.0, 0.5])
        out.append((i, at + rng.choice([0.25, 0.5, 1.0]), at - rng.choice([0.25, 0.5, 1.0]), at))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_under_any_cut_order_and_repetition(spark, tmp_path, seed):
    rng = random.Random(seed)
    bars, decisions = [], []
    for s in ("A", "B"):
        path = walk(rng, 70)
        bars += [(s, i, START + dt.timedelta(days=i), h, lo) for i, h, lo, _ in path]
        for i, _, _, c in path[:60:2]:
            e = rng.choice([0.0, 0.25])
            leg = lambda g, e=e, c=c: (c - g * e, c - g * 1.5, c + g, 0.05, rng.choice(["limit", "market"]), [c + g * k for k in (1, 2, 3)], [1.0, 2.0, 3.0])
            decisions.append((s, i, START + dt.timedelta(days=i), rng.choice(["long", "short", "flat", None]), leg(1), leg(-1)))
    want = sorted(tuple(r) for r in C.resolve_decisions(spark.createDataFrame(decisions, DECISION), spark.createDataFrame(bars, BAR)).select("symbol", "ts", "direction", "outcome", "r", "cf_long", "cf_short").collect())
    # pieces in random order, some of them twice; a last bar moves the watermark past everything
    for name, rows, schema in (("d", decisions, DECISION), ("b", bars, BAR)):
        rng.shuffle(rows)
        cuts = [rows[i::4] for i in range(4)]
        cuts += [cuts[1], cuts[2]]
        if name == "b":
            cuts.append([("Z", 0, START + dt.timedelta(days=900), 1.0, 1.0)])
        for part in cuts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    stream = J.decision_resolution(read("d", DECISION), read("b", BAR), late="400 days")
    got = sorted(tuple(r) for r in J.run_available(stream, "resolution").collect())
    assert len(got) == len(want) == len(decisions)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4])
        for a, b in zip(g[5:], w[5:]):
            assert a.outcome == b.outcome and a.n_hit == b.n_hit and a.time_exit == b.time_exit and a.realized_r == pytest.approx(b.realized_r) and a.mfe_r == pytest.approx(b.mfe_r) and a.mae_r == pytest.approx(b.mae_r)


def test_timer_closes_a_decision_without_enough_bars(spark, tmp_path):
    d, b = frames(spark, [([(100.5, 99.5)] * 3, "long", LONG), ([(110.0, 105.0)], "long", LONG)])
    late = spark.createDataFrame([("Z", 1, START + dt.timedelta(days=200), 1.0, 1.0)], BAR)
    d.write.parquet(f"{tmp_path}/d")
    b.union(late).write.parquet(f"{tmp_path}/b")
    stream = J.decision_resolution(spark.readStream.schema(DECISION).parquet(f"{tmp_path}/d"), spark.readStream.schema(BAR).parquet(f"{tmp_path}/b"), horizon_days=60)
    got = {r.symbol: (r.outcome, round(r.r, 4)) for r in J.run_available(stream, "timer").collect()}
    assert got == {"s0": ("time", -0.01), "s1": ("non_fill", 0.0)}


@pytest.mark.parametrize("after", [(105.0, 103.0), (104.0, 98.0)])
def test_a_side_with_all_rungs_waits_for_its_horizon(spark, tmp_path, after):
    # the short side is stopped at once and the long side has all rungs on the third bar; a later bar changes its best, or its outcome
    bars = [("s0", i, START + dt.timedelta(days=i), h, lo) for i, (h, lo) in enumerate([(100.0, 100.0), *CASES[0][0], *[(103.0, 102.0)] * 4, after, *[(103.0, 102.0)] * 15])]
    d = spark.createDataFrame([("s0", 0, START, "long", LONG, SHORT)], DECISION)
    want = C.resolve_decisions(d, spark.createDataFrame(bars, BAR)).first()
    assert want.cf_long.outcome == ("tp" if after[1] > 99 else "sl") and want.cf_long.n_hit == 3
    d.coalesce(1).write.parquet(f"{tmp_path}/d")
    # between the parts the watermark passes the third bar only
    for part in (bars[:7], bars[7:] + [("Z", 0, START + dt.timedelta(days=40), 1.0, 1.0)]):
        spark.createDataFrame(part, BAR).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    got = J.run_available(J.decision_resolution(read("d", DECISION), read("b", BAR)), "rungs").collect()
    assert [(r.outcome, r.cf_long, r.cf_short) for r in got] == [(want.outcome, want.cf_long, want.cf_short)]
