"""Pricing of candidate sides and the verdict between them, on worked cases."""

import pytest

from tideline.operators import decisions as C

SIDES = "symbol string, ts int, side string, close double, atr double, family string, prob double, confirmed boolean, engine_score int, entry double, stop double, target double, ladder array<double>, gate boolean, spread double, slip double"
TABLES = "side string, family string, tp1 double, tp2 double, tp3 double, sl double"
BASE = {"symbol": "X", "ts": 1, "close": 110.0, "atr": 4.0, "prob": 0.6, "confirmed": False, "engine_score": 0, "gate": True, "spread": None, "slip": None}
LONG = {**BASE, "side": "long", "family": "LONG_BUY_DIP", "entry": 100.0, "stop": 98.0, "target": 104.0, "ladder": [102.0, 104.0, 106.0]}
SHORT = {**BASE, "side": "short", "family": "SHORT_BREAKDOWN", "entry": 120.0, "stop": 122.0, "target": 116.0, "ladder": [118.0, 116.0, 114.0]}
GOOD, BAD = (0.3, 0.2, 0.2, 0.3), (0.1, 0.05, 0.05, 0.8)
PROBS = [("long", None, *GOOD), ("short", None, *BAD)]


def price(spark, sides, tables=PROBS, min_rr=2.5):
    rows = [tuple(s[c.split()[0]] for c in SIDES.split(", ")) for s in sides]
    return C.price_sides(spark.createDataFrame(rows, SIDES), spark.createDataFrame(tables, TABLES), min_rr)


def verdict(spark, *sides, tables=PROBS, min_ev=0.2):
    return C.opportunity_book(price(spark, sides, tables), min_ev).first()


def test_expected_values_of_the_scaling_out_plan(spark):
    r = price(spark, [LONG]).first()
    # rungs of 1, 2 and 3 R; a third leaves at each
    assert r.entry_type == "limit" and list(r.rrs) == [1, 2, 3] and r.cost_r == C.DEFAULT_COST
    assert r.ev_alloc == pytest.approx(0.3 / 3 + 0.2 * 3 / 3 + 0.2 * 6 / 3 - 0.3 - 0.05)
    assert r.ev_target == pytest.approx(0.3 + 0.4 + 0.6 - 0.3 - 0.05)
    assert r.cost_break_even == pytest.approx(r.ev_alloc + 0.05) and r.expected_r == pytest.approx(0.6 * 3 - 0.4 - 0.05) and r.ev == r.ev_alloc


def test_market_entries_are_priced_from_the_close(spark):
    r = price(spark, [{**LONG, "close": 100.9}]).first()
    assert r.entry_type == "market" and r.entry == 100.9 and r.best_rr == pytest.approx((106 - 100.9) / 2.9)
    assert price(spark, [{**LONG, "close": 101.1}]).first().entry_type == "limit"
    assert price(spark, [{**LONG, "close": 100.0, "atr": None}]).first().entry_type == "limit"


def test_costs_and_tables(spark):
    assert price(spark, [{**LONG, "spread": 0.2, "slip": 0.1}]).first().cost_r == pytest.approx(0.2)
    assert price(spark, [{**LONG, "spread": 0.2, "slip": 0.1, "stop": 100.0}]).first().cost_r == C.DEFAULT_COST
    own = price(spark, [LONG], [*PROBS, ("long", "LONG_BUY_DIP", 0.5, 0.1, 0.1, 0.3)]).first()
    assert own.ev_target == pytest.approx(0.5 + 0.2 + 0.3 - 0.3 - 0.05)
    # masses above one are no distribution: the ranking value is all there is
    broken = price(spark, [LONG], [("long", None, 0.5, 0.5, 0.5, 0.5)]).first()
    assert broken.ev_alloc is None and broken.ev == broken.expected_r
    short_ladder = price(spark, [{**LONG, "ladder": [104.0]}]).first()
    assert short_ladder.ev_target == pytest.approx(0.3 * 2 - 0.3 - 0.05)


def test_nothing_is_made_up(spark):
    r = price(spark, [{**LONG, "prob": None}]).first()
    assert r.ev is None and "no probability" in r.reasons and not r.blocked
    r = price(spark, [{**LONG, "target": None, "ladder": None, "family": None}], [("long", None, *GOOD)]).first()
    assert "no payoff" in r.reasons and "no family" in r.reasons and r.expected_r is None


def test_verdict_by_expected_value_and_hard_gates(spark):
    assert (verdict(spark, LONG, SHORT).direction, verdict(spark, LONG, SHORT).status) == ("long", "TRADE")
    both = [("long", None, *GOOD), ("short", None, *GOOD)]
    assert verdict(spark, LONG, SHORT, tables=both).direction == "long"
    assert verdict(spark, {**LONG, "prob": None}, SHORT, tables=both).direction == "short"
    for blocked, reason in (({"gate": False}, "macro gate"), ({"ladder": [101.0, 102.0], "target": 102.0}, "rr floor")):
        r = verdict(spark, {**LONG, **blocked}, SHORT, min_ev=-1.0)
        assert r.direction == "flat" and r.status == "FLAT" and reason in r.why_long
    r = verdict(spark, {**LONG, "prob": None}, {**SHORT, "family": "SHORT_REVERSAL"}, tables=both)
    assert r.direction == "flat" and "family falsified" in r.why_short
    assert verdict(spark, {**LONG, "gate": None}, SHORT).direction == "long"
    assert verdict(spark, LONG, SHORT, tables=[("long", None, *BAD), ("short", None, *BAD)]).direction == "flat"


def test_rule_path_without_probabilities(spark):
    bare = {"prob": None}
    one = verdict(spark, {**LONG, **bare, "confirmed": True, "engine_score": 6}, {**SHORT, **bare})
    assert (one.path, one.direction, one.status) == ("rule", "long", "CONFIRMED")
    two = verdict(spark, {**LONG, **bare, "confirmed": True, "engine_score": 6}, {**SHORT, **bare, "confirmed": True, "engine_score": 7})
    assert two.direction == "short"
    tie = verdict(spark, {**LONG, **bare, "confirmed": True, "engine_score": 6}, {**SHORT, **bare, "confirmed": True, "engine_score": 6})
    assert tie.direction == "long"
    dead = verdict(spark, {**LONG, **bare}, {**SHORT, **bare, "confirmed": True, "engine_score": 6, "family": "SHORT_REVERSAL"})
    assert dead.direction == "flat" and verdict(spark, {**LONG, **bare}, {**SHORT, **bare}).direction == "flat"
    assert verdict(spark, {**LONG, **bare, "confirmed": True, "engine_score": 6}).direction == "long"
