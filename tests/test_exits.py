"""Exit scores and protection on single positions."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import exits as X

POSITION = {"side": "long", "mode": "math_only", "regime": "hmm_bull", "entry": 100.0, "take_profit": 104.0, "stop_loss": 98.0, "price": 101.0, "age_hours": 2.0, "event_age_hours": None, "event_half_life": 6.0, "atr_pct": 0.012, "fee_rate": 0.0005, "slippage_rate": 0.0002, "funding_rate": 0.0001, "candidate_side": "long", "candidate_win_rate": 0.66, "candidate_direction": 0.5, "profit_protection": 0.0, "expectancy_pct": 0.01}


def score(spark, **change):
    row = POSITION | change
    kinds = ", ".join(f"{k} {'string' if k in ('side', 'mode', 'regime', 'candidate_side') else 'double'}" for k in row)
    return X.exit_scores(spark.createDataFrame([tuple(row.values())], kinds)).first()


def test_regimes_by_side(spark):
    df = spark.createDataFrame([("hmm_bull", "long"), ("hmm_bull", "short"), ("hmm_bear", "long"), ("hmm_bear", "short"), ("range", "long"), ("transition", "long"), ("trend", "short"), ("x", "long"), (None, "long")], "r string, s string")
    assert [r[0] for r in df.select(X.regime_kind(F.col("r"), F.col("s"))).collect()] == ["trend", "transition", "transition", "trend", "range", "transition", "trend", "unknown", "unknown"]


def test_healthy_positions_stay(spark):
    r = score(spark)
    assert not r.exit and r.kind == "trend" and r.threshold == 0.72 and r.confirmations == 3 and r.de_risk_fraction == 0
    assert r.max_hours == pytest.approx(18 * 1.15) and r.horizon_hours == 4 and r.time_decay == pytest.approx(2 / (18 * 1.15))


def test_exits_by_time_reversal_and_expectancy(spark):
    r = score(spark, age_hours=30.0)
    assert r.exit and r.expired and r.confirmations == 1 and r.threshold <= r.score
    r = score(spark, candidate_side="short", candidate_win_rate=0.9, candidate_direction=-0.9)
    assert r.signal_reversal == pytest.approx(0.9) and r.chance == pytest.approx(0.1) and r.negative and r.exit
    assert not score(spark, candidate_side="short", candidate_win_rate=0.9, candidate_direction=-0.9, age_hours=0.1).negative
    r = score(spark, candidate_side=None, take_profit=103.0, stop_loss=99.5, expectancy_pct=0.02)
    assert r.de_risk and r.de_risk_fraction in (0.25, 0.5)
    assert score(spark, event_age_hours=6.0).event_decay == pytest.approx(0.5)


def test_protection_ratchets_and_never_loosens():
    p = X.Protection("long", 100, 98, 104, 0.6, "range")
    assert (p.activation, p.even, p.giveback) == (pytest.approx(0.45), pytest.approx(0.85), 0.5)
    assert p.step(100.5)["stage"] == "inactive"
    a = p.step(101.2)
    assert a["stage"] == "tightening" and a["moved"] and 98 < a["stop"] < 100
    b = p.step(103.0)
    assert b["stage"] == "trailing" and b["stop"] == pytest.approx(102.0)
    c = p.step(102.4)
    assert c["stop"] == pytest.approx(102.0) and not c["moved"] and c["guard"] > 0.4
    assert p.step(101.9)["reason"] == "DYNAMIC_SL"
    assert X.Protection("long", 100, 98, 104, 0.6, "range").step(97.9)["reason"] == "SL"


def test_targets_are_extended_in_trends():
    p = X.Protection("short", 100, 102, 97, 0.6, "trend")
    a = p.step(96.9, True, -0.6, 0.6)
    assert (a["action"], a["sold"], a["stage"]) == ("partial_take_profit", 0.5, "runner") and a["target"] == pytest.approx(100 - 2 * (1.5 + 0.75))
    assert p.step(95.4)["reason"] == "TP_EXTENSION"
    assert X.Protection("short", 100, 102, 97, 0.6, "trend").step(96.9, True, -0.4, 0.6)["reason"] == "TP"
    assert X.Protection("long", 100, 98, 104, 0.6, "range", tick=0.5).step(101.2)["stop"] % 0.5 == 0


def test_replay_of_positions(spark):
    rows = [(1, "long", 100.0, 98.0, 103.0, 0.6, "trend", k, k, p, True, 0.6, 0.6) for k, p in enumerate([100.5, 103.2, 104.6, 104.9])] + [(2, "long", 100.0, 98.0, 103.0, 0.6, "range", k, k, p, False, 0.0, 0.5) for k, p in enumerate([99.0, 97.5, 120.0])] + [(3, "long", 100.0, 100.0, 103.0, 0.6, "range", 0, 0, 99.0, False, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "position_id long, side string, entry double, stop double, target double, win_rate double, kind string, ts long, seq long, price double, same_side boolean, direction double, candidate_win_rate double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {r.position_id: r for r in X.protect_replay(df).collect()}
    assert (got[1].reason, got[1].partial, got[1].n_steps) == ("TP_EXTENSION", True, 3) and got[1].realized_r == pytest.approx(0.5 * 1.6 + 0.5 * 2.3)
    assert (got[2].reason, got[2].n_steps, got[2].realized_r) == ("SL", 2, pytest.approx(-1.25)) and got[3].action == "none"
