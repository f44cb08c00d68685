"""Promotion, versions and explanations."""

import pytest

from tickloom.operators import review as R


def test_promotion_needs_trades_and_gains():
    old, new = R.Metrics(12, 0.5, 0.1), R.Metrics(12, 0.6, 0.2)
    assert R.blockers(60, old, new) == [] and R.status(60, 20, []) == "promotable"
    assert R.blockers(40, old, new) == ["minimum_promotion_trades"] and R.status(40, 20, ["x"]) == "shadow_candidate" and R.status(10, 20, []) == "insufficient_data"
    assert R.blockers(60, old, R.Metrics(5, 0.52, 0.1)) == ["minimum_validation_trades", "accuracy_gain", "margin_gain"]


def test_weights_are_applied_and_rolled_back():
    w = R.Weights(1, {"a": 0.5, "b": 0.5})
    v = R.applied(w, {"a": 0.9, "b": 0.1}, [])
    assert v.version == 2 and v.active == pytest.approx({"a": 0.875, "b": 0.125}) and v.previous == w.active
    back = R.rolled_back(v)
    assert back.active == w.active and back.version == 3 and R.rolled_back(back).active == v.active
    for call in (lambda: R.applied(w, {"a": 1.0, "b": 0.1}, ["x"]), lambda: R.applied(w, {"a": 1.0}, []), lambda: R.rolled_back(w)):
        with pytest.raises(ValueError):
            call()


def test_trades_are_explained(spark):
    rows = [(1, "long", 10.0, 8.0, 4.0, "TP", {"a": 0.5, "b": -0.1}), (2, "short", 1.0, -1.0, 4.0, "TP", {"a": -0.5}), (3, "long", -9.0, -10.0, 5.0, "SL", {"a": 0.9}), (4, "long", -9.0, -10.0, 0.0, "TIME", {})]
    df = spark.createDataFrame(rows, "id int, side string, gross double, net double, risk double, reason string, signals map<string,double>")
    got = {r.id: r for r in R.explain(df, {"a": 0.6, "b": 0.4}).collect()}
    assert [got[k]["class"] for k in (1, 2, 3, 4)] == ["profitable", "cost_drag", "stop_loss", "direction_or_timing_error"]
    assert got[1].net_r == 2 and got[1].right and got[1].strongest[0].factor == "a" and got[2].right and not got[3].right and got[4].net_r == 0
