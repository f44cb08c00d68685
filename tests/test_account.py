"""The account engine on hand-made ticks."""

import pandas as pd
import pytest

from tickloom.operators import account as A

T = pd.Timestamp("2024-01-01 01:00")
H = pd.Timedelta(hours=1)


def opened(side="long", price=100.0, **kw):
    a = A.Account()
    assert a.signal(T, "B", side, price, kw.get("stop_pct", 0.02), kw.get("reward", 2.0), 0.6, kw.get("risk_pct", 0.005), kw.get("kind", "range"))
    return a


def test_sizes_fees_and_a_stop():
    a = opened()
    p = a.open["B"]
    assert p["entry"] == pytest.approx(100.02) and p["quantity"] == pytest.approx(10_000 * 0.005 / (100.02 * 0.02))
    assert a.balance == pytest.approx(10_000 - p["fees"]) and not a.signal(T, "B", "long", 100, 0.02, 2, 0.6, 0.005, "range")
    a.tick(T + H, "B", 97.0)
    (t,) = a.trades
    assert t[7] == "SL" and t[11] < -50 and a.balance == pytest.approx(10_000 + t[11]) and not a.open


def test_margin_and_number_of_positions_bound_what_opens():
    a = A.Account()
    opened = [a.signal(T, s, "long", 100.0, 0.001, 2, 0.6, 0.05, "range") for s in "ABCDEFG"]
    assert sum(opened) <= A.MOST_OPEN and a.margin() <= a.equity() * A.MARGIN_SHARE * 1.01
    b = A.Account()
    assert [b.signal(T, s, "long", 100.0, 0.02, 2, 0.6, 0.0001, "range") for s in "ABCDEF"] == [True] * 5 + [False]


def test_funding_is_settled_every_eight_hours():
    a = opened()
    before = a.balance
    a.tick(T + H, "B", 100.0)
    assert a.balance == before
    a.tick(T + 16 * H, "B", 100.0)  # 08:00 and 16:00
    q = a.open["B"]["quantity"]
    assert a.balance == pytest.approx(before - 2 * q * 100 * A.FUNDING_RATE)
    b = opened("short")
    before = b.balance
    b.tick(T + 8 * H, "B", 100.0)
    assert b.balance > before


def test_targets_time_and_equity_points():
    a = opened()
    a.tick(T + H, "B", 104.2)
    assert a.trades[0][7] == "TP" and a.trades[0][11] > 90
    b = opened()
    b.tick(T + 73 * H, "B", 100.5)
    assert b.trades[0][7] == "TIME"
    for _ in range(3):
        b.point(T)
    assert len(b.points) == 1


def test_accounts_are_replayed_apart(spark):
    rows = []
    for acc in (1, 2):
        for k, price in enumerate([100.0, 101.0, 104.5, 90.0]):
            rows.append((acc, (T + k * H).to_pydatetime(), k, "B", price, "long" if k == 0 else None, 0.02, 2.0, 0.6, 0.005, "range"))
    df = spark.createDataFrame(rows, "account long, ts timestamp, seq long, symbol string, price double, side string, stop_pct double, reward double, win_rate double, risk_pct double, kind string")
    got = A.account_replay(df.repartition(3)).collect()
    assert len(got) == 2 and got[0][1:] == got[1][1:] and got[0].reason == "TP"
    assert A.account_replay(df.where("side is null")).isEmpty()
    s = A.account_summary(A.account_replay(df)).first()
    assert s.n == 1 and s.win_rate == 1 and s.profit_factor is None and s.sharpe is None and s["return"] > 0


def test_accounts_are_replayed_many_in_a_call(spark, monkeypatch):
    """Accounts of a call have states of their own, and ticks of symbols without a position aren't looked at."""
    from tickloom.operators import stateful as S

    rows = [(acc, (T + k * H).to_pydatetime(), k, "AB"[(k + acc) % 2], 100.0 + (k * acc) % 7, "long" if k % 5 == 0 else None, 0.02, 1.5, 0.6, 0.005, "range") for acc in range(1, 30) for k in range(40)]
    df = spark.createDataFrame(rows, "account long, ts timestamp, seq long, symbol string, price double, side string, stop_pct double, reward double, win_rate double, risk_pct double, kind string")
    want = []
    for acc in range(1, 30):
        a = A.Account()
        for r in rows:
            if r[0] == acc:
                ts = T + r[2] * H
                a.tick(ts, r[3], r[4])
                if r[5]:
                    a.signal(ts, r[3], r[5], r[4], *r[6:])
        want += [(acc, t[0], t[7], round(t[11], 6), round(t[14], 6)) for t in a.trades]
    for most in (1 << 17, 100):
        monkeypatch.setattr(S, "ROWS", most)
        got = [(r.account, r.symbol, r.reason, r.realized, r.balance) for r in A.account_replay(df).collect()]
        assert len(got) == len(want) > 29
        assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)] and [g[3] for g in sorted(got)] == pytest.approx([w[3] for w in sorted(want)], abs=2e-6)
