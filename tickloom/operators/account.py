"""Paper accounts: positions are opened from signals, marked, protected, partly or wholly closed, along each account's ordered ticks.

A step depends on the account's whole state (equity, margin, open positions), so an account is replayed by one task,
replayed in Python; accounts are spread over tasks, many in a call. Nothing is ordered anywhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.exits import Protection
from tickloom.operators.stateful import by_group, in_buckets

START, FEE, SLIPPAGE, LEVERAGE, MOST_OPEN, MARGIN_SHARE = 10_000.0, 0.0005, 0.0002, 3.0, 5, 0.8
FUNDING_HOURS, FUNDING_RATE, MOST_SETTLEMENTS, LONGEST_HOURS = 8, 0.0001, 24, 72.0
#: In nanoseconds.
HOUR = 3_600_000_000_000

TRADES = "account long, symbol string, side string, opened_at timestamp, closed_at timestamp, entry double, exit double, quantity double, reason string, gross double, fees double, funding double, realized double, mfe double, mae double, balance double"


class Account:
    """The state of one account. Events in order: `tick` marks a symbol's position, `signal` may open one."""

    def __init__(self, start: float = START):
        self.balance, self.open, self.trades, self.points = start, {}, [], []

    def equity(self) -> float:
        return self.balance + sum(p["sign"] * p["left"] * (p["mark"] - p["entry"]) for p in self.open.values())

    def margin(self) -> float:
        return sum(p["left"] * p["mark"] / LEVERAGE for p in self.open.values())

    def point(self, ts) -> None:
        """An equity point where time or equity changed."""
        now = (ts, round(self.equity(), 6))
        if not self.points or self.points[-1] != now:
            self.points.append(now)

    def signal(self, ts, symbol: str, side: str, price: float, stop_pct: float, reward: float, win_rate: float, risk_pct: float, kind: str) -> bool:
        """Opens a position unless the symbol has one, too many are open, or there is no margin left; sized by the risk to its stop and by the margin."""
        if symbol in self.open or len(self.open) >= MOST_OPEN or not price > 0 or not stop_pct > 0:
            return False
        sign = -1 if side == "short" else 1
        entry = price * (1 + sign * SLIPPAGE)
        room = max(0.0, self.equity() * MARGIN_SHARE - self.margin())
        quantity = min(self.equity() * risk_pct / (entry * stop_pct), room * LEVERAGE / entry)
        if not quantity > 0:
            return False
        fee = quantity * entry * FEE
        self.balance -= fee
        guard = Protection(side, entry, entry * (1 - sign * stop_pct), entry * (1 + sign * stop_pct * reward), win_rate, kind)
        self.open[symbol] = {"side": side, "sign": sign, "entry": entry, "mark": price, "quantity": quantity, "left": quantity, "opened": ts, "settled": ts, "guard": guard, "fees": fee, "funding": 0.0, "gross": 0.0}
        return True

    def tick(self, ts, symbol: str, price: float) -> None:
        """Funding up to now, then the protection's step, then what it asks for; positions older than 72 hours are closed."""
        p = self.open.get(symbol)
        if p is None or not price > 0:
            return
        step = FUNDING_HOURS * HOUR
        due = min(MOST_SETTLEMENTS, ts.value // step - p["settled"].value // step)
        if due > 0:
            paid = -p["sign"] * p["left"] * price * FUNDING_RATE * due
            p["funding"] += paid
            self.balance += paid
            p["settled"] = ts
        p["mark"] = price
        out = p["guard"].step(price)
        if out["action"] == "partial_take_profit":
            self.sell(ts, symbol, p["left"] * out["sold"], price)
        elif out["action"] == "close":
            self.close(ts, symbol, price, out["reason"])
        elif ts.value - p["opened"].value >= LONGEST_HOURS * HOUR:
            self.close(ts, symbol, price, "TIME")

    def sell(self, ts, symbol: str, quantity: float, price: float) -> float:
        p = self.open[symbol]
        at = price * (1 - p["sign"] * SLIPPAGE)
        gross, fee = p["sign"] * quantity * (at - p["entry"]), quantity * at * FEE
        p["gross"] += gross
        p["fees"] += fee
        p["left"] -= quantity
        self.balance += gross - fee
        return at

    def close(self, ts, symbol: str, price: float, reason: str) -> None:
        p = self.open[symbol]
        at = self.sell(ts, symbol, p["left"], price)
        del self.open[symbol]
        realized = p["gross"] - p["fees"] + p["funding"]
        self.trades.append((symbol, p["side"], p["opened"], ts, p["entry"], at, p["quantity"], reason, p["gross"], p["fees"], p["funding"], realized, p["guard"].mfe, p["guard"].mae, self.balance))


def account_replay(events: DataFrame) -> DataFrame:
    """events (account, ts, seq, symbol, price, side, stop_pct, reward, win_rate, risk_pct, kind): a tick each, and a signal where side isn't null. The closed trades of each account."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, begin = by_group(g, ["account"], ["ts", "seq"])
        rows, lists = [], [g[c].tolist() for c in ("ts", "symbol", "price", "side", "stop_pct", "reward", "win_rate", "risk_pct", "kind")]
        for i, j in zip(begin, [*begin[1:], len(g)]):
            a = Account()  # its points aren't asked for here
            for ts, symbol, price, side, *rest in zip(*(x[i:j] for x in lists)):
                if symbol in a.open:
                    a.tick(ts, symbol, price)
                if isinstance(side, str):
                    a.signal(ts, symbol, side, price, *rest)
            rows += [(g.account.iloc[i], *t) for t in a.trades]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in TRADES.split(", ")])
        return out.round({c: 6 for c in ("entry", "exit", "quantity", "gross", "fees", "funding", "realized", "mfe", "mae", "balance")})

    return in_buckets(events, ["account"], run, TRADES)


def account_summary(trades: DataFrame) -> DataFrame:
    """Each account's trades, win rate, profit factor (null without losses), return and Sharpe ratio of its trades (null below five)."""
    gain = lambda c: F.coalesce(F.sum(F.when(c, F.col("realized"))), F.lit(0.0))
    ratio = F.when((F.count("realized") >= 5) & (F.stddev_pop("realized") > 0), F.avg("realized") / F.stddev_pop("realized") * F.sqrt(F.count("realized")))
    a = trades.groupBy("account").agg(F.count("realized").alias("n"), F.avg((F.col("realized") > 0).cast("double")).alias("win_rate"), gain(F.col("realized") > 0).alias("won"), (-gain(F.col("realized") < 0)).alias("lost"), F.sum("realized").alias("pnl"), ratio.alias("sharpe"))
    return a.select("account", "n", "win_rate", F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).alias("profit_factor"), (F.col("pnl") / START).alias("return"), "sharpe")
