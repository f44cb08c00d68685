"""Exits of open positions: the six-factor exit score, and the ratcheting protection of stops with partial exits.

Both are columns over a row of a position with its market and candidate, so a table of positions is judged in one pass;
`protect_replay` runs the protection along each position's prices, where a step depends on the one before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTORS = {"signal_reversal": 0.277, "net_expectancy_decay": 0.238, "event_decay": 0.119, "time_decay": 0.158, "capital_efficiency": 0.088, "profit_protection": 0.12}
THRESHOLDS = {"trend": 0.72, "range": 0.64, "transition": 0.62}
GIVEBACK = {"trend": 0.75, "range": 0.5}
#: R at which the first stop is set; bounds of the activation and of breaking even; the share sold at the target; how far a target moves.
FIRST_STOP, ACTIVATION, BREAK_EVEN, PARTIAL, EXTENSION = -0.75, (0.4, 0.75), (0.8, 1.1), 0.5, 0.75


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def regime_kind(regime: Column, side: Column) -> Column:
    """trend, range, transition or unknown; a market that runs against the position's side is in transition for it."""
    low = F.lower(F.coalesce(regime, F.lit("unknown")))
    bull, bear = F.contains(low, F.lit("bull")), F.contains(low, F.lit("bear"))
    against = (bull & (side == "short")) | (bear & ~bull & (side == "long"))
    return (
        F.when(F.contains(low, F.lit("transition")), "transition").when(F.contains(low, F.lit("range")), "range").when(against, "transition")
        .when(bull | bear | F.contains(low, F.lit("trend")), "trend").otherwise("unknown")
    )


def exit_scores(positions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """positions (side, mode, regime, entry, take_profit, stop_loss, price, age_hours, event_age_hours, event_half_life, atr_pct, fee_rate, slippage_rate,
    funding_rate, candidate_side, candidate_win_rate, candidate_direction, profit_protection, expectancy_pct, ...) with the signals, the score and what it recommends."""
    total = sum(w := [max(0.01, min(0.7, (weights or FACTORS).get(k, v))) for k, v in FACTORS.items()])
    share = dict(zip(FACTORS, (x / total for x in w)))
    p = positions.withColumn("kind", regime_kind(F.col("regime"), F.col("side")))
    long, same = F.col("side") == "long", F.col("candidate_side") == F.col("side")
    move = lambda to: F.when(long, F.col(to) / F.col("price") - 1).otherwise(1 - F.col(to) / F.col("price"))
    p = p.withColumn("reward", F.greatest(F.lit(0.0), move("take_profit"))).withColumn("risk", F.greatest(F.lit(0.0), -move("stop_loss")))
    rate = F.coalesce("candidate_win_rate", F.lit(0.5))
    chance = F.when(F.col("candidate_side").isNull(), 0.5).when(same, _clamp(rate, 0.05, 0.95)).otherwise(_clamp(1 - rate, 0.05, 0.95))
    p = p.withColumn("chance", chance).withColumn("cost", F.greatest(F.lit(0.0), F.col("fee_rate") + F.col("slippage_rate")))
    p = p.withColumn("funding_cost", F.greatest(F.lit(0.0), F.when(long, F.col("funding_rate")).otherwise(-F.col("funding_rate"))))
    p = p.withColumn("expectancy", F.col("chance") * F.col("reward") - (1 - F.col("chance")) * F.col("risk") - F.col("cost") - F.col("funding_cost"))
    base = F.when(F.col("mode") == "event_impact", 8.0).when(F.col("mode") == "event_math", 12.0).otherwise(18.0)
    factor = F.when(F.col("kind") == "trend", 1.15).when(F.col("kind") == "range", 0.85).when(F.col("kind") == "transition", 0.75).otherwise(1.0)
    p = p.withColumn("max_hours", _clamp(base * _clamp(0.012 / F.greatest(F.lit(0.001), F.abs("atr_pct")), 0.65, 1.35) * factor, 4, 24))
    signals = {
        "signal_reversal": F.when(F.col("candidate_side").isNotNull() & ~same, _clamp(F.abs(F.coalesce("candidate_direction", F.lit(0.0))), 0, 1)).otherwise(0.0),
        "net_expectancy_decay": _clamp(-F.col("expectancy") / F.greatest(F.col("reward") + F.col("risk"), F.lit(0.005)), 0, 1),
        "event_decay": F.when(F.col("event_age_hours").isNotNull(), _clamp(1 - F.pow(F.lit(0.5), F.col("event_age_hours") / F.col("event_half_life")), 0, 1)).otherwise(0.0),
        "time_decay": _clamp(F.col("age_hours") / F.col("max_hours"), 0, 1),
        "capital_efficiency": F.lit(0.0),
        "profit_protection": _clamp(F.coalesce("profit_protection", F.lit(0.0)), 0, 1),
    }
    for k, c in signals.items():
        p = p.withColumn(k, c)
    p = p.withColumn("score", sum(F.col(k) * share[k] for k in FACTORS))
    threshold = F.when(F.col("kind") == "trend", 0.72).when(F.col("kind") == "range", 0.64).when(F.col("kind") == "transition", 0.62).otherwise(0.68)
    expired = F.col("time_decay") >= 1
    negative = (F.col("age_hours") >= 1 / 6) & (F.col("expectancy") <= -F.greatest(F.lit(0.0015), F.col("cost")))
    p = p.withColumn("threshold", F.when(expired | negative, F.least(threshold, F.col("score"))).otherwise(threshold)).withColumn("expired", expired).withColumn("negative", negative)
    p = p.withColumn("exit", expired | negative | (F.col("score") >= F.col("threshold")))
    entry = F.greatest(F.lit(0.0), F.col("expectancy_pct"))
    worse = (entry > 0) & (F.col("expectancy") <= entry * 0.55)
    p = p.withColumn("de_risk", ~F.col("exit") & (F.col("age_hours") >= 1 / 3) & (worse | (F.col("expectancy") <= F.col("cost") + F.col("funding_cost"))))
    deep = (F.col("expectancy") <= 0) | (F.when(entry > 0, F.col("expectancy") / entry).otherwise(1.0) <= 0.25)
    p = p.withColumn("de_risk_fraction", F.when(~F.col("de_risk"), 0.0).when(deep, 0.5).otherwise(0.25))
    return p.withColumn("confirmations", F.when(F.col("expired"), 1).otherwise(3)).withColumn("horizon_hours", _clamp(F.col("max_hours") / 4, 1, 4))


class Protection:
    """The state of one position's protection; `step` moves it on by a price."""

    def __init__(self, side: str, entry: float, stop: float, target: float, win_rate: float, kind: str, cost_r: float = 0.0, tick: float = 0.0):
        self.sign = -1 if side == "short" else 1
        self.entry, self.stop, self.target, self.kind, self.tick = entry, stop, target, kind, tick
        self.risk = abs(entry - stop)
        shift = {"trend": 0.15, "range": -0.05, "transition": -0.1}.get(kind, 0.0)
        self.activation = min(ACTIVATION[1], max(ACTIVATION[0], 0.5 + min(0.08, max(-0.08, (win_rate - 0.6) * 0.5)) + shift))
        self.even = min(BREAK_EVEN[1], max(BREAK_EVEN[0], self.activation + 0.4))
        self.giveback = GIVEBACK.get(kind, 0.3)
        self.target_r = abs(target - entry) / self.risk if self.risk else 0.0
        self.cost_r = min(0.3, max(0.0, cost_r))
        self.mfe = self.mae = 0.0
        self.stage, self.sold = "inactive", False

    def r_of(self, price: float) -> float:
        return self.sign * (price - self.entry) / self.risk

    def aligned(self, price: float) -> float:
        if self.tick <= 0:
            return price
        n = price / self.tick
        return self.tick * (int(n + 1e-9) if self.sign > 0 else -int(-n + 1e-9))

    def step(self, price: float, same_side: bool = False, direction: float = 0.0, win_rate: float = 0.5) -> dict:
        r = self.r_of(price)
        self.mfe, self.mae = max(self.mfe, r, 0.0), min(self.mae, r, 0.0)
        before = self.r_of(self.stop)
        to = before
        if self.mfe >= self.activation:
            if self.mfe < self.even:
                to = FIRST_STOP + min(1.0, (self.mfe - self.activation) / max(0.01, self.even - self.activation)) * (self.cost_r - FIRST_STOP)
                self.stage = "tightening"
            else:
                to = max(self.cost_r, self.mfe - self.giveback)
                self.stage = "trailing"
        stop = self.aligned(self.entry + self.sign * self.risk * max(before, to))
        moved = self.r_of(stop) > before + 1e-9
        self.stop = stop
        stop_r = self.r_of(stop)
        pressure = min(1.0, max(0.0, self.mfe - r) / max(0.1, self.giveback))
        progress = min(1.0, max(0.0, self.mfe - self.activation) / max(0.1, self.even - self.activation))
        guard = min(1.0, progress * 0.25 + pressure * 0.75) if self.mfe >= self.activation else 0.0
        action, reason, sold = "none", None, 0.0
        hit = self.sign * (price - self.target) >= 0
        if r <= stop_r + 1e-9:
            action, reason, self.stage = "close", "DYNAMIC_SL" if stop_r > -1 + 1e-9 else "SL", "exit"
        elif hit and self.sold:
            action, reason, self.stage = "close", "TP_EXTENSION", "exit"
        elif hit and self.kind == "trend" and same_side and abs(direction) >= 0.45 and win_rate >= 0.57:
            action, sold, self.sold, self.stage = "partial_take_profit", PARTIAL, True, "runner"
            self.target = self.aligned(self.entry + self.sign * self.risk * (self.target_r + min(EXTENSION, self.target_r * 0.5)))
        elif hit:
            action, reason, self.stage = "close", "TP", "exit"
        return {"action": action, "reason": reason, "sold": sold, "stop": stop, "moved": moved, "target": self.target, "r": r, "mfe": self.mfe, "mae": self.mae, "guard": guard, "stage": self.stage}


REPLAY = "position_id long, n_steps int, closed_at timestamp, action string, reason string, exit_r double, realized_r double, mfe double, mae double, stop double, stage string, partial boolean"


def protect_replay(prices: DataFrame) -> DataFrame:
    """prices (position_id, side, entry, stop, target, win_rate, kind, ts, seq, price, same_side, direction, candidate_win_rate) along each position, to its exit.

    A position's rows are one group of one task: as many as it has prices while it is open.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "seq"])
        a = g.iloc[0]
        if not (a.entry > 0 and abs(a.entry - a.stop) > 0 and a.target > 0):
            return pd.DataFrame([(a.position_id, 0, None, "none", None, None, None, 0.0, 0.0, a.stop, "inactive", False)], columns=[c.split()[0] for c in REPLAY.split(", ")])
        p = Protection(a.side, a.entry, a.stop, a.target, a.win_rate, a.kind)
        left, realized, n, out = 1.0, 0.0, 0, None
        for price, same, direction, chance, ts in zip(g.price, g.same_side, g.direction, g.candidate_win_rate, g.ts):
            n += 1
            out = p.step(price, bool(same), direction, chance)
            if out["action"] == "partial_take_profit":
                realized += left * out["sold"] * out["r"]
                left *= 1 - out["sold"]
            elif out["action"] == "close":
                realized += left * out["r"]
                left = 0.0
                break
        closed = out["action"] == "close"
        row = (a.position_id, n, ts if closed else None, out["action"], out["reason"], round(out["r"], 6) if closed else None, round(realized, 6), round(out["mfe"], 6), round(out["mae"], 6), round(out["stop"], 6), out["stage"], p.sold)
        return pd.DataFrame([row], columns=[c.split()[0] for c in REPLAY.split(", ")])

    return prices.groupBy("position_id").applyInPandas(run, REPLAY)

