"""Review of a model after its trades: promotion of proposed weights with its blockers, versions, and what explains a trade."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import contributions

LEAST_TRADES, LEAST_VALIDATION, LEAST_GAIN = 50, 10, 0.03


@dataclass(frozen=True)
class Metrics:
    n: int
    accuracy: float
    margin: float


def blockers(eligible: int, champion: Metrics, challenger: Metrics, least_trades: int = LEAST_TRADES) -> list[str]:
    """Why proposed weights aren't promoted; none: they may be."""
    out = []
    if eligible < least_trades:
        out.append("minimum_promotion_trades")
    if challenger.n < LEAST_VALIDATION:
        out.append("minimum_validation_trades")
    if challenger.accuracy - champion.accuracy < LEAST_GAIN - 1e-12:
        out.append("accuracy_gain")
    if not challenger.margin > champion.margin:
        out.append("margin_gain")
    return out


def status(eligible: int, least: int, blocked: list[str]) -> str:
    return "insufficient_data" if eligible < least else "shadow_candidate" if blocked else "promotable"


@dataclass(frozen=True)
class Weights:
    """Weights in use, those they replaced, and their version."""

    version: int
    active: dict[str, float]
    previous: dict[str, float] | None = None
    log: tuple[str, ...] = field(default_factory=tuple)


def normalised(weights: dict[str, float], low: float = 0.01, high: float = 0.7) -> dict[str, float]:
    w = {k: max(low, min(high, v)) for k, v in weights.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def applied(w: Weights, proposal: dict[str, float], blocked: list[str]) -> Weights:
    """The proposal in use; refused while anything blocks it or where it has other factors."""
    if blocked:
        raise ValueError(f"not promotable: {', '.join(blocked)}")
    if set(proposal) != set(w.active):
        raise ValueError("the proposal's factors differ")
    return Weights(w.version + 1, normalised(proposal), w.active, (*w.log, "apply"))


def rolled_back(w: Weights) -> Weights:
    """The former weights in use again; the ones rolled back can be brought back by another rollback."""
    if w.previous is None:
        raise ValueError("nothing to roll back to")
    return replace(w, version=w.version + 1, active=w.previous, previous=w.active, log=(*w.log, "rollback"))


def trade_class(gross: Column, net: Column, reason: Column) -> Column:
    return F.when(net > 0, "profitable").when(gross > 0, "cost_drag").when(reason.isin("SL", "DYNAMIC_SL"), "stop_loss").otherwise("direction_or_timing_error")


def explain(trades: DataFrame, weights: dict[str, float], top: int = 3) -> DataFrame:
    """trades (id, side, gross, net, risk, reason, signals map) with class, net R, the strongest contributions and whether the direction was right."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    label = F.when(F.col("gross") >= 0, 1).otherwise(-1) * F.when(F.col("side") == "short", -1).otherwise(1)
    t = trades.withColumn("c", contributions(F.col("signals"), w)).withColumn("score", F.aggregate("c", F.lit(0.0), lambda a, x: a + x["contribution"]))
    return t.select(
        "id", trade_class(F.col("gross"), F.col("net"), F.col("reason")).alias("class"), F.when(F.col("risk") > 0, F.col("net") / F.col("risk")).otherwise(0.0).alias("net_r"), "score", (F.signum("score") == label).alias("right"), F.slice("c", 1, top).alias("strongest")
    )
