"""Indicators and statistical models over each symbol's last bars, as folds over arrays of 120 at most."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import clamp, normal_cdf, sign

DIRECTION_WEIGHTS = {"trend": 0.24, "htf": 0.14, "momentum": 0.12, "rsi": 0.05, "funding": 0.05, "oi": 0.05, "gbm": 0.15, "hmm": 0.2}
QUALITY_WEIGHTS = {"event": 0.26, "trend": 0.12, "momentum": 0.08, "vol": 0.07, "funding": 0.04, "oi": 0.04, "liquidity": 0.04, "gbm": 0.1, "garch": 0.08, "hmm": 0.1, "markowitz": 0.07, "poisson": 0.04, "bayes": 0.08}
GARCH_GRID = [(a, b) for a in (0.05, 0.08, 0.12, 0.16) for b in (0.72, 0.8, 0.86, 0.9, 0.93) if a + b < 0.985]
LN_2PI = math.log(2 * math.pi)


def tail(a: str, n: int) -> str:
    return f"slice({a}, greatest(size({a}) - {n - 1}, 1), {n})"


def ema(a: str, last: int, period: int) -> Column:
    """EMA of the last values, seeded with the first of them."""
    al, t = 2 / (period + 1), tail(a, last)
    return F.expr(f"case when size({a}) = 0 then 0D else aggregate(slice({t}, 2, {last}), {t}[0], (s, x) -> x * {al}D + s * {1 - al}D) end")


def mean_of(a: str) -> str:
    return f"case when size({a}) = 0 then 0D else aggregate({a}, 0D, (s, x) -> s + x) / size({a}) end"


def std_of(a: str) -> str:
    """Population deviation; 0 of fewer than two."""
    m = f"(aggregate({a}, 0D, (s, x) -> s + x) / size({a}))"
    return f"case when size({a}) < 2 then 0D else sqrt(aggregate({a}, named_struct('m', {m}, 's', 0D), (q, x) -> named_struct('m', q.m, 's', q.s + (x - q.m) * (x - q.m)), q -> q.s / size({a}))) end"


def log_returns(a: str) -> Column:
    return F.expr(f"case when size({a}) < 2 then cast(array() as array<double>) else transform(sequence(1, size({a}) - 1), i -> ln({a}[i] / {a}[i - 1])) end")


def atr(n: int = 14) -> Column:
    """Plain mean of the last n true ranges."""
    tr = "transform(sequence(1, size(c) - 1), i -> greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])))"
    return F.expr(f"case when size(c) < 2 then 0D else {mean_of(f'slice({tr}, greatest(size(c) - {n}, 1), {n})')} end")


def rsi(n: int = 14) -> Column:
    """RSI of plain means: 50 of too few values, 100 without a loss."""
    d = f"slice(transform(sequence(1, size(c) - 1), i -> c[i] - c[i - 1]), greatest(size(c) - {n}, 1), {n})"
    up, down = f"aggregate({d}, 0D, (s, x) -> s + greatest(x, 0D))", f"aggregate({d}, 0D, (s, x) -> s + greatest(-x, 0D))"
    return F.expr(f"case when size(c) <= {n} then 50D when {down} = 0 then 100D else 100D - 100D / (1D + {up} / {down}) end")


def gbm(d: DataFrame, h: int = 4) -> DataFrame:
    """Adds g_m, g_sigma, g_expected, g_up and g_signal, from r (log-returns)."""
    d = d.withColumn("r96", F.expr(tail("r", 96))).withColumn("g_m", F.expr(mean_of("r96"))).withColumn("g_sigma", F.expr(std_of("r96")))
    vol, mh, s = F.col("g_sigma") * math.sqrt(h), F.col("g_m") * h, F.col("g_sigma")
    d = d.withColumn("g_expected", F.exp(mh + 0.5 * s * s * h) - 1).withColumn("g_up", F.when(s > 0, normal_cdf(mh / F.greatest(vol, F.lit(1e-9)))).otherwise(0.5))
    drift = F.when(vol > 0, clamp(F.col("g_expected") / F.greatest(vol * 1.5, F.lit(1e-9)), -1, 1)).otherwise(0.0)
    return d.withColumn("g_signal", clamp((F.col("g_up") - 0.5) * 2 * 0.7 + drift * 0.3, -1, 1))


def garch(d: DataFrame) -> DataFrame:
    """Adds v_alpha, v_beta, v_forecast, v_ratio, v_stability, v_confidence: the likeliest of the grid's pairs, the first of equals.

    The variance at t uses the return at t, and the forecast uses the last return again.
    """
    grid = ", ".join(f"named_struct('k', {k}, 'a', {a}D, 'b', {b}D)" for k, (a, b) in enumerate(GARCH_GRID))
    step = "greatest(w * (1D - p.a - p.b) + p.a * x * x + p.b * q.v, 1e-12D)"
    fit = f"""transform(array({grid}), p -> struct(
        aggregate(r96, named_struct('v', w, 'l', 0D), (q, x) -> named_struct('v', {step}, 'l', q.l - 0.5D * ({LN_2PI}D + ln({step}) + x * x / {step}))) as f, p as p))"""
    d = d.withColumn("w", F.greatest(F.col("g_sigma") * F.col("g_sigma"), F.lit(1e-12))).withColumn("fit", F.expr(fit))
    best = "aggregate(fit, fit[0], (m, y) -> case when y.f.l > m.f.l then y else m end)"
    d = d.withColumn("best", F.expr(best)).withColumn("last_r", F.expr("coalesce(try_element_at(r96, -1), 0D)"))
    f = F.greatest(F.expr("w * (1D - best.p.a - best.p.b) + best.p.a * last_r * last_r + best.p.b * best.f.v"), F.lit(1e-12))
    d = d.withColumn("v_forecast", F.sqrt(f)).withColumn("v_ratio", F.col("v_forecast") / F.sqrt("w"))
    d = d.withColumn("v_stability", clamp(1.25 - 0.35 * F.col("v_ratio"), 0, 1)).withColumn("v_confidence", 0.65 + 0.35 * F.col("v_stability"))
    return d.withColumn("v_alpha", F.col("best.p.a")).withColumn("v_beta", F.col("best.p.b")).drop("fit", "best", "last_r", "w")


def hmm(d: DataFrame) -> DataFrame:
    """Adds m_bull, m_bear, m_range, m_regime, m_confidence and m_signal: the filter of a three-state Markov model."""

    def density(mean: str, dev: str) -> str:
        s = f"greatest(abs({dev}), 1e-9D)"
        return f"(exp(-0.5D * pow((x - ({mean})) / {s}, 2)) / ({s} * {math.sqrt(2 * math.pi)}D))"

    dens = [density("g * 0.35D", "g * 0.9D"), density("-g * 0.35D", "g * 0.9D"), density("0D", "g * 0.55D")]
    pred = ["(q.a * 0.92D + q.b * 0.03D + q.c * 0.08D)", "(q.a * 0.03D + q.b * 0.92D + q.c * 0.08D)", "(q.a * 0.05D + q.b * 0.05D + q.c * 0.84D)"]
    x = [f"({p} * {e})" for p, e in zip(pred, dens)]
    t = f"({' + '.join(x)})"
    third = f"{1 / 3!r}D"
    each = ", ".join(f"'{n}', case when {t} > 0 then {e} / {t} else {third} end" for n, e in zip("abc", x))
    fold = f"aggregate(r96, named_struct('a', {third}, 'b', {third}, 'c', {third}), (q, x) -> named_struct({each}))"
    d = d.withColumn("g", F.greatest("g_sigma", F.lit(1e-6))).withColumn("p", F.expr(fold))
    d = d.withColumn("m_bull", F.col("p.a")).withColumn("m_bear", F.col("p.b")).withColumn("m_range", F.col("p.c")).drop("p", "g")
    d = d.withColumn("m_confidence", F.greatest("m_bull", "m_bear", "m_range"))
    d = d.withColumn("m_regime", F.when(F.col("m_bull") == F.col("m_confidence"), "bull").when(F.col("m_bear") == F.col("m_confidence"), "bear").otherwise("range"))
    return d.withColumn("m_signal", clamp(F.col("m_bull") - F.col("m_bear"), -1, 1))


def market(b: DataFrame, htf: DataFrame) -> DataFrame:
    """One row for each symbol with all indicators, models, direction and regime. b: base bars' arrays, and funding_rate and oi_change where they are known; htf: those of the slower bars."""
    for name in ("funding_rate", "oi_change"):
        b = b if name in b.columns else b.withColumn(name, F.lit(0.0))
    d = b.join(htf.select("symbol", F.col("c").alias("c4")), "symbol")
    d = d.withColumn("r", log_returns("c")).withColumn("latest", F.expr("element_at(c, -1)"))
    d = d.withColumn("atr", atr()).withColumn("rsi14", rsi())
    d = d.withColumn("atr_pct", F.when(F.col("latest") > 0, F.col("atr") / F.col("latest")).otherwise(0.0))
    for name, a, n, p in (("ema20", "c", 80, 20), ("ema50", "c", 120, 50), ("htf_ema20", "c4", 80, 20), ("htf_ema50", "c4", 120, 50)):
        d = d.withColumn(name, ema(a, n, p))
    for name, n in (("realized_vol", 48), ("short_vol", 12)):
        d = d.withColumn("r_n", F.expr(tail("r", n))).withColumn(name, F.expr(std_of("r_n")) * math.sqrt(96))
    d = d.withColumn("vol_expansion", F.when(F.col("realized_vol") > 0, F.col("short_vol") / F.col("realized_vol")).otherwise(1.0)).drop("r_n")
    roc = lambda a: F.expr(f"case when size({a}) >= 5 then element_at({a}, -1) / element_at({a}, -5) - 1 else 0D end")
    d = d.withColumn("roc", roc("c")).withColumn("htf_roc", F.expr("case when size(c4) >= 5 then latest / element_at(c4, -5) - 1 else 0D end"))
    scale = F.greatest(F.col("latest") * F.greatest("atr_pct", F.lit(0.004)), F.lit(1e-9))
    d = d.withColumn("trend", clamp((F.col("ema20") - F.col("ema50")) / scale * 0.5, -1, 1)).withColumn("htf_trend", clamp((F.col("htf_ema20") - F.col("htf_ema50")) / scale * 0.35, -1, 1))
    d = d.withColumn("momentum", clamp((F.col("roc") + F.col("htf_roc") * 0.8) / F.greatest(F.col("atr_pct") * 3, F.lit(0.006)), -1, 1))
    d = d.withColumn("rsi_signal", F.when(F.col("rsi14") > 72, -0.35).when(F.col("rsi14") < 28, 0.35).otherwise(0.0))
    d = d.withColumn("vol_score", F.when(F.col("vol_expansion") > 1.6, -0.15).when(F.col("vol_expansion") < 0.65, -0.05).otherwise(0.1))
    d = d.withColumn("funding_signal", clamp(-F.coalesce("funding_rate", F.lit(0.0)) / 0.001, -0.4, 0.4)).withColumn("oi_signal", clamp(F.coalesce("oi_change", F.lit(0.0)) / 0.06, -0.35, 0.35))
    d = hmm(garch(gbm(d)))
    k = DIRECTION_WEIGHTS
    total = F.col("funding_signal") * k["funding"] + F.col("oi_signal") * k["oi"] + F.col("trend") * k["trend"] + F.col("htf_trend") * k["htf"] + F.col("momentum") * k["momentum"] + F.col("rsi_signal") * k["rsi"] + F.col("g_signal") * k["gbm"] + F.col("m_signal") * k["hmm"]
    d = d.withColumn("direction", clamp(total, -1, 1)).withColumn("math_signal", clamp(F.col("direction") * F.col("v_confidence"), -1, 1))
    regime = F.when(F.col("m_confidence") >= 0.55, F.concat(F.lit("hmm_"), "m_regime")).when(F.abs(F.col("trend") + F.col("htf_trend")) > 0.8, "trend").when(F.col("vol_expansion") > 1.6, "high_volatility").when(F.abs("momentum") < 0.25, "range").otherwise("transition")
    return d.withColumn("regime", regime)


def poisson_tail(k: Column, lam: Column) -> Column:
    """P(N >= k): one minus the sum of the terms below k. Their logarithms are carried on, for e^-lam is 0 from lam = 746 on."""
    log = lambda q, i: q["t"] + F.ln(lam) - F.ln(i)
    terms = F.aggregate(
        F.when(k > 1, F.sequence(F.lit(1), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct((-lam).alias("t"), F.exp(-lam).alias("s")),
        lambda q, i: F.struct(log(q, i).alias("t"), (q["s"] + F.coalesce(F.exp(log(q, i)), F.lit(0.0))).alias("s")),
        lambda q: q["s"],
    )
    return F.when(k <= 0, 1.0).otherwise(clamp(1 - clamp(terms, 0, 1), 0, 1))


def bayes(prior: Column, direction: Column, score: Column, alignment: Column, vol_score: Column, boost: Column, burst: Column, cost_to_risk: Column) -> Column:
    """The posterior win rate of a candidate."""
    prior = clamp(prior, 0.35, 0.86)
    agree = F.when(alignment > 0, score * (0.55 + burst * 0.45)).when(alignment < 0, -score * (0.65 + burst * 0.35)).otherwise(0.0)
    zero = F.lit(0.0)
    win = F.abs(direction) * 0.75 + F.greatest(zero, agree) * 0.5 + F.greatest(zero, boost) * 7 + F.greatest(zero, vol_score) * 0.35
    loss = F.greatest(zero, -agree) * 0.6 + F.greatest(zero, -vol_score) * 0.4 + clamp(cost_to_risk, 0, 2) * 0.28
    a, b = prior * clamp(F.exp(win), 0.35, 2.8), (1 - prior) * clamp(F.exp(loss), 0.35, 2.8)
    return clamp(a / (a + b), 0.35, 0.86)


def candidates(m: DataFrame, min_direction: float = 0.0, cost: float = 0.0016) -> DataFrame:
    """Candidates without event context ("math_only"): side, risk, reward, win rate, expectancy, adaptive threshold and Kelly fraction."""
    # The window keeps the filter above the models: pushed below them it would repeat their expressions many times over.
    one = F.row_number().over(Window.partitionBy("symbol").orderBy("symbol"))
    d = m.withColumn("combined", F.col("math_signal")).withColumn("one", one).where((F.col("one") == 1) & (F.abs("combined") >= min_direction))
    boost = clamp((F.col("m_confidence") - 1 / 3) * 0.035 + (F.col("v_stability") - 0.5) * 0.025 + F.abs("g_signal") * 0.01, -0.02, 0.035)
    half = F.lit(0.5)
    factors = {"trend": F.abs("trend"), "momentum": F.abs("momentum"), "vol": F.greatest("vol_score", F.lit(-0.1)), "liquidity": half, "gbm": F.abs("g_signal"), "garch": F.col("v_stability"), "hmm": F.abs("m_signal") * F.col("m_confidence"), "markowitz": half, "poisson": half, "bayes": half}
    quality = sum((factors[k] * w for k, w in QUALITY_WEIGHTS.items() if k in factors), F.lit(0.0)) / sum(QUALITY_WEIGHTS.values())
    base = clamp(0.5 + F.abs("combined") * 0.18 + F.col("vol_score") * 0.05 - 0.02 + boost + clamp((quality - 0.45) * 0.06, -0.04, 0.04), 0.35, 0.86)
    d = d.withColumn("boost", boost).withColumn("base_win", base).withColumn("risk", clamp(F.greatest(F.col("atr_pct") * 1.9, F.col("v_forecast") * 2 * 1.25, F.lit(0.006)), 0.006, 0.09))
    d = d.withColumn("rr", F.when(F.abs("math_signal") > 0.65, 1.65).otherwise(1.45)).withColumn("side", F.when(F.col("combined") > 0, "long").otherwise("short"))
    zero = F.lit(0.0)
    post = bayes(F.col("base_win"), F.col("combined"), zero, zero, F.col("vol_score"), F.col("boost"), zero, cost / F.col("risk"))
    d = d.withColumn("win_rate", clamp(F.col("base_win") * 0.7 + post * 0.3, 0.35, 0.86))
    d = d.withColumn("expectancy", F.col("win_rate") * F.col("risk") * F.col("rr") - (1 - F.col("win_rate")) * F.col("risk") - cost).withColumn("expectancy_r", F.col("expectancy") / F.col("risk"))
    pen = F.when(F.col("regime").contains("transition"), 0.04).when(F.col("regime").contains("high_volatility"), 0.03).when(F.col("regime").contains("range"), 0.015).otherwise(0.0)
    vol = clamp((F.greatest("vol_expansion", "v_ratio") - 1.15) * 0.025, 0, 0.04)
    d = d.withColumn("break_even", clamp((1 + cost / F.col("risk")) / (1 + F.col("rr")), 0.05, 0.95))
    margin = 0.045 + 0.07 + pen + vol + 0.03 - clamp((F.abs("combined") - 0.5) * 0.025, 0, 0.015)
    low = F.greatest(F.lit(0.45), F.col("break_even") + 0.01)
    d = d.withColumn("threshold", F.greatest(low, F.least(F.greatest(low, F.lit(0.78)), F.col("break_even") + margin)))
    d = d.withColumn("status", F.when((F.col("expectancy") > 0) & (F.col("win_rate") >= F.col("threshold")), "passed").otherwise("watch"))
    kelly = clamp((F.col("rr") * F.col("win_rate") - (1 - F.col("win_rate"))) / F.col("rr"), 0, 0.35)
    d = d.withColumn("position_risk", clamp(F.least(kelly * 0.2, F.lit(0.005)), 0, 0.005))
    s = sign(F.col("combined"))
    return d.withColumn("stop_loss", F.col("latest") * (1 - s * F.col("risk"))).withColumn("take_profit", F.col("latest") * (1 + s * F.col("risk") * F.col("rr")))
