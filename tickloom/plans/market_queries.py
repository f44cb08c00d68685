"""Candles, indicators, models and candidates over the events table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import models as M
from tickloom.operators.candles import bars, last_bars, ticks
from tickloom.session import table

R = 6


def _ticks(s: SparkSession, d: str) -> DataFrame:
    return ticks(table(s, d, "events"))


def market_rows(s: SparkSession, d: str) -> DataFrame:
    t = _ticks(s, d)
    return M.market(last_bars(bars(t, 1)), last_bars(bars(t, 4)))


def _rounded(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, R).alias(c) for c in cols])


def _bar():
    """Made when asked for: a window needs a session."""
    return Window.partitionBy("symbol").orderBy("bar")



def log_returns(s, d):
    return bars(_ticks(s, d)).withColumn("prev", F.lag("close").over(_bar())).where("prev > 0").select("symbol", "bar", F.round(F.ln(F.col("close") / F.col("prev")), R).alias("r"))


def atr14(s, d):
    b = bars(_ticks(s, d)).withColumn("p", F.lag("close").over(_bar())).where("p is not null")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("p")), F.abs(F.col("low") - F.col("p")))
    return b.select("symbol", "bar", F.round(F.avg(tr).over(_bar().rowsBetween(-13, 0)), R).alias("atr14"))


def rsi14(s, d):
    b = bars(_ticks(s, d)).withColumn("x", F.col("close") - F.lag("close").over(_bar())).withColumn("n", F.row_number().over(_bar()))
    w = _bar().rowsBetween(-13, 0)
    b = b.withColumn("up", F.avg(F.greatest("x", F.lit(0.0))).over(w)).withColumn("down", F.avg(F.greatest(-F.col("x"), F.lit(0.0))).over(w))
    return b.where("n > 14").select("symbol", "bar", F.round(F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("up") / F.col("down"))), R).alias("rsi14"))


def roc(s, d):
    b = bars(_ticks(s, d)).withColumn("p", F.lag("close", 4).over(_bar())).where("p is not null")
    return b.select("symbol", "bar", F.round(F.col("close") / F.col("p") - 1, R).alias("roc4"))


def realized_vol(s, d):
    b = bars(_ticks(s, d)).withColumn("r", F.ln(F.col("close") / F.lag("close").over(_bar()))).withColumn("n", F.row_number().over(_bar())).where("n > 1")
    vol = lambda n: F.stddev_pop("r").over(_bar().rowsBetween(1 - n, 0)) * math.sqrt(96)
    b = b.withColumn("v48", vol(48)).withColumn("v12", vol(12)).where("n > 48")
    return b.select("symbol", "bar", F.round("v48", R).alias("realized_vol"), F.round("v12", R).alias("short_vol"), F.round(F.when(F.col("v48") > 0, F.col("v12") / F.col("v48")).otherwise(1.0), R).alias("expansion"))


def mfe_mae(s, d):
    """Most favourable and adverse return since each symbol's first tick, from 0."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    t = _ticks(s, d).withColumn("x", F.col("price") / F.first("price").over(w) - 1)
    return t.select("symbol", "event_id", F.round(F.greatest(F.max("x").over(w), F.lit(0.0)), R).alias("mfe"), F.round(F.least(F.min("x").over(w), F.lit(0.0)), R).alias("mae"))


def oi_change(s, d):
    """A bar's tick count over the one before, as open interest."""
    b = bars(_ticks(s, d)).withColumn("p", F.lag("n_ticks").over(_bar())).where("p > 0")
    return b.select("symbol", "bar", F.round(F.col("n_ticks") / F.col("p") - 1, R).alias("oi_change"))


def rank_trend(s, d):
    """Daily rank of symbols by ticks: change, best so far, observations and hotness."""
    n = _ticks(s, d).groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "symbol")))
    w = Window.partitionBy("symbol").orderBy("day")
    n = n.withColumn("delta", F.lag("rank").over(w) - F.col("rank")).withColumn("best_rank", F.min("rank").over(w)).withColumn("observations", F.row_number().over(w)).withColumn("first_seen", F.min("day").over(w))
    hot = 0.55 / F.sqrt("rank") + 0.25 * F.least(F.lit(1.0), F.col("observations") / 8) + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("delta", F.lit(0)) / 10))
    return n.select("symbol", "day", "rank", "delta", "best_rank", "observations", "first_seen", F.round(hot, R).alias("hotness"))


MARKET_COLS = ["latest", "atr_pct", "ema20", "ema50", "htf_ema20", "htf_ema50", "rsi14", "realized_vol", "short_vol", "vol_expansion", "trend", "htf_trend", "momentum", "direction", "math_signal"]


def candidates_topk(s, d, k: int = 5):
    c = M.candidates(market_rows(s, d)).orderBy(F.desc("expectancy_r"), "symbol").limit(k)
    return _rounded(c, ["symbol", "side", "status", "regime"], ["combined", "win_rate", "risk", "rr", "expectancy", "expectancy_r", "threshold", "position_risk", "stop_loss", "take_profit"])


def poisson_burst(s, d):
    b = bars(_ticks(s, d)).withColumn("lam", F.avg("n_ticks").over(_bar().rowsBetween(-24, -1))).where("lam is not null").withColumn("tail", M.poisson_tail(F.col("n_ticks"), F.col("lam")))
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("n_ticks") - F.col("lam")) / F.sqrt(F.col("lam") + 1e-9)))
    return b.select("symbol", "bar", F.round("lam", R).alias("lam"), F.round("tail", R).alias("tail"), F.round(1 - F.col("tail"), R).alias("burst"), F.round(z, R).alias("cluster_score"))


def covariance_pairs(s, d):
    """Population covariance of the last 96 bar returns of each pair, aligned from the last."""
    b = bars(_ticks(s, d)).withColumn("r", F.ln(F.col("close") / F.lag("close").over(_bar()))).where("r is not null")
    b = b.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar")))).where("k <= 96").select("symbol", "k", "r")
    a, c = b.toDF("a", "k", "ra"), b.toDF("b", "k", "rb")
    return a.join(c, "k").where("a <= b").groupBy("a", "b").agg(F.round(F.covar_pop("ra", "rb"), R).alias("covariance"), F.count(F.lit(1)).alias("n"))


def sql_bars(h: int = 1) -> str:
    bucket = "date_trunc('hour', ts)" if h == 1 else f"time_bucket(interval '{h} hours', ts, timestamp '1970-01-01')"
    return f"""(SELECT event_type AS symbol, {bucket} AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks
      FROM events WHERE value > 0 GROUP BY ALL)"""


def _sql_last(h: int) -> str:
    return f"(SELECT symbol, list(close ORDER BY bar) AS c, list(high ORDER BY bar) AS h, list(low ORDER BY bar) AS l FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS rn FROM {sql_bars(h)}) WHERE rn <= 120 GROUP BY symbol)"


def _sql_ema(a: str, n: int, p: int) -> str:
    al = 2 / (p + 1)
    return f"list_reduce({a}[-{n}:], lambda s, x: x * {al}::double + s * {1 - al}::double)"


def _cl(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::double, least({hi}::double, {x}))"


def _cdf(v: str) -> str:
    x = f"(abs({v}) / sqrt(2::double))"
    t = f"(1 / (1 + 0.3275911::double * {x}))"
    poly = f"(((((1.061405429::double * {t} - 1.453152027::double) * {t} + 1.421413741::double) * {t} - 0.284496736::double) * {t} + 0.254829592::double) * {t})"
    return f"(0.5::double * (1 + (CASE WHEN {v} < 0 THEN -1 ELSE 1 END) * (1 - {poly} * exp(-{x} * {x}))))"


def _den(mean: str, dev: str) -> str:
    s = f"greatest(abs({dev}), 1e-9::double)"
    return f"(exp(-0.5::double * pow((x - ({mean})) / {s}, 2)) / ({s} * {math.sqrt(2 * math.pi)}::double))"


_D = [_den("g * 0.35::double", "g * 0.9::double"), _den("-g * 0.35::double", "g * 0.9::double"), _den("0::double", "g * 0.55::double")]
_P = ["(q.a * 0.92 + q.b * 0.03 + q.c * 0.08)", "(q.a * 0.03 + q.b * 0.92 + q.c * 0.08)", "(q.a * 0.05 + q.b * 0.05 + q.c * 0.84)"]
_P = [p.replace(" * 0.", "::double * 0.") for p in _P]
_X = [f"({p} * {e})" for p, e in zip(_P, _D)]
_T = f"({' + '.join(_X)})"
_THIRD = f"{1 / 3!r}::double"
_HMM = f"list_reduce(list_prepend({{'a': {_THIRD}, 'b': {_THIRD}, 'c': {_THIRD}, 'x': 0::double}}, list_transform(r96, lambda y: {{'a': 0::double, 'b': 0::double, 'c': 0::double, 'x': y}})), lambda q, z: " + "{" + ", ".join(
    f"'{n}': CASE WHEN {_T} > 0 THEN {e} / {_T} ELSE {_THIRD} END".replace("(x - ", "(z.x - ") for n, e in zip("abc", _X)) + ", 'x': 0::double})"
_GRID = ", ".join(f"({k}, {a}::double, {b}::double)" for k, (a, b) in enumerate(M.GARCH_GRID))
_STEP = "greatest(w * (1 - ga - gb) + ga * z.x * z.x + gb * q.v, 1e-12::double)"
_GARCH = f"list_reduce(list_prepend({{'v': w, 'l': 0::double, 'x': 0::double}}, list_transform(r96, lambda y: {{'v': 0::double, 'l': 0::double, 'x': y}})), lambda q, z: {{'v': {_STEP}, 'l': q.l - 0.5::double * ({M.LN_2PI}::double + ln({_STEP}) + z.x * z.x / {_STEP}), 'x': 0::double}})"
_K = M.DIRECTION_WEIGHTS
_TR = "list_transform(range(2, len(c) + 1), lambda i: greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])))"
_DX = "list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1])[-14:]"
MARKET_SQL = f"""
a0 AS (SELECT b.symbol, b.c, b.h, b.l, f.c AS c4 FROM {_sql_last(1)} b JOIN {_sql_last(4)} f USING (symbol)),
a1 AS (SELECT *, c[-1] AS latest, list_transform(range(2, len(c) + 1), lambda i: ln(c[i] / c[i - 1])) AS r, list_avg({_TR}[-14:]) AS atr,
  list_sum(list_transform({_DX}, lambda x: greatest(x, 0))) AS up, list_sum(list_transform({_DX}, lambda x: greatest(-x, 0))) AS down,
  {_sql_ema("c", 80, 20)} AS ema20, {_sql_ema("c", 120, 50)} AS ema50, {_sql_ema("c4", 80, 20)} AS htf_ema20, {_sql_ema("c4", 120, 50)} AS htf_ema50 FROM a0),
a2 AS (SELECT *, atr / latest AS atr_pct, CASE WHEN len(c) <= 14 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi14,
  list_stddev_pop(r[-48:]) * sqrt(96::double) AS realized_vol, list_stddev_pop(r[-12:]) * sqrt(96::double) AS short_vol, r[-96:] AS r96,
  c[-1] / c[-5] - 1 AS roc, CASE WHEN len(c4) >= 5 THEN latest / c4[-5] - 1 ELSE 0 END AS htf_roc FROM a1),
a3 AS (SELECT *, CASE WHEN realized_vol > 0 THEN short_vol / realized_vol ELSE 1 END AS vol_expansion, list_avg(r96) AS g_m, list_stddev_pop(r96) AS g_sigma,
  greatest(latest * greatest(atr_pct, 0.004::double), 1e-9::double) AS scale FROM a2),
a4 AS (SELECT *, greatest(g_sigma * g_sigma, 1e-12::double) AS w, greatest(g_sigma, 1e-6::double) AS g, {_cl("(ema20 - ema50) / scale * 0.5::double", -1, 1)} AS trend, {_cl("(htf_ema20 - htf_ema50) / scale * 0.35::double", -1, 1)} AS htf_trend,
  {_cl("(roc + htf_roc * 0.8::double) / greatest(atr_pct * 3, 0.006::double)", -1, 1)} AS momentum, CASE WHEN rsi14 > 72 THEN -0.35::double WHEN rsi14 < 28 THEN 0.35::double ELSE 0::double END AS rsi_signal,
  CASE WHEN vol_expansion > 1.6 THEN -0.15::double WHEN vol_expansion < 0.65 THEN -0.05::double ELSE 0.1::double END AS vol_score,
  g_m * 4 AS mh, g_sigma * 2 AS hv, exp(g_m * 4 + 0.5::double * g_sigma * g_sigma * 4) - 1 AS g_expected FROM a3),
a5 AS (SELECT *, CASE WHEN g_sigma > 0 THEN {_cdf("(mh / greatest(hv, 1e-9::double))")} ELSE 0.5::double END AS g_up, {_HMM} AS p FROM a4),
a6 AS (SELECT *, {_cl("(g_up - 0.5::double) * 2 * 0.7::double + CASE WHEN hv > 0 THEN " + _cl("g_expected / greatest(hv * 1.5::double, 1e-9::double)", -1, 1) + " ELSE 0 END * 0.3::double", -1, 1)} AS g_signal,
  p.a AS m_bull, p.b AS m_bear, p.c AS m_range, greatest(p.a, p.b, p.c) AS m_confidence FROM a5),
a7 AS (SELECT *, CASE WHEN m_bull = m_confidence THEN 'bull' WHEN m_bear = m_confidence THEN 'bear' ELSE 'range' END AS m_regime, {_cl("m_bull - m_bear", -1, 1)} AS m_signal FROM a6),
fits AS (SELECT symbol, k, ga, gb, w, r96[-1] AS lr, {_GARCH} AS f FROM a7, (VALUES {_GRID}) grid(k, ga, gb)),
best AS (SELECT symbol, ga AS v_alpha, gb AS v_beta, sqrt(greatest(w * (1 - ga - gb) + ga * lr * lr + gb * f.v, 1e-12::double)) AS v_forecast, sqrt(w) AS base FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY f.l DESC, k) AS rn FROM fits) WHERE rn = 1),
a8 AS (SELECT *, v_forecast / base AS v_ratio, {_cl("1.25::double - 0.35::double * (v_forecast / base)", 0, 1)} AS v_stability FROM a7 JOIN best USING (symbol)),
a9 AS (SELECT *, 0.65::double + 0.35::double * v_stability AS v_confidence, {_cl(f"trend * {_K['trend']}::double + htf_trend * {_K['htf']}::double + momentum * {_K['momentum']}::double + rsi_signal * {_K['rsi']}::double + g_signal * {_K['gbm']}::double + m_signal * {_K['hmm']}::double", -1, 1)} AS direction FROM a8),
m AS (SELECT *, {_cl("direction * v_confidence", -1, 1)} AS math_signal, CASE WHEN m_confidence >= 0.55 THEN 'hmm_' || m_regime WHEN abs(trend + htf_trend) > 0.8 THEN 'trend' WHEN vol_expansion > 1.6 THEN 'high_volatility' WHEN abs(momentum) < 0.25 THEN 'range' ELSE 'transition' END AS regime FROM a9)"""


def _pick(keys: str, cols: list[str]) -> str:
    return f"WITH {MARKET_SQL} SELECT {keys}, " + ", ".join(f"round({c}, {R}) AS {c}" for c in cols) + " FROM m"


_Q = M.QUALITY_WEIGHTS
_QUAL = f"(abs(trend) * {_Q['trend']} + abs(momentum) * {_Q['momentum']} + greatest(vol_score, -0.1) * {_Q['vol']} + 0.5 * {_Q['liquidity']} + abs(g_signal) * {_Q['gbm']} + v_stability * {_Q['garch']} + abs(m_signal) * m_confidence * {_Q['hmm']} + 0.5 * {_Q['markowitz']} + 0.5 * {_Q['poisson']} + 0.5 * {_Q['bayes']})::double / {sum(_Q.values())}::double"
CANDIDATES_SQL = f"""WITH {MARKET_SQL},
c1 AS (SELECT *, math_signal AS combined, {_cl("(m_confidence - 1::double / 3) * 0.035::double + (v_stability - 0.5::double) * 0.025::double + abs(g_signal) * 0.01::double", -0.02, 0.035)} AS boost,
  {_cl("greatest(atr_pct * 1.9::double, v_forecast * 2.5::double, 0.006::double)", 0.006, 0.09)} AS risk, CASE WHEN abs(math_signal) > 0.65 THEN 1.65::double ELSE 1.45::double END AS rr FROM m),
c2 AS (SELECT *, {_cl("0.5::double + abs(combined) * 0.18::double + vol_score * 0.05::double - 0.02::double + boost + " + _cl(f"({_QUAL} - 0.45::double) * 0.06::double", -0.04, 0.04), 0.35, 0.86)} AS base_win, CASE WHEN combined > 0 THEN 'long' ELSE 'short' END AS side FROM c1),
c3 AS (SELECT *, {_cl("exp(abs(combined) * 0.75::double + greatest(0, boost) * 7 + greatest(0, vol_score) * 0.35::double)", 0.35, 2.8)} AS lw, {_cl("exp(greatest(0, -vol_score) * 0.4::double + least(2, 0.0016::double / risk) * 0.28::double)", 0.35, 2.8)} AS ll FROM c2),
c4 AS (SELECT *, {_cl("base_win * 0.7::double + " + _cl("base_win * lw / (base_win * lw + (1 - base_win) * ll)", 0.35, 0.86) + " * 0.3::double", 0.35, 0.86)} AS win_rate, {_cl("(1 + 0.0016::double / risk) / (1 + rr)", 0.05, 0.95)} AS break_even,
  0.045::double + 0.07::double + CASE WHEN contains(regime, 'transition') THEN 0.04::double WHEN contains(regime, 'high_volatility') THEN 0.03::double WHEN contains(regime, 'range') THEN 0.015::double ELSE 0::double END
  + {_cl("(greatest(vol_expansion, v_ratio) - 1.15::double) * 0.025::double", 0, 0.04)} + 0.03::double - {_cl("(abs(combined) - 0.5::double) * 0.025::double", 0, 0.015)} AS margin FROM c3),
c5 AS (SELECT *, win_rate * risk * rr - (1 - win_rate) * risk - 0.0016::double AS expectancy, greatest(0.45::double, break_even + 0.01::double) AS low FROM c4),
c6 AS (SELECT *, expectancy / risk AS expectancy_r, greatest(low, least(greatest(low, 0.78::double), break_even + margin)) AS threshold, {_cl("(rr * win_rate - (1 - win_rate)) / rr", 0, 0.35)} AS kelly, CASE WHEN combined > 0 THEN 1 ELSE -1 END AS sg FROM c5)
SELECT symbol, side, CASE WHEN expectancy > 0 AND win_rate >= threshold THEN 'passed' ELSE 'watch' END AS status, regime, round(combined, 6) AS combined, round(win_rate, 6) AS win_rate, round(risk, 6) AS risk, round(rr, 6) AS rr,
  round(expectancy, 6) AS expectancy, round(expectancy_r, 6) AS expectancy_r, round(threshold, 6) AS threshold, round(least(kelly * 0.2::double, 0.005::double), 6) AS position_risk,
  round(latest * (1 - sg * risk), 6) AS stop_loss, round(latest * (1 + sg * risk * rr), 6) AS take_profit
FROM c6 ORDER BY c6.expectancy_r DESC, symbol LIMIT 5"""

QUERIES = {
    "candles_1h": lambda s, d: bars(_ticks(s, d), 1),
    "candles_4h": lambda s, d: bars(_ticks(s, d), 4),
    "log_returns": log_returns, "atr14": atr14, "rsi14": rsi14, "roc": roc, "realized_vol": realized_vol, "mfe_mae": mfe_mae, "oi_change_lag": oi_change, "rank_trend": rank_trend,
    "ema_trend": lambda s, d: _rounded(market_rows(s, d), ["symbol"], ["ema20", "ema50", "htf_ema20", "htf_ema50", "trend", "htf_trend"]),
    "gbm_signal": lambda s, d: _rounded(market_rows(s, d), ["symbol"], ["g_m", "g_sigma", "g_expected", "g_up", "g_signal"]),
    "garch_grid": lambda s, d: _rounded(market_rows(s, d), ["symbol"], ["v_alpha", "v_beta", "v_forecast", "v_ratio", "v_stability", "v_confidence"]),
    "hmm_regime": lambda s, d: _rounded(market_rows(s, d), ["symbol", "m_regime"], ["m_bull", "m_bear", "m_range", "m_confidence", "m_signal"]),
    "direction_score": lambda s, d: _rounded(market_rows(s, d), ["symbol"], ["trend", "htf_trend", "momentum", "rsi_signal", "g_signal", "m_signal", "direction", "math_signal"]),
    "market_analysis": lambda s, d: _rounded(market_rows(s, d), ["symbol", "regime"], MARKET_COLS),
    "candidates_topk": candidates_topk, "poisson_burst": poisson_burst, "covariance_pairs": covariance_pairs,
}

_W = "PARTITION BY symbol ORDER BY bar"
ORACLES = {
    "candles_1h": f"SELECT * FROM {sql_bars(1)}",
    "candles_4h": f"SELECT * FROM {sql_bars(4)}",
    "log_returns": f"SELECT symbol, bar, round(ln(close / p), 6) AS r FROM (SELECT *, lag(close) OVER ({_W}) AS p FROM {sql_bars()}) WHERE p > 0",
    "atr14": f"SELECT symbol, bar, round(avg(greatest(high - low, abs(high - p), abs(low - p))) OVER ({_W} ROWS 13 PRECEDING), 6) AS atr14 FROM (SELECT *, lag(close) OVER ({_W}) AS p FROM {sql_bars()}) WHERE p IS NOT NULL",
    "rsi14": f"""SELECT symbol, bar, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi14 FROM (
      SELECT symbol, bar, n, avg(CASE WHEN x > 0 THEN x ELSE 0 END) OVER ({_W} ROWS 13 PRECEDING) AS up, avg(CASE WHEN x < 0 THEN -x ELSE 0 END) OVER ({_W} ROWS 13 PRECEDING) AS down
      FROM (SELECT *, close - lag(close) OVER ({_W}) AS x, row_number() OVER ({_W}) AS n FROM {sql_bars()})) WHERE n > 14""",
    "roc": f"SELECT symbol, bar, round(close / p - 1, 6) AS roc4 FROM (SELECT *, lag(close, 4) OVER ({_W}) AS p FROM {sql_bars()}) WHERE p IS NOT NULL",
    "realized_vol": f"""SELECT symbol, bar, round(v48, 6) AS realized_vol, round(v12, 6) AS short_vol, round(CASE WHEN v48 > 0 THEN v12 / v48 ELSE 1 END, 6) AS expansion FROM (
      SELECT symbol, bar, n, stddev_pop(r) OVER ({_W} ROWS 47 PRECEDING) * sqrt(96::double) AS v48, stddev_pop(r) OVER ({_W} ROWS 11 PRECEDING) * sqrt(96::double) AS v12
      FROM (SELECT *, ln(close / lag(close) OVER ({_W})) AS r, row_number() OVER ({_W}) AS n FROM {sql_bars()}) WHERE n > 1) WHERE n > 48""",
    "mfe_mae": """SELECT symbol, event_id, round(greatest(max(x) OVER w, 0), 6) AS mfe, round(least(min(x) OVER w, 0), 6) AS mae FROM (
      SELECT event_type AS symbol, ts, event_id, value / first_value(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS x FROM events WHERE value > 0) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)""",
    "oi_change_lag": f"SELECT symbol, bar, round(n_ticks / p - 1, 6) AS oi_change FROM (SELECT *, lag(n_ticks) OVER ({_W}) AS p FROM {sql_bars()}) WHERE p > 0",
    "rank_trend": """SELECT symbol, day, rank, delta, best_rank, observations, first_seen, round(0.55 / sqrt(rank) + 0.25 * least(1, observations / 8) + 0.2 * greatest(0, least(1, coalesce(delta, 0) / 10)), 6) AS hotness FROM (
      SELECT symbol, day, rank::int AS rank, (lag(rank) OVER w - rank)::int AS delta, (min(rank) OVER w)::int AS best_rank, (row_number() OVER w)::int AS observations, min(day) OVER w AS first_seen FROM (
        SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, symbol) AS rank FROM (SELECT event_type AS symbol, date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL)) WINDOW w AS (PARTITION BY symbol ORDER BY day))""",
    "ema_trend": _pick("symbol", ["ema20", "ema50", "htf_ema20", "htf_ema50", "trend", "htf_trend"]),
    "gbm_signal": _pick("symbol", ["g_m", "g_sigma", "g_expected", "g_up", "g_signal"]),
    "garch_grid": _pick("symbol", ["v_alpha", "v_beta", "v_forecast", "v_ratio", "v_stability", "v_confidence"]),
    "hmm_regime": _pick("symbol, m_regime", ["m_bull", "m_bear", "m_range", "m_confidence", "m_signal"]),
    "direction_score": _pick("symbol", ["trend", "htf_trend", "momentum", "rsi_signal", "g_signal", "m_signal", "direction", "math_signal"]),
    "market_analysis": _pick("symbol, regime", MARKET_COLS),
    "candidates_topk": CANDIDATES_SQL,
    "poisson_burst": f"""SELECT symbol, bar, round(lam, 6) AS lam, round(tail, 6) AS tail, round(1 - tail, 6) AS burst, round(greatest(-3, least(3, (n_ticks - lam) / sqrt(lam + 1e-9::double))), 6) AS cluster_score FROM (
      SELECT *, CASE WHEN n_ticks <= 0 THEN 1 ELSE greatest(0::double, least(1::double, 1 - list_sum(list_transform(range(0, n_ticks), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1)))))) END AS tail
      FROM (SELECT *, avg(n_ticks) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS lam FROM {sql_bars()}) WHERE lam IS NOT NULL)""",
    "covariance_pairs": f"""WITH r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS k, r FROM (SELECT *, ln(close / lag(close) OVER ({_W})) AS r FROM {sql_bars()}) WHERE r IS NOT NULL)
      SELECT x.symbol AS a, y.symbol AS b, round(covar_pop(x.r, y.r), 6) AS covariance, count(*) AS n FROM r x JOIN r y USING (k) WHERE k <= 96 AND x.symbol <= y.symbol GROUP BY ALL""",
}
