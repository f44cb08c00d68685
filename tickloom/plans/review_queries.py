"""Calibration kept up batch by batch, exit factors, portfolio variance, explanations and held observations; oracles written apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import exits, review
from tickloom.plans.position_queries import POSITION
from tickloom.session import table


def _outcomes(s, d):
    """Line items as trades: mode, predicted and actual."""
    t = table(s, d, "lineitem")
    return t.select(F.col("l_returnflag").alias("mode"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_quantity") / 50).alias("p"), (F.col("l_discount") > F.col("l_tax")).alias("won"))


def _state(t):
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    return t.groupBy("mode").agg(F.count(F.lit(1)).alias("samples"), F.count_if("won").alias("wins"), F.avg(p).alias("pred"), F.avg(F.pow(p - F.col("won").cast("int"), F.lit(2))).alias("brier"))


def calibration(s, d):
    """The state of earlier trades with that of later ones: running means by their numbers, without the earlier trades themselves."""
    t = _outcomes(s, d)
    both = _state(t.where("day < '1995-01-01'")).unionAll(_state(t.where("day >= '1995-01-01'")))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("samples")) / F.sum("samples"), 6)
    return both.groupBy("mode").agg(F.sum("samples").alias("samples"), F.sum("wins").alias("wins"), mean("pred").alias("pred"), mean("brier").alias("brier"))


CALIBRATION_SQL = """SELECT l_returnflag AS mode, count(*) AS samples, count(*) FILTER (l_discount > l_tax) AS wins, round(avg(least(1, l_quantity / 50.0::double)), 6) AS pred, round(avg((least(1, l_quantity / 50.0::double) - (l_discount > l_tax)::int) ** 2), 6) AS brier FROM lineitem GROUP BY 1"""


def exit_factors(s, d):
    """Statistics of the six exit factors against what the exit avoided (here the price's later move by the supplier's number)."""
    p = exits.exit_scores(s.sql(f"SELECT {POSITION}, cast(l_suppkey % 21 - 10 AS double) / 1e1 AS avoided FROM {{lineitem}}", lineitem=table(s, d, "lineitem")))
    u = p.select("avoided", F.inline(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("x")) for k in exits.FACTORS])))
    y = F.when(F.col("avoided") > 0, 1.0).otherwise(-1.0)
    flat = (F.count("x") < 3) | (F.stddev_pop("x") < 1e-12) | (F.stddev_pop("avoided") < 1e-12)
    return u.groupBy("factor").agg(F.count("x").alias("n"), F.count_if(F.abs("x") > 0.01).alias("active"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.avg(F.col("x") * y), 6).alias("agreement"), F.round(F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop("x", "avoided"), F.stddev_pop("x") * F.stddev_pop("avoided"))), 6).alias("association"))


def _exit_factors_sql() -> str:
    from tickloom.plans.position_queries import EXIT_SQL

    body = EXIT_SQL.rsplit("\nSELECT", 1)[0].replace("FROM lineitem)", ", (l_suppkey % 21 - 10) / 10.0::double AS avoided FROM lineitem)", 1)
    cols = {"signal_reversal": "signal_reversal", "net_expectancy_decay": "net_expectancy_decay", "event_decay": "event_decay", "time_decay": "time_decay", "capital_efficiency": "0.0::double", "profit_protection": "least(1e0, profit_protection)"}
    u = " UNION ALL ".join(f"SELECT '{k}' AS factor, ({c})::double AS x, avoided FROM g" for k, c in cols.items())
    return f"""{body}, u AS ({u})
SELECT factor, count(*) AS n, count(*) FILTER (abs(x) > 0.01) AS active, round(avg(x), 6) AS mean, round(avg(x * CASE WHEN avoided > 0 THEN 1 ELSE -1 END), 6) AS agreement, round(CASE WHEN stddev_pop(x) < 1e-12 THEN 0 ELSE corr(x, avoided) END, 6) AS association FROM u GROUP BY factor"""


def portfolio(s, d):
    """Return and variance of a portfolio that holds the symbols by their ticks' numbers: weights and covariances of daily returns, summed over pairs."""
    e = table(s, d, "events").where("value > 0").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("p"), F.count(F.lit(1)).alias("n"))
    r = e.withColumn("r", F.log(F.col("p") / F.lag("p").over(Window.partitionBy("symbol").orderBy("day")))).where("r is not null")
    every = r.groupBy("day").agg(F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("symbol", "r")).alias("rs")).where("k = 5").select("day", F.inline("rs"))
    w = e.groupBy("symbol").agg(F.sum("n").alias("m"))
    w = w.crossJoin(w.agg(F.sum("m").alias("all"))).select("symbol", (F.col("m") / F.col("all")).alias("w"))
    x = every.join(F.broadcast(w), "symbol")  # a row a symbol
    pairs = x.join(x.toDF("symbol_b", "day", "rb", "wb"), "day").groupBy("symbol", "symbol_b").agg((F.first("w") * F.first("wb") * F.covar_pop("r", "rb")).alias("c"))
    mean = x.groupBy("symbol").agg((F.first("w") * F.avg("r")).alias("m"))
    return mean.agg(F.sum("m").alias("m")).crossJoin(pairs.agg(F.sum("c").alias("v"))).select(F.round("m", 8).alias("expected"), F.round("v", 8).alias("variance"))


PORTFOLIO_SQL = """WITH e AS (SELECT event_type AS symbol, ts::date AS day, avg(value) AS p, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2), w AS (SELECT symbol, sum(n) / (SELECT sum(n) FROM e) AS w FROM e GROUP BY symbol),
r AS (SELECT symbol, day, ln(p / lag(p) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM e), d AS (SELECT day, sum(w * r) AS pr FROM r JOIN w USING (symbol) WHERE r IS NOT NULL GROUP BY day HAVING count(*) = 5)
SELECT round(avg(pr), 8) AS expected, round(var_pop(pr), 8) AS variance FROM d"""


def explanations(s, d):
    t = table(s, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "short").otherwise("long").alias("side"), ((F.col("l_discount") - 0.04) * 100).alias("gross"), ((F.col("l_discount") - 0.04 - F.col("l_tax") / 10) * 100).alias("net"), F.lit(2.0).alias("risk"),
        F.when(F.col("l_returnflag") == "R", "SL").otherwise("TIME").alias("reason"), F.create_map(F.lit("trend"), F.col("l_quantity") / 25 - 1, F.lit("momentum"), F.col("l_tax") * 10, F.lit("rsi"), F.lit(-0.3)).alias("signals"),
    )
    e = review.explain(t, {"trend": 0.5, "momentum": 0.3, "rsi": 0.2})
    return e.select("id", "class", F.round("net_r", 6).alias("net_r"), F.round("score", 6).alias("score"), "right", F.col("strongest")[0]["factor"].alias("strongest"))


EXPLAIN_SQL = """WITH t AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_linenumber % 2 = 0 AS short, (l_discount - 0.04::double) * 100 AS gross, (l_discount - 0.04::double - l_tax / 10) * 100 AS net, l_returnflag = 'R' AS sl, 0.5::double * (l_quantity / 25.0::double - 1) AS a, 0.3::double * (l_tax * 10) AS b, -0.06::double AS c FROM lineitem)
SELECT id, CASE WHEN net > 0 THEN 'profitable' WHEN gross > 0 THEN 'cost_drag' WHEN sl THEN 'stop_loss' ELSE 'direction_or_timing_error' END AS class, round(net / 2, 6) AS net_r, round(a + b + c, 6) AS score,
  sign(a + b + c) = CASE WHEN gross >= 0 THEN 1 ELSE -1 END * CASE WHEN short THEN -1 ELSE 1 END AS right, CASE WHEN abs(b) >= abs(a) AND abs(b) >= abs(c) THEN 'momentum' WHEN abs(c) >= abs(a) AND abs(c) > abs(b) THEN 'rsi' ELSE 'trend' END AS strongest FROM t"""

QUERIES = {"calibration_incremental": calibration, "exit_factor_stats": exit_factors, "portfolio_variance": portfolio, "trade_explanations": explanations}
ORACLES = {"calibration_incremental": CALIBRATION_SQL, "exit_factor_stats": _exit_factors_sql(), "portfolio_variance": PORTFOLIO_SQL, "trade_explanations": EXPLAIN_SQL}
