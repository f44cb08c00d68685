"""Exit scores of the line items as open positions, and the stored history of trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import account, exits
from tickloom.session import table
from tickloom.sources import storage

_MODES, _REGIMES = ["math_only", "event_math", "event_impact"], ["hmm_bull", "hmm_bear", "range", "transition", "trend", "other"]


def _pick(names, key):
    return "CASE " + key + "".join(f" WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


#: A line item as a position; written so that both engines read it.
POSITION = f"""l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'short' ELSE 'long' END AS side, {_pick(_MODES, "l_linenumber % 3")} AS mode, {_pick(_REGIMES, "l_partkey % 6")} AS regime,
  1e2 AS entry, CASE WHEN l_linenumber % 2 = 0 THEN 96e0 ELSE 104e0 END AS take_profit, CASE WHEN l_linenumber % 2 = 0 THEN 102e0 ELSE 98e0 END AS stop_loss, 98e0 + l_suppkey % 50 / 1e1 AS price, l_quantity / 4e0 AS age_hours,
  CASE WHEN l_partkey % 2 = 0 THEN l_quantity / 8e0 END AS event_age_hours, CASE WHEN l_partkey % 4 = 0 THEN 24e0 ELSE 6e0 END AS event_half_life, 2e-3 + l_discount / 5 AS atr_pct, 5e-4 AS fee_rate, 2e-4 AS slippage_rate, (l_tax - 4e-2) / 1e2 AS funding_rate,
  CASE l_suppkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' END AS candidate_side, 4e-1 + l_discount * 4 AS candidate_win_rate, l_tax * 12 AS candidate_direction, l_discount * 5 AS profit_protection, l_tax / 4 AS expectancy_pct"""
_OUT = ["signal_reversal", "net_expectancy_decay", "event_decay", "time_decay", "profit_protection", "score", "threshold", "expectancy", "max_hours", "horizon_hours"]


def exit_score(s, d):
    p = s.sql(f"SELECT {POSITION} FROM {{lineitem}}", lineitem=table(s, d, "lineitem"))
    return exits.exit_scores(p).select("l_orderkey", "l_linenumber", "kind", *[F.round(c, 9).alias(c) for c in _OUT], "expired", "negative", "exit", "de_risk", F.col("de_risk_fraction"), "confirmations")


EXIT_SQL = f"""WITH p AS (SELECT {POSITION} FROM lineitem),
a AS (SELECT *, CASE regime WHEN 'transition' THEN 'transition' WHEN 'range' THEN 'range' WHEN 'hmm_bull' THEN CASE side WHEN 'short' THEN 'transition' ELSE 'trend' END WHEN 'hmm_bear' THEN CASE side WHEN 'long' THEN 'transition' ELSE 'trend' END WHEN 'trend' THEN 'trend' ELSE 'unknown' END AS kind,
  greatest(0, CASE side WHEN 'long' THEN take_profit / price - 1 ELSE 1 - take_profit / price END) AS reward, greatest(0, CASE side WHEN 'long' THEN 1 - stop_loss / price ELSE stop_loss / price - 1 END) AS risk,
  CASE WHEN candidate_side IS NULL THEN 5e-1 ELSE greatest(5e-2, least(95e-2, CASE WHEN candidate_side = side THEN candidate_win_rate ELSE 1 - candidate_win_rate END)) END AS chance, greatest(0, CASE side WHEN 'long' THEN funding_rate ELSE -funding_rate END) AS fund FROM p),
b AS (SELECT *, chance * reward - (1 - chance) * risk - 7e-4 - fund AS expectancy, greatest(4e0, least(24e0, CASE mode WHEN 'event_impact' THEN 8 WHEN 'event_math' THEN 12 ELSE 18 END * greatest(65e-2, least(135e-2, 12e-3 / greatest(1e-3, atr_pct))) * CASE kind WHEN 'trend' THEN 115e-2 WHEN 'range' THEN 85e-2 WHEN 'transition' THEN 75e-2 ELSE 1e0 END)) AS max_hours FROM a),
c AS (SELECT *, CASE WHEN candidate_side <> side THEN least(1e0, candidate_direction) ELSE 0e0 END AS signal_reversal, greatest(0e0, least(1e0, -expectancy / greatest(reward + risk, 5e-3))) AS net_expectancy_decay,
  coalesce(1 - 5e-1 ** (event_age_hours / event_half_life), 0e0) AS event_decay, least(1e0, age_hours / max_hours) AS time_decay FROM b),
e AS (SELECT *, signal_reversal * 277e-3 + net_expectancy_decay * 238e-3 + event_decay * 119e-3 + time_decay * 158e-3 + least(1e0, profit_protection) * 12e-2 AS score, time_decay >= 1 AS expired, age_hours >= 1 / 6e0 AND expectancy <= -15e-4 AS negative,
  CASE kind WHEN 'trend' THEN 72e-2 WHEN 'range' THEN 64e-2 WHEN 'transition' THEN 62e-2 ELSE 68e-2 END AS base FROM c),
f AS (SELECT *, CASE WHEN expired OR negative THEN least(base, score) ELSE base END AS threshold, expired OR negative OR score >= base AS exit FROM e),
g AS (SELECT *, NOT exit AND age_hours >= 1 / 3e0 AND (expectancy_pct > 0 AND expectancy <= expectancy_pct * 55e-2 OR expectancy <= 7e-4 + fund) AS de_risk FROM f)
SELECT l_orderkey, l_linenumber, kind, round(signal_reversal, 9) AS signal_reversal, round(net_expectancy_decay, 9) AS net_expectancy_decay, round(event_decay, 9) AS event_decay, round(time_decay, 9) AS time_decay, round(least(1e0, profit_protection), 9) AS profit_protection,
  round(score, 9) AS score, round(threshold, 9) AS threshold, round(expectancy, 9) AS expectancy, round(max_hours, 9) AS max_hours, round(greatest(1e0, least(4e0, max_hours / 4)), 9) AS horizon_hours, expired, negative, exit, de_risk,
  CASE WHEN NOT de_risk THEN 0e0 WHEN expectancy <= 0 OR expectancy_pct > 0 AND expectancy / expectancy_pct <= 25e-2 THEN 5e-1 ELSE 25e-2 END AS de_risk_fraction, CASE WHEN expired THEN 1 ELSE 3 END AS confirmations FROM g"""


def _trades(s, d, later: bool):
    """Orders as trades; the later batch has every third one again with another result, and some without an id or a date."""
    o = table(s, d, "orders")
    o = o.where("o_orderkey % 3 = 0") if later else o.where("o_orderkey % 5 < 4")
    pnl = F.col("o_totalprice") * (F.lit(2.0) if later else F.lit(1.0))
    return o.select(F.when(F.col("o_orderkey") % 97 > 0, F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 89 > 0, F.col("o_orderdate").cast("timestamp")).alias("closed_at"), F.round(pnl, 2).alias("realized_pnl"), F.col("o_orderpriority").alias("mode"))


def upsert(s, d):
    return storage.merged(_trades(s, d, False), _trades(s, d, True)).select("id", F.unix_seconds("closed_at").alias("closed_s"), "realized_pnl", "mode", "month")


def manifest(s, d):
    m = storage.manifest(storage.merged(_trades(s, d, False), _trades(s, d, True)))
    return m.select("month", "records", F.unix_seconds("first_closed_at").alias("first_s"), F.unix_seconds("last_closed_at").alias("last_s"))


_KEPT = """k AS (SELECT o_orderkey AS id, epoch(o_orderdate::timestamp)::bigint AS closed_s, round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, 2) AS realized_pnl, o_orderpriority AS mode, strftime(o_orderdate, '%Y-%m') AS month
  FROM orders WHERE (o_orderkey % 5 < 4 OR o_orderkey % 3 = 0) AND o_orderkey % 97 > 0 AND o_orderkey % 89 > 0)"""
UPSERT_SQL = f"WITH {_KEPT} SELECT * FROM k"
MANIFEST_SQL = f"WITH {_KEPT} SELECT month, count(*) AS records, min(closed_s) AS first_s, max(closed_s) AS last_s FROM k GROUP BY month UNION ALL SELECT 'total', count(*), min(closed_s), max(closed_s) FROM k"


def retention(s, d):
    """Archives of each customer (their orders: newest first, the price is the size): at most 4 and 600,000 bytes, larger ones passed over."""
    a = table(s, d, "orders").where("o_custkey % 10 = 1").select(F.col("o_custkey").alias("log"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp").alias("at"), F.floor("o_totalprice").cast("bigint").alias("size"))
    return storage.retained(a, 4, 600_000).select("log", "path", "kept")


RETENTION_SQL = """WITH RECURSIVE a AS (SELECT o_custkey AS log, o_orderkey::varchar AS path, floor(o_totalprice)::bigint AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::varchar DESC) AS n FROM orders WHERE o_custkey % 10 = 1),
r AS (SELECT log, path, n, size <= 600000 AS kept, CASE WHEN size <= 600000 THEN size ELSE 0 END AS bytes, CASE WHEN size <= 600000 THEN 1 ELSE 0 END AS files FROM a WHERE n = 1
  UNION ALL SELECT a.log, a.path, a.n, files < 4 AND bytes + size <= 600000, bytes + CASE WHEN files < 4 AND bytes + size <= 600000 THEN size ELSE 0 END, files + CASE WHEN files < 4 AND bytes + size <= 600000 THEN 1 ELSE 0 END FROM r JOIN a ON a.log = r.log AND a.n = r.n + 1)
SELECT log, path, kept FROM r"""

def accounts(s, d):
    """Every user's ticks as an account of its own; each eleventh is a signal, too."""
    e = table(s, d, "events").where("value > 0")
    sig = F.col("event_id") % 11 == 0
    e = e.select(F.col("user_id").alias("account"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), (100 + F.col("value") / 20).alias("price"), F.when(sig & (F.col("event_id") % 2 == 0), "long").when(sig, "short").alias("side"))
    return account.account_replay(e.select("*", F.lit(0.02).alias("stop_pct"), F.lit(1.5).alias("reward"), F.lit(0.6).alias("win_rate"), F.lit(0.005).alias("risk_pct"), F.lit("range").alias("kind")))


def accounts_summary(s, d):
    r = account.account_summary(accounts(s, d))
    return r.select("account", "n", *[F.round(c, 6).alias(c) for c in ("win_rate", "profit_factor", "return", "sharpe")])


QUERIES = {"account_replay": accounts, "account_summary_replayed": accounts_summary, "exit_score": exit_score, "trade_history_upsert": upsert, "trade_history_manifest": manifest, "archive_retention": retention}
ORACLES = {"exit_score": EXIT_SQL, "trade_history_upsert": UPSERT_SQL, "trade_history_manifest": MANIFEST_SQL, "archive_retention": RETENTION_SQL}
