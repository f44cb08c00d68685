"""Further SQL queries: position exit scores, source handling and formatting."""

from __future__ import annotations

from tickloom.plans.sql_catalog import SIGNALS, TICKS, duck, run

SPARK = {
    # Long positions opened at each user's first tick, without a candidate: no reversal, even odds; 21.6 hours of holding at most.
    "exit_score": f"""WITH {TICKS}, {SIGNALS}, l AS (SELECT symbol, max_by(price, event_id) AS latest, max(ts) AS seen FROM k GROUP BY symbol),
      x AS (SELECT s.symbol, s.user_id, s.entry, latest, (cast(cast(seen AS timestamp) AS double) - cast(cast(opened AS timestamp) AS double)) AS age, greatest(0e0, s.entry * 1.1e0 / latest - 1) AS reward, greatest(0e0, 1 - s.entry * 9e-1 / latest) AS risk FROM sig s JOIN l ON s.symbol = l.symbol),
      y AS (SELECT *, 5e-1 * reward - 5e-1 * risk - 8e-4 AS rem, greatest(0e0, least(1e0, age / 77760e0)) AS time_decay FROM x),
      z AS (SELECT *, greatest(0e0, least(1e0, -rem / greatest(reward + risk, 5e-3))) AS decay FROM y),
      w AS (SELECT *, decay * 2.38e-1 + time_decay * 1.58e-1 AS score, time_decay >= 1 AS expired, age >= 600 AND rem <= -1.5e-3 AS negative FROM z)
      SELECT symbol, user_id, round(rem, 6) AS remaining_expectancy, round(score, 6) AS score, expired, expired OR negative OR score >= 6.8e-1 AS recommends_exit,
        CASE WHEN expired OR negative OR score >= 6.8e-1 OR age < 1200 OR NOT (rem <= 1.1e-2 OR rem <= 8e-4) THEN 0e0 WHEN rem <= 0 OR rem / 2e-2 <= 2.5e-1 THEN 5e-1 ELSE 2.5e-1 END AS de_risk FROM w""",
    "source_fallback": """WITH u AS (SELECT o_custkey, o_totalprice AS price, 0 AS pri, o_orderkey FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice AS price, 1 AS pri, o_orderkey FROM {orders} WHERE o_orderstatus <> 'F'),
      r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pri, o_orderkey, price) AS n FROM u) SELECT o_custkey, price, pri FROM r WHERE n = 1""",
    "ttl_cache": """WITH g AS (SELECT event_type, max_by(value, event_id) AS value, max(ts) AS seen FROM {events} WHERE value > 1 GROUP BY event_type), n AS (SELECT max(ts) AS now FROM {events})
      SELECT event_type, value, CASE WHEN seen >= now - INTERVAL 1 HOUR THEN true ELSE false END AS fresh FROM g CROSS JOIN n""",
    "source_status": "SELECT event_type AS source, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS latency, max(ts) AS last_seen FROM {events} GROUP BY event_type",
    "union_messages": "SELECT kind, count(*) AS n, cast(max(length(body)) AS bigint) AS longest FROM (SELECT 'document' AS kind, text AS body FROM {documents} UNION ALL SELECT 'page' AS kind, url AS body FROM {pages} UNION ALL SELECT 'benchmark' AS kind, text AS body FROM {benchmark} UNION ALL SELECT 'turn' AS kind, text AS body FROM {conversations}) z GROUP BY kind",
    "price_bands": "SELECT CASE WHEN value >= 1e3 THEN 2 WHEN value >= 1e0 THEN 4 ELSE 6 END AS digits, count(*) AS n FROM {events} GROUP BY 1",
    "key_mask": "SELECT c_custkey, concat(substring(c_name, 1, 4), '****', substring(c_name, length(c_name) - 3, 4)) AS masked FROM {customer}",
    "timestamp_normalise": "SELECT event_id, CASE WHEN raw < 10000000000 THEN raw * 1000 ELSE raw END AS ms FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1704067200 + event_id ELSE 1704067200000 + event_id END AS raw FROM {events}) z",
    "binary_probabilities": "SELECT s_suppkey, round(a / (a + b), 6) AS yes, round(b / (a + b), 6) AS no, round(a / b, 6) AS ratio FROM (SELECT s_suppkey, abs(s_acctbal) + 1e0 AS a, s_nationkey + 1e0 AS b FROM {supplier}) z",
    "equity_points": "WITH e AS (SELECT o_custkey, o_orderdate, o_orderkey, round(o_totalprice / 5e4) AS equity FROM {orders}), g AS (SELECT *, lag(equity) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM e) SELECT o_custkey, o_orderkey, equity FROM g WHERE prev IS NULL OR prev <> equity",
    "replacement_pair": f"WITH {TICKS}, l AS (SELECT symbol, user_id, max_by(price, event_id) AS price FROM k GROUP BY symbol, user_id) SELECT a.user_id, round(a.price, 4) AS own, round(b.price, 4) AS replacement, round(b.price / a.price - 1, 6) AS edge FROM l a JOIN l b ON a.user_id = b.user_id WHERE a.symbol = 'click' AND b.symbol = 'view'",
    "partition_totals": "SELECT n_regionkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey",
}
QUERIES = {k: run(v) for k, v in SPARK.items()}
ORACLES = {k: duck(v.replace("cast(cast(seen AS timestamp) AS double)", "epoch(seen)").replace("cast(cast(opened AS timestamp) AS double)", "epoch(opened)")) for k, v in SPARK.items()}
