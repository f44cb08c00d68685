"""Queries whose natural form is SQL: aggregates, windows, joins, predicates and table maintenance over the driver tables.

Texts are run by Spark with tables as named arguments, and by DuckDB as they are, but for what
DIALECT replaces. Doubles are written with an exponent, which both engines read as DOUBLE.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: What DuckDB calls otherwise.
DIALECT = [
    (r"\btimestamp_ntz\b", "timestamp"),
    (r"\brlike\(", "regexp_matches("),
    (r"\bcollect_list\(", "list("),
    (r"\btry_divide\((.+?), (.+?)\)", r"(\1 / nullif(\2, 0))"),
    (r"\bunix_millis\((.+?)\)", r"epoch_ms(\1)"),
    (r"\bget_json_object\((\w+), ('\$\.\w+')\)", r"json_extract_string(\1, \2)"),
    (r"\bsha2\((.+?), 256\)", r"sha256(\1)"),
    (r"\bdate_format\((\w+), 'yyyy-MM'\)", r"strftime(\1, '%Y-%m')"),
    (r"\bregexp_replace\(([^()]+|[^()]*\([^()]*\)[^()]*), ('[^']*'), ('[^']*')\)", r"regexp_replace(\1, \2, \3, 'g')"),
    (r"\bstack\((\d+), ", r"unnest(stack_\1, "),
]


def duck(sql: str) -> str:
    for a, b in DIALECT:
        sql = re.sub(a, b, sql)
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql).replace("{{", "{").replace("}}", "}")


def run(sql: str):
    used = [t for t in TABLES if "{" + t + "}" in sql]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    return query


#: Trades of the line items; a trade's risk is a tenth of its price.
TRADES = """t AS (SELECT o_custkey AS account, concat('P', cast(l_partkey % 20 AS string)) AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'short' ELSE 'long' END AS side, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice AS notional, l_extendedprice * (l_discount - l_tax) AS pnl, l_extendedprice * l_discount AS gross, l_quantity / 50e0 AS win_rate, l_returnflag AS mode, l_linestatus AS regime, l_shipdate AS closed_at,
  l_extendedprice * 1e-1 AS risk, l_quantity, l_discount, l_tax FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)"""
T = f"WITH {TRADES}"
#: A total order of the trades but for equal rows.
ORD = "closed_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, notional, l_quantity, l_discount, l_tax"


def cl(x: str, lo: str, hi: str) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


BUCKET = "count(*) AS samples, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, avg(" + cl("win_rate", "0e0", "1e0") + ") AS pred"
CORR = "(pred - (wins + 2e0) / (samples + 4)) * samples / (samples + 30e0)"
FACTORS = "SELECT id, r, y, 'size' AS factor, l_quantity / 25e0 - 1 AS s FROM f UNION ALL SELECT id, r, y, 'discount' AS factor, l_discount * 20e0 - 1 AS s FROM f UNION ALL SELECT id, r, y, 'tax' AS factor, 1 - l_tax * 25e0 AS s FROM f UNION ALL SELECT id, r, y, 'side' AS factor, CASE WHEN side = 'long' THEN 1e0 ELSE -1e0 END AS s FROM f"
BASE_F = f"{TRADES}, f AS (SELECT *, {{}} AS id, pnl / risk AS r, CASE WHEN pnl >= 0 THEN 1e0 ELSE -1e0 END AS y FROM t)"
F0 = "WITH " + TRADES + ", f AS (SELECT *, 0 AS id, pnl / risk AS r, CASE WHEN pnl >= 0 THEN 1e0 ELSE -1e0 END AS y FROM t), u AS (" + FACTORS + ")"
STATS = "SELECT factor, count(*) AS n, count(CASE WHEN abs(s) > 1e-2 THEN 1 END) AS active, avg(s) AS mean, avg(s * y) AS agreement, CASE WHEN count(*) < 3 OR stddev_pop(s) = 0 OR stddev_pop(r) = 0 THEN 0e0 ELSE corr(s, r) END AS association FROM u GROUP BY factor"
EQUITY = """e AS (SELECT o_custkey AS account, o_orderdate AS day, o_orderkey AS id, greatest(c_acctbal, 1e3) AS start, (o_totalprice - 1.5e5) * 1e-2 AS pnl FROM {orders} JOIN {customer} ON o_custkey = c_custkey),
q AS (SELECT *, start + sum(pnl) OVER (PARTITION BY account ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM e),
dd AS (SELECT *, greatest(start, max(equity) OVER (PARTITION BY account ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak, lag(equity) OVER (PARTITION BY account ORDER BY day, id) AS prev FROM q),
rr AS (SELECT *, equity / peak - 1 AS drawdown, CASE WHEN coalesce(prev, start) > 0 THEN equity / coalesce(prev, start) - 1 END AS ret FROM dd)"""
TICKS = "k AS (SELECT event_type AS symbol, ts, event_id, user_id, value AS price FROM {events} WHERE value > 0)"
#: The entry of each user's first tick of a symbol, as a signal of 10 % either way and 72 hours.
SIGNALS = "s AS (SELECT symbol, user_id, min(ts) AS opened FROM k GROUP BY symbol, user_id), sig AS (SELECT s.symbol, s.user_id, s.opened, min(k.price) AS entry FROM s JOIN k ON k.symbol = s.symbol AND k.user_id = s.user_id AND k.ts = s.opened GROUP BY s.symbol, s.user_id, s.opened)"
BULL = "APPROVE APPROVAL INFLOW LISTING DOVISH ADOPTION BUY ACCUMULATION RESERVE PARTNERSHIP LAUNCH REOPEN".split()
BULL = [*BULL, "ETF INFLOW", "RATE CUT"]
BEAR = [*"HACK EXPLOIT LAWSUIT BAN REJECT REJECTION DELIST OUTFLOW HAWKISH DEPEG INSOLV BANKRUPT FREEZE OUTAGE SELL".split(), "RATE HIKE", "SEC CHARG"]
HIGH = "ETF SEC FED FOMC CPI PCE RATE BINANCE OKX TETHER USDT USDC STABLECOIN HACK EXPLOIT DELIST APPROVAL REJECTION POLYMARKET LIQUIDATION".split()


def terms(words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(up, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


#: Documents as messages: one a minute from the first of 2024, the source's number gives its outlet.
MESSAGES = """m0 AS (SELECT doc_id, text, upper(text) AS up, lang, source, doc_id % 4320 AS age, CASE doc_id % 7 WHEN 0 THEN 'Federal Reserve' WHEN 1 THEN 'CNBC Markets' WHEN 2 THEN 'Decrypt' WHEN 3 THEN 'Binance' WHEN 4 THEN 'NewsNow' WHEN 5 THEN 'WhaleAlert' ELSE source END AS outlet FROM {documents}),
m1 AS (SELECT *, CASE WHEN rlike(upper(outlet), 'FEDERAL RESERVE|SEC PRESS|ECB PRESS|CFTC |BINANCE|OKX') THEN 1 WHEN rlike(upper(outlet), 'NPR WORLD|CNBC |GDELT|WALLSTREETCN') THEN 2 WHEN rlike(upper(outlet), 'COINTELEGRAPH|DECRYPT|BITCOIN MAGAZINE|FASTBULL|MKTNEWS|XUEQIU') THEN 3 ELSE 4 END AS tier FROM m0),
m2 AS (SELECT *, CASE tier WHEN 1 THEN 1.15e0 WHEN 2 THEN 1.03e0 WHEN 3 THEN 9.2e-1 ELSE 8e-1 END AS weight,
  CASE WHEN outlet = 'WhaleAlert' THEN 2e0 WHEN outlet = 'NewsNow' THEN 4e0 WHEN outlet = 'Binance' THEN 1.2e1 WHEN tier = 1 THEN 7.2e1 ELSE 2.4e1 END AS half_life,
  CASE WHEN outlet = 'WhaleAlert' THEN 10 / 6e1 WHEN outlet = 'NewsNow' THEN 2.5e-1 WHEN outlet = 'Binance' THEN 5e-1 WHEN tier = 1 THEN 1e0 ELSE 5e-1 END AS grace FROM m1),
m3 AS (SELECT *, greatest(1.5e-1, least(1e0, exp(-6.931471805599453e-1 * greatest(0e0, age / 6e1 - grace) / half_life))) AS fresh FROM m2)"""
SCORED = MESSAGES + f""",
c0 AS (SELECT *, {terms(BULL)} AS bull, {terms(BEAR)} AS bear, {terms(HIGH)} AS high FROM m3),
c1 AS (SELECT *, CASE WHEN bull > bear THEN 1 WHEN bull < bear THEN -1 ELSE 0 END AS direction, least(1e2, (18 + high * 12 + abs(bull - bear) * 10) * weight) AS raw_impact, rlike(up, 'CRYPTO|BITCOIN|BTC|ETHEREUM|ETH|BINANCE|OKX|STABLECOIN|USDT|USDC|ETF|FED|FOMC|CPI|PCE') AS market_wide FROM c0),
c2 AS (SELECT *, least(1e2, raw_impact * fresh) AS impact FROM c1)"""
TITLE = "trim(regexp_replace(lower(split_part(text, '.', 1)), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"

SPARK: dict[str, str] = {
    # Aggregates and calibration.
    "calibration_grouping_sets": f"{T} SELECT coalesce(mode, '*') AS mode, coalesce(regime, '*') AS regime, samples, wins, samples - wins AS losses, round(pred, 6) AS avg_predicted FROM (SELECT mode, regime, {BUCKET} FROM t GROUP BY GROUPING SETS ((), (mode), (regime)))",
    "winrate_calibration": f"""{T}, g AS (SELECT {BUCKET} FROM t), m AS (SELECT mode, {BUCKET} FROM t GROUP BY mode), r AS (SELECT regime, {BUCKET} FROM t GROUP BY regime),
      x AS (SELECT m.mode, r.regime, {CORR.replace('pred', 'g.pred').replace('wins', 'g.wins').replace('samples', 'g.samples')} AS cg, {CORR.replace('pred', 'm.pred').replace('wins', 'm.wins').replace('samples', 'm.samples')} AS cm, m.samples AS nm,
        {CORR.replace('pred', 'r.pred').replace('wins', 'r.wins').replace('samples', 'r.samples')} AS cr, r.samples AS nr FROM g CROSS JOIN m CROSS JOIN r)
      SELECT mode, regime, round(greatest(0e0, least(1.8e-1, 3.5e-1 * cg + 6.5e-1 * (cm * nm + cr * nr) / (nm + nr))), 6) AS applied, round(greatest(3.5e-1, least(8.6e-1, 7e-1 - greatest(0e0, least(1.8e-1, 3.5e-1 * cg + 6.5e-1 * (cm * nm + cr * nr) / (nm + nr))))), 6) AS calibrated FROM x""",
    "bayes_update": f"""{T}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, {cl('win_rate', '3.5e-1', '8.6e-1')} AS prior, l_discount * 10 AS dir, l_tax * 10 AS score, {cl('l_tax / 2e-2', '0e0', '2e0')} AS cost FROM t),
      l AS (SELECT *, {cl('exp(dir * 7.5e-1 + score * 5.5e-1 * 5e-1 + 3.5e-2)', '3.5e-1', '2.8e0')} AS lw, {cl('exp(cost * 2.8e-1)', '3.5e-1', '2.8e0')} AS ll FROM x)
      SELECT l_orderkey, l_linenumber, l_partkey, round(prior, 6) AS prior, round({cl('prior * lw / (prior * lw + (1 - prior) * ll)', '3.5e-1', '8.6e-1')}, 6) AS posterior FROM l""",
    "entry_gate": f"""{T}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, regime, mode, win_rate, 2e-2 AS risk, 1.5e0 AS rr, l_tax / 2e1 AS cost, l_discount * 10 AS dir FROM t),
      g AS (SELECT *, {cl('(1 + cost / risk) / (1 + rr)', '5e-2', '9.5e-1')} AS break_even, win_rate * risk * rr - (1 - win_rate) * risk - cost AS expectancy,
        4.5e-2 + 7e-2 + CASE WHEN regime = 'O' THEN 4e-2 ELSE 0e0 END + CASE mode WHEN 'R' THEN 3e-2 WHEN 'A' THEN 1.5e-2 ELSE 0e0 END - {cl('(dir - 5e-1) * 2.5e-2', '0e0', '1.5e-2')} AS margin FROM x),
      h AS (SELECT *, greatest(4.5e-1, break_even + 1e-2) AS low FROM g), i AS (SELECT *, greatest(low, least(greatest(low, 7.8e-1), break_even + margin)) AS threshold FROM h)
      SELECT mode, regime, count(*) AS n, count(CASE WHEN expectancy > 0 AND win_rate >= threshold - 1e-12 THEN 1 END) AS passed, round(avg(threshold), 6) AS threshold, round(avg(expectancy), 6) AS expectancy FROM i GROUP BY mode, regime""",
    "brier_outcomes": """WITH x AS (SELECT lang, quality AS won, 1 / (1 + exp(-(n_chars - 1500) / 1e3)) AS p FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id)
      SELECT lang, count(*) AS samples, cast(sum(won) AS bigint) AS wins, round(avg(won), 6) AS win_rate, round(avg(p), 6) AS avg_predicted, round(avg((p - won) * (p - won)), 6) AS brier FROM x GROUP BY lang""",
    "chrono_split_8020": """WITH x AS (SELECT quality AS won, 1 / (1 + exp(-(n_chars - 1500) / 1e3)) AS p, row_number() OVER (ORDER BY l.doc_id, n_chars) AS k, count(*) OVER () AS n FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id),
      y AS (SELECT *, CASE WHEN k <= floor(8e-1 * n + 1e-9) THEN 'train' ELSE 'validation' END AS part FROM x) SELECT part, count(*) AS samples, round(avg(won), 6) AS win_rate, round(avg((p - won) * (p - won)), 6) AS brier FROM y GROUP BY part""",
    "factor_stats": f"{F0} SELECT factor, n, active, round(mean, 6) AS mean, round(agreement, 6) AS agreement, round(association, 6) AS association FROM ({STATS}) z",
    "quality_factor_stats": f"{F0} SELECT factor, round(avg(CASE WHEN y > 0 THEN coalesce(s, 0e0) END), 6) AS mean_on_wins, round(avg(CASE WHEN y < 0 THEN coalesce(s, 0e0) END), 6) AS mean_on_losses FROM u GROUP BY factor",
    "weight_proposal": f"""{F0}, z AS ({STATS}), d AS (SELECT factor, 2.5e-1 AS w, {cl('association * active / n * n / (n + 4e1)', '-3e-2', '3e-2')} AS delta FROM z), e AS (SELECT *, {cl('w + delta', '1e-2', '7e-1')} AS c FROM d)
      SELECT factor, round(delta, 6) AS delta, round(c / sum(c) OVER (), 6) AS proposed FROM e""",
    "champion_challenger": f"""{T}, n AS (SELECT *, row_number() OVER (ORDER BY {ORD}) AS k, count(*) OVER () AS n FROM t), p AS (SELECT *, CASE WHEN k > n - greatest(5, least(ceil(3e-1 * n - 1e-9), 40)) THEN 'validation' ELSE 'train' END AS part, CASE WHEN pnl >= 0 THEN 1e0 ELSE -1e0 END AS y FROM n),
      v AS (SELECT part, y, l_discount * 20 - 1 - l_tax AS champion, l_discount * 20 - l_tax * 20 AS challenger FROM p)
      SELECT part, count(*) AS n, round(avg(CASE WHEN (champion >= 0) = (y > 0) THEN 1e0 ELSE 0e0 END), 6) AS champion_accuracy, round(avg(CASE WHEN (challenger >= 0) = (y > 0) THEN 1e0 ELSE 0e0 END), 6) AS challenger_accuracy,
        round(avg(champion * y), 6) AS champion_margin, round(avg(challenger * y), 6) AS challenger_margin FROM v GROUP BY part""",
    "trade_analytics": f"""{T} SELECT mode, count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(try_divide(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END), -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0e0 END)), 6) AS profit_factor,
      round(avg(win_rate), 6) AS mean_prediction, round(avg((win_rate - CASE WHEN pnl > 0 THEN 1 ELSE 0 END) * (win_rate - CASE WHEN pnl > 0 THEN 1 ELSE 0 END)), 6) AS brier, round(sum(gross - pnl) / sum(abs(gross)), 6) AS cost_drag FROM t GROUP BY mode""".replace("try_divide(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END), -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0e0 END))", "sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0e0 END), 0)"),
    "cumulative_pnl": f"{T}, m AS (SELECT account, closed_at, sum(pnl) AS pnl FROM t GROUP BY account, closed_at) SELECT account, closed_at, cast(row_number() OVER w AS bigint) AS k, round(sum(pnl) OVER (PARTITION BY account ORDER BY closed_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cumulative FROM m WINDOW w AS (PARTITION BY account ORDER BY closed_at)",
    "trade_classification": f"{T} SELECT CASE WHEN pnl >= 0 THEN 'profitable' WHEN gross > 0 AND pnl < 0 THEN 'cost_drag' WHEN pnl <= -risk * 9e-1 THEN 'stop_loss' ELSE 'direction_or_timing_error' END AS kind, count(*) AS n, round(avg(pnl / risk), 6) AS net_r FROM t GROUP BY 1",
    "equity_drawdown": f"WITH {EQUITY} SELECT account, id, round(equity, 4) AS equity, round(drawdown, 6) AS drawdown FROM rr",
    "rolling_sharpe": f"""WITH {EQUITY}, w AS (SELECT account, id, count(ret) OVER v AS n, avg(ret) OVER v AS m, stddev_pop(ret) OVER v AS s FROM rr WHERE ret IS NOT NULL WINDOW v AS (PARTITION BY account ORDER BY day, id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
      SELECT account, id, round(CASE WHEN s > 1e-9 THEN m / s * sqrt(cast(n AS double)) ELSE 0e0 END, 4) AS sharpe FROM w WHERE n >= 5""",
    "account_summary": f"WITH {EQUITY} SELECT account, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, round(sum(pnl) / max(start), 6) AS total_return, round(max(peak) / max(start) - 1, 6) AS max_return, round(min(drawdown), 6) AS max_drawdown FROM rr GROUP BY account",
    "mark_to_market": f"""WITH {TICKS}, l AS (SELECT symbol, max_by(price, struct_of) AS latest FROM (SELECT symbol, price, event_id AS struct_of FROM k) z GROUP BY symbol), p AS (SELECT symbol, user_id, avg(price) AS entry, count(*) AS qty FROM k GROUP BY symbol, user_id)
      SELECT user_id, count(*) AS positions, round(sum(qty * (latest - entry)), 4) AS unrealised, round(sum(qty * entry / 10), 4) AS margin FROM p JOIN l ON p.symbol = l.symbol GROUP BY user_id""",
    "source_counts": "SELECT source, count(*) AS input, count(DISTINCT text) AS selected, count(*) - count(DISTINCT text) AS suppressed, max(n_chars) AS longest FROM {documents} GROUP BY source",
    # Joins.
    "leverage_bracket_range_join": """WITH b AS (SELECT * FROM (VALUES (1, 0e0, 1e4, 50), (2, 1e4, 1e5, 20), (3, 1e5, 2.5e5, 10)) v(bracket, floor, cap, leverage))
      SELECT o_orderkey, coalesce(b.bracket, 3) AS bracket, coalesce(b.leverage, 10) AS leverage FROM {orders} LEFT JOIN b ON o_totalprice >= b.floor AND o_totalprice < b.cap""",
    "asof_backward_prev": f"WITH {TICKS} SELECT symbol, event_id, lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS prev_price FROM k",
    "semi_changed": "SELECT c_custkey, c_name FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 3e5",
    "anti_new_signals": "SELECT c_custkey, c_name FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 4e5",
    "left_defaults": "SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(top, 0e0) AS top_price, coalesce(n_name, 'unknown') AS nation FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey LEFT JOIN {nation} ON c_nationkey = n_nationkey",
    "signal_first_touch": f"""WITH {TICKS}, {SIGNALS}, hit AS (SELECT s.symbol, s.user_id, s.opened, s.entry, min(CASE WHEN k.price >= s.entry * 1.1e0 OR k.price <= s.entry * 9e-1 THEN k.event_id END) AS touch FROM sig s JOIN k ON k.symbol = s.symbol AND k.ts > s.opened AND k.ts <= s.opened + INTERVAL 72 HOURS GROUP BY s.symbol, s.user_id, s.opened, s.entry)
      SELECT h.symbol, h.user_id, round(entry, 4) AS entry, CASE WHEN touch IS NULL THEN 'EXPIRED' WHEN k.price >= entry * 1.1e0 THEN 'TP' ELSE 'SL' END AS outcome, CASE WHEN touch IS NULL THEN NULL WHEN k.price >= entry * 1.1e0 THEN 1 ELSE -1 END AS realized_r FROM hit h LEFT JOIN k ON k.event_id = h.touch""",
    "funding_settlements": f"""WITH {TICKS}, {SIGNALS}, f AS (SELECT symbol, date_trunc('day', ts) AS day, max_by(price, event_id) AS mark FROM k GROUP BY 1, 2)
      SELECT s.symbol, s.user_id, count(*) AS settlements, round(sum(f.mark) * -1e-4, 6) AS funding FROM sig s JOIN f ON f.symbol = s.symbol AND f.day > s.opened AND f.day <= s.opened + INTERVAL 72 HOURS GROUP BY s.symbol, s.user_id""",
    "funding_next": "SELECT event_id, (unix_millis(cast(ts AS timestamp)) DIV 28800000 + 1) * 28800000 AS next_ms FROM {events}",
    "adverse_price": f"{T} SELECT side, mode, round(sum(notional * (1 + CASE WHEN side = 'long' THEN 3e-4 ELSE -3e-4 END)), 2) AS executed, round(sum(CASE WHEN side = 'long' THEN 1 ELSE -1 END * l_quantity * (notional / l_quantity * 1.01e0 - notional / l_quantity)), 2) AS gross FROM t GROUP BY side, mode",
    "step_align": "SELECT l_orderkey, l_linenumber, l_partkey, round(floor(l_extendedprice / 2.5e-1 + 1e-9) * 2.5e-1, 4) AS floored, round(ceil(l_extendedprice / 2.5e-1 - 1e-9) * 2.5e-1, 4) AS ceiled FROM {lineitem}",
    "order_rule_check": "SELECT l_orderkey, l_linenumber, l_partkey, cast(floor(l_quantity / 2) * 2 AS double) AS quantity, CASE WHEN floor(l_quantity / 2) * 2 < 2 THEN 'below_min_qty' WHEN floor(l_quantity / 2) * 2 * (l_extendedprice / l_quantity) < 5e3 THEN 'below_min_notional' ELSE 'ok' END AS verdict FROM {lineitem}",
    # Messages.
    "keyword_filter": "SELECT doc_id FROM {documents} WHERE rlike(lower(text), '(^|[^a-z0-9])(th|eth|btc)([^a-z0-9]|$)') OR contains(lower(text), 'licensed')",
    "routine_filter": f"WITH {MESSAGES} SELECT outlet, count(*) AS n, count(CASE WHEN rlike(upper(outlet), 'BINANCE|OKX') AND NOT rlike(up, 'HACK|EXPLOIT|DELIST') AND rlike(up, 'LISTING|MAINTENANCE|COMPETITION|AIRDROP|PROMOTION|CAMPAIGN|THE ') THEN 1 END) AS routine FROM m3 GROUP BY outlet",
    "source_tier": f"WITH {MESSAGES} SELECT tier, weight, count(*) AS n FROM m3 GROUP BY tier, weight",
    "freshness_decay": f"WITH {MESSAGES} SELECT doc_id, round(fresh, 4) AS weight, CASE WHEN age <= 5 THEN 'live' WHEN age <= 30 THEN 'fresh' WHEN age <= 120 THEN 'recent' WHEN age <= 1440 THEN 'today' WHEN age <= 4320 THEN 'aging' ELSE 'stale' END AS level FROM m3",
    "event_classify": f"WITH {SCORED} SELECT doc_id, bull, bear, high, direction, market_wide, round(raw_impact, 4) AS raw_impact, round(impact, 4) AS impact FROM c2 WHERE impact >= 5",
    "symbol_event_aggregate": f"""WITH {SCORED}, e AS (SELECT concat('S', cast(doc_id % 6 AS string)) AS symbol, impact, direction, CASE WHEN market_wide THEN 4.5e-1 ELSE 1e0 END AS rel FROM c2 WHERE impact >= 1),
      a AS (SELECT symbol, greatest(0e0, least(1e2, sum(impact * rel))) AS score, sum(rel) AS n, sum(direction * impact * rel) AS d FROM e GROUP BY symbol) SELECT symbol, round(score, 4) AS score, round(n, 3) AS event_count, round(greatest(-1e0, least(1e0, d / greatest(score, 1e0))), 4) AS direction FROM a""",
    "feed_topn": f"WITH {SCORED}, r AS (SELECT doc_id, outlet, round(impact, 4) AS impact, row_number() OVER (PARTITION BY outlet ORDER BY round(impact, 4) DESC, doc_id) AS k FROM c2) SELECT doc_id, outlet, impact FROM r WHERE k <= 5",
    "story_representative": f"""WITH {MESSAGES}, s AS (SELECT doc_id, tier, length(text) AS n, {TITLE} AS title FROM m3), r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY tier, n DESC, doc_id) AS k, count(*) OVER (PARTITION BY title) AS corroboration FROM s)
      SELECT doc_id, tier, corroboration, round(least(1.24e0, 1 + 8e-2 * (corroboration - 1)), 4) AS multiplier FROM r WHERE k = 1""",
    "stable_ids": "SELECT page_id, substring(sha2(concat(url, '|', cast(page_id AS string)), 256), 1, 24) AS id FROM {pages}",
    "html_strip": "SELECT page_id, cast(length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[ \\n\\t\\r]+', ' '))) AS bigint) AS n FROM {pages}",
    "props_json": "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.v') AS v FROM {events}",
    # Ordered analytics and table maintenance.
    "bucketed_history": f"WITH {TICKS}, h AS (SELECT symbol, cast(date_trunc('hour', ts) AS timestamp_ntz) AS bucket, max_by(price, event_id) AS last_price FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS n FROM h) SELECT symbol, bucket, last_price FROM r WHERE n <= 168",
    "upsert_latest": "WITH u AS (SELECT l_orderkey AS id, l_shipdate, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_linenumber DESC) AS k FROM {lineitem}) SELECT id, date_format(l_shipdate, 'yyyy-MM') AS shard, l_extendedprice AS price FROM u WHERE k = 1",
    "manifest": "SELECT date_format(l_shipdate, 'yyyy-MM') AS shard, count(*) AS n, min(l_shipdate) AS first_closed, max(l_shipdate) AS last_closed FROM {lineitem} GROUP BY 1",
    "page_query": "WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) SELECT o_orderkey, o_orderdate FROM o WHERE k > 50 AND k <= 100",
    "delete_ids": "SELECT o_orderkey, o_totalprice FROM {orders} LEFT ANTI JOIN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') r ON o_orderkey = l_orderkey",
    "tail_load": "SELECT o_orderkey, o_orderdate FROM (SELECT * FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500) z",
    "downsample_uniform": f"WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM k) SELECT symbol, event_id, price FROM n WHERE floor(i * 59e0 / (n - 1)) <> floor((i - 1) * 59e0 / (n - 1)) OR i = 0",
    "downsample_minmax": f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM k), b AS (SELECT *, cast(floor(i * 3e1 / n) AS int) AS bucket FROM n)
      SELECT symbol, bucket, min(price) AS low, max(price) AS high, count(*) AS n FROM b GROUP BY symbol, bucket""",
    "union_override": "SELECT id, max_by(price, seq) AS price FROM (SELECT o_orderkey AS id, o_totalprice AS price, 0 AS seq FROM {orders} UNION ALL SELECT o_orderkey AS id, o_totalprice * 2 AS price, 1 AS seq FROM {orders} WHERE o_orderstatus = 'F') z GROUP BY id",
    "warnings_distinct": "SELECT DISTINCT event_type AS warning FROM {events} ORDER BY warning LIMIT 80",
    "rotation_plan": f"""{T}, v AS (SELECT account, l_orderkey, l_linenumber, notional, {ORD.replace('closed_at, ', 'closed_at, ')}, l_discount - l_tax AS ev FROM t), r AS (SELECT account, ev, notional, row_number() OVER (PARTITION BY account ORDER BY ev, {ORD}) AS k FROM t2)""",
    "confirmation_counters": f"WITH {TICKS}, x AS (SELECT *, CASE WHEN price > 50 THEN 1 ELSE 0 END AS ok FROM k), g AS (SELECT *, sum(1 - ok) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM x) SELECT symbol, event_id, cast(sum(ok) OVER (PARTITION BY symbol, grp ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS confirmations FROM g",
    "heartbeat": "SELECT event_type AS source, max(ts) AS last_seen, CASE WHEN max(ts) < timestamp_ntz '2024-01-30 00:00:00' THEN true ELSE false END AS stale FROM {events} GROUP BY event_type",
}
SPARK["rotation_plan"] = f"""{T}, r AS (SELECT account, notional, l_discount - l_tax AS ev, row_number() OVER w AS k, sum(notional) OVER (PARTITION BY account ORDER BY l_discount - l_tax, {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS released FROM t WINDOW w AS (PARTITION BY account ORDER BY l_discount - l_tax, {ORD})),
  p AS (SELECT *, 6e4 AS deficit FROM r WHERE k <= 3 AND released - notional < 6e4) SELECT account, count(*) AS victims, round(sum(least(notional, deficit - (released - notional))), 2) AS released, CASE WHEN sum(notional) >= max(deficit) THEN true ELSE false END AS covered FROM p GROUP BY account"""
#: Where DuckDB needs another text.
DUCK: dict[str, str] = {
    "semi_changed": SPARK["semi_changed"].replace("LEFT SEMI", "SEMI"),
    "anti_new_signals": SPARK["anti_new_signals"].replace("LEFT ANTI", "ANTI"),
    "delete_ids": SPARK["delete_ids"].replace("LEFT ANTI", "ANTI"),
    "story_representative": SPARK["story_representative"].replace("\\\\", "\\").replace("+', ' '))", "+', ' ', 'g'))"),
    "heartbeat": SPARK["heartbeat"].replace("timestamp_ntz '", "timestamp '"),
}


def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its text numbers all trades in one task. As the validation has 40 trades at most, here each task finds its last 40, and the others are told
    by comparing them with the validation's first; trades equal to that one are all alike and shared out by number."""
    order = ORD.split(", ")
    t = spark.sql(f"{T} SELECT {ORD}, pnl FROM t", lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
    x = t.select(F.struct(*order).alias("key"), F.when(F.col("pnl") >= 0, 1.0).otherwise(-1.0).alias("y"), F.expr("l_discount * 20 - 1 - l_tax").alias("champion"), F.expr("l_discount * 20 - l_tax * 20").alias("challenger"))
    n = x.count()
    size = int(max(5, min(math.ceil(0.3 * n - 1e-9), 40)))
    last = x.select("key").orderBy(F.desc("key")).limit(size)
    cut = last.agg(F.min("key").alias("cut")).crossJoin(last.toDF("k")).groupBy("cut").agg(F.count_if(F.col("k") == F.col("cut")).alias("shared"))
    right = lambda c: F.sum(F.when((F.col(c) >= 0) == (F.col("y") > 0), 1.0).otherwise(0.0)).alias(f"{c}_accuracy")
    margin = lambda c: F.sum(F.col(c) * F.col("y")).alias(f"{c}_margin")
    side = F.when(F.col("key") < F.col("cut"), -1).when(F.col("key") > F.col("cut"), 1).otherwise(0)
    g = x.crossJoin(F.broadcast(cut)).groupBy(side.alias("side"), "shared").agg(F.count(F.lit(1)).alias("n"), right("champion"), right("challenger"), margin("champion"), margin("challenger"))
    own = F.expr("CASE WHEN part = 'train' THEN CASE side WHEN -1 THEN n WHEN 0 THEN n - shared ELSE 0 END ELSE CASE side WHEN 1 THEN n WHEN 0 THEN shared ELSE 0 END END")
    g = g.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("validation")))).withColumn("own", own).where("own > 0")
    mean = lambda c: F.round(F.sum(F.col(c) / F.col("n") * F.col("own")) / F.sum("own"), 6).alias(c)
    return g.groupBy("part").agg(F.sum("own").alias("n"), mean("champion_accuracy"), mean("challenger_accuracy"), mean("champion_margin"), mean("challenger_margin"))


QUERIES = {k: run(v) for k, v in SPARK.items()} | {"champion_challenger": champion_challenger}
ORACLES = {k: duck(DUCK.get(k, v)) for k, v in SPARK.items()} | {
    "funding_next": "SELECT event_id, (epoch_ms(ts) // 28800000 + 1) * 28800000 AS next_ms FROM events",
    "html_strip": "SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g'))) AS n FROM pages",
}
