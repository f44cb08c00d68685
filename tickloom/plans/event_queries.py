"""Events of messages, and the first touch of signals: queries whose plans are built here and whose oracles are written apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.operators import events as E
from tickloom.plans.sql_catalog import MESSAGES, SPARK, duck
from tickloom.session import table

#: What is added to the documents' words, so that the terms occur.
PHRASES = ["Bitcoin ETF inflow approved", "exploit: Ethereum bridge hack", "美联储降息 soon", "Solana partnership launch", "nothing", "BNB delist lawsuit", "crypto ban", "SEC charges after CPI rate hike"]
_PHRASE = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END"
_COLUMNS = f"doc_id AS id, {_PHRASE} AS title, substring(text, 1, 200) AS text, weight, doc_id % 5 AS corroboration, doc_id % 11 / 1e1 AS trend, fresh"


def _events(s, d):
    sql = f"WITH {MESSAGES} SELECT {_COLUMNS} FROM m3 WHERE text IS NOT NULL"
    return E.classify(s.sql(sql, documents=table(s, d, "documents")))


def classify(s, d):
    e = _events(s, d).where(F.col("impact") >= E.LEAST_IMPACT)
    return e.select("id", "bull", "bear", "high", "direction", "market_wide", F.array_join("matched", ",").alias("symbols"), F.round("raw_impact", 4).alias("raw_impact"), F.round("impact", 4).alias("impact"))


def by_symbol(s, d):
    return E.aggregate_by_symbol(_events(s, d).where(F.col("impact") >= E.LEAST_IMPACT)).withColumn("top", F.array_join(F.col("top").cast("array<string>"), ","))


def poisson(s, d):
    return E.poisson_arrival(E.aggregate_by_symbol(_events(s, d).where((F.col("impact") >= E.LEAST_IMPACT) & (F.col("id") % 100 == 0))))


def first_beyond(ticks: pa.Table, signals: pa.Table) -> pa.Table:
    """The first tick of an hour after each signal's opening that is at or beyond one of its bounds, if its time isn't over by then.

    Extremes of 1, 2, 4 ... ticks from each tick on: a signal goes over the longest runs that don't cross, so it takes as many steps as the number of ticks has digits.
    """
    t = ticks.sort_by([("ts", "ascending"), ("event_id", "ascending")])
    us = lambda c: c.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
    number = lambda c: np.where(np.isnan(x := c.to_numpy()), np.inf, x)  # noqa: E731  (NaN is above all in both engines)
    ts, price, n, m = us(t.column("ts")), t.column("price").to_numpy(), t.num_rows, signals.num_rows
    tp, sl = number(signals.column("tp")), number(signals.column("sl"))
    runs = [(p := number(t.column("price")), p)]
    while 2 << len(runs) - 1 <= n:
        (hi, lo), k = runs[-1], 1 << len(runs) - 1
        runs.append((np.maximum(hi[:-k], hi[k:]), np.minimum(lo[:-k], lo[k:])))
    at = np.searchsorted(ts, us(signals.column("opened")), "right")
    for k in range(len(runs) - 1, -1, -1):
        for _ in range(2 if k == len(runs) - 1 else 1):  # the longest run may fit twice
            i = np.flatnonzero(at + (1 << k) <= n)
            hi, lo = runs[k]
            i = i[(hi[at[i]] < tp[i]) & (lo[at[i]] > sl[i])]
            at[i] += 1 << k
    i = np.flatnonzero(at < n)
    i = i[ts[at[i]] <= us(signals.column("until"))[i]]
    got = signals.take(pa.array(i))
    return pa.Table.from_arrays([got.column("symbol"), got.column("user_id"), t.column("ts").take(pa.array(at[i])), pa.array(price[at[i]])], ["symbol", "user_id", "ts", "price"])


def first_touch(s, d):
    """The first tick beyond 10 % either way within 72 hours of each signal.

    A signal meets the extremes of the hours after its own, in blocks of 72 hours; in the first that crosses, and in its own,
    it is looked for among the ticks by halving (`first_beyond`). No signal is joined with an hour's ticks.
    """
    tick = table(s, d, "events").where("value > 0").select(F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", F.col("value").alias("price"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).withColumn("h", F.expr("t div 3600"))
    first = tick.groupBy("symbol", "user_id").agg(F.min(F.struct("ts", "price")).alias("f"))
    sig = first.select("symbol", "user_id", F.col("f.ts").alias("opened"), F.col("f.price").alias("entry"))
    sig = sig.withColumn("until", F.expr("opened + INTERVAL 72 HOURS")).withColumn("tp", F.col("entry") * 1.1).withColumn("sl", F.col("entry") * 0.9).withColumn("h0", F.expr("unix_seconds(cast(opened as timestamp)) div 3600"))
    hours = tick.groupBy("symbol", "h").agg(F.max("price").alias("hi"), F.min("price").alias("lo"))
    # An hour is in its own block and in the one before, so each signal has its 72 hours in one block.
    blocks = hours.select("symbol", F.explode(F.expr("array(floor(h / 72), floor(h / 72) - 1)")).alias("block"), F.struct("h", "hi", "lo").alias("x")).groupBy("symbol", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    ahead = sig.withColumn("block", F.floor(F.col("h0") / 72)).join(blocks, ["symbol", "block"]).withColumn("h", F.expr("filter(xs, x -> x.h > h0 and x.h <= h0 + 72 and (x.hi >= tp or x.lo <= sl))[0].h")).where("h is not null")
    key = ["symbol", "user_id", "opened", "until", "tp", "sl"]
    look = ahead.select(*key, "h").unionByName(sig.withColumn("h", F.col("h0")).select(*key, "h"))
    hit = tick.select("symbol", "h", "ts", "event_id", "price").groupBy("symbol", "h").cogroup(look.toDF("symbol", "user_id", "opened", "until", "tp", "sl", "hour").groupBy("symbol", "hour")).applyInArrow(first_beyond, f"symbol string, user_id long, ts {dict(tick.dtypes)['ts']}, price double")
    touch = hit.groupBy("symbol", "user_id").agg(F.min(F.struct("ts", "price")).alias("x"))
    out = sig.join(touch, ["symbol", "user_id"], "left")
    won = F.col("x.price") >= F.col("tp")
    return out.select("symbol", "user_id", F.round("entry", 4).alias("entry"), F.when(F.col("x").isNull(), "EXPIRED").when(won, "TP").otherwise("SL").alias("outcome"), F.when(F.col("x").isNull(), None).when(won, 1).otherwise(-1).alias("realized_r"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_COUNT = "len(list_filter({0}, lambda t: contains(up, t)))"
_ALIAS = ", ".join(f"({k}, '{s}', '{n}')" for k, (s, names) in enumerate(E.ALIASES.items()) for n in names)
EVENTS_SQL = f"""WITH {duck(MESSAGES)}, msg AS (SELECT {_COLUMNS} FROM m3 WHERE text IS NOT NULL), u AS (SELECT *, upper(title || ' ' || text) AS up FROM msg),
alias(place, symbol, name) AS (VALUES {_ALIAS}),
hits AS (SELECT DISTINCT id, place, symbol FROM u, alias WHERE regexp_matches(up, '(^|[^A-Z0-9])' || name || '([^A-Z0-9]|$)')),
matched AS (SELECT id, string_agg(symbol, ',' ORDER BY place) AS symbols FROM hits GROUP BY id),
n AS (SELECT u.*, coalesce(symbols, '') AS symbols, {_COUNT.format(_list(E.BULL))} AS bull, {_COUNT.format(_list(E.BEAR))} AS bear, {_COUNT.format(_list(E.HIGH))} AS high, {_COUNT.format(_list(E.MARKET))} > 0 AS market_wide FROM u LEFT JOIN matched USING (id)),
r AS (SELECT *, least(100.0::double, (18 + high * 12 + abs(bull - bear) * 10) * weight * least(1.24::double, 1 + (greatest(1, corroboration) - 1) * 0.08::double) + trend * 10) AS raw_impact FROM n),
ev AS (SELECT *, sign(bull - bear)::int AS direction, least(100.0::double, raw_impact * fresh) AS impact FROM r)"""
CLASSIFY_SQL = EVENTS_SQL + " SELECT id, bull::int AS bull, bear::int AS bear, high::int AS high, direction, market_wide, symbols, round(raw_impact, 4) AS raw_impact, round(impact, 4) AS impact FROM ev WHERE impact >= 18"
_BY = """, fan AS (SELECT ev.id, impact, direction, hits.symbol, 1.0::double AS rel FROM ev JOIN hits USING (id) WHERE impact >= 18 {0}
  UNION ALL SELECT ev.id, impact, direction, s.symbol, 0.45::double FROM ev, (SELECT DISTINCT symbol FROM alias WHERE place < 6) s WHERE symbols = '' AND market_wide AND impact >= 18 {0}),
sums AS (SELECT symbol, sum(impact * rel) AS s, sum(direction * impact * rel) AS d, sum(rel) AS n FROM fan GROUP BY symbol),
tops AS (SELECT symbol, string_agg(id::varchar, ',' ORDER BY impact DESC, id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY impact DESC, id) AS k FROM fan) WHERE k <= 5 GROUP BY symbol),
agg AS (SELECT symbol, round(greatest(0, least(100, coalesce(s, 0))), 6) AS score, round(CASE WHEN s > 0 THEN greatest(-1, least(1, d / greatest(1, least(100, s)))) ELSE 0 END, 6) AS direction, round(coalesce(n, 0), 3) AS event_count, coalesce(top, '') AS top FROM (SELECT DISTINCT symbol FROM alias) LEFT JOIN sums USING (symbol) LEFT JOIN tops USING (symbol))"""
BY_SYMBOL_SQL = EVENTS_SQL + _BY.format("") + " SELECT symbol, score::double AS score, direction::double AS direction, event_count, top FROM agg"
POISSON_SQL = EVENTS_SQL + _BY.format("AND ev.id % 100 = 0") + """, l AS (SELECT symbol, direction, floor(event_count)::bigint AS k, greatest(0.05::double, least(4.0::double, 0.25 + score / 100 * 1.65 + CASE WHEN score >= 70 AND abs(direction) >= 0.2 THEN 0.35 ELSE 0 END)) AS lam FROM agg),
c AS (SELECT *, CASE WHEN k > 0 THEN greatest(0.0::double, least(1.0::double, 1 - (SELECT sum(exp(-lam) * lam ** i / gamma(i + 1)) FROM range(0, 100) t(i) WHERE i < k))) ELSE 1.0::double END AS tail FROM l)
SELECT symbol, k AS observed, round(lam, 6) AS lambda, round(tail, 6) AS tail, round(CASE WHEN k > 0 THEN greatest(-3.0::double, least(3.0::double, (k - lam) / sqrt(lam + 1e-9))) ELSE 0 END, 6) AS cluster, round(CASE WHEN k > 0 THEN (1 - tail) * abs(direction) ELSE 0 END, 6) AS intensity FROM c"""

QUERIES = {"event_classify": classify, "symbol_event_aggregate": by_symbol, "event_poisson": poisson, "signal_first_touch": first_touch}
#: The first touch's oracle compares every signal with every tick.
ORACLES = {"event_classify": CLASSIFY_SQL, "symbol_event_aggregate": BY_SYMBOL_SQL, "event_poisson": POISSON_SQL, "signal_first_touch": duck(SPARK["signal_first_touch"])}
