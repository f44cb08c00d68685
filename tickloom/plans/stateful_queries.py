"""Queries over the stateful operators, the streams, as-of joins and title similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import fold_text
from tickloom.operators import stateful as S
from tickloom.operators.candles import ticks
from tickloom.plans.market_queries import market_rows, sql_bars
from tickloom.session import table
from tickloom.streaming import prices as P


def _titles(s, d):
    return table(s, d, "documents").select("doc_id", "source", fold_text(F.split_part("text", F.lit("."), F.lit(1))).alias("title"))


def source_dedup(s, d):
    t = _titles(s, d)
    return S.source_dedup(t.select("source", F.col("doc_id").alias("seq"), F.concat(F.lit("u"), F.col("doc_id") % 40).alias("url"), "title"))


def leader_clusters(s, d):
    return S.leader_clusters(_titles(s, d).select(F.floor(F.col("doc_id") / 250).cast("long").alias("batch"), F.col("doc_id").alias("seq"), "title"))


def change_or_period_log(s, d):
    e = table(s, d, "events")
    return S.change_or_period_log(e.select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"), F.col("event_id").alias("seq"), F.col("event_type").alias("mark")), 6 * 3600)


def protection_replay(s, d):
    e = table(s, d, "events").where("value > 0")
    return S.protection_replay(e.select(F.col("event_type").alias("symbol"), "user_id", "ts", F.col("event_id").alias("seq"), F.col("value").alias("price")))


def markowitz_weights(s, d):
    m = market_rows(s, d)
    return S.markowitz(m.select("symbol", F.greatest(F.lit(1e-6), F.abs("math_signal") * 0.01).alias("mu"), F.col("r96").alias("returns")))


def asof_forward(s, d):
    """Each tick settled at the first price at or after an hour later. One sort: a running last value over time in reverse."""
    t = ticks(table(s, d, "events"))
    due = t.select("symbol", "event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit(None).cast("double").alias("p"), F.lit(0).alias("kind"))
    both = due.unionAll(t.select("symbol", "event_id", F.col("ts").alias("at"), F.col("price").alias("p"), F.lit(1).alias("kind")))
    w = Window.partitionBy("symbol").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("settled", F.last("p", ignorenulls=True).over(w)).where("kind = 0").select("symbol", "event_id", "settled")


#: Documents of a class of equal titles that are paired in one row.
SLICE = 512


def title_pairs(s, d):
    """Pairs of titles of a source with a Jaccard similarity of 0.5 or more.

    Titles of the same tokens are one class. Classes meet by their rarest tokens: of n tokens in the order of frequency, the first n - n / 2 + 1
    (two sets this similar share one of these), and only at the first one they share, where the rest can still be enough; there they are
    compared, so candidates aren't shuffled. Only what is found is spread to the documents of both classes, in slices.
    """
    t = _titles(s, d).select("source", "doc_id", F.array_sort(F.array_distinct(F.expr("regexp_extract_all(title, '([a-z0-9]{2,})', 1)"))).alias("tok")).where("size(tok) > 0 and source is not null and doc_id is not null")
    c = t.groupBy("source", "tok").agg(F.sort_array(F.collect_list("doc_id")).alias("docs")).withColumn("k", F.struct(F.col("docs")[0].alias("first"), F.xxhash64("tok").alias("h")))
    x = c.select("source", "k", F.explode("tok").alias("w"))
    o = x.join(x.groupBy("w").agg(F.count(F.lit(1)).alias("f")), "w").groupBy("source", "k").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("o"))
    p = o.select("source", "k", F.col("o.w").alias("o"), F.size("o").alias("n"), F.posexplode(F.expr("slice(o.w, 1, size(o) - cast(ceil(size(o) / 2) as int) + 1)")).alias("i", "w"))
    q = p.toDF("source", "kb", "ob", "m", "i_b", "w")
    near = p.join(q, ["source", "w"]).where("k < kb and n <= 2 * m and m <= 2 * n and 3 * least(n - i, m - i_b) >= n + m").withColumn("both", F.array_intersect("o", "ob"))
    near = near.where("both[0] = w").withColumn("j", F.size("both") / (F.col("n") + F.col("m") - F.size("both"))).where("j >= 0.5").select("source", "k", "kb", "j")
    part = F.expr(f"explode(transform(sequence(0, (size(docs) - 1) div {SLICE}), z -> struct(z, slice(docs, z * {SLICE} + 1, {SLICE}) AS a)))")
    mine = c.select("source", "k", part.alias("z")).select("source", "k", "z.a")
    theirs = c.select("source", F.col("k").alias("kb"), "docs")
    across = near.join(mine, ["source", "k"]).join(theirs, ["source", "kb"]).select("a", F.col("docs").alias("b"), "j")
    same = c.where("size(docs) > 1").select("docs", part.alias("z")).select("z.a", F.expr(f"slice(docs, z.z * {SLICE} + 1, size(docs))").alias("b"), F.lit(1.0).alias("j"))
    pairs = lambda y: y.repartition(F.xxhash64("a", "b")).select(F.explode("a").alias("x"), "b", "j").select("x", F.explode("b").alias("y"), "j")
    every = pairs(across).select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("doc_b"), "j").unionAll(pairs(same).toDF("doc_id", "doc_b", "j"))
    return every.where("doc_id < doc_b").select("doc_id", "doc_b", F.round("j", 4).alias("jaccard"))


def _levels(s, d):
    """A stop and a target for each symbol but one: its mean price, a fifth off either way."""
    e = table(s, d, "events").where("value > 0 and event_type <> 'error'")
    return e.groupBy(F.col("event_type").alias("symbol")).agg((F.avg("value") * 0.8).alias("stop"), (F.avg("value") * 1.2).alias("target"))


QUERIES = {
    "source_dedup": source_dedup,
    "leader_clusters": leader_clusters,
    "change_or_period_log": change_or_period_log,
    "protection_replay": protection_replay,
    "markowitz_weights": markowitz_weights,
    "asof_forward_settlement": asof_forward,
    "title_similarity_pairs": title_pairs,
    "stream_latest_price": lambda s, d: P.drain(P.latest_price(P.tick_stream(s, f"{d}/events.parquet"))).select("symbol", "price", F.col("ts").cast("timestamp_ntz").alias("ts")),
    "stream_coalesced": lambda s, d: P.drain(P.coalesced(P.tick_stream(s, f"{d}/events.parquet"), now="2024-01-20 00:00:00")).select("symbol", F.unix_millis("at").alias("at_ms"), "price", "n"),
    "stream_static_join": lambda s, d: P.drain(P.with_static(P.tick_stream(s, f"{d}/events.parquet"), _levels(s, d))),
    "stream_candles": lambda s, d: P.drain(P.bars(P.tick_stream(s, f"{d}/events.parquet"))).withColumn("bar", F.col("bar").cast("timestamp_ntz")),
}
_NORM = "trim(regexp_replace(lower(split_part(text, '.', 1)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
ORACLES = {
    "asof_forward_settlement": """WITH k AS (SELECT event_type AS symbol, ts, event_id, value AS price FROM events WHERE value > 0)
      SELECT a.symbol, a.event_id, b.price AS settled FROM (SELECT symbol, event_id, ts + INTERVAL 1 HOUR AS due FROM k) a ASOF LEFT JOIN k b ON a.symbol = b.symbol AND a.due <= b.ts""",
    "title_similarity_pairs": f"""WITH t AS (SELECT source, doc_id, list_distinct(regexp_extract_all({_NORM}, '[a-z0-9]{{2,}}')) AS tok FROM documents), x AS (SELECT source, doc_id, len(tok) AS n, unnest(tok) AS w FROM t)
      SELECT doc_id, doc_b, round(c / (n + m - c), 4) AS jaccard FROM (SELECT a.doc_id, b.doc_id AS doc_b, a.n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.source = b.source AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL) WHERE c / (n + m - c) >= 0.5""",
    "stream_latest_price": "SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price, max(ts) AS ts FROM events WHERE value > 0 GROUP BY ALL",
    "stream_coalesced": """SELECT event_type AS symbol, epoch_us(ts) // 100000 * 100 AS at_ms, arg_max(value, (ts, event_id)) AS price, count(*) AS n FROM events WHERE value > 0 AND ts <= TIMESTAMP '2024-01-20 00:01:00' GROUP BY ALL""",
    "stream_static_join": """SELECT symbol, price, price <= stop AS stopped, price >= target AS reached FROM (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price FROM events WHERE value > 0 GROUP BY 1)
      LEFT JOIN (SELECT event_type AS symbol, avg(value) * 0.8::double AS stop, avg(value) * 1.2::double AS target FROM events WHERE value > 0 AND event_type <> 'error' GROUP BY 1) USING (symbol)""",
    "stream_candles": f"SELECT * FROM {sql_bars(1)}",
}
