"""Scans of payloads that are made of the driver tables' rows, so that their oracles can be said from the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.session import table
from tickloom.sources import feeds

KEYWORDS = ["of", "der", "idiot", "clown", "ción"]
MATCH_SQL = "(regexp_matches(lower({0}), '(^|[^a-z0-9])(of|der)([^a-z0-9]|$)') OR contains(lower({0}), 'idiot') OR contains(lower({0}), 'clown') OR contains(lower({0}), 'ción'))"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def _messages(s, d):
    """Documents as items of payloads of up to 40, of three formats."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.col("source").alias("feed"), F.floor(F.col("doc_id") / 40).alias("payload_id"), F.substring("text", 1, 60).alias("title"), F.substring("text", 1, 300).alias("body"))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.withColumn("t", esc(F.col("title"))).withColumn("b", esc(F.col("body"))).withColumn("at", when)


def rss_items(s, d):
    m = _messages(s, d)
    rss = F.format_string("<item><title>%s</title><description>%s</description><link>http://x.org/%d</link><guid>g%d</guid><pubDate>%s</pubDate></item>", "t", "b", "doc_id", "doc_id", "at")
    atom = F.format_string('<entry><title type="html">%s</title><summary>%s</summary><link rel="self" href="http://x.org/self"/><link rel="alternate" href="http://x.org/%d"/><id>g%d</id><updated>%s</updated></entry>', "t", "b", "doc_id", "doc_id", "at")
    kind = F.col("payload_id") % 3
    items = m.withColumn("item", F.when(kind == 1, atom).otherwise(rss)).groupBy("feed", "payload_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("i"))
    body = F.array_join(F.transform("i", lambda x: x["item"]), "")
    xml = F.when(kind == 0, F.concat(F.lit("<rss><channel><title>c</title>"), body, F.lit("</channel></rss>"))).when(kind == 1, F.concat(F.lit("<feed>"), body, F.lit("</feed>"))).otherwise(F.concat(F.lit("<RDF>"), body, F.lit("</RDF>")))
    out = feeds.feed_items(items.select("feed", "payload_id", xml.alias("xml")), KEYWORDS, 5)
    return out.select("feed", "payload_id", "position", "id", "title", "text", "url", F.unix_timestamp("occurred_at").alias("occurred_s"))


def hotlist(s, d):
    m = _messages(s, d)
    item = F.struct(F.concat(F.lit("g"), "doc_id").alias("id"), "title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://x.org/"), "doc_id")).alias("url"), F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("body")).alias("hover")).alias("extra"))
    p = m.groupBy("feed", "payload_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))).alias("i"))
    status = F.element_at(F.array(F.lit("success"), F.lit("cache"), F.lit("error")), (F.col("payload_id") % 3 + 1).cast("int"))
    js = F.to_json(F.struct(status.alias("status"), F.lit("1704067200000").alias("updatedTime"), F.transform("i", lambda x: x["i"]).alias("items")))
    out = feeds.hotlist_items(p.select("feed", "payload_id", js.alias("json")), KEYWORDS, 2)
    return out.select("feed", "payload_id", "rank", "id", "title", "text", "url", F.unix_timestamp("occurred_at").alias("occurred_s"))


def _items_sql(most: int, order: str, keep: str = "true") -> str:
    title, body = CLEAN_SQL.format("substr(text, 1, 60)"), CLEAN_SQL.format("substr(text, 1, 300)")
    return f"""i AS (SELECT doc_id, source AS feed, doc_id // 40 AS payload_id, {title} AS title, {body} AS body, row_number() OVER (PARTITION BY source, doc_id // 40 ORDER BY doc_id) - 1 AS position FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY feed, payload_id ORDER BY position) AS n FROM ({order}) WHERE {keep} AND title <> '' AND {MATCH_SQL.format("concat(title, ' ', text)")})"""


RSS_SQL = f"""WITH {_items_sql(5, "SELECT *, CASE WHEN body <> '' THEN body ELSE title END AS text FROM i")}
SELECT feed, payload_id, position::int AS position, substr(sha256('rss|' || feed || '|g' || doc_id || '|http://x.org/' || doc_id || '|' || title), 1, 24) AS id, title, text, 'http://x.org/' || doc_id AS url, 1704067200 + doc_id * 60 AS occurred_s FROM f WHERE n <= 5"""
HOT_SQL = f"""WITH {_items_sql(4, "SELECT *, CASE WHEN doc_id % 3 = 0 AND body <> '' THEN concat(title, ' ', body) ELSE title END AS text, CASE WHEN doc_id % 2 = 0 THEN 'http://x.org/' || doc_id ELSE 'g' || doc_id END AS url FROM i", "payload_id % 3 < 2")}
SELECT feed, payload_id, (position + 1)::int AS rank, substr(sha256('newsnow|' || feed || '|g' || doc_id || '|' || url || '|' || title), 1, 24) AS id, title, text, url, 1704067200 AS occurred_s FROM f WHERE n <= 4"""


def klines(s, d):
    """Ticks as candles of one price; rows that are no candle are dropped."""
    e = table(s, d, "events").select(F.col("event_type").alias("symbol"), F.array(*[c.cast("string") for c in (F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.col("value") + 1, F.col("value") - 1, F.when(F.col("event_id") % 10 > 0, F.col("value").cast("string")).otherwise("x"), F.col("event_id"))]).alias("r"))
    p = e.groupBy("symbol").agg(F.to_json(F.collect_list("r")).alias("json"))
    return feeds.kline_rows(p).select("symbol", F.unix_millis("ts").alias("ms"), F.round("high", 6).alias("high"), F.round("close", 6).alias("close"), F.col("volume").cast("bigint").alias("volume"))


KLINES_SQL = "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ms, round(value + 1, 6) AS high, round(value, 6) AS close, event_id::bigint AS volume FROM events WHERE event_id % 10 > 0 AND value > 0"


def rules(s, d):
    step = lambda name, value, on=F.lit(True): F.when(on, F.struct(F.lit(name).alias("filterType"), F.lit("1").alias("minQty"), F.lit("1000").alias("maxQty"), value.cast("string").alias("stepSize")))
    p = table(s, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("price"))
    lot, market = step("LOT_SIZE", F.lit("0.1")), step("MARKET_LOT_SIZE", F.when(F.col("p_size") % 2 == 0, F.lit("0.5")).otherwise(F.lit("0")), F.col("p_size") % 3 > 0)
    notional = F.when(F.col("p_size") % 5 == 0, F.struct(F.lit("NOTIONAL").alias("filterType"), F.lit("20").alias("minNotional"), F.lit("9000").alias("maxNotional"), (F.col("p_size") % 2 == 0).alias("applyMaxToMarket")))
    minimum = F.when(F.col("p_size") % 4 == 0, F.struct(F.lit("MIN_NOTIONAL").alias("filterType"), F.lit("50").alias("notional")))
    filters = F.array_join(F.filter(F.array(*[F.to_json(x) for x in (lot, market, notional, minimum)]), lambda x: x.isNotNull()), ",")
    one = F.format_string('{"symbol":"p%d","status":"%s","contractType":"PERPETUAL","filters":[%s]}', "p_partkey", F.when(F.col("p_size") > 5, "TRADING").otherwise("BREAK"), filters)
    payloads = p.withColumn("one", one).groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.concat(F.lit('{"symbols":['), F.array_join(F.collect_list("one"), ","), F.lit("]}")).alias("json"))
    return feeds.exchange_rules(payloads)


RULES_SQL = """SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size > 5 THEN 'TRADING' ELSE 'BREAK' END AS status, p_size > 5 AS tradable, 1.0::double AS min_qty, 1000.0::double AS max_qty,
  CASE WHEN p_size % 3 > 0 AND p_size % 2 = 0 THEN '0.5' ELSE '0.1' END AS step_size, '0' AS tick_size,
  greatest(CASE WHEN p_size % 4 = 0 THEN 50.0::double ELSE 0 END, CASE WHEN p_size % 5 = 0 THEN 20.0::double ELSE 0 END) AS min_notional, CASE WHEN p_size % 10 = 0 THEN 9000.0::double END AS max_notional FROM part"""


def brackets(s, d):
    b = lambda k, lev, lo, hi: F.struct(F.lit(k).alias("bracket"), F.lit(lev).alias("initialLeverage"), lo.cast("double").alias("notionalFloor"), hi.cast("double").alias("notionalCap"))
    p = table(s, d, "part").where("p_partkey % 7 = 0")
    size = F.col("p_size") * 100
    one = F.struct(F.concat(F.lit("p"), "p_partkey").alias("symbol"), F.array(b(2, 20, size, size * 4), b(1, 50, F.lit(0), size), b(3, 5, size * 4, size * 4)).alias("brackets"))
    return feeds.leverage_brackets(p.groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.to_json(F.collect_list(one)).alias("json")))


BRACKETS_SQL = """SELECT 'P' || p_partkey AS symbol, b AS bracket, CASE b WHEN 1 THEN 50 ELSE 20 END AS leverage, CASE b WHEN 1 THEN 0.0::double ELSE p_size * 100.0::double END AS floor, CASE b WHEN 1 THEN p_size * 100.0::double ELSE p_size * 400.0::double END AS cap, b AS place
FROM part, (SELECT unnest([1, 2]) AS b) WHERE p_partkey % 7 = 0"""

#: Questions by the document's number: (text of SQL, symbol, yes is bullish; null where it says nothing).
QUESTIONS = [("'Will Bitcoin be above $' || doc_id || '?'", "BTCUSDT", "true"), ("'Will ETH fall to $' || doc_id || ' today'", "ETHUSDT", "false"), ("'Solana will not reach ' || doc_id || ' USD'", "SOLUSDT", "false"), ("'Will someone win ' || doc_id || ' USD?'", None, None), ("'XRP over or under $' || doc_id", None, None), ("'狗狗币价格突破 ' || doc_id", "DOGEUSDT", "true"), ("'BTC above the moon'", None, None)]
_ASK = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {q}" for k, (q, _, _) in enumerate(QUESTIONS)) + " END"


def sentiment(s, d):
    m = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_ASK).alias("question"), F.expr("CASE WHEN doc_id % 11 = 0 THEN '[\"A\", \"B\"]' WHEN doc_id % 2 = 0 THEN '[\"No\", \"Yes\"]' ELSE '[\"Yes\", \"No\"]' END").alias("outcomes"),
                                            F.expr("concat('[\"', cast(doc_id % 10 / 10e0 as string), '\", \"', cast(1 - doc_id % 10 / 10e0 as string), '\"]')").alias("outcomePrices"), F.expr("cast(n_chars as double)").alias("volume24hr"), F.lit(None).cast("double").alias("volume"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 5e-1 END").alias("prev_bull"))
    return feeds.price_sentiment(m)


SENTIMENT_SQL = f"""WITH q AS (SELECT doc_id AS id, n_chars, CASE doc_id % 7 {" ".join(f"WHEN {k} THEN '{s}'" for k, (_, s, _) in enumerate(QUESTIONS) if s)} END AS symbol, CASE doc_id % 7 {" ".join(f"WHEN {k} THEN {b}" for k, (_, s, b) in enumerate(QUESTIONS) if s)} END AS up,
  CASE WHEN doc_id % 2 = 0 THEN 1 - doc_id % 10 / 10.0::double ELSE doc_id % 10 / 10.0::double END AS yes FROM documents WHERE doc_id % 11 > 0),
b AS (SELECT *, CASE WHEN up THEN yes ELSE 1 - yes END AS bull FROM q WHERE symbol IS NOT NULL),
c AS (SELECT *, CASE WHEN id % 3 = 0 THEN bull - 0.5::double ELSE 0 END AS delta FROM b)
SELECT id, symbol, CASE WHEN up THEN 'bullish-yes' ELSE 'bearish-yes' END AS orientation, round(yes, 6) AS yes_probability, round(bull, 6) AS bull_probability, round(delta, 6) AS delta,
  CASE WHEN (bull - 0.5) * 0.7 + delta * 1.5 > 0.02 THEN 1 WHEN (bull - 0.5) * 0.7 + delta * 1.5 < -0.02 THEN -1 ELSE 0 END AS direction,
  round(least(100.0::double, greatest(0.0::double, 20 + abs(bull - 0.5) * 80 + abs(delta) * 250 + least(15, log10(coalesce(n_chars, 0)::double + 1) * 2))), 6) AS impact FROM c"""


def source_cache(s, d):
    e = table(s, d, "events")
    log = e.select(F.concat("event_type", F.lit("-"), F.col("user_id") % 20).alias("source"), F.col("ts").cast("timestamp").alias("at"), F.lit(86400).alias("ttl_s"), (F.col("event_id") % 3 > 0).alias("ok"), F.col("event_id").alias("value"))
    return feeds.cached_source(log, F.lit("2024-01-15 00:00:00").cast("timestamp"))


CACHE_SQL = """WITH l AS (SELECT event_type || '-' || user_id % 20 AS source, ts, event_id, event_id % 3 > 0 AS ok FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'),
g AS (SELECT source, max(ts) FILTER (ok) AS good, max(ts) AS last, max(struct_pack(t := ts, v := event_id)) FILTER (ok) AS b FROM l GROUP BY source)
SELECT source, b.v AS value, epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(good)) < 86400 AS cached, epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(good)) >= 86400 AS stale, last > good AS failed_since FROM g WHERE good IS NOT NULL"""

QUERIES = {"feed_rss_items": rss_items, "feed_hotlist_items": hotlist, "feed_klines": klines, "feed_exchange_rules": rules, "feed_leverage_brackets": brackets, "feed_price_sentiment": sentiment, "feed_source_cache": source_cache}
ORACLES = {"feed_rss_items": RSS_SQL, "feed_hotlist_items": HOT_SQL, "feed_klines": KLINES_SQL, "feed_exchange_rules": RULES_SQL, "feed_leverage_brackets": BRACKETS_SQL, "feed_price_sentiment": SENTIMENT_SQL, "feed_source_cache": CACHE_SQL}
