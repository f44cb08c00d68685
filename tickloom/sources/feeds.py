"""Scans of raw payloads: feeds, hot-lists, candles, exchange rules, prediction markets and nested documents as DataFrames.

Payloads are string columns (one response a row). Known shapes are parsed by Spark's own XML and JSON readers, so
that only the asked fields are kept; a payload that can't be parsed gives no rows. Only the walk through JSON of unknown
depth runs in Python, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import timestamp_of

#: The built-in feeds and hot-lists: a small dimension of (kind, name, most items).
CATALOG = [("rss", name, 15) for name in ("Federal Reserve", "SEC Press", "ECB Press", "CFTC Enforcement", "NPR World", "CNBC Markets", "CNBC Economy", "CoinTelegraph", "Decrypt", "Bitcoin Magazine", "Fastbull", "Investing")]
CATALOG += [("hot", name, 30) for name in ("wallstreetcn", "cls", "jin10", "gelonghui", "xueqiu", "fastbull", "mktnews")]

ITEM = "title: string, description: string, summary: string, content: string, subtitle: string, guid: string, id: string, pubDate: string, published: string, updated: string, date: string"
LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
FEED_SCHEMA = f"channel struct<item: array<struct<{ITEM}, link: {LINK}>>>, entry array<struct<{ITEM}, link: {LINK}>>, item array<struct<{ITEM}, link: {LINK}>>"


def catalog(spark) -> DataFrame:
    return spark.createDataFrame(CATALOG, "kind string, name string, max_items int")


def clean(text: Column) -> Column:
    """Tags and runs of white space become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def first_text(*cols: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cols])


def link_of(links: Column) -> Column:
    """The alternate link, else the first: its address or its text."""
    one = F.coalesce(F.try_element_at(F.filter(links, lambda x: x["_rel"] == "alternate"), F.lit(1)), F.try_element_at(links, F.lit(1)))
    return first_text(one["_href"], one["_VALUE"])


def keyword_match(text: Column, keywords: list[str]) -> Column:
    """Short ASCII keywords (1 to 3 letters or digits) stand between other characters; longer ones may be part of a word. No keywords: all match."""
    words = [k.strip().lower() for k in keywords if k.strip()]
    if not words:
        return F.lit(True)
    short = [k for k in words if len(k) <= 3 and k.isascii() and k.isalnum()]
    low = F.lower(text)
    out = F.lit(False)
    if short:
        out = low.rlike("(^|[^a-z0-9])(" + "|".join(short) + ")([^a-z0-9]|$)")
    for k in words:
        if k not in short:
            out = out | F.contains(low, F.lit(k))
    return out


def repair_keywords(words: list[str], defaults: list[str], most: int = 120) -> list[str]:
    """Drops words of ? and replacement characters alone; if there were any, the defaults of Han script come back. No words left: the defaults."""
    broken = lambda w: bool(w) and set(w) <= {"?", "�"}
    valid = [w for w in words if not broken(w)]
    if len(valid) < len(words):
        valid = list(dict.fromkeys([*valid, *[d for d in defaults if any("㐀" <= c <= "鿿" for c in d)]]))
    return valid[:most] or defaults


def message_id(*parts: Column) -> Column:
    """24 hex digits of the SHA-256 of the parts that aren't empty."""
    return F.substring(F.sha2(F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), "|"), 256), 1, 24)


def _numbered(items: DataFrame, keep: Column, most: Column) -> DataFrame:
    """The rows to keep, the first `most` of each payload by position."""
    w = Window.partitionBy("feed", "payload_id").orderBy("position")
    return items.where(keep).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def feed_items(payloads: DataFrame, keywords: list[str], most: int = 15) -> DataFrame:
    """RSS, Atom and RDF: payloads (feed, payload_id, xml) to (feed, payload_id, position, id, title, text, url, occurred_at)."""
    p = payloads.select("feed", "payload_id", F.from_xml("xml", F.lit(FEED_SCHEMA), {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true"}).alias("p"))
    rows = p.select("feed", "payload_id", F.posexplode(F.coalesce("p.channel.item", "p.entry", "p.item")).alias("position", "r"))
    title = clean(F.col("r.title"))
    rows = rows.withColumn("title", title).withColumn("url", F.coalesce(link_of(F.col("r.link")), F.trim("r.guid"), F.lit("")))
    text = clean(first_text(F.col("r.description"), F.col("r.summary"), F.col("r.content"), F.col("r.subtitle"), F.col("title")))
    rows = rows.withColumn("text", F.when(text != "", text).otherwise(F.col("title")))
    out = rows.select(
        "feed", "payload_id", "position", message_id(F.lit("rss"), F.col("feed"), first_text(F.col("r.guid"), F.col("r.id")), F.col("url"), F.col("title")).alias("id"), "title", "text", "url",
        timestamp_of(first_text(F.col("r.pubDate"), F.col("r.published"), F.col("r.updated"), F.col("r.date"))).alias("occurred_at"),
    )
    return _numbered(out, (F.col("title") != "") & keyword_match(F.concat_ws(" ", "title", "text"), keywords), F.lit(most))


HOT = "status string, updatedTime string, items array<struct<id: string, title: string, url: string, mobileUrl: string, description: string, summary: string, digest: string, extra: struct<hover: string>>>"


def hotlist_items(payloads: DataFrame, keywords: list[str], most: int = 15) -> DataFrame:
    """Hot-lists: payloads (feed, payload_id, json) to (feed, payload_id, rank, id, title, text, url, occurred_at); ranks are places before the filter."""
    p = payloads.select("feed", "payload_id", F.from_json("json", HOT).alias("p")).where("p.status in ('success', 'cache')")
    rows = p.select("feed", "payload_id", "p.updatedTime", F.posexplode("p.items").alias("position", "r"))
    rows = rows.withColumn("title", clean(F.col("r.title"))).withColumn("about", clean(first_text(F.col("r.extra.hover"), F.col("r.description"), F.col("r.summary"), F.col("r.digest"))))
    rows = rows.withColumn("url", F.coalesce(first_text(F.col("r.url"), F.col("r.mobileUrl"), F.col("r.id")), F.lit("")))
    out = rows.select(
        "feed", "payload_id", "position", (F.col("position") + 1).alias("rank"), message_id(F.lit("newsnow"), F.col("feed"), F.col("r.id"), F.col("url"), F.col("title")).alias("id"), "title",
        F.when(F.col("about") != "", F.concat_ws(" ", "title", "about")).otherwise(F.col("title")).alias("text"), "url", F.timestamp_millis(F.col("updatedTime").try_cast("bigint")).alias("occurred_at"),
    )
    return _numbered(out, (F.col("title") != "") & keyword_match(F.concat_ws(" ", "title", "text"), keywords), F.lit(2 * most)).drop("position")


def kline_rows(payloads: DataFrame) -> DataFrame:
    """Candles as JSON arrays [ms, open, high, low, close, volume, ...]: payloads (symbol, json) to rows of a positive close, by time."""
    p = payloads.select("symbol", F.explode(F.from_json("json", "array<array<string>>")).alias("r"))
    num = lambda k: F.try_element_at("r", F.lit(k + 1)).try_cast("double")
    out = p.select("symbol", F.timestamp_millis(num(0).cast("bigint")).alias("ts"), *[num(k).alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)])
    return out.where("ts is not null and close > 0")


def open_interest_and_funding(payloads: DataFrame) -> DataFrame:
    """payloads (symbol, oi_primary, oi_fallback, funding_primary, funding_fallback) as JSON: the first finite of each pair."""
    num = lambda c, path: F.get_json_object(c, path).try_cast("double")
    oi = F.coalesce(num("oi_primary", "$.openInterest"), num("oi_fallback", "$.data[0].oi"))
    funding = F.coalesce(num("funding_primary", "$.lastFundingRate"), num("funding_fallback", "$.data[0].fundingRate"))
    return payloads.select("symbol", oi.alias("open_interest"), funding.alias("funding_rate"))


FILTER = "struct<filterType: string, minQty: string, maxQty: string, stepSize: string, tickSize: string, minNotional: string, maxNotional: string, notional: string, applyToMarket: boolean, applyMinToMarket: boolean, applyMaxToMarket: boolean>"
RULES = f"symbols array<struct<symbol: string, status: string, contractType: string, baseAsset: string, quoteAsset: string, permissions: array<string>, isSpotTradingAllowed: boolean, filters: array<{FILTER}>>>"


def exchange_rules(payloads: DataFrame, futures: bool = True) -> DataFrame:
    """Trading rules of each symbol: payloads (json). The market lot counts before the lot where its step is positive."""
    r = payloads.select(F.explode(F.from_json("json", RULES)["symbols"]).alias("r")).select("r.*").where("symbol <> ''")
    of = lambda kind: F.try_element_at(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(1))
    num = lambda c, d: F.coalesce(c.try_cast("double"), F.lit(d))
    r = r.select("*", of("LOT_SIZE").alias("lot"), of("MARKET_LOT_SIZE").alias("market"), of("PRICE_FILTER").alias("price"), of("MIN_NOTIONAL").alias("minimum"), of("NOTIONAL").alias("notional"))
    step = num(F.col("market.stepSize"), 0.0) > 0
    eff = lambda f: F.when(step, F.col(f"market.{f}")).otherwise(F.col(f"lot.{f}"))
    lower = F.when(F.col("minimum").isNotNull() & (F.lit(futures) | F.coalesce(F.col("minimum.applyToMarket"), F.lit(True))), F.coalesce(F.col("minimum.minNotional").try_cast("double"), num(F.col("minimum.notional"), 0.0)))
    also = F.when(F.col("notional").isNotNull() & F.coalesce(F.col("notional.applyMinToMarket"), F.lit(True)), num(F.col("notional.minNotional"), 0.0))
    upper = F.when(F.coalesce(F.col("notional.applyMaxToMarket"), F.lit(True)) & (num(F.col("notional.maxNotional"), 0.0) > 0), F.col("notional.maxNotional").try_cast("double"))
    spot = (F.size(F.coalesce("permissions", F.array().cast("array<string>"))) == 0) | F.array_contains("permissions", "SPOT") | F.coalesce("isSpotTradingAllowed", F.lit(False))
    tradable = (F.col("status") == "TRADING") & (F.coalesce(F.col("contractType") == "PERPETUAL", F.lit(False)) if futures else F.coalesce(spot, F.lit(False)))
    return r.select(
        F.upper("symbol").alias("symbol"), F.coalesce(first_text(F.col("status")), F.lit("UNKNOWN")).alias("status"), F.coalesce(tradable, F.lit(False)).alias("tradable"), F.greatest(F.lit(0.0), num(eff("minQty"), 0.0)).alias("min_qty"),
        num(eff("maxQty"), 1.7976931348623157e308).alias("max_qty"), F.coalesce(first_text(eff("stepSize"), F.col("lot.stepSize")), F.lit("0")).alias("step_size"), F.coalesce(first_text(F.col("price.tickSize")), F.lit("0")).alias("tick_size"),
        F.greatest(F.lit(0.0), lower, also).alias("min_notional"), upper.alias("max_notional"),
    )


BRACKETS = "array<struct<symbol: string, brackets: array<struct<bracket: int, initialLeverage: int, notionalFloor: double, notionalCap: double>>>>"


def leverage_brackets(payloads: DataFrame) -> DataFrame:
    """payloads (json) to (symbol, bracket, leverage, floor, cap), those whose cap is above their floor, by floor."""
    r = payloads.select(F.explode(F.from_json("json", BRACKETS)).alias("r")).where("r.symbol <> ''").select(F.upper("r.symbol").alias("symbol"), F.explode("r.brackets").alias("b"))
    r = r.select("symbol", F.greatest(F.lit(1), F.coalesce("b.bracket", F.lit(1))).alias("bracket"), F.greatest(F.lit(1), F.coalesce("b.initialLeverage", F.lit(1))).alias("leverage"), F.greatest(F.lit(0.0), F.coalesce("b.notionalFloor", F.lit(0.0))).alias("floor"), F.greatest(F.lit(0.0), F.coalesce("b.notionalCap", F.lit(1.7976931348623157e308))).alias("cap"))
    return r.where("cap > floor").withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("floor", "bracket")))


MARKETS = "array<struct<id: string, volume24hr: double, markets: array<struct<id: string, question: string, slug: string, description: string, outcomes: string, outcomePrices: string, volume24hr: double, volume: double, closed: boolean>>>>"


def prediction_markets(payload: DataFrame, tracked: DataFrame, most: int = 30) -> DataFrame:
    """The markets of the busiest events (payload: json), then tracked ones (id, market as the same struct in JSON) that aren't among them; a market found twice counts once, the last time."""
    events = payload.select(F.posexplode(F.from_json("json", MARKETS)).alias("at", "e"))
    m = events.select("at", F.coalesce("e.volume24hr", F.lit(0.0)).alias("busy"), F.posexplode("e.markets").alias("place", "m"))
    found = m.withColumn("n", F.row_number().over(Window.orderBy(F.desc("busy"), "at", "place"))).where(F.col("n") <= most)  # of one response
    kind = MARKETS.split("markets: array<", 1)[1][:-3]
    rest = tracked.join(found.select(F.col("m.id").alias("id")), "id", "left_anti").select(F.from_json("market", "m " + kind)["m"].alias("m"), F.lit(most + 1).alias("n")) if "market" in tracked.columns else None
    both = found.select("m", "n") if rest is None else found.select("m", "n").unionByName(rest)
    last = F.row_number().over(Window.partitionBy("m.id").orderBy(F.desc("n")))
    return both.withColumn("_k", last).where("_k = 1").select("m.*", "n")


def binary_probabilities(outcomes: Column, prices: Column) -> Column:
    """struct(labels, probabilities, ratio) of a market of two priced outcomes, else null; both are JSON arrays as text."""
    labels = F.transform(F.coalesce(F.from_json(outcomes, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    p = F.transform(F.from_json(prices, "array<string>"), lambda x: x.try_cast("double"))
    total = F.get(p, 0) + F.get(p, 1)
    share = F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / total)))
    named = F.when((F.size(labels) == 2) & F.forall(labels, lambda x: x != ""), labels).otherwise(F.array(F.lit("Yes"), F.lit("No")))
    ok = (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull()) & (total > 0)
    return F.when(ok, F.struct(named.alias("labels"), share.alias("probabilities"), F.when(F.get(share, 1) > 0, F.get(share, 0) / F.get(share, 1)).alias("ratio")))


#: (symbol, names as words, names as parts of words)
PRICED = [("BTCUSDT", "BITCOIN|BTC", "比特币"), ("ETHUSDT", "ETHEREUM|ETH", "以太坊"), ("SOLUSDT", "SOLANA|SOL", "索拉纳"), ("XRPUSDT", "XRP", "瑞波"), ("DOGEUSDT", "DOGECOIN|DOGE", "狗狗币")]


def _either(words: list[str], parts: list[str]) -> str:
    return r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b|" + "|".join(parts)


UP = _either(["AT LEAST", "HIGHER THAN", "HITS?", "REACH(?:ES)?", "EXCEEDS?", "OVER", "ABOVE"], ["达到", "突破", "超过", "高于", "大于"])
DOWN = _either(["AT MOST", "DROPS? BELOW", "FALLS? TO", "LOWER THAN", "UNDER", "BELOW"], ["不高于", "小于", "跌破", "低于"])
NOT_UP = r"\b(?:WILL\s+NOT|WON'T|NOT)\b.{0,25}\b(?:HIT|REACH|EXCEED|OVER|ABOVE)\b|(?:未能|不能|不会).{0,12}(?:高于|达到|突破|超过)"
THRESHOLD = r"[€$£¥]\s*\d|\b\d[\d.,]*\s*(?:DOLLARS?|USDT|USD|M|K)\b|(?:价位|价格).{0,12}\d"


def price_sentiment(markets: DataFrame) -> DataFrame:
    """Markets on a price threshold (id, question, outcomes, outcomePrices, volume24hr, volume, prev_bull): bullish and bearish chances, change, direction and impact."""
    title = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"\s+", " "))
    hit = lambda pattern: title.rlike("(?i)" + pattern)
    symbol = F.coalesce(*[F.when(hit(rf"\b(?:{w})\b|{part}"), F.lit(s)) for s, w, part in PRICED])
    b = binary_probabilities(F.col("outcomes"), F.col("outcomePrices"))
    m = markets.withColumn("symbol", symbol).where(F.col("symbol").isNotNull() & hit(THRESHOLD)).withColumn("b", b).where("b is not null")
    label = F.transform("b.labels", lambda x: F.upper(x))
    yes = F.array_position(label, "YES").cast("int")
    m = m.withColumn("yes", yes).where((F.col("yes") > 0) & (F.array_position(label, "NO") > 0))
    m = m.withColumn("p", F.get("b.probabilities", F.col("yes") - 1))
    bull = ~hit(NOT_UP) & hit(UP)
    m = m.withColumn("bull_yes", bull).where(F.col("bull_yes") != (hit(NOT_UP) | hit(DOWN)))
    m = m.withColumn("bull", F.when(F.col("bull_yes"), F.col("p")).otherwise(1 - F.col("p"))).withColumn("delta", F.coalesce(F.col("bull") - F.col("prev_bull"), F.lit(0.0)))
    volume = F.coalesce("volume24hr", "volume", F.lit(0.0))
    signal = (F.col("bull") - 0.5) * 0.7 + F.col("delta") * 1.5
    impact = 20 + F.abs(F.col("bull") - 0.5) * 80 + F.abs("delta") * 250 + F.least(F.lit(15.0), F.log10(volume + 1) * 2)
    return m.select(
        "id", "symbol", F.when(F.col("bull_yes"), "bullish-yes").otherwise("bearish-yes").alias("orientation"), F.round("p", 6).alias("yes_probability"), F.round("bull", 6).alias("bull_probability"), F.round("delta", 6).alias("delta"),
        F.when(signal > 0.02, 1).when(signal < -0.02, -1).otherwise(0).alias("direction"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), impact)), 6).alias("impact"),
    )


def whale_transfers(payloads: DataFrame, now: Column, least: float = 5e6, most: int = 30) -> DataFrame:
    """payloads (json): transfers of the last hour of `least` dollars or more, the first `most`."""
    r = payloads.select(F.posexplode(F.from_json("json", "transactions array<struct<id: string, symbol: string, amount_usd: double, timestamp: bigint>>")["transactions"]).alias("position", "r"))
    r = r.select("position", "r.id", F.upper("r.symbol").alias("symbol"), "r.amount_usd", F.timestamp_seconds("r.timestamp").alias("ts"))
    r = r.where((F.col("amount_usd") >= least) & (F.col("ts") >= now - F.expr("INTERVAL 1 HOUR")) & (F.col("ts") <= now))
    return r.orderBy("position").limit(most)


ARTICLE = "source string, payload_id long, place int, title string, text string, url string"


def walk_articles(payloads: DataFrame, most: int = 30) -> DataFrame:
    """JSON of any depth (source, payload_id, json): in order, parents first, the objects with a title of more than five characters; each (source, text, url) once."""

    def walk(value, found: list[dict]) -> None:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                title = next((str(v[k]).strip() for k in ("title", "name", "question", "heading") if v.get(k) and not isinstance(v[k], (dict, list))), "")
                if len(title) > 5:
                    found.append({"title": title, "text": str(v.get("description") or v.get("summary") or title), "url": str(v.get("url") or v.get("link") or "")})
                stack += reversed([x for x in v.values() if isinstance(x, (dict, list))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, number, text in zip(*(c.to_pylist() for c in b.columns)):
                found: list[dict] = []
                try:
                    walk(json.loads(text or ""), found)
                except ValueError:
                    continue
                seen, kept = set(), []
                for x in found:
                    if (key := (x["title"], x["url"])) not in seen and len(kept) < most:
                        seen.add(key)
                        kept.append(x)
                rows += [(source, number, k, x["title"], x["text"], x["url"]) for k, x in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], [x.split()[0] for x in ARTICLE.split(", ")])

    return payloads.select("source", F.col("payload_id").cast("bigint"), "json").mapInArrow(run, ARTICLE)


def jsonl(spark, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cached_source(log: DataFrame, now: Column) -> DataFrame:
    """log (source, at, ttl_s, ok, value): each source's last good value; cached while it is younger than its TTL, stale where a later try failed or it is older."""
    good = F.max(F.when(F.col("ok"), F.struct("at", "value", "ttl_s"))).alias("g")
    g = log.where(F.col("at") <= now).groupBy("source").agg(good, F.max("at").alias("last")).where("g is not null")
    age = F.unix_timestamp(now) - F.unix_timestamp("g.at")
    return g.select("source", "g.value", (age < F.col("g.ttl_s")).alias("cached"), (age >= F.col("g.ttl_s")).alias("stale"), (F.col("last") > F.col("g.at")).alias("failed_since"))
