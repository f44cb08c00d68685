"""Scans of raw payloads, on small payloads of every shape."""

import json
import pathlib

from pyspark.sql import functions as F

from tickloom.functions.scalars import timestamp_of
from tickloom.sources import feeds as S

RSS = """<rss><channel><title>c</title><item><title>Bitcoin &lt;b&gt;ETF&lt;/b&gt; inflow</title><description>A  fund
bought</description><link>http://a/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title> </title></item><item><title>Betcha</title><guid>http://g/2</guid></item></channel></rss>"""
ATOM = """<feed><entry><title>Fed cuts</title><link rel="self" href="http://s"/><link rel="alternate" href="http://alt"/><summary>Rates</summary><id>i1</id><updated>2024-01-02T00:00:00Z</updated></entry></feed>"""


def test_feeds_of_three_formats(spark):
    p = spark.createDataFrame([("a", 1, RSS), ("b", 2, ATOM), ("c", 3, "<RDF><item><title>One item of RDF</title><link>http://r</link></item></RDF>"), ("d", 4, "no xml"), ("e", 5, None)], "feed string, payload_id int, xml string")
    got = {(r.feed, r.position): r for r in S.feed_items(p, []).collect()}
    assert set(got) == {("a", 0), ("a", 2), ("b", 0), ("c", 0)}
    assert (got["a", 0].title, got["a", 0].text, got["a", 0].url, str(got["a", 0].occurred_at)) == ("Bitcoin ETF inflow", "A fund bought", "http://a/1", "2024-01-01 10:00:00")
    assert (got["a", 2].url, got["a", 2].text) == ("http://g/2", "Betcha")
    assert (got["b", 0].url, got["b", 0].text, str(got["b", 0].occurred_at)) == ("http://alt", "Rates", "2024-01-02 00:00:00")
    assert {r.title for r in S.feed_items(p, ["etf"]).collect()} == {"Bitcoin ETF inflow"}  # a short keyword is a word of its own
    assert {r.title for r in S.feed_items(p, ["etch"]).collect()} == {"Betcha"}


def test_keywords_are_repaired():
    assert S.repair_keywords(["btc", "???", "btc"], ["x", "比特币"]) == ["btc", "比特币"]
    assert S.repair_keywords(["a", "b"], ["x", "比特币"]) == ["a", "b"]
    assert S.repair_keywords([], ["x"]) == ["x"] and len(S.repair_keywords([str(k) for k in range(200)], [])) == 120


def test_times_of_every_form(spark):
    forms = ["1704103200", "1704103200000", "20240101T100000Z", "2024-01-01T10:00:00Z", "Mon, 01 Jan 2024 10:00:00 GMT", "01 Jan 2024 12:00:00 +0200", "x", ""]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "t string").select(timestamp_of(F.col("t")).cast("string")).collect()]
    assert got == ["2024-01-01 10:00:00"] * 6 + [None] * 2


def test_exchange_rules_and_scalars(spark):
    symbols = [{"symbol": "btcusdt", "status": "TRADING", "contractType": "PERPETUAL", "filters": [{"filterType": "LOT_SIZE", "minQty": "0.001", "stepSize": "0.001"}, {"filterType": "MARKET_LOT_SIZE", "stepSize": "0"}, {"filterType": "PRICE_FILTER", "tickSize": "0.10"}, {"filterType": "MIN_NOTIONAL", "notional": "100", "applyToMarket": False}]}, {"symbol": ""}]
    p = spark.createDataFrame([(json.dumps({"symbols": symbols}),)], "json string")
    (r,) = S.exchange_rules(p).collect()
    assert (r.symbol, r.tradable, r.min_qty, r.step_size, r.tick_size, r.min_notional, r.max_notional) == ("BTCUSDT", True, 0.001, "0.001", "0.10", 100.0, None)
    (r,) = S.exchange_rules(p, futures=False).collect()
    assert r.tradable and r.min_notional == 0
    d = spark.createDataFrame([("B", None, '{"data":[{"oi":"7"}]}', '{"lastFundingRate":"0.01"}', None), ("C", '{"openInterest":"nope"}', None, None, None)], "symbol string, oi_primary string, oi_fallback string, funding_primary string, funding_fallback string")
    assert sorted(map(tuple, S.open_interest_and_funding(d).collect())) == [("B", 7.0, 0.01), ("C", None, None)]


def test_prediction_markets_and_tracking(spark):
    m = lambda i: {"id": i, "question": f"Q{i}", "volume": 1.0}
    events = [{"id": "e1", "volume24hr": 1, "markets": [m("a"), m("b")]}, {"id": "e2", "volume24hr": 9, "markets": [m("c"), m("a")]}]
    tracked = spark.createDataFrame([("z", json.dumps({"m": m("z")})), ("c", json.dumps({"m": m("c")}))], "id string, market string")
    got = {r.id: r.n for r in S.prediction_markets(spark.createDataFrame([(json.dumps(events),)], "json string"), tracked, 3).collect()}
    assert got == {"c": 1, "a": 3, "z": 4}


def test_walk_through_nested_json(spark):
    doc = {"data": [{"title": "Parent article", "url": "u", "items": [{"heading": "Child article", "link": "v"}, {"name": "tiny"}]}, {"title": "Parent article", "url": "u"}], "question": "After that one?"}
    p = spark.createDataFrame([("s", 1, json.dumps(doc)), ("s", 2, "{broken"), ("s", 3, None)], "source string, payload_id int, json string")
    assert [(r.payload_id, r.place, r.title, r.url) for r in S.walk_articles(p).orderBy("payload_id", "place").collect()] == [(1, 0, "After that one?", ""), (1, 1, "Parent article", "u"), (1, 2, "Child article", "v")]
    assert S.walk_articles(p, 1).count() == 1


def test_whales_and_broken_lines(spark, tmp_path):
    t = lambda i, usd, at: {"id": i, "symbol": "btc", "amount_usd": usd, "timestamp": at}
    p = spark.createDataFrame([(json.dumps({"transactions": [t("a", 6e6, 3000), t("b", 4e6, 3000), t("c", 9e6, 100), t("d", 7e6, 3500)]}),)], "json string")
    now = F.timestamp_seconds(F.lit(4000))
    assert [r.id for r in S.whale_transfers(p, now).collect()] == ["a", "d"]
    pathlib.Path(tmp_path / "x.jsonl").write_text('{"id": 1}\n{broken\n{"id": 2}\n')
    assert sorted(r.id for r in S.jsonl(spark, str(tmp_path / "x.jsonl"), "id int").collect()) == [1, 2]
    assert S.catalog(spark).count() == 19
