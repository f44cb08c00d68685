"""Titles of messages, trends over days, and the tracking of prediction markets until they close; oracles written apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.session import table

#: Titles that repeat in variants: a few hundred stories in four wordings.
_TITLE = "concat('story ', cast(doc_id % 50 as string), ' about rates and markets', CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' today in full' WHEN 2 THEN ' 美联储降息' ELSE ' and nothing else at all' END)"


def similar_titles(s, d):
    """Pairs of titles of a source that are 0.5 or more alike: candidates share one of their rarest tokens, so common words join nothing."""
    t = table(s, d, "documents").where("doc_id < 4000").select("source", "doc_id", F.expr(_TITLE).alias("title")).withColumn("tokens", X.title_tokens(F.col("title")))
    # Titles of Jaccard 0.5 or more share half of the tokens of either, so one of the rarer half and one; contained titles share all.
    each = t.select("source", "doc_id", F.size("tokens").alias("n"), F.explode("tokens").alias("w"))
    rare = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("source", "w")))
    kept = rare.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "w"))).where("k <= n div 2 + 1").select("source", "doc_id", "w")
    pairs = kept.join(each.select("source", F.col("doc_id").alias("other"), "w"), ["source", "w"]).where("doc_id <> other").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    a, b = (t.select(F.col("doc_id").alias(k), F.col("title").alias(f"t{k}")) for k in "ab")
    p = pairs.join(a, "a").join(b, "b").withColumn("similarity", X.title_similarity(F.col("ta"), F.col("tb"))).where("similarity >= 0.5")
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


SIMILAR_SQL = f"""WITH t AS (SELECT source, doc_id, {_TITLE} AS title FROM documents WHERE doc_id < 4000),
k AS (SELECT *, list_distinct(list_concat(regexp_extract_all(title, '[a-z0-9]{{2,}}'), CASE WHEN contains(title, '美联储降息') THEN ['美联', '联储', '储降', '降息'] ELSE [] END)) AS tok FROM t),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.title AS ta, y.title AS tb, len(list_intersect(x.tok, y.tok))::double / len(list_distinct(list_concat(x.tok, y.tok))) AS j FROM k x JOIN k y ON x.source = y.source AND x.doc_id < y.doc_id),
s AS (SELECT a, b, CASE WHEN ta = tb THEN 1.0::double WHEN contains(ta, tb) OR contains(tb, ta) THEN 0.86::double ELSE j END AS similarity FROM p)
SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.5"""


def trend_ttl(s, d):
    """Trend records (a user's events of a kind): those seen within seven days of now, the 4,000 seen last."""
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    e = table(s, d, "events").where(F.col("ts") <= now).groupBy("event_type", "user_id").agg(F.max("ts").alias("seen"), F.count(F.lit(1)).alias("observations"))
    return e.where(F.col("seen") > now - F.expr("INTERVAL 7 DAYS")).orderBy(F.desc("seen"), "event_type", "user_id").limit(4000).select("event_type", "user_id", F.unix_micros(F.col("seen").cast("timestamp")).alias("seen_us"), "observations")


TTL_SQL = """SELECT event_type, user_id, epoch_us(max(ts)) AS seen_us, count(*) AS observations FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' GROUP BY event_type, user_id
HAVING max(ts) > TIMESTAMP '2024-01-18 00:00:00' ORDER BY max(ts) DESC, event_type, user_id LIMIT 4000"""


def market_tracking(s, d):
    """Users as prediction markets, their events as observations: tracked until the first "purchase", which closes them; last values, first and last seen, and the last of each of the newest 168 hours."""
    e = table(s, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.col("value").alias("p"), (F.col("event_type") == "purchase").alias("closed"))
    e = e.withColumn("end", F.min(F.when(F.col("closed"), F.struct("ts", "event_id"))).over(Window.partitionBy("id"))).where("end is null or struct(ts, event_id) <= end")
    e = e.withColumn("hour", F.date_trunc("hour", "ts"))
    state = e.groupBy("id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(F.when(F.col("closed"), F.col("ts"))).alias("closed_at"), F.count(F.lit(1)).alias("observations"), F.max_by("p", F.struct("ts", "event_id")).alias("yes"))
    hourly = e.groupBy("id", "hour").agg(F.max_by("p", F.struct("ts", "event_id")).alias("p")).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hour")))).where("k <= 168").groupBy("id").agg(F.count(F.lit(1)).alias("hours"), F.sum("p").alias("total"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return state.join(hourly, "id").select("id", F.when(F.col("closed_at").isNull(), "tracking").otherwise("closed").alias("status"), us("first").alias("first_us"), us("last").alias("last_us"), us("closed_at").alias("closed_us"), "observations", F.round("yes", 4).alias("yes"), "hours", F.round("total", 4).alias("hourly_total"))


TRACKING_SQL = """WITH c AS (SELECT user_id, min((ts, event_id)) AS e FROM events WHERE event_type = 'purchase' GROUP BY user_id),
o AS (SELECT ev.user_id AS id, ts, event_id, value, event_type FROM events ev LEFT JOIN c ON c.user_id = ev.user_id WHERE e IS NULL OR (ts, event_id) <= e),
h AS (SELECT id, hour, arg_max(value, (ts, event_id)) AS p, row_number() OVER (PARTITION BY id ORDER BY hour DESC) AS k FROM (SELECT *, date_trunc('hour', ts) AS hour FROM o) GROUP BY id, hour)
SELECT id, CASE WHEN bool_or(event_type = 'purchase') THEN 'closed' ELSE 'tracking' END AS status, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(max(ts) FILTER (event_type = 'purchase')) AS closed_us, count(*) AS observations, round(arg_max(value, (ts, event_id)), 4) AS yes,
  any_value(hours) AS hours, round(any_value(total), 4) AS hourly_total FROM o JOIN (SELECT id, count(*) AS hours, sum(p) AS total FROM h WHERE k <= 168 GROUP BY id) USING (id) GROUP BY id"""

QUERIES = {"similar_titles": similar_titles, "trend_ttl": trend_ttl, "market_tracking": market_tracking}
ORACLES = {"similar_titles": SIMILAR_SQL, "trend_ttl": TTL_SQL, "market_tracking": TRACKING_SQL}
