"""Messages to events: term counts, direction, impact, symbols by alias, and the aggregate of each symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols in the order in which market-wide events fan out, with their names.
ALIASES = {
    "BTCUSDT": ["BITCOIN", "BTC", "WBTC"], "ETHUSDT": ["ETH", "ETHEREUM", "STETH"], "SOLUSDT": ["SOL", "SOLANA"], "BNBUSDT": ["BINANCE", "BINANCE COIN", "BNB"], "XRPUSDT": ["RIPPLE", "XRP"],
    "DOGEUSDT": ["DOGE", "DOGECOIN"], "ADAUSDT": ["ADA", "CARDANO"], "AVAXUSDT": ["AVALANCHE", "AVAX"], "LINKUSDT": ["CHAINLINK", "LINK"], "TRXUSDT": ["TRON", "TRX"], "LTCUSDT": ["LITECOIN", "LTC"],
    "BCHUSDT": ["BCH", "BITCOIN CASH"], "DOTUSDT": ["DOT", "POLKADOT"], "NEARUSDT": ["NEAR"], "APTUSDT": ["APT", "APTOS"], "ARBUSDT": ["ARB", "ARBITRUM"], "OPUSDT": ["OP", "OPTIMISM"], "INJUSDT": ["INJ", "INJECTIVE"], "SUIUSDT": ["SUI"],
}
BULL = sorted("批准 通过 流入 上线 降息 采用 增持 储备 合作 推出 APPROVE APPROVAL INFLOW LISTING DOVISH ADOPTION BUY ACCUMULATION RESERVE PARTNERSHIP LAUNCH REOPEN".split() + ["ETF INFLOW", "RATE CUT"])
BEAR = sorted("黑客 攻击 漏洞 诉讼 禁止 拒绝 下架 流出 加息 脱锚 破产 冻结 宕机 制裁 HACK EXPLOIT LAWSUIT BAN REJECT REJECTION DELIST OUTFLOW HAWKISH DEPEG INSOLV BANKRUPT FREEZE OUTAGE SELL".split() + ["RATE HIKE", "SEC CHARG"])
HIGH = sorted("比特币 以太坊 加密货币 稳定币 美联储 央行 利率 降息 加息 通胀 关税 制裁 战争 冲突 监管 黑客 攻击 下架 批准 拒绝 ETF SEC FED FOMC CPI PCE RATE BINANCE OKX TETHER USDT USDC STABLECOIN HACK EXPLOIT DELIST APPROVAL REJECTION POLYMARKET LIQUIDATION".split())
MARKET = sorted("CRYPTO BITCOIN BTC ETHEREUM ETH BINANCE OKX STABLECOIN USDT USDC ETF FED FOMC CPI PCE 比特币 以太坊 加密货币 数字货币 虚拟货币 稳定币 美联储 央行 利率 降息 加息 通胀 关税 制裁 战争 冲突".split())
FAN_OUT, FAN_WEIGHT, LEAST_IMPACT, TOP = 6, 0.45, 18.0, 5


def symbol_table(spark) -> DataFrame:
    """The universe as a small dimension: (place, symbol, pattern that finds one of its names)."""
    rows = [(k, s, "(^|[^A-Z0-9])(" + "|".join(names) + ")([^A-Z0-9]|$)") for k, (s, names) in enumerate(ALIASES.items())]
    return spark.createDataFrame(rows, "place int, symbol string, pattern string")


def _found(up: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(up, w)))


def classify(messages: DataFrame) -> DataFrame:
    """messages (id, title, text, weight, corroboration, trend, fresh, ...) with counts of terms, direction, market_wide, matched (symbols), raw_impact and impact.

    The text is searched once: the counts come out of a generator, through which no later column expands them again.
    """
    up = F.upper(F.concat_ws(" ", "title", "text"))
    names = F.filter(F.array(*[F.when(up.rlike("(^|[^A-Z0-9])(" + "|".join(n) + ")([^A-Z0-9]|$)"), F.lit(s)) for s, n in ALIASES.items()]), lambda x: x.isNotNull())
    counts = F.struct(_found(up, BULL).alias("bull"), _found(up, BEAR).alias("bear"), _found(up, HIGH).alias("high"), up.rlike("|".join(MARKET)).alias("market_wide"), names.alias("matched"))
    m = messages.select("*", F.inline(F.array(counts)))
    net = F.col("bull") - F.col("bear")
    support = F.least(F.lit(1.24), 1 + (F.greatest(F.lit(1.0), F.col("corroboration").cast("double")) - 1) * 0.08)
    raw = (18 + F.col("high") * 12 + F.abs(net) * 10) * F.col("weight") * support + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trend"))) * 10
    m = m.withColumn("direction", F.signum(net).cast("int")).withColumn("raw_impact", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    return m.withColumn("impact", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw_impact") * F.col("fresh"))))


def fan_out(events: DataFrame) -> DataFrame:
    """A row for each event and symbol: those whose names it has, at relevance 1; else, if it concerns the whole market, the first six at 0.45."""
    first = F.array(*[F.lit(s) for s in list(ALIASES)[:FAN_OUT]])
    to = F.when(F.size("matched") > 0, F.col("matched")).when(F.col("market_wide"), first)
    return events.withColumn("relevance", F.when(F.size("matched") > 0, F.lit(1.0)).otherwise(F.lit(FAN_WEIGHT))).withColumn("symbol", F.explode(to))


def aggregate_by_symbol(events: DataFrame) -> DataFrame:
    """(symbol, score, direction, event_count, top ids) of every symbol of the universe; the score is clamped before it divides the direction."""
    e = fan_out(events)
    w = Window.partitionBy("symbol").orderBy(F.desc("impact"), "id")
    top = e.withColumn("n", F.row_number().over(w)).where(F.col("n") <= TOP).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("t")).select("symbol", F.transform("t", lambda x: x["id"]).alias("top"))
    a = e.groupBy("symbol").agg(F.sum(F.col("impact") * F.col("relevance")).alias("s"), F.sum(F.col("direction") * F.col("impact") * F.col("relevance")).alias("d"), F.sum("relevance").alias("n"))
    a = symbol_table(events.sparkSession).select("symbol").join(a, "symbol", "left").join(top, "symbol", "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("s", F.lit(0.0))))
    direction = F.when(score > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d") / F.greatest(score, F.lit(1.0))))).otherwise(0.0)
    return a.select("symbol", F.round(score, 6).alias("score"), F.round(direction, 6).alias("direction"), F.round(F.coalesce("n", F.lit(0.0)), 3).alias("event_count"), F.coalesce("top", F.array().cast("array<bigint>")).alias("top"))


def poisson_arrival(aggregates: DataFrame) -> DataFrame:
    """How unusual the number of a symbol's events is, against a rate that grows with its score."""
    k = F.floor("event_count")
    lam = F.greatest(F.lit(0.05), F.least(F.lit(4.0), 0.25 + F.col("score") / 100 * 1.65 + F.when((F.col("score") >= 70) & (F.abs("direction") >= 0.2), 0.35).otherwise(0.0)))
    a = aggregates.withColumn("k", k).withColumn("lambda", lam)
    term = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("k") - 1, F.lit(200)).cast("int"))), F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s")), lambda acc, i: F.struct((acc["p"] * F.col("lambda") / i).alias("p"), (acc["s"] + acc["p"] * F.col("lambda") / i).alias("s")), lambda acc: acc["s"])
    below = F.when(F.col("k") <= 1, F.exp(-F.col("lambda"))).otherwise(F.exp(-F.col("lambda")) * term)
    tail = F.when(F.col("k") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - below))).otherwise(1.0)
    cluster = F.when(F.col("k") > 0, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("k") - F.col("lambda")) / F.sqrt(F.col("lambda") + 1e-9)))).otherwise(0.0)
    surprise = F.when(F.col("k") > 0, 1 - tail).otherwise(0.0)
    return a.select("symbol", F.col("k").alias("observed"), F.round("lambda", 6).alias("lambda"), F.round(tail, 6).alias("tail"), F.round(cluster, 6).alias("cluster"), F.round(surprise * F.abs("direction"), 6).alias("intensity"))
