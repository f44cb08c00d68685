"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the paths of a tree, here domain / language / source. The token budget goes
down the tree by weight; a child takes no more than its subtree can supply (its tokens
times max_epochs). What a child lacks goes to its siblings in proportion to their
weights, and only what all of them lack has been taken from the level above: a node's
share there was bounded by what its subtree supplies. Each level is weighted
water-filling in closed form, with window functions over the small table of nodes:
share = min(supply, weight x L), L = max over k of (budget - the k least supplies by
ratio) / (the other weights).

A leaf's share is made of whole epochs and a prefix of one more, in an order seeded by
(seed, epoch, doc_id). The prefix ends in one of 4,096 ranges of the order's hash: ranges
before it are taken whole, later ones left, and only the range in which it ends is
sorted, so a hot leaf is never sorted as a whole and no text is shuffled but that range's.

A node of weight 0 takes nothing, nor does what is below it; negative weights are refused.

Defined cases: null levels are a child of their own, named ""; null or empty texts have
0 tokens; documents are taken while the tokens before them are under the share; ids that
are null or repeated are ordered by their text's hash, and rows repeated in full are documents each; other columns pass through, whatever their
names but "_mx_epoch" and "_mx_tokens", which are refused; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import columns, materialise, need, quoted

LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "forums": 0.2, "reference": 0.1}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
#: Weights of nodes by level and name; others have weight 1 (sources are equal within their language).
WEIGHTS = {0: DOMAIN_WEIGHTS, 1: LANG_WEIGHTS}
SEED, MAX_EPOCHS, SHARE = 17, 2, 1.0
#: The largest table of leaves that is broadcast; beyond it the planner joins by shuffle.
MOST_LEAVES = 200_000


def source_domain(source: Column) -> Column:
    """The domain that a source belongs to, by its number in fives; unnumbered sources are "web"."""
    n = F.coalesce(F.regexp_extract(source, r"^src([0-9]{1,6})$", 1).try_cast("int"), F.lit(0))
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "forums").otherwise("reference")


def _weight(level: int, name: Column, weights: dict[int, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.get(level, {}).items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds share: nodes have cap, weight, budget (the parent's) and path columns."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("weight"), *[c for c in nodes.columns if c.startswith("l_")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = nodes.withColumn("_c", F.sum("cap").over(order) - F.col("cap")).withColumn("_w", F.sum("weight").over(by) - (F.sum("weight").over(order) - F.col("weight")))
    n = n.withColumn("_level", F.max((F.col("budget") - F.col("_c")) / F.col("_w")).over(by))
    return n.withColumn("share", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("weight") * F.col("_level")))).drop("_c", "_w", "_level")


def leaf_shares(leaves: DataFrame, depth: int, weights: dict[int, dict[str, float]], share: float, max_epochs: int) -> DataFrame:
    """leaves: (l_0 .. l_{depth-1}, supply). Adds take (tokens to take), full (whole epochs) and rest (tokens of the epoch after)."""
    if any(w < 0 for table in weights.values() for w in table.values()):
        raise ValueError("weights must not be negative")
    path = [f"l_{k}" for k in range(depth)]
    takes = F.lit(True)
    for k in range(depth):
        takes = takes & (_weight(k, F.col(path[k]), weights) > 0)
    caps = leaves.withColumn("cap", F.when(takes, F.col("supply") * F.lit(float(max_epochs))).otherwise(F.lit(0.0)))
    up = caps.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("double").alias("_s")).select(F.least(F.col("_s") * max_epochs, F.col("_s") * share).alias("budget"))
    for k in range(depth):
        nodes = caps.groupBy(*path[: k + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(k, F.col(path[k]), weights))
        nodes = nodes.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0)))  # of weight 0: they have no cap, so any weight is as good
        nodes = nodes.crossJoin(up) if k == 0 else nodes.join(up, path[:k])
        up = _fill(nodes, path[:k] or [F.lit(0)]).select(*path[: k + 1], F.col("share").alias("budget"))
    out = caps.join(up, path).withColumn("take", F.floor(F.col("budget") + 1e-6).cast("bigint"))
    full = F.when(F.col("supply") > 0, F.floor(F.col("take") / F.col("supply"))).otherwise(0).cast("bigint")
    return out.withColumn("full", full).withColumn("rest", F.col("take") - F.col("full") * F.col("supply")).select(*path, "supply", "take", "full", "rest")


def mix_sources(docs: DataFrame, weights: dict[int, dict[str, float]] | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, levels: list[Column] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The chosen documents with all their columns and _mx_epoch, _mx_tokens: a row for each epoch that takes the document.

    share: the token budget over the tokens that there are. levels: the tree's levels from the root.
    """
    need(docs, text, doc_id)
    if clash := {"_mx_epoch", "_mx_tokens"} & set(docs.columns):
        raise ValueError(f"columns of these names are added: {', '.join(sorted(clash))}")
    weights = WEIGHTS if weights is None else weights
    levels = levels or [source_domain(F.col("source")), F.col("lang"), F.col("source")]
    path = [f"l_{k}" for k in range(len(levels))]
    # Columns go by number meanwhile: their names may be anything.
    names = [f"c{k}" for k in range(len(docs.columns))]
    numbers = [c.alias(n) for c, n in zip(columns(docs), names)]
    d = docs.select(*numbers, *[F.coalesce(c.cast("string"), F.lit("")).alias(f"_mx_{p}") for p, c in zip(path, levels)], F.coalesce(F.regexp_count(F.col(quoted(text)), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("_mx_tokens"))
    doc_id, text = (names[docs.columns.index(c)] for c in (doc_id, text))
    mine = [f"_mx_{p}" for p in path]
    leaves = d.groupBy(*mine).agg(F.sum("_mx_tokens").alias("supply")).toDF(*path, "supply")
    shares = materialise(leaf_shares(leaves, len(path), weights, share, max_epochs), "mix-shares")
    small = shares.count() <= MOST_LEAVES
    near = lambda x: F.broadcast(x) if small else x
    d = d.join(near(shares.toDF(*mine, *[f"_mx_{c}" for c in ("supply", "take", "full", "rest")])), mine)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mx_full").cast("string"), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")))))))
    d = d.withColumn("_mx_key", key).withColumn("_mx_range", F.substring("_mx_key", 1, 3))
    ranges = d.groupBy(*mine, "_mx_range").agg(F.sum("_mx_tokens").alias("n"), F.first("_mx_rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*mine).orderBy("_mx_range")) - F.col("n")
    # The last range that begins under the rest is the one in which the prefix ends.
    edge = ranges.withColumn("b", before).where("b < rest").groupBy(*mine).agg(F.max_by("_mx_range", "_mx_range").alias("_mx_edge"), F.max_by("b", "_mx_range").alias("_mx_before"))
    d = d.join(near(materialise(edge, "mix-edges")), mine, "left")
    whole = d.where("_mx_full > 0").withColumn("_mx_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_mx_full") - 1)))
    under = d.where(F.col("_mx_range") < F.col("_mx_edge")).withColumn("_mx_epoch", F.col("_mx_full"))
    w = Window.partitionBy(*mine).orderBy("_mx_key", F.md5(F.coalesce(F.col(text), F.lit("")))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = d.where(F.col("_mx_range") == F.col("_mx_edge")).withColumn("_mx_sum", F.sum("_mx_tokens").over(w) - F.col("_mx_tokens") + F.col("_mx_before")).where("_mx_sum < _mx_rest").withColumn("_mx_epoch", F.col("_mx_full"))
    out = [*names, "_mx_epoch", "_mx_tokens"]
    return whole.select(*out).unionAll(under.select(*out)).unionAll(at.select(*out)).toDF(*docs.columns, "_mx_epoch", "_mx_tokens")


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens) of the mixture."""
    m = mix_sources(docs.select("doc_id", "text", "lang", "source"), **kw)
    return m.select("doc_id", source_domain(F.col("source")).alias("domain"), "lang", "source", F.col("_mx_epoch").alias("epoch"), F.col("_mx_tokens").alias("tokens"))


def _case(col: str, table: dict[str, float]) -> str:
    return "CASE " + col + "".join(f" WHEN '{k}' THEN {v}::double" for k, v in table.items()) + " ELSE 1.0::double END"


def _fill_sql(name: str, src: str, path: list[str], k: int, weight: str) -> str:
    p, c = ", ".join(path[: k + 1]), path[k]
    part = "PARTITION BY " + ", ".join(path[:k]) if k else ""
    order = f"{part} ORDER BY cap / weight, {p} ROWS UNBOUNDED PRECEDING"
    join = f"JOIN {src} u USING ({', '.join(path[:k])})" if k else f"CROSS JOIN {src} u"
    return f"""
{name}_n AS (SELECT {p}, cap, weight, budget FROM (SELECT {p}, sum(cap) AS cap, any_value({weight}) AS weight FROM caps GROUP BY {p}) n {join}),
{name}_c AS (SELECT *, sum(cap) OVER ({order}) - cap AS cb, sum(weight) OVER ({part}) - (sum(weight) OVER ({order}) - weight) AS wr FROM {name}_n),
{name} AS (SELECT {p}, greatest(0.0::double, least(cap, weight * max((budget - cb) / wr) OVER ({part}))) AS budget FROM {name}_c)"""


MIXTURE_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '\\S+'))::bigint AS tokens,
    CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'books' WHEN n < 15 THEN 'forums' ELSE 'reference' END AS domain
  FROM (SELECT *, coalesce(try_cast(regexp_extract(source, '^src([0-9]{{1,6}})$', 1) AS int), 0) AS n FROM documents)),
leaves AS (SELECT domain, lang, source, sum(tokens)::double AS supply FROM d GROUP BY ALL),
caps AS (SELECT *, supply * {MAX_EPOCHS} AS cap FROM leaves),
top AS (SELECT least(sum(supply) * {MAX_EPOCHS}, sum(supply) * {SHARE}::double) AS budget FROM caps),
{_fill_sql("f0", "top", list(LEVELS), 0, _case("domain", DOMAIN_WEIGHTS))},
{_fill_sql("f1", "f0", list(LEVELS), 1, _case("lang", LANG_WEIGHTS))},
{_fill_sql("f2", "f1", list(LEVELS), 2, "1.0::double")},
shares AS (
  SELECT *, CASE WHEN supply > 0 THEN floor(take / supply)::bigint ELSE 0 END AS whole
  FROM (SELECT domain, lang, source, supply, floor(budget + 1e-6)::bigint AS take FROM caps JOIN f2 USING (domain, lang, source))),
k AS (SELECT d.*, whole, take - whole * supply AS rest, md5('{SEED}:' || whole || ':' || doc_id) AS key FROM d JOIN shares USING (domain, lang, source)),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS sofar FROM k)
SELECT doc_id, domain, lang, source, epoch::bigint AS epoch, tokens FROM (
  SELECT *, unnest(range(whole)) AS epoch FROM k)
UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, tokens FROM o WHERE sofar < rest
"""
