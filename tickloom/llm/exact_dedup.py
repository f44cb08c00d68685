"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level passes to the next only the keys that occur twice or more, as a bitmap of
fixed size (see `bitmaps`). Level 1 measures the texts; a length column may be stale or in bytes, so none is read. Level 2 hashes a
prefix of the texts whose length recurs. Level 3 hashes the full text of those whose
length and prefix recur, and decides exactly by length and SHA-256. No text is
shuffled to find the copies; false positives of a bitmap cost a hash and change nothing. The bitmap's size follows the number of
rows up to a bound; far beyond that it lets most rows through, so that finding copies costs a hash of every text, and dropping them one shuffle of the
texts, as dropDuplicates does.

Defined cases: a null text is no copy of anything; empty texts are copies of each other;
rows without an id count as copies and stand last
when one is kept; rows repeated in full are copies; among rows of one id and text any stays, and other columns pass through, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.bitmaps import bitmap_of, bits_for, mark
from tickloom.llm.shared import columns, integer_id, need, numbered, quoted

PREFIX = 256


def _length(text: str) -> Column:
    return F.char_length(text).cast("bigint")


def _marked(docs: DataFrame, text: str, prefix: int) -> DataFrame:
    """All rows with _xd_len and _xd_live: whether length and prefix (may) recur."""
    need(docs, text)
    lengths = docs.where(F.col(text).isNotNull()).select(_length(text).alias("n")).groupBy("n").count().where("count > 1")
    d = mark(docs.withColumn("_xd_len", _length(text)), [F.col("_xd_len")], bitmap_of(lengths, [F.col("n")], 22), "_xd_1", 22)
    key = F.when(F.col("_xd_1"), F.xxhash64("_xd_len", F.substring(text, 1, prefix)))
    d = d.withColumn("_xd_key", F.when(F.col(text).isNotNull(), key))
    twice = d.where(F.col("_xd_key").isNotNull()).groupBy("_xd_key").count().where("count > 1")
    bits = bits_for(docs.count() // 2)
    d = mark(d, [F.col("_xd_key")], bitmap_of(twice, [F.col("_xd_key")], bits), "_xd_2", bits)
    return d.withColumn("_xd_live", F.col("_xd_key").isNotNull() & F.col("_xd_2")).drop("_xd_1", "_xd_2", "_xd_key")


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, n_copies) of every document whose text occurs twice or more; keep_id is the least id of the group."""
    need(docs, doc_id, text)
    w = Window.partitionBy("_xd_len", "_xd_sha")
    return (
        _marked(docs.select(integer_id(docs, doc_id).alias("doc_id"), F.col(quoted(text)).alias("text")), "text", prefix)
        .where("_xd_live")
        .select("doc_id", "_xd_len", F.unhex(F.sha2("text", 256)).alias("_xd_sha"))
        .withColumn("keep_id", F.min("doc_id").over(w))
        .withColumn("n_copies", F.count(F.lit(1)).over(w))
        .where("n_copies > 1")
        .select("doc_id", "keep_id", "n_copies")
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """The documents with one of each group of equal texts: that of the least id. Only rows of recurring length and prefix are shuffled."""
    need(docs, doc_id, text)
    plain = numbered(docs)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    d = _marked(plain, text, prefix)
    w = Window.partitionBy("_xd_len", "_xd_sha").orderBy(F.col(doc_id).asc_nulls_last())
    first = d.where("_xd_live").withColumn("_xd_sha", F.unhex(F.sha2(text, 256))).withColumn("_xd_n", F.row_number().over(w)).where("_xd_n = 1")
    return d.where("not _xd_live").select(*columns(plain)).unionAll(first.select(*columns(plain))).toDF(*docs.columns)


EXACT_COPIES_SQL = """
SELECT doc_id, keep_id, n_copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS n_copies
  FROM documents WHERE text IS NOT NULL)
WHERE n_copies > 1
"""
