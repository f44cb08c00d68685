"""A set of keys as a bitmap of bounded size, to thin a large table before anything of it is shuffled.

The bitmap has 2^bits bits; bits follow a bound of the number of keys, up to MOST_BITS (64 MB), so it may be
broadcast at any scale: a fuller one lets more rows through, which costs time, and never
drops a key that was put in. Whoever uses it decides exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LEAST_BITS, MOST_BITS = 27, 20, 29


def bits_for(keys: int) -> int:
    """Eight bits a key, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * keys - 1).bit_length()))


def _bit(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits).cast("bigint"))


def bitmap_of(df: DataFrame, keys: list[Column], bits: int = BITS) -> DataFrame:
    """At most 2^bits / 32768 rows (bucket, bitmap of 4 KB); map-side combined."""
    b = df.select(_bit(keys, bits).alias("__tl_bit"))
    return b.groupBy(F.bitmap_bucket_number("__tl_bit").alias("__tl_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__tl_bit")).alias("__tl_map"))


def mark(df: DataFrame, keys: list[Column], bitmap: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """The table with a boolean: whether the bitmap may hold the row's key (never false for a key that was put in)."""
    d = df.withColumn("__tl_bit", _bit(keys, bits)).withColumn("__tl_bucket", F.bitmap_bucket_number("__tl_bit"))
    d = d.join(F.broadcast(bitmap), "__tl_bucket", "left")
    byte = F.expr("cast(conv(hex(substring(__tl_map, cast(bitmap_bit_position(__tl_bit) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    hit = F.coalesce(F.expr("shiftright(%s, cast(bitmap_bit_position(__tl_bit) %% 8 as int)) & 1" % "__tl_byte") == 1, F.lit(False))
    return d.withColumn("__tl_byte", byte).withColumn(name, hit).drop("__tl_bit", "__tl_bucket", "__tl_map", "__tl_byte")
