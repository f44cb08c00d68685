import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use for columns of their own.
CLASHING = ["part", "rid", "node", "h", "n", "tokens", "count", "key", "first", "l_0", "shard", "seq", "a.b", "_bit", "at", "keep_id", "_mx_key", "_mx_l_0", "_nd_id", "_nd_hit", "_xd_len", "_xd_sha", "__tl_map", "__tl_bit", "c0", "c1"]


def words(rng, n, lang="en"):
    syl = {"en": ["th", "er", "on", "an", "re", "he", "in"], "de": ["sch", "ung", "keit", "ein", "ver", "zu"]}[lang]
    return [rng.choice(syl) + rng.choice(syl) + rng.choice(syl) for _ in range(n)]


def messy_rows():
    rng = random.Random(1)
    base = [" ".join(words(rng, 80)) for _ in range(8)]
    rows = [(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "src0", len(base[0])), (101, base[0], None, None, None)]  # copies
    rows += [(102, None, "en", "src1", None), (103, "", "en", "src1", 0), (104, "", "de", "src2", 0), (105, "   \n", "de", "src2", 4)]
    rows += [(None, base[1], "en", "src1", len(base[1])), (None, None, None, None, None)]
    rows += [rows[2], rows[2]]  # repeated rows
    long = " ".join(words(rng, 60_000))
    rows += [(106, long, "en", "src3", len(long)), (107, "x" * 70_000, "en", "src3", 70_000), (108, "日本語のテキスト。" * 50, "ja", "other", 450)]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def with_extra(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def messy(spark):
    return with_extra(spark.createDataFrame(messy_rows(), SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return with_extra(spark.createDataFrame([], SCHEMA))
