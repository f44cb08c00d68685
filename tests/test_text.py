"""Titles, formatting and contributions."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import text as X


def test_titles(spark):
    df = spark.createDataFrame([("ＢＴＣ rises​ again! - CoinDesk", "btc rises again"), ("美联储降息 now", "美联储降息 now"), (None, None)], "t string, want string")
    assert all(r.t == r.want for r in df.select(X.normal_title(F.col("t")).alias("t"), "want").collect())
    got = spark.createDataFrame([("btc up 12 x 美联储 a",)], "t string").select(X.title_tokens(F.col("t"))).first()[0]
    assert got == ["btc", "up", "12", "美联", "联储"]


@pytest.mark.parametrize("a,b,want", [("same", "same", 1.0), ("fed cuts rates", "fed cuts rates again today", 0.86), ("aa bb", "aa cc", 1 / 3), ("美联储降息", "美联储加息", 2 / 6), ("", "", 0.0), ("a", "b", 0.0)])
def test_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.title_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_prices_and_contributions(spark):
    df = spark.createDataFrame([(1234.5,), (1.5,), (0.00012345,), (None,)], "p double")
    assert [r[0] for r in df.select(X.price_text(F.col("p"))).collect()] == ["1,234.50", "1.5000", "0.000123", "-"]
    df = spark.createDataFrame([({"a": 0.5, "b": -2.0, "c": 1.0}, {"a": 1.0, "b": 0.5})], "s map<string,double>, w map<string,double>")
    assert [tuple(x) for x in df.select(X.contributions(F.col("s"), F.col("w"))).first()[0]] == [("b", -1.0), ("a", 0.5), ("c", 0.0)]
    assert spark.createDataFrame([("比特",), ("btc",)], "t string").select(X.has_han(F.col("t"))).collect() == [(True,), (False,)]
