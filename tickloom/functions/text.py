"""Titles, prices and factors as text: normalising, tokens, similarity, formatting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OUTLET = r"\s+[-|–—_]\s+[^-|–—_]{2,30}$"


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, which Spark has no expression for: a Pandas UDF, for titles alone."""

    def compose(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(compose, "string")(c)


def normal_title(c: Column) -> Column:
    """NFKC, lower case, without zero-width characters and a trailing outlet's name, letters and digits alone between single spaces."""
    t = F.regexp_replace(F.regexp_replace(F.lower(nfkc(c)), "[​-‍﻿]", ""), OUTLET, "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def title_tokens(title: Column) -> Column:
    """Distinct runs of two or more ASCII letters and digits, and pairs of neighbouring Han characters."""
    runs = F.regexp_extract_all(title, F.lit(r"([㐀-鿿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(title, F.lit("([a-z0-9]{2,})"), F.lit(1)), pairs))


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal titles, 0.86 where one of 12 characters or more is part of the other, else the Jaccard similarity of their tokens."""
    x, y = title_tokens(a), title_tokens(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    union = F.size(F.array_union(x, y))
    jaccard = F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / union).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((F.length(short) >= 12) & F.contains(long, short), 0.86).otherwise(jaccard)


def has_han(c: Column) -> Column:
    return c.rlike("[㐀-鿿]")


def price_text(c: Column) -> Column:
    """Two decimals from 100 on, four from 1 on, six below."""
    return F.when(c.isNull(), "-").when(F.abs(c) >= 100, F.format_number(c, 2)).when(F.abs(c) >= 1, F.format_number(c, 4)).otherwise(F.format_number(c, 6))


def contributions(signals: Column, weights: Column) -> Column:
    """The factors of two maps with their products, the largest by size first."""
    each = F.transform(F.map_entries(signals), lambda e: F.struct((-F.abs(e["value"] * F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.0)))).alias("k"), e["key"].alias("factor"), (e["value"] * F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.0))).alias("contribution")))
    return F.transform(F.array_sort(each), lambda x: F.struct(x["factor"], x["contribution"]))
