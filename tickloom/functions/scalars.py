"""Scalar functions shared by all operators, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def clamp(v: Column | str, lo: float, hi: float) -> Column:
    """v within [lo, hi]; null stays null (greatest and least alone would skip it)."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v.isNull(), v).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))


def safe_number(v: Column, default: float = 0.0) -> Column:
    """A finite double: null and "" count as 0, what isn't a finite number as the default."""
    x = v.cast("string").try_cast("double")
    bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(v.isNull() | (F.trim(v.cast("string")) == ""), F.lit(0.0)).when(bad, F.lit(float(default))).otherwise(x)


def sign(v: Column) -> Column:
    return F.when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0)


def normal_cdf(v: Column) -> Column:
    """Normal distribution by the polynomial of Abramowitz and Stegun 7.1.26 (Spark has no erf)."""
    x = F.abs(v) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + c
    erf = 1 - poly * t * F.exp(-x * x)
    return 0.5 * (1 + F.when(v < 0, -1.0).otherwise(1.0) * erf)


def floor_to_step(v: Column, step: Column | float) -> Column:
    step = step if isinstance(step, Column) else F.lit(step)
    return F.when(step > 0, F.floor(v / step + 1e-9) * step).otherwise(v)


def align_to_step(v: Column, step: Column | float, mode: str = "nearest") -> Column:
    step = step if isinstance(step, Column) else F.lit(step)
    q = v / step
    n = {"floor": F.floor(q + 1e-9), "ceil": F.ceil(q - 1e-9), "nearest": F.floor(q + 0.5 + 1e-9)}[mode]
    return F.when(step > 0, n * step).otherwise(v)


def freshness_level(age_minutes: Column) -> Column:
    out = F.lit("stale")
    for most, name in reversed([(5, "live"), (30, "fresh"), (120, "recent"), (1440, "today"), (4320, "aging")]):
        out = F.when(age_minutes <= most, name).otherwise(out)
    return F.when(age_minutes.isNull(), "unknown").otherwise(out)


def fold_text(c: Column) -> Column:
    """Lower case, without zero-width characters, runs of other than letters and digits as one blank."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[​-‍﻿]", "")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def stable_id(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def timestamp_of(c: Column) -> Column:
    """A time from text: seconds (below 1e10) or milliseconds, YYYYMMDDTHHMMSSZ, an ISO or an RFC 822 date; null else."""
    n = c.try_cast("double")
    number = F.when(n.isNotNull() & (n > 0), F.timestamp_millis(F.when(n < 1e10, n * 1000).otherwise(n).cast("bigint")))
    compact = F.try_to_timestamp(F.regexp_extract(c, r"^(\d{8}T\d{6})Z?$", 1), F.lit("yyyyMMdd'T'HHmmss"))
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (?:GMT|UTC|[+-]\d{4}))", 1), "GMT|UTC", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(number, compact, mail, c.try_cast("timestamp"))
