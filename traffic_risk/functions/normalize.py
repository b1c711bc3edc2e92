"""Scalar expressions shared by all operators. Everything here stays inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traffic_risk import labels
from traffic_risk.columns import FEATURES, FINAL_RISK

# Accepted screen side in pixels, accepted spellings of "true",
# the centre and width of the two hour weights.
MIN_SCREEN_PX = 100
MAX_SCREEN_PX = 10_000
TRUE_WORDS = ("1", "true", "t", "yes")
MATCH_WORDS = ("1", "true", "yes")
HOUR_WEIGHTS = {"night": (3.0, 6.0), "evening": (21.0, 4.0)}

NULL_IP = "nan"
"""Pseudo segment shared by all events without an address."""


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Spellings of a day other than ISO.
DAY_PATTERNS = ("yyyy/M/d", "yyyyMMdd", "yyyy.M.d", "yyyy/M/d H:m:s", "yyyyMMddHHmmss")


def normalize_date(c: str | Column) -> Column:
    """Calendar day of a date, timestamp or text in ISO or one of the known spellings; null when it cannot be read."""
    text = F.trim(_col(c).cast("string"))
    others = [F.try_to_timestamp(text, F.lit(p)).cast("date") for p in DAY_PATTERNS]
    return F.coalesce(_col(c).try_cast("date"), *others)


def number(c: str | Column) -> Column:
    """Numeric reading of a column, null when it cannot be read.

    The cast alone would accept Java literals such as ``360f``.
    """
    text = _col(c).cast("string")
    return F.when(~text.rlike("[0-9.][dDfF]\\s*$"), text.try_cast("double"))


def to_number_or(c: str | Column, default: float | int | None, dtype: str = "double") -> Column:
    value = number(c)
    if dtype != "double":
        value = value.try_cast(dtype)
    return value if default is None else F.coalesce(value, F.lit(default).cast(dtype))


def canonical_resolution(width: str | Column, height: str | Column) -> Column:
    """``"{short}x{long}"`` of a plausible screen, else null. Sides round half to even."""
    w, h = number(width), number(height)
    plausible = w.between(MIN_SCREEN_PX, MAX_SCREEN_PX) & h.between(MIN_SCREEN_PX, MAX_SCREEN_PX)
    w, h = F.bround(w, 0).cast("long"), F.bround(h, 0).cast("long")
    name = F.concat(F.least(w, h).cast("string"), F.lit("x"), F.greatest(w, h).cast("string"))
    return F.when(plausible, name)


def c_segment_rsplit(ip: str | Column) -> Column:
    """Address without its last dotted part. IPv6 stays whole, null becomes one pseudo segment."""
    return F.regexp_replace(F.coalesce(_col(ip), F.lit(NULL_IP)), r"\.[^.]*$", "")


def c_segment_regex(ip: str | Column) -> Column:
    """First three numbers of an IPv4 address, ``''`` for any other text, null for null."""
    return F.regexp_extract(_col(ip), r"^(\d+\.\d+\.\d+)", 1)


def is_direct(referrer: str | Column) -> Column:
    r = _col(referrer)
    return (r.isNull() | (r == "")).cast("int")


def _stripped(c: str | Column) -> Column:
    return F.trim(_col(c).cast("string"))


def blank_to_unknown(c: str | Column, unknown: str = labels.UNKNOWN_TEXT) -> Column:
    return F.coalesce(F.nullif(_stripped(c), F.lit("")), F.lit(unknown))


def bool_flag(c: str | Column) -> Column:
    """True for the usual spellings of true, false for everything else and for null."""
    return F.coalesce(F.lower(_stripped(c)).isin(*TRUE_WORDS), F.lit(False))


def first_day_flag(c: str | Column) -> Column:
    return F.when(bool_flag(c), F.lit(labels.FIRST_DAY)).otherwise(F.lit(labels.NOT_FIRST_DAY))


def parse_match_flag(df: DataFrame, name: str) -> Column:
    """Model-match flag of a stored cohort table; the rule depends on the stored type."""
    dtype, c = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, T.BooleanType):
        flag = c
    elif isinstance(dtype, T.NumericType):
        flag = c != 0
    else:
        flag = F.lower(_stripped(c)).isin(*MATCH_WORDS)
    return F.coalesce(flag, F.lit(False))


def soft_fingerprint(columns: Sequence[str]) -> Column:
    """Weak device dimensions joined by ``|``; a blank one is named after its column."""
    if not columns:
        raise ValueError("a fingerprint needs at least one dimension")
    return F.concat_ws("|", *[blank_to_unknown(c, labels.UNKNOWN_TEXT + c) for c in columns])


def hour_weight(hour: str | Column, period: str) -> Column:
    centre, width = HOUR_WEIGHTS[period]
    return F.exp(-F.pow(_col(hour).cast("double") - F.lit(centre), F.lit(2.0)) / F.lit(width))


def weight_of(hour: int, period: str) -> float:
    """The same weight for one known hour."""
    centre, width = HOUR_WEIGHTS[period]
    return math.exp(-((hour - centre) ** 2) / width)


def select_features(
    df: DataFrame, features: Sequence[str] = FEATURES, strict: bool = False, risk: bool = True
) -> DataFrame:
    """User-day keys plus the features in the given order.

    A missing feature becomes 0.0, or an error when ``strict``. ``final_time_risk`` is always
    part of the output unless ``risk`` is off.
    """
    wanted = list(features)
    if risk and FINAL_RISK not in wanted:
        wanted.append(FINAL_RISK)
    missing = [c for c in wanted if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing model features: {missing}")
    return df.select(
        "date",
        "distinct_id",
        *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in wanted],
    )
