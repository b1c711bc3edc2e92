"""Mergeable summaries of days: distinct users and quantiles over any range of days without the events.

A day's sketch has a fixed size, whatever the traffic; sketches of days merge into that of a range. They are an option beside the exact
reports, with a stated error: distinct counts are within ``distinct_error`` of the truth and quantiles within ``rank_error`` of the wanted rank, each with
95 % confidence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.sources.store import date_range

LOG_BUCKETS = 14
"""2^14 counters of a distinct sketch, some 8 KB."""
QUANTILE_K = 400
"""Accuracy of a quantile sketch, some 10 KB."""


def distinct_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Relative error that a distinct count stays within in 95 of 100 cases."""
    return 2 * 1.04 / math.sqrt(1 << log_buckets)


def rank_error(k: int = QUANTILE_K) -> float:
    """Normalised rank error that a quantile stays within in 95 of 100 cases."""
    return 2.446 / k**0.9433


def distinct_sketches(df: DataFrame, by: Sequence[str], column: str = "distinct_id", log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """A sketch of the different values of ``column`` for each day and group; nulls are not counted."""
    return df.groupBy("date", *by).agg(F.hll_sketch_agg(F.col(column).cast("string"), log_buckets).alias("sketch"))


def range_distinct(sketches: DataFrame, by: Sequence[str], start=None, end=None) -> DataFrame:
    """Estimated distinct values over a range of days, one row per group."""
    merged = date_range(sketches, start, end).groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, F.hll_sketch_estimate("sketch").alias("estimate"))


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """A sketch of a value's distribution for each day and group; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy("date", *by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def range_quantiles(sketches: DataFrame, by: Sequence[str], probs: dict[str, float], start=None, end=None, k: int = QUANTILE_K) -> DataFrame:
    """Estimated quantiles over a range of days, one row per group: an element whose rank is near the wanted one."""
    merged = date_range(sketches, start, end).groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.select(
        *by,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()],
    )


# ------------------------------------------------------------------ membership


PAGE = 32_768
"""Bits of one bitmap of Spark's bitmap functions."""
BITS_PER_KEY = 16
MOST_BYTES = 64 << 20
"""Largest filter that is sent to all tasks."""


def _bit(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits).cast("long"))


def _fresh(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def only_members(df: DataFrame, members: DataFrame, keys: Sequence[str], most_bytes: int = MOST_BYTES, n: int | None = None) -> DataFrame:
    """Rows of ``df`` whose keys may be among those of ``members``: all that are, and at most one in ``BITS_PER_KEY`` of the others.

    ``members`` becomes a bitmap with a bit for each key's hash, which is broadcast in pages of 4 KB and read right at the scan of ``df``, so what a later
    join shuffles falls to about the members. Its size follows from the number of members (``n``, else counted) and is checked: beyond ``most_bytes``
    all rows stay, and the join has to do it alone. Rows with a null key go.
    """
    keys = list(keys)
    known = members.select(*keys).dropna().distinct()
    n = known.count() if n is None else n
    bits = max(PAGE, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length())
    if bits // 8 > most_bytes:
        return df
    page, inside, content = (_fresh(c, df) for c in ("page", "inside", "content"))
    place = known.select(_bit(keys, bits).alias("at"))
    pages = place.groupBy(F.floor(F.col("at") / PAGE).alias(page)).agg(
        F.bitmap_construct_agg(F.pmod("at", F.lit(PAGE).cast("long"))).alias(content)
    )
    at = _bit(keys, bits)
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    asked = df.where(complete).select("*", F.floor(at / PAGE).alias(page), F.pmod(at, F.lit(PAGE).cast("long")).cast("int").alias(inside))
    # a bitmap's byte i holds bits 8 i to 8 i + 7, lowest first
    byte = F.conv(F.hex(F.substring(F.col(content), F.floor(F.col(inside) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(inside, F.lit(8)))) != 0
    return asked.join(F.broadcast(pages), page).where(hit).select(*df.columns)
