"""Look-up join that stays balanced when single keys hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
"""Parts a key is split into by hand where adaptive execution does not split it."""
SPREAD = 4096
"""Parts that rows without a key are spread over."""


def splits_skew(spark: SparkSession) -> bool:
    """Whether this session splits skewed join partitions at run time."""
    wanted = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name, "true").lower() == "true" for name in wanted)


def attach(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    salts: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Left (or inner) join of ``left`` with ``right``, which has one row per key.

    The join has one key more than asked for, a salt. It is 0 on both sides, except for rows of
    ``left`` with a null key, where a left join keeps them: those get a hash of the ``spread``
    columns and so spread over all tasks. The salt also makes both sides of the join shuffles of their own. Adaptive execution
    only splits the partitions of a hot key between two such shuffles; without the
    salt, ``right`` would often come out of an aggregation that is already partitioned by the keys,
    and the hot key would stay in one task. ``right`` has one row per key, so repeating its partition
    for every split is cheap, and all uses shuffle by other keys afterwards or write their result.

    Where adaptive skew handling is off, or ``salts`` is given, every key is split by hand: rows of ``left`` take one of
    ``salts`` numbers by a hash of the ``spread`` columns, rows of ``right`` are repeated for each of them. With ``salts`` 0 the join is
    by the keys alone: for tables that are stored in buckets by them, which a salt would shuffle again.
    """
    keys = list(keys)
    if salts == 0:
        return left.join(right.select(*keys, *[c for c in right.columns if c not in (*left.columns, *keys)]), keys, how)
    salt = "_salt"
    while any(c.lower() == salt for c in (*left.columns, *right.columns)):
        salt = f"_{salt}"
    values = [c for c in right.columns if c not in (*left.columns, *keys)]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # Always 0, but no literal, which would be folded out of the join keys; and never null, as a null
    # check would move into the scan and keep both sides from sharing a shuffle.
    unsalted = F.hash(keys[0]).bitwiseAND(F.lit(0)).cast("long")
    if salts is None and splits_skew(left.sparkSession):
        here, there = unsalted, unsalted
    else:
        n = SALTS if salts is None else salts
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
        here, there = _hashed(spread, n), F.explode(numbers)
    if how != "inner":
        here = F.when(no_key, 1 + _hashed(spread, SPREAD)).otherwise(here)
    salted = left.select(*left.columns, here.alias(salt))
    keyed = right.select(*keys, *values, there.alias(salt)).select(*keys, salt, *values)
    return salted.join(keyed, [*keys, salt], how).select(*left.columns, *values)


def _hashed(spread: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(parts).cast("long"))
