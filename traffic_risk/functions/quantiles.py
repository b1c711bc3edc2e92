"""Exact quantiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 65_536


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    low: float,
    high: float,
    bins: int = BINS,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    The built-in ``percentile`` keeps every distinct value of a group in one task. Here a
    histogram of at most ``bins`` rows per group (over ``[low, high]``, outliers in the end bins)
    finds the bin each wanted rank falls into, and only the values of those bins are ranked. Equal
    values collapse into one counted row before any shuffle. ``groups`` must be a small, fixed set
    such as risk groups: two rows per group and quantile are broadcast.
    """
    keys = list(groups) or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    out = quantiles_of_counts(counted_values(df, keys, value), keys, probs, low, high, bins)
    return out if groups else out.drop("_all")


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``_n`` rows of each value ``_v`` (also null) per group: all that means and quantiles of a group need."""
    return df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))


def quantiles_of_counts(
    counted: DataFrame, groups: Sequence[str], probs: dict[str, float], low: float, high: float, bins: int = BINS
) -> DataFrame:
    """``exact_quantiles`` from ``counted_values``."""
    keys = list(groups)
    binned = counted.where(F.col("_v").isNotNull()).select(
        *keys,
        F.col("_v"),
        F.col("_n"),
        F.greatest(
            F.least(
                F.floor((F.col("_v") - F.lit(low)) / F.lit(high - low) * F.lit(bins)),
                F.lit(bins - 1).cast("long"),
            ),
            F.lit(0).cast("long"),
        ).alias("_bin"),
    )
    in_order = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    hist = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_before", F.sum("_in_bin").over(in_order) - F.col("_in_bin"))
        .withColumn("_total", F.sum("_in_bin").over(whole))
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    )
    at = F.col("_q.p") * (F.col("_total") - 1)
    ranks = (
        hist.withColumn("_q", wanted)
        .withColumn("_at", at)
        .select(
            *keys,
            "_bin",
            "_before",
            "_in_bin",
            F.col("_q.name").alias("_name"),
            (F.col("_at") - F.floor("_at")).alias("_frac"),
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.floor("_at").alias("rank")),
                    F.struct(F.lit(1).alias("side"), F.ceil("_at").alias("rank")),
                )
            ).alias("_r"),
        )
        .where(
            (F.col("_before") <= F.col("_r.rank"))
            & (F.col("_r.rank") < F.col("_before") + F.col("_in_bin"))
        )
        .select(
            *keys, "_bin", "_before", "_name", "_frac", F.col("_r.side").alias("_side"), F.col("_r.rank").alias("_rank")
        )
    )
    bins_needed = ranks.groupBy(*keys, "_bin").agg(
        F.min("_before").alias("_before"),
        F.collect_list(F.struct("_name", "_frac", "_side", "_rank")).alias("_ranks"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ranked = (
        binned.join(F.broadcast(bins_needed), [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_r", F.explode("_ranks"))
        .where(
            (F.col("_upto") - F.col("_n") <= F.col("_r._rank")) & (F.col("_r._rank") < F.col("_upto"))
        )
    )
    name, side = F.col("_r._name"), F.col("_r._side")

    def quantile(n):
        lo = F.max(F.when((name == n) & (side == 0), F.col("_v")))
        hi = F.max(F.when((name == n) & (side == 1), F.col("_v")))
        frac = F.max(F.when(name == n, F.col("_r._frac")))
        return (lo + (hi - lo) * frac).alias(n)

    return ranked.groupBy(*keys).agg(*[quantile(n) for n in probs])
