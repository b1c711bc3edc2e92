"""Daily share of each screen resolution, and how far it lies above its usual share.

After the first two aggregations all tables are days x vocabulary: small, whatever the traffic.
Zero-filled days come from exploding the list of days per bucket, and each bucket's days (one entry
per day of the training window) sit in one array, so medians and leave-one-day-out references are
array expressions instead of self joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traffic_risk import labels
from traffic_risk.columns import RESOLUTION_Z, USER_DAY
from traffic_risk.functions import attach, canonical_resolution
from traffic_risk.params import ResolutionParams

# Scale of a normal distribution's median deviation, smallest scale.
MAD_SCALE = 1.4826
MIN_SCALE = 1e-6

OTHER = labels.OTHER_RESOLUTION


@dataclass(frozen=True)
class ResolutionBaseline:
    """Fitted share baseline: one row per bucket, with the shares of all training days."""

    shares: DataFrame
    """resolution, days (array of date, daily_share, resolution_user_days, valid_user_days),
    share_scale_floor and the share summary"""
    params: ResolutionParams

    def grid(self) -> DataFrame:
        """Training shares per (date, bucket), zero-filled."""
        return self.shares.select(F.col("resolution").alias("resolution_bucket"), F.inline("days"))

    def summary(self) -> DataFrame:
        return self.shares.drop("days", "share_scale_floor")

    def persist(self) -> ResolutionBaseline:
        return ResolutionBaseline(self.shares.persist(), self.params)

    def save(self, path: str) -> None:
        self.shares.write.mode("overwrite").parquet(path)

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, params: ResolutionParams = ResolutionParams()
    ) -> ResolutionBaseline:
        return cls(spark.read.parquet(path), params)


def screen_counts(events: DataFrame) -> DataFrame:
    """Page views per (day, user, canonical resolution); the resolution may be null."""
    return (
        events.where(F.col("date").isNotNull() & F.col("distinct_id").isNotNull())
        .groupBy(*USER_DAY, canonical_resolution("screen_width", "screen_height").alias("resolution"))
        .agg(F.count("*").alias("n"))
    )


def main_resolution(events: DataFrame, by_resolution: DataFrame | None = None) -> DataFrame:
    """Most frequent canonical resolution per user-day, null if it has none.

    Counted per (user-day, resolution) first, so a user-day of any size is a handful of rows. Ties
    go to the smaller name (the reference takes whichever it met first).
    """
    by_resolution = screen_counts(events) if by_resolution is None else by_resolution
    best = F.min(F.when(F.col("resolution").isNotNull(), F.struct(-F.col("n"), "resolution")))
    return by_resolution.groupBy(*USER_DAY).agg(best["resolution"].alias("main_resolution_canonical"))


def daily_resolutions(main: DataFrame) -> DataFrame:
    """User-days per (date, resolution); the null row counts user-days without one."""
    return main.groupBy("date", F.col("main_resolution_canonical").alias("resolution")).agg(
        F.count("*").alias("n")
    )


def _is_common(user_days: Column, days: Column, params: ResolutionParams) -> Column:
    return (user_days >= params.min_user_days) & (days >= params.min_days)


def fit_resolution_vocab(
    daily: DataFrame, params: ResolutionParams = ResolutionParams(), common_only: bool = True
) -> DataFrame:
    """Resolutions with their user-days and days; only the common ones unless told otherwise."""
    stats = (
        daily.where(F.col("resolution").isNotNull())
        .groupBy("resolution")
        .agg(F.sum("n").alias("total_user_days"), F.count("*").alias("days_present"))
    )
    common = _is_common(F.col("total_user_days"), F.col("days_present"), params)
    return stats.where(common) if common_only else stats


def check_training(daily: DataFrame, params: ResolutionParams = ResolutionParams()) -> None:
    """Raise when the training user-days cannot carry a share baseline."""
    days = daily.where(F.col("resolution").isNotNull()).select("date").distinct().count()
    if days == 0:
        raise ValueError("training user-days have no valid main resolution")
    if days < params.min_training_days:
        raise ValueError(
            f"training covers {days} days with a valid resolution, need {params.min_training_days}"
        )


def _bucket(resolution: Column, is_common: Column) -> Column:
    return F.when(resolution.isNotNull(), F.when(is_common, resolution).otherwise(F.lit(OTHER)))


def resolution_bucket(main: DataFrame, vocab: DataFrame, salts: int | None = None) -> DataFrame:
    """Common resolution -> itself, rare -> one bucket, none -> null."""
    known = (
        main.groupBy("main_resolution_canonical")
        .agg(F.count("*").alias("n"))
        .join(vocab.select(F.col("resolution").alias("main_resolution_canonical")), "main_resolution_canonical")
        .withColumn("common", F.lit(True))
    )
    out = attach(main, known, ["main_resolution_canonical"], USER_DAY, salts)
    r = F.col("main_resolution_canonical")
    return out.select(*main.columns, _bucket(r, F.col("common").isNotNull()).alias("resolution_bucket"))


def bucket_counts(daily: DataFrame, vocab: DataFrame) -> DataFrame:
    """User-days per (date, bucket); bucketed after counting, so no popular resolution is shuffled."""
    common = vocab.select("resolution", F.lit(True).alias("common"))
    return (
        daily.join(common, "resolution", "left")
        .groupBy("date", _bucket(F.col("resolution"), F.col("common").isNotNull()).alias("resolution_bucket"))
        .agg(F.sum("n").alias("resolution_user_days"))
    )


def _calendar(daily: DataFrame, only_valid_days: bool) -> DataFrame:
    """One row: the days with their user-days that have a resolution, and the smallest scale.

    One array entry per day; the median is over days.
    """
    valid = F.sum(F.when(F.col("resolution").isNotNull(), F.col("n")))
    per_day = daily.groupBy("date").agg(F.coalesce(valid, F.lit(0).cast("long")).alias("users"))
    used = F.col("users") > 0
    day = F.struct("date", F.col("users").alias("valid_user_days"))
    typical = F.percentile(F.when(used, F.col("users")), F.lit(0.5))
    return per_day.agg(
        F.array_sort(F.collect_list(F.when(used, day) if only_valid_days else day)).alias("days"),
        F.greatest(F.lit(0.5) / F.greatest(typical, F.lit(1.0)), F.lit(MIN_SCALE)).alias("share_scale_floor"),
    )


def share_scale_floor(daily: DataFrame) -> DataFrame:
    """Smallest scale: half a user of a typical day (one row)."""
    return _calendar(daily, True).select("share_scale_floor")


def _share(n: Column, valid: Column) -> Column:
    return F.when(valid > 0, n / valid).otherwise(F.lit(0.0))


def _with_all_days(counts: DataFrame, daily: DataFrame, only_valid_days: bool) -> DataFrame:
    """One row per bucket: its share on every day, zero where it does not occur.

    ``counts`` are user-days per (date, resolution_bucket). The bucket of rare resolutions is always
    there. Each row holds one entry per day.
    """
    spark = counts.sparkSession
    present = counts.where(F.col("resolution_bucket").isNotNull()).select(
        "resolution_bucket", "date", "resolution_user_days"
    )
    always = spark.range(1).select(
        F.lit(OTHER).alias("resolution_bucket"),
        F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("long").alias("resolution_user_days"),
    )
    seen = F.when(F.col("date").isNotNull(), F.struct("date", "resolution_user_days"))
    calendar = _calendar(daily, only_valid_days)
    zero = F.lit(0).cast("long")

    def one_day(d: Column) -> Column:
        n = F.coalesce(F.col("seen")[d["date"]], zero)
        return F.struct(
            d["date"].alias("date"),
            _share(n, d["valid_user_days"]).alias("daily_share"),
            n.alias("resolution_user_days"),
            d["valid_user_days"].alias("valid_user_days"),
        )

    return (
        present.unionByName(always)
        .groupBy("resolution_bucket")
        .agg(F.map_from_entries(F.collect_list(seen)).alias("seen"))
        .withColumn("calendar", calendar.select(F.struct("days", "share_scale_floor")).scalar())
        .select(
            "resolution_bucket",
            F.transform("calendar.days", one_day).alias("days"),
            F.col("calendar.share_scale_floor").alias("share_scale_floor"),
        )
    )


def daily_share_grid(daily: DataFrame, vocab: DataFrame, only_valid_days: bool = True) -> DataFrame:
    """Share of every bucket on every day, zero-filled.

    Days are those with a valid user-day, or all days of ``daily``. A common resolution that does not
    occur at all has no rows here (its shares would be zero throughout).
    """
    rows = _with_all_days(bucket_counts(daily, vocab), daily, only_valid_days)
    return rows.select("resolution_bucket", F.inline("days"))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    return (lower + upper) / 2


def summarize_shares(rows: DataFrame) -> DataFrame:
    """Location and scale of the shares in ``days``, never below ``share_scale_floor``."""
    zero = F.lit(0.0)
    n = F.size("days")
    mean = F.aggregate("shares", zero, lambda s, x: s + x) / n
    squares = F.aggregate(
        "shares", zero, lambda s, x: s + (x - F.col("daily_share_mean")) * (x - F.col("daily_share_mean"))
    )
    center = F.col("daily_share_median")
    robust = F.lit(MAD_SCALE) * F.col("daily_share_mad")
    least = F.col("share_scale_floor")
    return (
        rows.withColumn("shares", F.col("days.daily_share"))
        .withColumns({"daily_share_mean": mean, "daily_share_median": _median(F.col("shares"))})
        .withColumns(
            {
                "daily_share_std": F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(zero),
                "daily_share_mad": _median(F.transform("shares", lambda x: F.abs(x - center))),
            }
        )
        .withColumn(
            "scale_source",
            F.when(robust > least, F.lit("MAD"))
            .when(F.col("daily_share_std") > least, F.lit("STD_FALLBACK"))
            .otherwise(F.lit("FLOOR")),
        )
        .withColumns(
            {
                "daily_share_scale": F.when(F.col("scale_source") == "MAD", robust)
                .when(F.col("scale_source") == "STD_FALLBACK", F.col("daily_share_std"))
                .otherwise(least),
                "baseline_days": n,
                "total_user_days": F.aggregate(
                    "days", F.lit(0).cast("long"), lambda s, d: s + d["resolution_user_days"]
                ),
                "days_present": F.size(F.filter("days", lambda d: d["resolution_user_days"] > 0)),
            }
        )
        .drop("shares")
    )


def leave_one_out(rows: DataFrame) -> DataFrame:
    """Median and scale of every bucket's shares without each of its days, one row per (resolution_bucket, date).

    By order statistics: shares are sorted once for each bucket, and the k-th of them without one value is the next one in order if the
    k-th is not below that value. The median without a day can only take three values, so three sorted arrays of deviations serve
    all days in the same way. Mean and variance are updated by the day's share.
    """
    n = F.size("shares")
    kept = n - 1
    low, high = F.floor((kept - 1) / 2).cast("int"), F.floor(kept / 2).cast("int")
    zero = F.lit(0.0)

    def without(ordered: Column, k: Column, value: Column) -> Column:
        at = F.get(ordered, k)
        return F.when(at >= value, F.get(ordered, k + 1)).otherwise(at)

    def middle(ordered: Column, value: Column) -> Column:
        return (without(ordered, low, value) + without(ordered, high, value)) / 2

    def deviations(center: Column) -> Column:
        return F.array_sort(F.transform("ordered", lambda x: F.abs(x - center)))

    ordered = F.col("ordered")
    # without a day above, below or between the two middle ones
    centers = {
        "above": (F.get(ordered, low) + F.get(ordered, high)) / 2,
        "below": (F.get(ordered, low + 1) + F.get(ordered, high + 1)) / 2,
        "between": (F.get(ordered, low) + F.get(ordered, high + 1)) / 2,
    }
    mean = F.aggregate("shares", zero, lambda s, x: s + x) / n
    squares = F.aggregate("shares", zero, lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    prepared = (
        rows.withColumn("shares", F.col("days.daily_share"))
        .withColumns({"ordered": F.array_sort("shares"), "mean": mean})
        .withColumn("squares", squares)
        .withColumns({name: deviations(center) for name, center in centers.items()})
        .select("resolution_bucket", "share_scale_floor", "ordered", "mean", "squares", n.alias("n"), *centers, F.explode("days").alias("day"))
    )
    n, x = F.col("n"), F.col("day.daily_share")
    kept = n - 1
    low, high = F.floor((kept - 1) / 2).cast("int"), F.floor(kept / 2).cast("int")
    center = middle(ordered, x)
    moved_low, moved_high = F.get(ordered, low) >= x, F.get(ordered, high) >= x
    which = F.when(moved_low, F.col("below")).when(moved_high, F.col("between")).otherwise(F.col("above"))
    left = F.greatest(F.col("squares") - (x - F.col("mean")) * (x - F.col("mean")) * n / kept, zero)
    robust = F.lit(MAD_SCALE) * middle(which, F.abs(x - F.col("center")))
    std = F.when(kept > 1, F.sqrt(left / (kept - 1))).otherwise(zero)
    least = F.col("share_scale_floor")
    return (
        prepared.where(n > 1)
        .withColumn("center", center)
        .withColumns({"robust": robust, "std": std})
        .select(
            "resolution_bucket",
            F.col("day.date").alias("date"),
            F.col("center").alias("daily_share_median"),
            F.when(F.col("robust") > least, F.col("robust")).when(F.col("std") > least, F.col("std")).otherwise(least).alias("daily_share_scale"),
        )
    )


def fit_share_baseline(daily: DataFrame, params: ResolutionParams = ResolutionParams()) -> DataFrame:
    """Per bucket: all training days and their summary.

    Whether a resolution is common is decided by a window over its days, one row per day.
    """
    over = Window.partitionBy("resolution")
    common = _is_common(F.sum("n").over(over), F.count("*").over(over), params)
    counts = (
        daily.withColumn("common", common)
        .groupBy("date", _bucket(F.col("resolution"), F.col("common")).alias("resolution_bucket"))
        .agg(F.sum("n").alias("resolution_user_days"))
    )
    rows = summarize_shares(_with_all_days(counts, daily, True))
    return rows.withColumnRenamed("resolution_bucket", "resolution")


def fit_resolution(
    events: DataFrame, params: ResolutionParams = ResolutionParams(), check: bool = False
) -> ResolutionBaseline:
    """Learn the share baseline from training events.

    The result is a small table that is cheap to ``save`` and ``load``; ``persist`` it when it is
    used right away, or its lineage runs again with every use.
    """
    daily = daily_resolutions(main_resolution(events))
    if check:
        check_training(daily, params)
    return ResolutionBaseline(fit_share_baseline(daily, params), params)


def _scored(shares: DataFrame, baseline: ResolutionBaseline, leave_one_day_out: bool) -> DataFrame:
    """Add the positive z-score to rows with (date, resolution_bucket, daily_share).

    Against all training days, or, when ``leave_one_day_out``, against all but the row's own day.
    """
    fitted = baseline.shares.withColumnRenamed("resolution", "resolution_bucket")
    keep = [c for c in shares.columns if c != RESOLUTION_Z]
    summary = fitted.select("resolution_bucket", "daily_share_median", "daily_share_scale")
    rows = shares.join(summary, "resolution_bucket", "left")
    if leave_one_day_out:
        # a row's own day may not be one of the training days: then nothing is left out
        own = leave_one_out(fitted).withColumnsRenamed({"daily_share_median": "own_median", "daily_share_scale": "own_scale"})
        trained = fitted.select("resolution_bucket", F.explode("days.date").alias("date"), F.lit(True).alias("own_day"))
        own = trained.join(own, ["resolution_bucket", "date"], "left")
        rows = rows.join(own, ["resolution_bucket", "date"], "left").withColumns(
            {
                "daily_share_median": F.when(F.col("own_day"), F.col("own_median")).otherwise(F.col("daily_share_median")),
                "daily_share_scale": F.when(F.col("own_day"), F.col("own_scale")).otherwise(F.col("daily_share_scale")),
            }
        )
    z = (F.col("daily_share") - F.col("daily_share_median")) / F.col("daily_share_scale")
    usable = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
    clipped = F.least(F.greatest(z, F.lit(0.0)), F.lit(float(baseline.params.z_clip)))
    return rows.select(*keep, F.when(usable, clipped).otherwise(F.lit(0.0)).alias(RESOLUTION_Z))


def resolution_zscore(shares: DataFrame, baseline: ResolutionBaseline) -> DataFrame:
    """Each day's share against the summary of the training days."""
    return _scored(shares, baseline, leave_one_day_out=False)


def resolution_zscore_loo(shares: DataFrame, baseline: ResolutionBaseline) -> DataFrame:
    """Each day's share against the summary of all *other* training days."""
    return _scored(shares, baseline, leave_one_day_out=True)


def resolution_scores(
    daily: DataFrame, baseline: ResolutionBaseline, leave_one_day_out: bool = False
) -> DataFrame:
    """Score of every (date, resolution) that occurs; a rare one takes its bucket's.

    Scores are made per day and bucket; the resolutions of a day, any number of names sent by clients, look theirs up.
    """
    common = baseline.shares.select("resolution", F.lit(True).alias("common"))
    named = (
        daily.where(F.col("resolution").isNotNull())
        .join(common, "resolution", "left")
        .withColumn("resolution_bucket", _bucket(F.col("resolution"), F.col("common").isNotNull()))
        .select("date", "resolution", "resolution_bucket", "n")
    )
    buckets = named.groupBy("date", "resolution_bucket").agg(F.sum("n").alias("of_bucket"))
    days = buckets.groupBy("date").agg(F.sum("of_bucket").alias("of_day"))
    shares = buckets.join(days, "date").select(
        "date", "resolution_bucket", _share(F.col("of_bucket"), F.col("of_day")).alias("daily_share")
    )
    scored = _scored(shares, baseline, leave_one_day_out)
    return attach(named, scored, ["date", "resolution_bucket"], ["resolution"])


def attach_resolution_feature(
    user_days: DataFrame,
    events: DataFrame,
    baseline: ResolutionBaseline,
    leave_one_day_out: bool = False,
    salts: int | None = None,
    by_resolution: DataFrame | None = None,
) -> DataFrame:
    """Give every user-day the z-score of its bucket; without a resolution it is 0."""
    main = main_resolution(events, by_resolution)
    scores = resolution_scores(daily_resolutions(main), baseline, leave_one_day_out).select(
        "date", F.col("resolution").alias("main_resolution_canonical"), "n", F.col(RESOLUTION_Z).alias("z")
    )
    out = user_days.join(main, list(USER_DAY), "left")
    out = attach(out, scores, ("date", "main_resolution_canonical"), ("distinct_id",), salts)
    return out.select(*user_days.columns, F.coalesce("z", F.lit(0.0)).alias(RESOLUTION_Z))
