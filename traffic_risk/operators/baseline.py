"""Reference behaviour learned on normal traffic."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traffic_risk.functions import c_segment_rsplit, hour_weight
from traffic_risk.functions.normalize import weight_of

RATIO_FLOOR = 1e-6


@dataclass(frozen=True)
class Baseline:
    """What ``fit_baseline`` learned: 24 shares and four numbers.

    They go into later plans as literals, so scoring a day needs neither a join nor a subquery.
    """

    hours: dict[int, float]
    night_mass: float | None
    evening_mass: float | None
    c_mean: float | None
    c_std: float | None

    def hour_ratio(self, hour: Column) -> Column:
        """Reference share of an hour, null for an hour the training days do not have."""
        if not self.hours:
            return F.lit(None).cast("double")
        table = F.create_map(*[F.lit(v) for kv in sorted(self.hours.items()) for v in kv])
        return table[hour]

    def number(self, name: str) -> Column:
        return F.lit(getattr(self, name)).cast("double")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("hour", int(h), float(r)) for h, r in self.hours.items()]
        rows += [
            (n, -1, None if v is None else float(v))
            for n, v in asdict(self).items()
            if n != "hours"
        ]
        frame = spark.createDataFrame(rows, "name string, hour int, value double")
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Baseline:
        rows = spark.read.parquet(path).collect()
        hours = {r["hour"]: r["value"] for r in rows if r["name"] == "hour"}
        return cls(hours, **{r["name"]: r["value"] for r in rows if r["name"] != "hour"})


def hour_counts(events: DataFrame) -> DataFrame:
    """Page views per day and hour."""
    placed = events.where(F.col("date").isNotNull() & F.col("hour_time").isNotNull())
    return placed.groupBy("date", "hour_time").agg(F.count("*").alias("pv"))


def fit_hour_distribution(events: DataFrame | None, by_hour: DataFrame | None = None) -> DataFrame:
    """Share of each hour in a day's traffic: median over the days that have the hour.

    After the first aggregation there are at most 24 rows per day, so the two windows and the
    exact median work on groups bounded by hours and by days. With ``by_hour`` (see ``hour_counts``) events are not read.
    """
    by_hour = hour_counts(events) if by_hour is None else by_hour
    day_total = F.sum("pv").over(Window.partitionBy("date"))
    typical = (
        by_hour.withColumn("ratio", F.col("pv") / (day_total + F.lit(1e-12)))
        .groupBy("hour_time")
        .agg(F.greatest(F.percentile("ratio", F.lit(0.5)), F.lit(RATIO_FLOOR)).alias("ratio"))
    )
    everything = Window.partitionBy(F.lit(1))
    return typical.select("hour_time", (F.col("ratio") / F.sum("ratio").over(everything)).alias("ratio"))


def fit_reference_mass(hours: DataFrame) -> DataFrame:
    """Expected night and evening mass of normal traffic."""
    return hours.where(F.col("hour_time").between(0, 23)).agg(
        F.sum(F.col("ratio") * hour_weight("hour_time", "night")).alias("night_mass"),
        F.sum(F.col("ratio") * hour_weight("hour_time", "evening")).alias("evening_mass"),
    )


def segment_users(events: DataFrame) -> DataFrame:
    """Distinct users per day and C segment. Events without an address share one pseudo segment."""
    return (
        events.where(F.col("date").isNotNull())
        .groupBy("date", c_segment_rsplit("ip").alias("ip_c_segment"))
        .agg(F.count_distinct("distinct_id").alias("cnt"))
    )


def segment_days(users: DataFrame) -> DataFrame:
    """Median and standard deviation of each day's users per C segment, from ``segment_users``.

    The exact median holds one entry per *distinct* count of a day; k distinct counts need at least
    k(k+1)/2 users, so ten billion users a day make no more than 150,000 entries.
    """
    return users.groupBy("date").agg(F.percentile("cnt", F.lit(0.5)).alias("middle"), F.stddev_samp("cnt").alias("deviation"))


def fit_c_segment(events: DataFrame | None, daily: DataFrame | None = None) -> DataFrame:
    """Typical users per C segment: mean over days of the daily median and standard deviation.

    A day with one segment has no deviation and is skipped; a mean deviation of 0 becomes 1. With ``daily`` (see
    ``segment_days``) events are not read.
    """
    daily = segment_days(segment_users(events)) if daily is None else daily
    deviation = F.avg("deviation")
    return daily.agg(
        F.avg("middle").alias("c_mean"),
        F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias("c_std"),
    )


def fit_baseline(events: DataFrame | None, by_hour: DataFrame | None = None, by_day: DataFrame | None = None) -> Baseline:
    """Learn the baseline in one job. Brings at most 26 rows to the driver.

    With ``by_hour`` and ``by_day`` (see ``hour_counts`` and ``segment_days``) events are not read.
    """
    hours = fit_hour_distribution(events, by_hour).where(F.col("hour_time").between(0, 23))
    segments = fit_c_segment(events, by_day)
    rows = hours.select(F.lit("hour").alias("name"), "hour_time", F.col("ratio").alias("value"))
    for name in ("c_mean", "c_std"):
        rows = rows.unionAll(segments.select(F.lit(name), F.lit(-1), F.col(name)))
    found = rows.collect()
    ratios = {r["hour_time"]: r["value"] for r in found if r["name"] == "hour"}
    masses = {
        f"{period}_mass": sum(r * weight_of(h, period) for h, r in sorted(ratios.items()))
        for period in ("night", "evening")
    }
    segment = {r["name"]: r["value"] for r in found if r["name"] != "hour"}
    return Baseline(ratios, **masses, **segment)
