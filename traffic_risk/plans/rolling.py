"""Baselines over a window of days from statistics that are kept for each day.

When the window moves on by a day, one day's statistics are made, from that day's partial aggregates, and one day's are no longer read; the events and
partial aggregates of the days in between are not touched. All of a baseline's parts are medians, means or counts over days, so
they are the same as those of a fit over all events of the window.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traffic_risk.operators.baseline import Baseline, fit_baseline, segment_days
from traffic_risk.operators.partials import Partials
from traffic_risk.operators.resolution import ResolutionBaseline, check_training, daily_resolutions, fit_share_baseline, main_resolution
from traffic_risk.params import RETENTION_DAYS, ResolutionParams
from traffic_risk.plans.scoring import Store, day_partials
from traffic_risk.sources import versions

HOURS, SEGMENTS, SCREENS = "hours", "segments", "screens"
SCHEMA = "date date, kind string, hour_time int, resolution string, n bigint, middle double, deviation double"


def statistics_path(store: Store) -> str:
    return f"{store.root}/statistics"


def day_statistics(parts: Partials) -> DataFrame:
    """All that baselines need of a day: views per hour, two numbers on C segments, user-days per main resolution."""
    none = {c: F.lit(None).cast(t) for c, t in (f.split(" ") for f in SCHEMA.split(", "))}

    def rows(kind: str, df: DataFrame) -> DataFrame:
        found = {c: F.col(c).cast(t) for c, t in (f.split(" ") for f in SCHEMA.split(", ")) if c in df.columns}
        return df.select(*[{**none, **found, "kind": F.lit(kind)}[f.split(" ")[0]].alias(f.split(" ")[0]) for f in SCHEMA.split(", ")])

    hours = parts.hours.withColumnRenamed("pv", "n")
    segments = segment_days(parts.segment_users())
    screens = daily_resolutions(main_resolution(None, parts.screens))
    return rows(HOURS, hours).unionByName(rows(SEGMENTS, segments)).unionByName(rows(SCREENS, screens))


def refresh_statistics(spark: SparkSession, store: Store, dates: Iterable | None = None) -> list[str]:
    """Make the statistics of stored days (or some of them) whose raw content they do not fit; the days made."""
    raw, path = versions.current(spark, store.raw), statistics_path(store)
    have = versions.current(spark, path)
    wanted = sorted(raw.days) if dates is None else [d for d in sorted({str(d) for d in dates}) if d in raw.days]
    days = [d for d in wanted if [dict(e.facts) for e in have.days.get(d, {}).values()] != [{"raw": raw.digest(d)}] or not raw.digest(d)]
    if not days:
        return []
    found = day_statistics(day_partials(spark, store, days, raw))
    entries = versions.write_batch(found, path, "statistics", stamp=False)
    made = {d: replace(e, facts={"raw": raw.digest(d)}) for d, e in entries.items()}
    versions.commit(spark, path, lambda v: v.with_days("statistics", made, set(days), remember=False))
    return days


def fit_days(stats: DataFrame, params: ResolutionParams = ResolutionParams(), check: bool = False) -> tuple[Baseline, ResolutionBaseline]:
    """Baselines from some days' statistics."""
    by_hour = stats.where(F.col("kind") == HOURS).select("date", "hour_time", F.col("n").alias("pv"))
    by_day = stats.where(F.col("kind") == SEGMENTS).select("date", "middle", "deviation")
    screens = stats.where(F.col("kind") == SCREENS).select("date", "resolution", "n")
    if check:
        check_training(screens, params)
    return fit_baseline(None, by_hour, by_day), ResolutionBaseline(fit_share_baseline(screens, params), params)


def fit_window(
    spark: SparkSession, store: Store, as_of, days: int = RETENTION_DAYS, params: ResolutionParams = ResolutionParams(), check: bool = False
) -> tuple[Baseline, ResolutionBaseline]:
    """Baselines over the ``days`` before ``as_of``. Statistics of new or changed days are made first, nothing else is read."""
    last = date.fromisoformat(str(as_of)) - timedelta(days=1)
    window = [str(last - timedelta(days=n)) for n in range(days)]
    refresh_statistics(spark, store, window)
    stats = versions.read_version(spark, statistics_path(store), window[-1], window[0]).drop(versions.BATCH)
    return fit_days(stats, params, check)
