"""Keep the stored cohort result up to date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traffic_risk.operators.cohort import cohort_scores
from traffic_risk.sources.store import calendar, replace_dates_on_disk


def cohort_cache_check(cached: DataFrame, scored: DataFrame, start, end) -> DataFrame:
    """Per day of the range: is it cached, and not older than the scores it was joined with.

    ``cached`` has (date, built_at) rows, ``scored`` (date, scored_at) rows, any number per day.
    """
    have = cached.groupBy("date").agg(F.min("built_at").alias("built_at"), F.count("*").alias("rows"))
    newest = scored.groupBy("date").agg(F.max("scored_at").alias("scored_at"))
    return (
        calendar(cached.sparkSession, start, end)
        .join(have, "date", "left")
        .join(newest, "date", "left")
        .select(
            "date",
            F.coalesce("rows", F.lit(0).cast("long")).alias("row_count"),
            F.col("built_at").isNotNull().alias("covered"),
            (
                F.col("built_at").isNotNull()
                & F.coalesce(F.col("scored_at") <= F.col("built_at"), F.lit(True))
            ).alias("current"),
        )
    )


def refresh_cohort_store(
    visits: DataFrame, iforest: DataFrame, gbt: DataFrame, path: str, start, end
) -> None:
    """Join a range of landing-page visits with the scores and overwrite those days on disk.

    Days of the range without visits are cleared.
    """
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    result = cohort_scores(visits, iforest, gbt).withColumn("built_at", F.current_timestamp())
    replace_dates_on_disk(result, path, days, check=False)
