"""The event source: page views, and the visits of one landing page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traffic_risk.columns import COHORT_DISPLAY, COHORT_USER, PAGEVIEW
from traffic_risk.functions import blank_to_unknown, normalize_date

PAGE_VIEW_EVENT = "pageview"
WEB_LIB = "js"


def read_jdbc(
    spark: SparkSession, url: str, table: str, start, end, partitions: int = 32, **options: str
) -> DataFrame:
    """Event rows of a date range over JDBC, one slice of days per partition.

    The driver class comes with the cluster; nothing in this library depends on one.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    bounds = {
        "partitionColumn": "date",
        "lowerBound": str(start),
        "upperBound": str(end),
        "numPartitions": str(partitions),
    }
    return reader.options(**bounds).load().where(_days(F.col("date"), start, end))


def _days(day: Column, start, end) -> Column:
    rule = day.isNotNull()
    if start is not None:
        rule = rule & (day >= F.lit(start).cast("date"))
    if end is not None:
        rule = rule & (day <= F.lit(end).cast("date"))
    return rule


def _with_day_and_hour(events: DataFrame) -> DataFrame:
    """``date`` becomes a date once, here; ``hour_time`` comes from ``time`` where it is absent."""
    out = events
    if not isinstance(events.schema["date"].dataType, T.DateType):
        out = out.withColumn("date", normalize_date("date"))
    if "hour_time" not in events.columns:
        out = out.withColumn("hour_time", F.hour("time"))
    return out


def scan_pageviews(events: DataFrame, start=None, end=None, excluded_host: str | None = None) -> DataFrame:
    """Browser page views of a date range without known bots and without one host.

    With a host to exclude, rows without a url are dropped too. Conditions are plain comparisons on
    columns, so they reach the file scan, and the day prunes partitions.
    """
    rule = (
        (F.col("event") == PAGE_VIEW_EVENT)
        & F.col("bot_name").isNull()
        & (F.col("lib") == WEB_LIB)
        & _days(F.col("date"), start, end)
    )
    if excluded_host is not None:
        rule = rule & ~F.col("url").contains(excluded_host)
    kept = _with_day_and_hour(events).where(rule)
    return kept.select(*[c for c in PAGEVIEW if c in kept.columns])


def scan_cohort_events(events: DataFrame, start, end, path: str, title: str) -> DataFrame:
    """Page views of one landing page, counted per user, hour and device."""
    kept = _with_day_and_hour(events).where(
        (F.col("event") == PAGE_VIEW_EVENT)
        & F.col("app_version").isNull()
        & F.col("bot_name").isNull()
        & (F.col("url_path") == path)
        & (F.col("title") == title)
        & F.col("distinct_id").isNotNull()
        & _days(F.col("date"), start, end)
    )
    # counted on the raw values: the display names are made afterwards, as rows may share one
    counted = kept.groupBy(
        "date",
        "distinct_id",
        "hour_time",
        *[F.col(c.removesuffix("_display")).alias(c) for c in COHORT_DISPLAY],
    ).agg(F.count("*").alias("seek_report_pv"))
    return counted.withColumns({c: blank_to_unknown(c) for c in COHORT_DISPLAY}).select(*COHORT_USER)
