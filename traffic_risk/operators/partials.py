"""What features and baselines need of raw events, as tables that merge: a batch's part is made once and never again.

* cells: page views and direct views per (day, user, url, hour), merged by sums
* addresses: different (day, user, address), merged by distinct; users may be null here
* screens: page views per (day, user, canonical resolution), merged by sums
* hours: page views per (day, hour), merged by sums

A day's features and its share of a baseline follow from the merged parts of its batches, whatever the number of batches and of events.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traffic_risk.columns import USER_DAY
from traffic_risk.functions import c_segment_rsplit
from traffic_risk.operators.baseline import hour_counts
from traffic_risk.operators.features import cells
from traffic_risk.operators.resolution import screen_counts

COLUMNS = {
    "cells": (*USER_DAY, "url", "hour_time", "pv", "direct_pv"),
    "addresses": (*USER_DAY, "ip"),
    "screens": (*USER_DAY, "resolution", "n"),
    "hours": ("date", "hour_time", "pv"),
}
KINDS = tuple(COLUMNS)


@dataclass(frozen=True)
class Partials:
    """Merged parts, all rows of a key together."""

    cells: DataFrame
    screens: DataFrame
    hours: DataFrame
    everyone: DataFrame
    """Different (day, user, address) with the C segment, users may be null."""

    @property
    def addresses(self) -> DataFrame:
        return self.everyone.where(F.col("distinct_id").isNotNull())

    def persist(self) -> Partials:
        """Kept for several uses; user-days are together in the larger tables, so what is made of them by user-day needs no shuffle."""
        n = int(self.cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def kept(df: DataFrame) -> DataFrame:
            return df.repartition(n, *USER_DAY).persist(StorageLevel.MEMORY_AND_DISK)

        return Partials(kept(self.cells), kept(self.screens), self.hours.persist(StorageLevel.MEMORY_AND_DISK), kept(self.everyone))

    def segment_users(self) -> DataFrame:
        """Distinct users per day and C segment, as ``baseline.segment_users`` counts them in events."""
        return self.everyone.groupBy("date", "ip_c_segment").agg(F.count_distinct("distinct_id").alias("cnt"))


def stored(events: DataFrame) -> Mapping[str, DataFrame]:
    """The parts of some events: tables to keep with a batch, see ``store.append_batch``."""
    dated = events.where(F.col("date").isNotNull())
    return {
        "cells": cells(dated),
        "addresses": dated.select(*COLUMNS["addresses"]).distinct(),
        "screens": screen_counts(dated),
        "hours": hour_counts(dated),
    }


def merge(parts: Iterable[Mapping[str, DataFrame]]) -> Partials:
    """One table of each kind from those of any number of batches."""
    every = list(parts)
    together = {kind: reduce(DataFrame.unionByName, [p[kind].select(*columns) for p in every]) for kind, columns in COLUMNS.items()}

    def summed(kind: str, keys: tuple[str, ...], *values: str) -> DataFrame:
        return together[kind].groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])

    return Partials(
        summed("cells", (*USER_DAY, "url", "hour_time"), "pv", "direct_pv"),
        summed("screens", (*USER_DAY, "resolution"), "n"),
        summed("hours", ("date", "hour_time"), "pv"),
        together["addresses"].distinct().withColumn("ip_c_segment", c_segment_rsplit("ip")),
    )


def partials_of(events: DataFrame) -> Partials:
    return merge([stored(events)])
