"""Date-partitioned parquet tables: read, write, replace days, coverage, staleness."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traffic_risk.params import RETENTION_DAYS
from traffic_risk.sources import versions
from traffic_risk.sources.versions import BATCH, LOADED_AT, Derive
from traffic_risk.sources.versions import children as _children
from traffic_risk.sources.versions import delete as _delete
from traffic_risk.sources.versions import exists as _exists

BACKFILL = "backfill"


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """The table itself, or an error at planning time that names the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, start=None, end=None
) -> DataFrame:
    """A stored table, optionally a date range of it; the range prunes partitions. Of a versioned table, the newest version."""
    if versions.is_versioned(spark, path):
        return versions.read_version(spark, path, start, end).drop(BATCH)
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if start is None and end is None else date_range(df, start, end)


def date_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive range of days; reversed bounds are swapped."""
    if start is not None and end is not None and str(start) > str(end):
        start, end = end, start
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def date_slice(df: DataFrame, start=None, end=None, default_days: int = 4) -> DataFrame:
    """A range of days, by default the last ``default_days`` days that the table reaches."""
    if start is not None or end is not None:
        return date_range(df, start, end)
    last = df.agg(F.max("date")).scalar()
    return df.where(F.col("date") >= F.date_sub(last, default_days - 1))


def write_partitions(df: DataFrame, path: str, *below: str) -> None:
    """Write by day; partitions that are not in ``df`` stay as they are.

    The rebalance hint lets AQE cut a day into files of the advisory size and split a heavy
    day over several tasks, so neither small files nor one huge writer per day appear.
    """
    (
        df.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("date", *below)
        .parquet(path)
    )


def append_batch(df: DataFrame, path: str, name: str, batch_id: int = 0, derive: Derive | None = None) -> list[str]:
    """Add one batch to a raw table that keeps batches apart below the day; the days it has rows for.

    ``name`` tells ingests apart: one per load, and per stream and checkpoint. A batch takes the place of its own
    earlier attempt, in one step with all its days, so writing it again after a failure changes nothing. Days on which a backfill has replaced
    this very batch are left out. Every row gets the time it was loaded. ``df`` is evaluated once. ``derive`` names tables that
    are made from the batch's rows and kept with them, see ``versions``.
    """
    spark, batch = df.sparkSession, f"{name}-{int(batch_id)}"
    replaced = versions.current(spark, path).replaced.get(batch, ())
    days = [F.lit(d).cast("date") for d in replaced]
    entries = versions.write_batch(df.where(~F.col("date").isin(*days)) if days else df, path, batch, derive)
    now = versions.commit(spark, path, lambda v: v.with_batch(batch, entries))
    return sorted(d for d in entries if batch in now.days.get(d, {}))


def days_of_batch(spark: SparkSession, path: str, batch: str) -> list[str]:
    """Days a raw table holds rows of a batch for."""
    return sorted(d for d, own in versions.current(spark, path).days.items() if batch in own)


def claim_name(spark: SparkSession, path: str, name: str, owner: str) -> None:
    """Keep an ingest's name for one checkpoint; an error if another one has it."""
    at = f"{path.rstrip('/')}/_ingests/{name}"
    if _exists(spark, at):
        known = versions.read_text(spark, at)
        if known != owner:
            raise ValueError(f"the ingest name {name} belongs to the checkpoint {known}")
    else:
        versions.write_text(spark, at, owner)


def replace_batches(df: DataFrame, path: str, dates: Iterable, derive: Derive | None = None, facts: Mapping[str, str] | None = None) -> None:
    """Replace whole days of such a table: the new rows become the days' only batch.

    ``df`` is evaluated once. Its rows are written first; if a day got none, the call
    fails and nothing has changed. Then one version switches all the days and remembers the batches they held, so that a stream that repeats one of them does
    not bring it back. Readers see the old rows or the new ones, never both; a failure at any step leaves the old ones.
    """
    _replace(df, path, dates, True, derive, facts)


def replace_found(df: DataFrame, path: str, dates: Iterable, derive: Derive | None = None, facts: Mapping[str, str] | None = None) -> list[str]:
    """``replace_batches`` for those of the days that ``df`` has rows for; other days stay as they are. The days replaced."""
    return _replace(df, path, dates, False, derive, facts)


def _replace(df: DataFrame, path: str, dates: Iterable, every: bool, derive: Derive | None, facts: Mapping[str, str] | None) -> list[str]:
    spark, days = df.sparkSession, sorted({str(d) for d in dates})
    batch = f"{BACKFILL}-{uuid.uuid4().hex}"
    entries = versions.write_batch(df.where(F.col("date").isin(*[F.lit(d).cast("date") for d in days])), path, batch, derive, facts=facts)
    if every and len(entries) < len(days):
        for day, entry in entries.items():
            _delete(spark, f"{path.rstrip('/')}/date={day}/{BATCH}={entry.folder}")
        raise ValueError(f"increment has no rows for {', '.join(sorted(set(days) - set(entries)))}")
    if entries:
        versions.commit(spark, path, lambda v: v.with_days(batch, entries))
    return sorted(entries)


def compact_days(spark: SparkSession, path: str, dates: Iterable, derive: Derive | None = None) -> list[str]:
    """Rewrite days of many small batches as one batch each, with the same rows and so the same digest; the days rewritten."""
    now = versions.current(spark, path)
    days = [str(d) for d in dates if len(now.days.get(str(d), {})) > 1]
    if not days:
        return []
    batch = f"{BACKFILL}-{uuid.uuid4().hex}"
    entries = versions.write_batch(versions.read_version(spark, path, number=now.number, days=days).drop(LOADED_AT), path, batch, derive)

    def change(v: versions.Version) -> versions.Version:
        same = {d: e for d, e in entries.items() if v.days.get(d) == now.days.get(d)}  # a day another writer changed stays as it is
        return v.with_days(batch, same)

    done = versions.commit(spark, path, change)
    return sorted(d for d in entries if batch in done.days.get(d, {}))


def read_batches(spark: SparkSession, path: str, start=None, end=None, days: Iterable[str] | None = None) -> DataFrame:
    return versions.read_version(spark, path, start, end, days=days).drop(BATCH, LOADED_AT)


def drop_expired(spark: SparkSession, path: str, as_of, days: int = RETENTION_DAYS) -> list[str]:
    """Take the days older than ``days`` before ``as_of`` out of the table and delete what no recent version names; the days that went."""
    first = date.fromisoformat(str(as_of)) - timedelta(days=days)
    old = [d for d in stored_days(spark, path) if d < str(first)]
    if not versions.is_versioned(spark, path):
        for day in old:
            _delete(spark, f"{path.rstrip('/')}/date={day}")
    elif old:
        versions.commit(spark, path, lambda v: v.without(old))
    return old


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """Days a table has rows for, by its newest version or its folders."""
    return sorted(versions.current(spark, path).days)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_dates(table: DataFrame, new: DataFrame, dates: Iterable) -> DataFrame:
    """Whole days of ``table`` replaced by those of ``new``; columns match by name.

    ``dates`` is the caller's list of days. Rows without a date are dropped.
    """
    days = [F.lit(d).cast("date") for d in dates]
    if not days:
        raise ValueError("no dates to replace")
    kept = table.where(~F.col("date").isin(*days))
    fresh = new.where(F.col("date").isin(*days))
    return kept.unionByName(fresh, allowMissingColumns=True)


def missing_dates(new: DataFrame, dates: Iterable) -> list[str]:
    """Days of the list that ``new`` has no row for (the answer is at most the list)."""
    wanted = sorted({str(d) for d in dates})
    days = [F.lit(d).cast("date") for d in wanted]
    found = new.where(F.col("date").isin(*days)).select(F.col("date").cast("string")).distinct()
    return sorted(set(wanted) - {r[0] for r in found.collect()})


def require_dates(new: DataFrame, dates: Iterable, what: str = "increment") -> DataFrame:
    gaps = missing_dates(new, dates)
    if gaps:
        raise ValueError(f"{what} has no rows for {', '.join(gaps)}")
    return new


def replace_dates_on_disk(new: DataFrame, path: str, dates: Iterable, check: bool = True) -> None:
    """Overwrite the partitions of the given days; the rest of the table is not read.

    ``new`` is evaluated once, into a folder that readers of the table skip; then its days are moved into place one by one.
    With ``check`` every day must be produced, or nothing changes. Without it, days without rows are cleared.
    """
    spark, days, root = new.sparkSession, sorted({str(d) for d in dates}), path.rstrip("/")
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    write_partitions(new.where(F.col("date").isin(*[F.lit(d).cast("date") for d in days])), staged)
    found = set(_children(spark, staged))
    gaps = [d for d in days if f"date={d}" not in found]
    if not (gaps and check):
        for day in days:
            _delete(spark, f"{root}/date={day}")
            if f"date={day}" in found:
                _move(spark, f"{staged}/date={day}", f"{root}/date={day}")
    _delete(spark, staged)
    if gaps and check:
        raise ValueError(f"increment has no rows for {', '.join(gaps)}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(source)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, hadoop.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def retain_window(df: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    return df.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def calendar(spark: SparkSession, start, end) -> DataFrame:
    """One row per day of the range."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("date"))


def day_coverage(df: DataFrame, start, end) -> DataFrame:
    """Rows per day of the range, whether the day is covered, and all rows of the range."""
    per_day = date_range(df, start, end).groupBy("date").agg(F.count("*").alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy(F.lit(1)))  # one row per calendar day
    return (
        calendar(df.sparkSession, start, end)
        .join(per_day, "date", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("long")))
        .withColumn("covered", F.col("row_count") > 0)
        .withColumn("total_rows", total)
    )


def missing_date_ranges(df: DataFrame, start, end) -> DataFrame:
    """Days of the range the table lacks, merged into contiguous ranges."""
    present = date_range(df, start, end).select("date").distinct()
    gaps = calendar(df.sparkSession, start, end).join(present, "date", "left_anti")
    # the rows are days of one range, so a single ordered window is small
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date"))
    return (
        gaps.withColumn("island", F.date_sub("date", number))
        .groupBy("island")
        .agg(F.min("date").alias("range_start"), F.max("date").alias("range_end"))
        .drop("island")
    )


def fetch_plan(df: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Date ranges to fetch so that the window before ``as_of`` is complete, inner gaps included."""
    day = date.fromisoformat(str(as_of))
    first, last = day - timedelta(days=days), day - timedelta(days=1)
    return missing_date_ranges(df, first, last).select(
        F.col("range_start").alias("fetch_start"), F.col("range_end").alias("fetch_end")
    )


def first_fetch_date(df: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """First day to fetch judged by the table's first and last day alone (null: nothing to fetch).

    One row. Kept next to ``fetch_plan``, which also sees gaps between those days.
    """
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    span = df.agg(F.min("date").alias("min_d"), F.max("date").alias("max_d"))
    complete = (F.col("max_d") >= yesterday) & (F.col("min_d") <= cutoff)
    empty_or_late = F.col("min_d").isNull() | (F.col("min_d") > cutoff)
    return span.select(
        F.when(complete, F.lit(None).cast("date"))
        .when(empty_or_late, cutoff)
        .otherwise(F.date_add("max_d", 1))
        .alias("fetch_start")
    )


def stale_dates(
    raw: DataFrame, features: DataFrame, model_version: str, lacking: Sequence[str] = ()
) -> DataFrame:
    """Days to score again: not scored, scored before the raw day was loaded, by another model, or all of them if the
    stored scores lack columns (``lacking``).

    ``raw`` has (date, loaded_at), ``features`` (date, built_at, model_version): one row per day.
    """
    return (
        raw.join(features, "date", "left")
        .where(
            F.lit(bool(lacking))
            | F.col("built_at").isNull()
            | (F.col("loaded_at") > F.col("built_at"))
            | ~F.col("model_version").eqNullSafe(F.lit(model_version))
        )
        .select("date")
    )


def day_manifest(df: DataFrame, stamp: str, *extra: str) -> DataFrame:
    """Latest time stamp per day, with further per-day columns such as the model version."""
    return df.groupBy("date").agg(F.max(stamp).alias(stamp), *[F.max(c).alias(c) for c in extra])


def common_date_range(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days both tables cover: the later first day and the earlier last day (one row)."""
    first, last = F.min("date"), F.max("date")
    return a.agg(first.alias("a_min"), last.alias("a_max")).select(
        F.greatest(F.col("a_min"), b.agg(first).scalar()).alias("min_d"),
        F.least(F.col("a_max"), b.agg(last).scalar()).alias("max_d"),
    )

