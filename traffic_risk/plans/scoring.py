"""From raw events to the two stored score tables, for all days or for some."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traffic_risk.columns import GBT_REQUIRED, IFOREST_REQUIRED, RAW_REQUIRED
from traffic_risk.operators.baseline import Baseline, fit_baseline, segment_days
from traffic_risk.operators.features import user_day_features
from traffic_risk.operators import partials
from traffic_risk.operators.models import BoostedTrees, IsolationForest, score_features
from traffic_risk.operators.resolution import ResolutionBaseline, check_training, daily_resolutions, fit_share_baseline, main_resolution
from traffic_risk.params import RETENTION_DAYS, ResolutionParams
from traffic_risk.sources import versions
from traffic_risk.sources.store import (
    LOADED_AT,
    append_batch,
    day_manifest,
    drop_expired,
    read_batches,
    read_table,
    replace_batches,
    replace_dates,
    replace_found,
    require_columns,
    require_dates,
    stored_days,
)


@dataclass(frozen=True)
class Models:
    """Everything fitted that scoring needs."""

    baseline: Baseline
    resolution: ResolutionBaseline | None
    iforest: IsolationForest
    gbt: BoostedTrees
    version: str = "1"


@dataclass(frozen=True)
class Store:
    """Paths of the stored tables, all partitioned by day, raw events also by ingest batch."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def iforest(self) -> str:
        return f"{self.root}/iforest"

    @property
    def gbt(self) -> str:
        return f"{self.root}/gbt"


def _features(events: DataFrame, models: Models) -> DataFrame:
    require_columns(events, RAW_REQUIRED, "raw events")
    days = events.where(F.col("date").isNotNull())
    return user_day_features(days, models.baseline, models.resolution)


def fit_features(
    events: DataFrame, params: ResolutionParams = ResolutionParams(), leave_one_day_out: bool = False, check: bool = False
) -> tuple[Baseline, ResolutionBaseline, DataFrame]:
    """Baselines learned on some events, and the features of the same events.

    Events are reduced once, to partial aggregates that fits and features share; they are kept until the caller clears the cache or ends.
    """
    parts = partials.partials_of(require_columns(events, RAW_REQUIRED, "raw events")).persist()
    daily = daily_resolutions(main_resolution(None, parts.screens)).persist(StorageLevel.MEMORY_AND_DISK)
    if check:
        check_training(daily, params)
    baseline = fit_baseline(None, parts.hours, segment_days(parts.segment_users()))
    resolution = ResolutionBaseline(fit_share_baseline(daily, params), params).persist()
    return baseline, resolution, user_day_features(None, baseline, resolution, leave_one_day_out, partials=parts)


def _stamp(scores: DataFrame, models: Models) -> DataFrame:
    return scores.withColumn("model_version", F.lit(models.version)).withColumn(
        "built_at", F.current_timestamp()
    )


def build_scores(events: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """Both score tables. Their features are derived once and kept until the caller clears the cache or ends."""
    iforest = score_features(_features(events, models).persist(StorageLevel.MEMORY_AND_DISK), models.iforest)
    return iforest, score_features(iforest, models.gbt)


def append_events(df: DataFrame, store: Store, name: str, batch_id: int = 0) -> list[str]:
    """``append_batch`` to the raw events, with the batch's partial aggregates; the days it has rows for."""
    return append_batch(require_columns(df, RAW_REQUIRED, "raw events"), store.raw, name, batch_id, partials.stored)


def day_partials(spark: SparkSession, store: Store, dates: Iterable[str], version: versions.Version | None = None) -> partials.Partials:
    """Merged partial aggregates of stored days. Raw events are read only of batches that were written without."""
    version = version or versions.current(spark, store.raw)
    days = [str(d) for d in dates]
    kept = {kind: versions.read_derived(spark, store.raw, kind, days, version) for kind in partials.KINDS}
    bare = versions.read_underived(spark, store.raw, partials.KINDS, days, version)
    parts = [kept] if all(k is not None for k in kept.values()) else []
    if bare is not None:
        parts.append(partials.stored(require_columns(bare.where(F.col("date").isNotNull()), RAW_REQUIRED, "raw events")))
    if not parts:
        raise ValueError(f"no raw events of {', '.join(days)}")
    return partials.merge(parts)


def day_features(spark: SparkSession, store: Store, dates: Iterable[str], models: Models, version: versions.Version | None = None) -> DataFrame:
    """Features of stored days from their partial aggregates."""
    parts = day_partials(spark, store, dates, version)
    return user_day_features(None, models.baseline, models.resolution, partials=parts)


def _score_days(spark: SparkSession, store: Store, days: list[str], models: Models) -> None:
    """Derive the days and put them in place of their former scores, each table in one step.

    What the scores were made from, the content of the raw days and the models, is remembered with them.
    """
    raw = versions.current(spark, store.raw)
    gaps = [d for d in days if d not in raw.days]
    if gaps:
        raise ValueError(f"raw events has no rows for {', '.join(gaps)}")
    iforest = _stamp(score_features(day_features(spark, store, days, models, raw), models.iforest), models)
    _put_scores(spark, iforest, store.iforest, days, raw, models)
    fresh = versions.read_version(spark, store.iforest, days=days).drop(versions.BATCH)
    _put_scores(spark, _stamp(score_features(fresh, models.gbt), models), store.gbt, days, raw, models)


def _put_scores(spark: SparkSession, scores: DataFrame, path: str, days: list[str], raw: versions.Version, models: Models) -> None:
    entries = versions.write_batch(scores, path, "scores", stamp=False)
    made = {d: replace(e, facts={"raw": raw.digest(d), "models": models.version}) for d, e in entries.items()}
    versions.commit(spark, path, lambda v: v.with_days("scores", made, set(days), remember=False))


def build_store(spark: SparkSession, store: Store, models: Models) -> None:
    """Score all stored raw days. The second table reads the features the first one wrote."""
    _score_days(spark, store, stored_days(spark, store.raw), models)


def rescore_dates(
    events: DataFrame,
    iforest: DataFrame,
    gbt: DataFrame,
    dates: Iterable,
    models: Models,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Score tables with the given days derived again; other days are kept as they are."""
    days = sorted({str(d) for d in dates})
    touched = events.where(F.col("date").isin(*[F.lit(d).cast("date") for d in days]))
    if check:
        require_dates(touched, days, "raw events")
    new_iforest, new_gbt = build_scores(touched, models)
    return replace_dates(iforest, new_iforest, days), replace_dates(gbt, new_gbt, days)


def rescore_store(spark: SparkSession, store: Store, dates: Iterable, models: Models) -> None:
    """Derive the given days again from the stored partial aggregates and switch to them."""
    _score_days(spark, store, sorted({str(d) for d in dates}), models)


def backfill_day(spark: SparkSession, store: Store, fetched: DataFrame, day, models: Models) -> None:
    """Replace one day in raw events and both score tables; no retention cut."""
    replace_batches(fetched, store.raw, [day], partials.stored)
    rescore_store(spark, store, [day], models)


def stored_manifest(spark: SparkSession, path: str, stamp: str, *extra: str) -> DataFrame:
    """Latest time stamp per day of a stored table, from columns it was written with."""
    return day_manifest(read_table(spark, path), stamp, *extra)


def stale_store_dates(spark: SparkSession, store: Store, models: Models) -> list[str]:
    """Days of the store whose scores do not fit its raw events and these models (at most its days).

    Decided by content: scores remember the digest of the raw day they were made from, so a day that was loaded again
    with the same rows is not stale, whatever its time stamps. Reads versions only, no rows. Scores that lack a column are stale.
    """
    raw = versions.current(spark, store.raw)
    found = set()
    for path, required in ((store.iforest, IFOREST_REQUIRED), (store.gbt, GBT_REQUIRED)):
        scored = versions.current(spark, path)
        lacking = not scored.days or any(c not in read_table(spark, path).columns for c in (*required, "built_at", "model_version"))
        for day in raw.days:
            facts = [dict(e.facts) for e in scored.days.get(day, {}).values()]
            if lacking or facts != [{"raw": raw.digest(day), "models": models.version}] or not raw.digest(day):
                found.add(day)
    return sorted(found)


def sync_window(
    spark: SparkSession,
    store: Store,
    fetch: Callable[[str, str], DataFrame],
    as_of,
    models: Models,
    days: int = RETENTION_DAYS,
) -> tuple[list[str], list[str], list[str]]:
    """Bring the store up to the day before ``as_of``: days fetched, expired and scored again.

    Gaps of the window, also inner ones, are fetched range by range (``fetch`` gets the first and last day and
    gives page views) and replaced; if the stored events lack columns that features need, the whole window is. Days before
    the window are deleted from all three tables, then days without fitting scores are scored. A day the source has nothing
    for stays a gap. A run that failed is repeated by the next one.
    """
    last = date.fromisoformat(str(as_of)) - timedelta(days=1)
    first = last - timedelta(days=days - 1)
    have = set(stored_days(spark, store.raw))
    if have:
        columns = read_table(spark, store.raw).columns
        if any(c not in columns for c in (*RAW_REQUIRED, LOADED_AT)):
            have = set()
    wanted = [first + timedelta(days=n) for n in range(days)]
    gaps = [d for d in wanted if str(d) not in have]
    fetched: list[str] = []
    while gaps:
        n = next((k for k in range(1, len(gaps)) if gaps[k] - gaps[k - 1] != timedelta(days=1)), len(gaps))
        part, gaps = gaps[:n], gaps[n:]
        fetched += replace_found(fetch(str(part[0]), str(part[-1])), store.raw, part, partials.stored)
    expired = sorted({d for path in (store.raw, store.iforest, store.gbt) for d in drop_expired(spark, path, as_of, days)})
    stale = stale_store_dates(spark, store, models) if stored_days(spark, store.raw) else []
    if stale:
        rescore_store(spark, store, stale, models)
    for path in (store.raw, store.iforest, store.gbt):
        versions.sweep(spark, path)
    return fetched, expired, stale
