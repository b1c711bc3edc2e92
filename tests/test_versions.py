"""Versioned day tables: what readers see at every step, late rows from partial aggregates, staleness by content, rolling fits."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from traffic_risk.columns import FEATURES
from traffic_risk.operators import partials, resolution
from traffic_risk.operators.baseline import fit_baseline
from traffic_risk.operators.features import user_day_features
from traffic_risk.operators.resolution import ResolutionBaseline, fit_resolution
from traffic_risk.params import ResolutionParams
from traffic_risk.plans import rolling, scoring
from traffic_risk.sources import store, versions
from tests.conftest import rows_of


def day(n):
    return date(2024, 1, 1) + timedelta(days=n - 1)


def users(df):
    return sorted((r.date.day, r.distinct_id) for r in df.collect())


@pytest.fixture
def raw(tmp_path):
    return str(tmp_path / "raw")


def test_a_reader_sees_old_rows_until_the_switch_and_may_finish_after_it(spark, events, raw):
    store.append_batch(events({"date": day(1), "distinct_id": "old"}), raw, "load")
    began = store.read_batches(spark, raw)
    entries = versions.write_batch(events({"date": day(1), "distinct_id": "new"}), raw, "fix")
    assert users(store.read_batches(spark, raw)) == [(1, "old")]  # written, not switched
    versions.commit(spark, raw, lambda v: v.with_days("fix", entries))
    assert users(store.read_batches(spark, raw)) == [(1, "new")]
    assert users(began) == [(1, "old")]
    assert users(versions.read_version(spark, raw, number=versions.numbers(spark, raw)[-2])) == [(1, "old")]


STEPS = ("traffic_risk.sources.store.write_partitions", "traffic_risk.sources.versions.content_digest", "traffic_risk.sources.versions.write_text", "traffic_risk.sources.versions._put")


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_at_any_step_leaves_the_old_rows(spark, events, raw, monkeypatch, step, after):
    store.append_batch(events({"date": day(1), "distinct_id": "old"}, {"date": day(2), "distinct_id": "old"}), raw, "load")
    new = events({"date": day(1), "distinct_id": "new"}, {"date": day(2), "distinct_id": "new"})
    module, name = step.rsplit(".", 1)
    import importlib

    real = getattr(importlib.import_module(module), name)

    def broken(*args, **kwargs):
        if after:
            real(*args, **kwargs)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(step, broken)
        with pytest.raises(RuntimeError, match="lost"):
            store.replace_batches(new, raw, [day(1), day(2)])
    switched = after and name == "_put"
    assert users(store.read_batches(spark, raw)) == [(d, "new" if switched else "old") for d in (1, 2)]
    store.replace_batches(new, raw, [day(1), day(2)])
    assert users(store.read_batches(spark, raw)) == [(1, "new"), (2, "new")]
    versions.sweep(spark, raw, keep=1, orphan_hours=-1)
    assert users(store.read_batches(spark, raw)) == [(1, "new"), (2, "new")]


def test_writers_at_the_same_time_both_count(spark, events, raw):
    store.append_batch(events({"date": day(1), "distinct_id": "a"}), raw, "load")
    mine = versions.write_batch(events({"date": day(1), "distinct_id": "mine"}), raw, "mine")
    calls = []

    def change(v):
        if not calls:  # another writer is faster, once
            store.append_batch(events({"date": day(1), "distinct_id": "other"}), raw, "other")
        calls.append(v.number)
        return v.with_batch("mine", mine)

    versions.commit(spark, raw, change)
    assert len(calls) == 2
    assert users(store.read_batches(spark, raw)) == [(1, "a"), (1, "mine"), (1, "other")]


def test_sweep_keeps_what_recent_versions_name(spark, events, raw):
    for n in range(4):
        store.append_batch(events({"date": day(1), "distinct_id": f"v{n}"}), raw, "load", 0)
    orphan = versions.write_batch(events({"date": day(1), "distinct_id": "lost"}), raw, "lost")
    assert len(versions.sweep(spark, raw, keep=2)) == 2  # two old attempts; the orphan may be a writer's
    assert len(versions.numbers(spark, raw)) == 2
    assert users(versions.read_version(spark, raw, number=versions.numbers(spark, raw)[0])) == [(1, "v2")]
    assert orphan["2024-01-01"].folder in versions.sweep(spark, raw, keep=2, orphan_hours=-1)[0]
    assert users(store.read_batches(spark, raw)) == [(1, "v3")]


def test_tables_from_before_versions_stay_readable(spark, events, raw):
    rows = events({"date": day(1), "distinct_id": "a"}, {"date": day(2), "distinct_id": "b"})
    store.write_partitions(rows.withColumn("loaded_at", F.current_timestamp()).withColumn("ingest_batch", F.lit("load-0")), raw, "ingest_batch")
    assert users(store.read_batches(spark, raw)) == [(1, "a"), (2, "b")]
    store.append_batch(events({"date": day(2), "distinct_id": "c"}), raw, "late")
    assert users(store.read_batches(spark, raw)) == [(1, "a"), (2, "b"), (2, "c")]
    assert store.stored_days(spark, raw) == ["2024-01-01", "2024-01-02"]


def test_reads_prune_days_by_their_folders(spark, events, raw):
    store.append_batch(events(*[{"date": day(n)} for n in range(1, 8)]), raw, "load")
    some = store.read_batches(spark, raw, "2024-01-05", "2024-01-03")
    assert sorted({f.split("date=")[1][:10] for f in some.inputFiles()}) == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert store.read_batches(spark, raw, "2025-01-01").count() == 0


def test_digests_do_not_see_order_or_batches_but_rows(spark, events, raw, tmp_path):
    rows = [{"date": day(1), "distinct_id": f"u{n}", "url": None if n % 3 else "/x"} for n in range(9)]
    store.append_batch(events(*rows), raw, "load")
    other = str(tmp_path / "other")
    for n in range(3):
        store.append_batch(events(*rows[n::3][::-1]), other, "part", n)
    whole, parts = (versions.current(spark, p).digest("2024-01-01") for p in (raw, other))
    assert whole == parts and len(whole) == 32
    assert store.compact_days(spark, other, ["2024-01-01"]) == ["2024-01-01"]
    assert versions.current(spark, other).digest("2024-01-01") == whole
    assert len(versions.current(spark, other).days["2024-01-01"]) == 1
    store.append_batch(events(rows[0]), other, "part", 1)  # a compacted batch that comes again
    assert store.read_batches(spark, other).count() == 9
    store.append_batch(events(rows[0]), other, "more")  # a repeated row is another content
    assert versions.current(spark, other).digest("2024-01-01") != whole
    swapped = events({**rows[0], "url": "r", "referrer": "/x"})
    assert len({r.digest for df in (events(rows[0]), swapped, events({**rows[0], "url": None})) for r in versions.content_digest(df).collect()}) == 3


# ------------------------------------------------------------------ partial aggregates



def made_up(n_days, seed, per_day=40):
    rng = random.Random(seed)
    out = []
    for n in range(1, n_days + 1):
        for _ in range(rng.randrange(per_day // 2, per_day)):
            out.append(
                {
                    "date": day(n), "distinct_id": rng.choice(["a", "b", "c", "d", None, f"u{rng.randrange(30)}"]), "hour_time": rng.choice([None, *range(24)]),
                    "url": rng.choice([None, "/a", "/b", "/c"]), "referrer": rng.choice([None, "", "r"]), "ip": rng.choice([None, "1.2.3.4", "1.2.3.9", "7.7.7.7"]),
                    "screen_width": rng.choice(["360", "1920", None, "x"]), "screen_height": rng.choice(["800", "1080"]),
                }
            )
    return out


PARAMS = ResolutionParams(min_user_days=5)


def test_parts_of_batches_make_the_features_of_all_events(spark, events):
    rows = made_up(3, 1)
    whole = events(*rows)
    shares = fit_resolution(whole, PARAMS)
    base = fit_baseline(whole)
    merged = partials.merge([partials.stored(events(*rows[n::4])) for n in range(4)])
    got = user_day_features(None, base, shares, partials=merged)
    assert plain(got) == plain(user_day_features(whole, base, shares))


@pytest.fixture(scope="module")
def fitted(spark, inputs):
    from traffic_risk.operators import models
    from traffic_risk.params import ForestParams

    whole = inputs.all_pageviews.where(F.col("date") < F.lit("2024-01-06").cast("date"))
    base, shares = fit_baseline(whole), fit_resolution(whole, ResolutionParams(min_user_days=5)).persist()
    table = user_day_features(whole, base, shares).cache()
    forest = models.iforest_fit(table, params=ForestParams(trees=5, sample_size=32))
    trees = models.gbt_fit(table.withColumn("label", (F.col("total_pv") > 1).cast("int")), "label", rounds=2, depth=2)
    return scoring.Models(base, shares, forest, trees, "v1")


def plain(df):
    return rows_of(df.select("date", "distinct_id", *[F.round(c, 9).alias(c) for c in FEATURES]))


def test_a_late_row_rescores_its_day_without_reading_events(spark, inputs, fitted, tmp_path):
    whole = inputs.all_pageviews.where(F.col("date") < F.lit("2024-01-06").cast("date")).cache()
    late = whole.where(F.col("date") == F.lit("2024-01-03").cast("date")).orderBy("distinct_id", "hour_time", "url").limit(1).cache()
    tables = scoring.Store(str(tmp_path / "store"))
    scoring.append_events(whole.exceptAll(late), tables, "load")
    scoring.build_store(spark, tables, fitted)
    assert scoring.append_events(late, tables, "late") == ["2024-01-03"]
    assert scoring.stale_store_dates(spark, tables, fitted) == ["2024-01-03"]
    read = scoring.day_features(spark, tables, ["2024-01-03"], fitted).inputFiles()
    assert read and all("/_derived/" in f and "date=2024-01-03" in f for f in read)
    scoring.rescore_store(spark, tables, ["2024-01-03"], fitted)
    assert scoring.stale_store_dates(spark, tables, fitted) == []
    full = user_day_features(whole, fitted.baseline, fitted.resolution)
    assert plain(store.read_table(spark, tables.iforest)) == plain(full)
    # the same batch again, or the same day fetched again, changes no content: nothing to score
    scoring.append_events(late, tables, "late")
    store.replace_batches(whole.where(F.col("date") == F.lit("2024-01-02").cast("date")), tables.raw, ["2024-01-02"], partials.stored)
    assert scoring.stale_store_dates(spark, tables, fitted) == []
    store.replace_batches(late.withColumn("date", F.lit("2024-01-02").cast("date")), tables.raw, ["2024-01-02"], partials.stored)
    assert scoring.stale_store_dates(spark, tables, fitted) == ["2024-01-02"]
    from dataclasses import replace

    assert len(scoring.stale_store_dates(spark, tables, replace(fitted, version="v2"))) == 5


def test_batches_without_parts_are_read_from_events(spark, events, fitted, tmp_path):
    rows = made_up(2, 5)
    tables = scoring.Store(str(tmp_path / "store"))
    scoring.append_events(events(*rows[::2]), tables, "a")
    store.append_batch(events(*rows[1::2]), tables.raw, "b")  # as older ingests wrote it
    got = scoring.day_features(spark, tables, ["2024-01-01", "2024-01-02"], fitted)
    assert plain(got) == plain(user_day_features(events(*rows), fitted.baseline, fitted.resolution))
    with pytest.raises(ValueError, match="2024-02-02"):
        scoring.rescore_store(spark, tables, ["2024-02-02"], fitted)


# ------------------------------------------------------------------ rolling fits


def shares_of(fit):
    columns = ["resolution", "daily_share_median", "daily_share_scale", "scale_source", "baseline_days", "total_user_days", "days_present"]
    return rows_of(fit.shares.select(*[F.round(c, 12).alias(c) if c.startswith("daily") else c for c in columns]))


def same(base, other):
    """Sums over hours are taken in any order."""
    numbers = ("night_mass", "evening_mass", "c_mean", "c_std")
    return base.hours == pytest.approx(other.hours, rel=1e-12) and all(
        getattr(base, n) == pytest.approx(getattr(other, n), rel=1e-12) for n in numbers
    )


def test_sixty_days_of_a_rolling_window(spark, events, tmp_path):
    rows = made_up(60, 3, per_day=12)
    tables = scoring.Store(str(tmp_path / "store"))
    by_day = {}
    for r in rows:
        by_day.setdefault(r["date"], []).append(r)
    scoring.append_events(events(*rows), tables, "load")
    params = ResolutionParams(min_user_days=2, min_days=1)
    rolling.refresh_statistics(spark, tables)
    stats = versions.read_version(spark, rolling.statistics_path(tables)).drop("ingest_batch").cache()
    for n in range(2, 62):
        first, last = max(1, n - 10), n - 1
        window = stats.where(F.col("date").between(F.lit(day(first)), F.lit(day(last))))
        base, shares = rolling.fit_days(window, params)
        if n % 6 == 0 or n in (2, 61):  # from scratch, with all events of the window
            events_of = events(*[r for d, rs in by_day.items() if day(first) <= d <= day(last) for r in rs])
            assert same(base, fit_baseline(events_of))
            assert shares_of(shares) == shares_of(fit_resolution(events_of, params))
    # a day more: only its own statistics are made, from its parts
    scoring.append_events(events(*[{**r, "date": day(61)} for r in rows[:20]]), tables, "next")
    made = rolling.day_statistics(scoring.day_partials(spark, tables, ["2024-03-01"]))
    assert all("date=2024-03-01" in f and "/_derived/" in f for f in made.inputFiles())
    base, shares = rolling.fit_window(spark, tables, "2024-03-02", 10, params)
    assert rolling.refresh_statistics(spark, tables) == []
    whole = store.read_batches(spark, tables.raw, "2024-02-21", "2024-03-01")
    assert same(base, fit_baseline(whole)) and shares_of(shares) == shares_of(fit_resolution(whole, params))


# ------------------------------------------------------------------ leaving one day out


@pytest.mark.parametrize("seed", range(6))
def test_leaving_a_day_out_by_order_statistics(spark, seed):
    from statistics import median, stdev

    rng = random.Random(seed)
    rows, floor = [], 0.01 if seed % 2 else 1e-6
    for b in range(12):
        n = rng.randrange(1, 9)
        values = [rng.choice([0.0, 0.1, 0.1, 0.3, round(rng.random(), 3)]) for _ in range(n)]
        rows.append((f"b{b}", [(day(i + 1), v, 1, 10) for i, v in enumerate(values)], floor))
    days = "days array<struct<date: date, daily_share: double, resolution_user_days: bigint, valid_user_days: bigint>>"
    frame = spark.createDataFrame(rows, f"resolution_bucket string, {days}, share_scale_floor double")
    got = {(r.resolution_bucket, r.date): (r.daily_share_median, r.daily_share_scale) for r in resolution.leave_one_out(frame).collect()}
    count = 0
    for b, ds, _ in rows:
        for d, v, *_ in ds:
            others = [x for e, x, *_ in ds if e != d]
            if not others:
                assert (b, d) not in got
                continue
            center = median(others)
            robust = resolution.MAD_SCALE * median([abs(x - center) for x in others])
            std = stdev(others) if len(others) > 1 else 0.0
            want = robust if robust > floor else std if std > floor else floor
            assert got[b, d] == pytest.approx((center, want), abs=1e-12)
            count += 1
    assert count == len(got)


def test_leave_one_out_plan_joins_by_equal_keys_only(spark, inputs):
    whole = inputs.all_pageviews
    fitted = fit_resolution(whole, ResolutionParams(min_user_days=5)).persist()
    scored = resolution.resolution_zscore_loo(fitted.grid(), ResolutionBaseline(fitted.shares, fitted.params))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    for line in plan.splitlines():
        if " Join " in f" {line}":
            assert " = " in line and not any(f" {op} " in line for op in ("<", ">", "<=", ">=", "!="))


def test_digest_sums_do_not_overflow(spark):
    """Sums of whole hashes modulo 2^64, which no long holds, made without decimals for each row."""
    df = spark.range(5000).select(F.lit("2024-01-01").cast("date").alias("date"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    marked = [c for n in ("a", "b", "date") for c in (F.col(n).isNull(), F.col(n))]
    hashes = df.select(F.xxhash64(*marked).alias("h"), F.xxhash64(F.lit(1), *marked).alias("g")).collect()
    found = versions.content_digest(df)
    assert "decimal" not in found._jdf.queryExecution().sparkPlan().toString().split("HashAggregate")[-1]
    [row] = found.collect()
    assert (row["rows"], row["digest"]) == (5000, "".join(f"{sum(r[c] for r in hashes) % (1 << 64):016x}" for c in ("h", "g")))
