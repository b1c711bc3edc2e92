"""Stored tables, model fits and the streaming ingest."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from traffic_risk.columns import FEATURES
from traffic_risk.operators import models
from traffic_risk.operators.baseline import fit_baseline
from traffic_risk.operators.features import user_day_features
from traffic_risk.operators.resolution import fit_resolution
from traffic_risk.params import ForestParams, ResolutionParams
from traffic_risk.plans import scoring
from traffic_risk.sources import pageviews, store
from traffic_risk.sources.redteam import UNKNOWN_VERSION, read_redteam_json
from traffic_risk.streaming import ingest
from tests.conftest import rows_of

ROW = "date date, k string, v int"


def day(n):
    return date(2024, 1, n)


def table(spark, *rows):
    return spark.createDataFrame([(day(d), k, v) for d, k, v in rows], ROW)


def test_replacing_a_day_twice_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_partitions(table(spark, (1, "a", 1), (2, "b", 1)), path)
    for v in (2, 3):
        store.replace_dates_on_disk(table(spark, (2, "b", v)), path, [day(2)])
    assert rows_of(store.read_table(spark, path).select("date", "k", "v")) == [(day(1), "a", 1), (day(2), "b", 3)]


def test_a_day_that_was_not_produced_is_an_error_or_cleared(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_partitions(table(spark, (1, "a", 1), (2, "b", 1), (3, "c", 1)), path)
    with pytest.raises(ValueError, match="2024-01-03"):
        store.replace_dates_on_disk(table(spark, (2, "b", 2)), path, [day(2), day(3)])
    assert store.read_table(spark, path).count() == 3
    store.replace_dates_on_disk(table(spark, (2, "b", 2)), path, [day(2), day(3)], check=False)
    assert rows_of(store.read_table(spark, path).select("k", "v")) == [("a", 1), ("b", 2)]


def test_replace_by_name_fills_missing_columns(spark):
    old = table(spark, (1, "a", 1), (2, "b", 1)).unionByName(table(spark).limit(0))
    new = table(spark, (2, "z", 9), (3, "other", 9)).select("k", "date")
    assert rows_of(store.replace_dates(old, new, ["2024-01-02"])) == [(day(1), "a", 1), (day(2), "z", None)]
    undated = old.unionByName(spark.createDataFrame([(None, "n", 1)], ROW))
    assert store.replace_dates(undated, new, [day(2)]).where(F.col("date").isNull()).count() == 0


def test_date_range_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_partitions(table(spark, *[(d, "k", d) for d in range(1, 8)]), path)
    df = store.read_table(spark, path, start="2024-01-03", end="2024-01-04")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert df.count() == 2
    assert store.date_slice(store.read_table(spark, path)).count() == 4


def test_missing_ranges(spark):
    have = table(spark, *[(d, "k", 1) for d in (1, 2, 5, 6, 9)])
    got = rows_of(store.missing_date_ranges(have, "2024-01-01", "2024-01-10"))
    assert sorted(got) == [(day(3), day(4)), (day(7), day(8)), (day(10), day(10))]
    assert store.missing_date_ranges(have, "2024-01-01", "2024-01-02").count() == 0
    plan = rows_of(store.fetch_plan(have, "2024-01-07", days=6))
    assert plan == [(day(3), day(4))]


@pytest.mark.parametrize(
    "days, expected",
    [((1, 9), None), ((1, 5), day(6)), ((4, 9), day(1)), ((), day(1)), ((1, 2, 9), None)],
)
def test_first_fetch_date(spark, days, expected):
    have = table(spark, *[(d, "k", 1) for d in days])
    assert store.first_fetch_date(have, "2024-01-10", days=9).first()[0] == expected


def test_retention_and_required_columns(spark):
    have = table(spark, (1, "a", 1), (5, "b", 1))
    assert store.retain_window(have, "2024-01-07", days=2).first()["k"] == "b"
    with pytest.raises(ValueError, match="screen_width"):
        store.require_columns(have, ["date", "screen_width"])


def test_source_filters_reach_the_file_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    columns = "date date, distinct_id string, time timestamp, event string, lib string, bot_name string, url string, ip string"
    rows = [
        (day(1), "a", None, "pageview", "js", None, "https://www/x", "1"),
        (day(1), "b", None, "pageview", "js", None, None, "1"),
        (day(1), "c", None, "pageview", "js", "crawler", "https://www/x", "1"),
        (day(2), "d", None, "pageview", "js", None, "https://eu.example.com/x", "1"),
        (None, "e", None, "pageview", "js", None, "https://www/x", "1"),
    ]
    spark.createDataFrame(rows, columns).write.partitionBy("date").parquet(path)
    df = pageviews.scan_pageviews(spark.read.parquet(path), "2024-01-01", "2024-01-31", "eu.example.com")
    assert [r["distinct_id"] for r in df.collect()] == ["a"]
    plan = df.select("distinct_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event,pageview)" in plan and "IsNull(bot_name)" in plan
    assert "ip:string" not in plan


def test_redteam_file_defaults(spark, tmp_path):
    record = {"scenario": "s", "user_days": 10}
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"attack_results": [record], "normal_results": []}))
    attack, normal = read_redteam_json(spark, str(good))
    row = attack.first()
    assert (row["model_version"], row["scenario"], row["user_days"], row["verdict"]) == (UNKNOWN_VERSION, "s", 10, None)
    assert normal.count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"attack_results": [record]}))
    with pytest.raises(Exception, match="normal_results"):
        read_redteam_json(spark, str(bad))[1].collect()


# ------------------------------------------------------------------ models


def planted(spark, partitions):
    """500 ordinary user-days and 20 far away."""
    rng = np.random.default_rng(5)
    rows = [(day(1), f"n{i}", *map(float, rng.normal(0, 1, 3)), 0) for i in range(500)]
    rows += [(day(1), f"o{i}", *map(float, rng.normal(6, 1, 3)), 1) for i in range(20)]
    columns = "date date, distinct_id string, x double, y double, z double, label int"
    return spark.createDataFrame(rows, columns).repartition(partitions)


def auc(rows, score):
    bad = [r[score] for r in rows if r["label"] == 1]
    good = [r[score] for r in rows if r["label"] == 0]
    return np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])


PARAMS = ForestParams(trees=40, sample_size=64, contamination=0.04)


def test_forest_finds_planted_anomalies_whatever_the_partitioning(spark, tmp_path):
    forests = [models.iforest_fit(planted(spark, n), ["x", "y", "z"], PARAMS) for n in (1, 7)]
    assert forests[0].nodes.equals(forests[1].nodes)
    assert forests[0].threshold == pytest.approx(forests[1].threshold)
    rows = models.iforest_score(planted(spark, 3), forests[0]).collect()
    assert auc(rows, "anomaly_score") > 0.99
    flagged = [r for r in rows if r["model_anomaly"] == -1]
    assert 15 <= len(flagged) <= 25 and all(0 < r["anomaly_score"] < 1 for r in rows)
    forests[0].save(spark, str(tmp_path / "f"))
    again = models.IsolationForest.load(spark, str(tmp_path / "f"))
    assert rows_of(again.transform(planted(spark, 2))) == rows_of(forests[0].transform(planted(spark, 2)))


def test_forest_samples_are_bounded(spark):
    many = spark.range(200_000).select(
        F.lit(day(1)).alias("date"), F.col("id").cast("string").alias("distinct_id"), F.rand(1).alias("x")
    )
    sizes = [r["count"] for r in models.draw_samples(many, ["x"], PARAMS).groupBy("tree").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 64 and min(sizes) > 20


@pytest.mark.parametrize("n", [40, 2_000, 2_600, 20_000])
def test_one_law_of_sampling(spark, n):
    """Draws per tree and per row follow the same binomial at every size of the table."""
    params = ForestParams(trees=20, sample_size=128)
    rows = spark.range(n).select(F.lit(day(1)).alias("date"), F.col("id").cast("string").alias("distinct_id"), F.rand(1).alias("x"))
    drawn = models.draw_samples(rows, ["x"], params).select("distinct_id", "tree").collect()
    chance = min(1.0, 128 / n)
    assert len(drawn) == len({tuple(r) for r in drawn})
    assert abs(len(drawn) - 20 * n * chance) <= 5 * np.sqrt(20 * n * chance * (1 - chance)) + 1e-9
    twice = len({r["distinct_id"] for r in drawn if sum(q["distinct_id"] == r["distinct_id"] for q in drawn) > 1}) if n < 3000 else None
    if twice is not None:
        want = n * (1 - (1 - chance) ** 20 - 20 * chance * (1 - chance) ** 19)
        assert abs(twice - want) <= 5 * np.sqrt(want) + 1e-9


def test_boosted_trees(spark, tmp_path):
    fitted = models.gbt_fit(planted(spark, 2), "label", ["x", "y", "z"], rounds=5, depth=2)
    scored = models.gbt_score(planted(spark, 2), fitted)
    rows = scored.collect()
    assert auc(rows, "xgb_bot_prob") > 0.95
    assert all((r["xgb_bot_prob"] >= 0.5) == (r["model_anomaly"] == -1) for r in rows)
    fitted.save(str(tmp_path / "g"))
    again = models.BoostedTrees.load(str(tmp_path / "g"))
    assert again.features == ("x", "y", "z")
    assert rows_of(again.transform(planted(spark, 1))) == rows_of(scored)
    with pytest.raises(ValueError, match="y"):
        models.score_features(planted(spark, 1).drop("y"), fitted)


def test_prediction_encodings(spark):
    df = spark.createDataFrame([([0.2, 0.8],), ([0.9, 0.1],), ([None, None],)], "p array<double>")
    p = F.col("p")
    got = df.select(
        models.single_prediction(p, "binary"),
        models.normalize_anomaly(models.single_prediction(p, "binary"), "binary"),
        models.single_prediction(p, "signed"),
        models.class_probability(p, ["bot", "human"], "bot"),
        models.class_probability(p, ["x", "y"]),
    ).collect()
    assert [tuple(r) for r in got] == [
        (0.8, -1, 1.0, 0.2, 0.8),
        (0.1, 1, 0.0, 0.9, 0.1),
        (None, 1, None, 0.0, 0.0),
    ]
    with pytest.raises(ValueError):
        models.normalize_anomaly(p, "guess")


@pytest.fixture(scope="module")
def fitted(inputs):
    events = inputs.all_pageviews
    base = fit_baseline(events)
    shares = fit_resolution(events, ResolutionParams(min_user_days=5)).persist()
    table = user_day_features(events, base, shares).cache()
    forest = models.iforest_fit(table, params=ForestParams(trees=10, sample_size=64))
    labelled = table.withColumn("label", F.col("distinct_id").startswith("b").cast("int"))
    trees = models.gbt_fit(labelled, "label", rounds=2, depth=2)
    return scoring.Models(base, shares, forest, trees, "v1")


def plain(df):
    digits = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return rows_of(df.drop("built_at", "model_version").select(*[d for d in digits if d is not None]))


def test_store_build_rescore_and_backfill(spark, inputs, fitted, tmp_path):
    events = inputs.all_pageviews
    tables = scoring.Store(str(tmp_path / "store"))
    store.append_batch(events, tables.raw, "load")
    scoring.build_store(spark, tables, fitted)
    columns = ["date", "distinct_id", *FEATURES, "model_anomaly"]
    built = store.read_table(spark, tables.iforest).select(*columns)
    whole = plain(built)
    # scoring some days again gives what the full build gave
    days = [day(3), day(9)]
    scoring.rescore_store(spark, tables, days, fitted)
    assert plain(store.read_table(spark, tables.iforest).select(*columns)) == whole
    iforest, gbt = scoring.build_scores(events, fitted)
    again_i, again_g = scoring.rescore_dates(events, iforest, gbt, days, fitted)
    assert plain(again_i.select(*columns)) == whole
    assert again_g.count() == gbt.count()
    # a backfilled day replaces its raw rows and scores, and nothing else
    fetched = events.where((F.col("date") == F.lit(day(9))) & (F.col("hour_time") < 12))
    for _ in range(2):
        scoring.backfill_day(spark, tables, fetched, day(9), fitted)
    raw = store.read_batches(spark, tables.raw)
    assert raw.count() == events.where(F.col("date") != F.lit(day(9))).count() + fetched.count()
    scored = store.read_table(spark, tables.gbt).where(F.col("date") == F.lit(day(9)))
    assert scored.count() == fetched.select("distinct_id").distinct().count()
    other = store.read_table(spark, tables.iforest).where(F.col("date") != F.lit(day(9))).select(*columns)
    assert plain(other) == [r for r in whole if day(9) not in r]
    with pytest.raises(ValueError, match="2023-01-01"):
        scoring.rescore_dates(events, iforest, gbt, [date(2023, 1, 1)], fitted)


# ------------------------------------------------------------------ streaming


def test_stream_takes_in_files_once_and_rescoring_sees_whole_days(spark, events, tmp_path):
    source, raw, state = (str(tmp_path / n) for n in ("in", "raw", "state"))
    first = events({"date": day(1)}, {"date": day(2)})
    late = events({"date": day(1), "distinct_id": "late"}, {"date": None, "distinct_id": "undated"})
    seen = []

    def on_dates(days):
        whole = store.read_batches(spark, raw).where(F.col("date").cast("string").isin(*days))
        seen.append((days, whole.count()))

    def run():
        ingest.stream_ingest_rescore(
            spark, source, first.schema, raw, state, lambda df: df, on_dates
        ).awaitTermination()

    first.coalesce(1).write.mode("append").parquet(source)
    run()
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    assert seen == [(["2024-01-01", "2024-01-02"], 2), (["2024-01-01"], 2)]
    assert store.read_batches(spark, raw).count() == 3


def test_replaying_a_batch_changes_nothing(spark, events, tmp_path):
    raw = str(tmp_path / "raw")
    batch = events({"date": day(1)}, {"date": day(2)})
    for _ in range(2):
        ingest.ingest_batch(batch, 7, raw)
    ingest.ingest_batch(events({"date": day(1)}), 8, raw)
    per_day = store.read_batches(spark, raw).groupBy("date").count()
    assert rows_of(per_day) == [(day(1), 2), (day(2), 1)]


def test_ingests_keep_out_of_each_others_way(spark, events, tmp_path):
    """Initial load, two sources and a new checkpoint: the rows add up."""
    raw = str(tmp_path / "raw")
    store.append_batch(events({"date": day(1)}, {"date": day(1)}, {"date": day(2)}), raw, "load")
    late, more = events({"date": day(1)}), events({"date": day(2)})

    def run(name, rows, checkpoint):
        source = str(tmp_path / f"in-{name}")
        rows.coalesce(1).write.mode("append").parquet(source)
        ingest.stream_ingest_rescore(
            spark, source, rows.schema, raw, str(tmp_path / checkpoint), lambda df: df, name=name
        ).awaitTermination()

    run("a", late, "state-a")
    run("b", more, "state-b")
    assert rows_of(store.read_batches(spark, raw).groupBy("date").count()) == [(day(1), 3), (day(2), 2)]
    with pytest.raises(ValueError, match="state-a"):
        run("a", late, "state-lost")
    run("a", more, "state-a")
    assert store.read_batches(spark, raw).count() == 7  # with the file the refused run left to be read


def test_replay_after_a_backfill_does_not_double(spark, events, tmp_path):
    raw = str(tmp_path / "raw")
    batch = events({"date": day(1), "distinct_id": "a"}, {"date": day(2), "distinct_id": "c"})
    assert store.append_batch(batch, raw, "s", 5) == ["2024-01-01", "2024-01-02"]
    store.replace_batches(events({"date": day(1), "distinct_id": "a"}, {"date": day(1), "distinct_id": "b"}), raw, [day(1)])
    assert store.append_batch(batch, raw, "s", 5) == ["2024-01-02"]
    store.append_batch(events({"date": day(1), "distinct_id": "d"}), raw, "s", 6)
    got = rows_of(store.read_batches(spark, raw).select("date", "distinct_id"))
    assert got == [(day(1), "a"), (day(1), "b"), (day(1), "d"), (day(2), "c")]
    with pytest.raises(ValueError, match="2024-01-03"):
        store.replace_batches(events({"date": day(2)}), raw, [day(2), day(3)])
    assert store.read_batches(spark, raw).count() == 4


def test_writes_evaluate_their_source_once(spark, events, tmp_path):
    rows = events({"date": day(1)}, {"date": day(2)})
    for write in (
        lambda df: store.append_batch(df, str(tmp_path / "a"), "x"),
        lambda df: store.replace_batches(df, str(tmp_path / "b"), [day(1), day(2)]),
        lambda df: store.replace_dates_on_disk(df, str(tmp_path / "c"), [day(1), day(2)]),
        lambda df: ingest.ingest_batch(df, 1, str(tmp_path / "d"), lambda days: None),
    ):
        seen = spark.sparkContext.accumulator(0)

        @F.pandas_udf("string")
        def counted(k, seen=seen):
            seen.add(len(k))
            return k

        write(rows.withColumn("distinct_id", counted("distinct_id")))
        assert seen.value == 2


def test_staleness_of_a_store(spark, inputs, fitted, tmp_path):
    tables = scoring.Store(str(tmp_path / "store"))
    events = inputs.all_pageviews.where(F.col("date") < F.lit(day(6)))
    store.append_batch(events, tables.raw, "load")
    assert len(scoring.stale_store_dates(spark, tables, fitted)) == 5
    scoring.build_store(spark, tables, fitted)
    assert scoring.stale_store_dates(spark, tables, fitted) == []
    store.append_batch(events.where(F.col("date") == F.lit(day(3))).limit(1), tables.raw, "late")
    assert scoring.stale_store_dates(spark, tables, fitted) == ["2024-01-03"]
