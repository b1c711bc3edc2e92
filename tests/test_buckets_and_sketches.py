"""Bucketed tables, membership filters and sketches of days."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from traffic_risk.columns import USER_DAY
from traffic_risk.operators import cohort, labeling, sketches
from traffic_risk.sources import bucketed
from tests.conftest import rows_of


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_of_bucketed_tables_shuffle_nothing(spark, inputs, tmp_path):
    tables = {n: bucketed.write_bucketed(df, str(tmp_path / n), 4) for n, df in (("events", inputs.pageviews), ("iforest", inputs.iforest), ("gbt", inputs.xgb))}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = labeling.label_traffic(tables["events"], tables["iforest"], tables["gbt"]).rows(salts=0)
        assert "Exchange" not in plan_of(rows) and "SortMergeJoin" in plan_of(rows)
        plainly = labeling.label_traffic(inputs.pageviews, inputs.iforest, inputs.xgb).rows()
        assert "Exchange" in plan_of(plainly)
        assert rows_of(rows) == rows_of(plainly.select(*rows.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bucketed_tables_open_by_path_and_grow(spark, events, tmp_path):
    path = str(tmp_path / "t")
    first = bucketed.write_bucketed(events({"distinct_id": "a"}, {"distinct_id": "b"}), path, 3)
    assert first.count() == 2
    bucketed.forget(spark, path)
    again = bucketed.open_bucketed(spark, path)
    assert again.schema.names == first.schema.names and again.count() == 2
    bucketed.write_bucketed(events({"distinct_id": "c"}), path, 3, append=True)
    assert sorted(r.distinct_id for r in bucketed.open_bucketed(spark, path).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="3 buckets"):
        bucketed.write_bucketed(events({"distinct_id": "d"}), path, 5, append=True)
    days = bucketed.open_bucketed(spark, path).where(F.col("date") == F.lit("2024-01-02").cast("date"))
    assert "EqualTo(date" in plan_of(days)


def test_members_all_stay_and_few_others(spark):
    rows = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("date"), F.concat(F.lit("u"), F.col("id") % 7919).alias("distinct_id"), F.col("id").alias("_page")
    )
    members = rows.where(F.pmod(F.xxhash64("distinct_id"), F.lit(50)) == 1)
    kept = sketches.only_members(rows, members, USER_DAY)
    assert kept.columns == rows.columns
    inside = members.count()
    assert kept.join(members, ["date", "distinct_id", "_page"], "left_semi").count() == inside
    assert inside <= kept.count() <= inside + 60_000 / sketches.BITS_PER_KEY
    assert rows_of(sketches.only_members(rows, members, USER_DAY, most_bytes=10).limit(1).drop("date"))  # too large: all stay
    assert sketches.only_members(rows, members, USER_DAY, most_bytes=10).count() == 60_000


def test_null_keys_and_no_members(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (3, "c")], "k int, v string")
    assert rows_of(sketches.only_members(rows, rows.where("k = 3 OR k IS NULL"), ["k"])) == [(3, "c")]
    assert sketches.only_members(rows, rows.limit(0), ["k"]).collect() == []


def test_prefilter_leaves_the_cohort_as_it_is(spark, inputs):
    whole = cohort.cohort_scores(inputs.cohort, inputs.iforest, inputs.xgb)
    assert rows_of(cohort.cohort_scores(inputs.cohort, inputs.iforest, inputs.xgb, prefilter=True)) == rows_of(whole)


@pytest.mark.parametrize("days", [(1, 1), (2, 9), (1, 20)])
def test_sketches_of_ranges_are_within_their_error(spark, days):
    rng = random.Random(5)
    start = date(2024, 1, 1)
    rows = [(start + timedelta(days=rng.randrange(20)), rng.choice("ab"), f"u{rng.randrange(4000)}", rng.random() ** 3) for _ in range(40_000)]
    rows += [(start, "a", None, None)] * 5
    df = spark.createDataFrame(rows, "date date, g string, distinct_id string, v double").repartition(6)
    first, last = (start + timedelta(days=d - 1) for d in days)
    mine = [r for r in rows if first <= r[0] <= last]
    for r in sketches.range_distinct(sketches.distinct_sketches(df, ["g"]), ["g"], first, last).collect():
        exact = len({u for _, g, u, _ in mine if g == r.g and u is not None})
        assert abs(r.estimate - exact) <= max(2, 2 * sketches.distinct_error() * exact)
    probs = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    for r in sketches.range_quantiles(sketches.quantile_sketches(df, ["g"], "v"), ["g"], probs, first, last).collect():
        values = [v for _, g, _, v in mine if g == r.g and v is not None]
        assert r.n == len(values)
        for name, p in probs.items():
            assert abs(sum(v <= r[name] for v in values) / len(values) - p) <= 2 * sketches.rank_error() + 1 / len(values)
