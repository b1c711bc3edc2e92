import math
import re
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traffic_risk import labels
from traffic_risk.functions import (
    attach,
    bool_flag,
    c_segment_regex,
    c_segment_rsplit,
    canonical_resolution,
    exact_quantiles,
    hour_weight,
    normalize_date,
    parse_match_flag,
    select_features,
    soft_fingerprint,
    to_number_or,
)
from traffic_risk.functions.normalize import weight_of
from tests.conftest import rows_of


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    "w, h, expected",
    [
        ("800", "360", "360x800"),
        ("100.5", "102.5", "100x102"),
        ("101.5", "10000", "102x10000"),
        ("99.9", "400", None),
        ("400", "10001", None),
        ("bad", "400", None),
        ("400", None, None),
        ("400f", "500", None),
        (" 400 ", "4e2", "400x400"),
    ],
)
def test_canonical_resolution(spark, w, h, expected):
    assert one(spark, canonical_resolution("w", "h"), w=w, h=h) == expected


@pytest.mark.parametrize(
    "ip, rsplit, regex",
    [
        ("1.2.3.4", "1.2.3", "1.2.3"),
        ("fe80::1", "fe80::1", ""),
        (None, "nan", None),
        ("10.0", "10", ""),
        ("1.2.3.4.5", "1.2.3.4", "1.2.3"),
    ],
)
def test_two_segment_definitions(spark, ip, rsplit, regex):
    assert one(spark, c_segment_rsplit("ip"), ip=ip) == rsplit
    assert one(spark, c_segment_regex("ip"), ip=ip) == regex


def test_normalize_date(spark):
    assert one(spark, normalize_date("d"), d="2024-01-05 10:11:12") == date(2024, 1, 5)
    assert one(spark, normalize_date("d"), d="2024-02-30") is None
    assert one(spark, normalize_date("d"), d=None) is None


def test_flags(spark):
    for text, expected in [(" TRUE ", True), ("t", True), ("1", True), ("yes", True), ("no", False), (None, False)]:
        assert one(spark, bool_flag("x"), x=text) is expected
    texts = spark.createDataFrame([("t",), ("Yes ",), (None,)], "f string")
    assert [r[0] for r in texts.select(parse_match_flag(texts, "f")).collect()] == [False, True, False]
    numbers = spark.createDataFrame([(0.0,), (2.0,), (None,)], "f double")
    assert [r[0] for r in numbers.select(parse_match_flag(numbers, "f")).collect()] == [False, True, False]
    flags = spark.createDataFrame([(True,), (None,)], "f boolean")
    assert [r[0] for r in flags.select(parse_match_flag(flags, "f")).collect()] == [True, False]


def test_to_number_or(spark):
    assert one(spark, to_number_or("x", 0, "bigint"), x="7") == 7
    assert one(spark, to_number_or("x", 0, "bigint"), x="seven") == 0
    assert one(spark, to_number_or("x", None), x=None) is None


def test_soft_fingerprint_names_blanks(spark):
    got = one(spark, soft_fingerprint(["os", "browser"]), os="  ", browser=" Chrome ")
    assert got == f"{labels.UNKNOWN_TEXT}os|Chrome"
    with pytest.raises(ValueError):
        soft_fingerprint([])


def test_hour_weight(spark):
    got = spark.range(24).select(hour_weight("id", "night"), hour_weight("id", "evening")).collect()
    for h, (night, evening) in enumerate(got):
        assert night == pytest.approx(math.exp(-((h - 3) ** 2) / 6), abs=1e-12)
        assert evening == pytest.approx(weight_of(h, "evening"), abs=1e-12)


def test_select_features(spark):
    df = spark.createDataFrame([("2024-01-01", "u", 3)], "date string, distinct_id string, total_pv long")
    out = select_features(df, ["cluster_size", "total_pv"])
    assert out.columns == ["date", "distinct_id", "cluster_size", "total_pv", "final_time_risk"]
    assert tuple(out.first())[2:] == (0.0, 3, 0.0)
    with pytest.raises(ValueError, match="cluster_size"):
        select_features(df, ["cluster_size"], strict=True)


@pytest.mark.parametrize("salts", [None, 1, 3, 100])
def test_attach_is_a_left_join(spark, salts):
    """A key with most rows, cold keys, keys without a match and null keys."""
    left = spark.range(1000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")))
        .alias("k"),
    )
    right = left.where(F.col("k").isNotNull() & (F.col("k") != "k7")).groupBy("k").agg(
        F.count("*").alias("n"), F.max("id").alias("last")
    )
    got = attach(left, right, ["k"], ["id"], salts)
    assert got.columns == ["id", "k", "n", "last"]
    assert rows_of(got) == rows_of(left.join(right, "k", "left").select("id", "k", "n", "last"))


def test_attach_salts_where_adaptive_skew_handling_is_off(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        left = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
        right = left.groupBy("k").agg(F.count("*").alias("n"))
        for salts in (None, 3):
            out = attach(left, right, ["k"], ["id"], salts)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "explode(" in plan and re.search(r"[kK]#\d+L?, _salt#\d+L?\]", plan)
            assert {tuple(r) for r in out.select("k", "n").collect()} == {(0, 5), (1, 5)}
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=60),
    st.sampled_from([4, 65_536]),
    st.floats(0, 1),
)
def test_exact_quantiles(spark, values, bins, p):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 0.5)], "g string, v double")
    out = exact_quantiles(df, ["g"], "v", {"a": p, "b": 0.5}, 0.0, 1.0, bins)
    got = {r["g"]: r for r in out.collect()}
    assert got["g"]["a"] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert got["g"]["b"] == pytest.approx(np.quantile(values, 0.5), abs=1e-12)
    assert got["h"]["a"] == 0.5


def test_exact_quantiles_of_everything(spark):
    df = spark.range(101).select((F.col("id") / 50.0).alias("v"))  # half of it beyond the range
    assert exact_quantiles(df, [], "v", {"q": 0.9}, 0.0, 1.0, 8).first()["q"] == pytest.approx(1.8)


def test_spellings_of_a_day(spark):
    texts = ["2024-01-05", "2024/01/05", "2024/1/5", "20240105", "2024.01.05", "2024-01-05 10:11:12", "2024/01/05 10:11:12", " 2024-01-05 "]
    rows = spark.createDataFrame([(t,) for t in [*texts, "no day", "", None, "2024/13/45"]], "t string")
    got = [str(r[0]) for r in rows.select(normalize_date("t")).collect()]
    assert got == ["2024-01-05"] * len(texts) + ["None"] * 4
