"""Edge cases of the behaviour features on hand-made events."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from traffic_risk.columns import FEATURES, RESOLUTION_Z
from traffic_risk.operators import baseline as base
from traffic_risk.operators import features as f
from traffic_risk.operators import resolution as res
from traffic_risk.params import ResolutionParams
from tests.conftest import rows_of

D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def flat(hours=(10,)):
    return base.Baseline({h: 1 / len(hours) for h in hours}, 0.1, 0.1, 1.0, 1.0)


def by_user(df):
    return {r["distinct_id"]: r for r in df.collect()}


def test_first_block_has_the_growth_cap_and_gaps_use_the_previous_present_hour(events):
    ev = events(*[{"hour_time": 8, "distinct_id": f"u{i}"} for i in range(4)], {"hour_time": 11})
    got = {r["hour_time"]: r for r in f.block_growth(f.block_stats(ev)).collect()}
    assert got[8]["prev_pv"] == 0 and got[8]["growth_rate"] == 50.0
    assert got[11]["prev_pv"] == 4 and got[11]["growth_rate"] == pytest.approx(0.25, abs=1e-6)


def test_null_url_or_hour_makes_no_block_but_counts_as_a_view(events):
    ev = events({}, {"url": None}, {"hour_time": None}, {"url": ""}, {"distinct_id": "x", "url": None})
    blocks = f.block_stats(ev).collect()
    assert sorted((r["url"], r["block_pv"]) for r in blocks) == [("", 1), ("/a", 1)]
    rows = by_user(f.base_features(ev, flat()))
    assert rows["u1"]["total_pv"] == 4
    assert rows["u1"]["attack_block_ratio"] == 0.0
    assert rows["x"]["max_block_pv"] is None and rows["x"]["avg_block_pv"] is None
    assert rows["x"]["attack_block_ratio"] == 0.0


def test_one_view_users_are_counted_per_block(events):
    ev = events({"distinct_id": "a"}, {"distinct_id": "b"}, {"distinct_id": "c"}, {"distinct_id": "c", "url": "/b"})
    got = {r["url"]: r for r in f.block_stats(ev).collect()}
    assert (got["/a"]["block_uv"], got["/a"]["block_1pv_uv"]) == (3, 2)
    assert (got["/b"]["block_uv"], got["/b"]["block_1pv_uv"]) == (1, 0)


def test_null_addresses_share_a_segment_but_no_address(events):
    ev = events(*[{"distinct_id": f"n{i}", "ip": None} for i in range(5)], {"distinct_id": "v"})
    rows = by_user(f.base_features(ev, flat()))
    assert rows["n0"]["max_exact_ip_uv"] is None
    assert rows["n0"]["max_c_zscore"] == 4.0
    assert rows["v"]["max_exact_ip_uv"] == 1 and rows["v"]["max_c_zscore"] == 0.0
    # without an address the environment risk is unknown, and the final risk ignores it
    assert rows["n0"]["env_risk"] is None and rows["n0"]["final_time_risk"] is not None


def test_unknown_segment_deviation_keeps_the_score_null(events):
    b = base.Baseline({10: 1.0}, 0.1, 0.1, 1.0, None)
    assert by_user(f.base_features(events({}), b))["u1"]["max_c_zscore"] is None


def test_single_segment_days_have_no_deviation(events):
    assert base.fit_c_segment(events({}, {"distinct_id": "u2"})).first()["c_std"] is None
    two = events({}, {"distinct_id": "u2", "ip": "9.9.9.9"})
    assert base.fit_c_segment(two).first()["c_std"] == 1.0


def test_hour_reference_is_a_median_over_the_days_that_have_the_hour(events):
    ev = events(
        {"date": D1, "hour_time": 1}, {"date": D1, "hour_time": 2},
        {"date": D2, "hour_time": 1}, {"date": D3, "hour_time": 1},
    )
    got = {r["hour_time"]: r["ratio"] for r in base.fit_hour_distribution(ev).collect()}
    assert got[1] == pytest.approx(1 / 1.5) and got[2] == pytest.approx(0.5 / 1.5)
    fitted = base.fit_baseline(ev)
    assert fitted.hours[1] == pytest.approx(1 / 1.5)
    masses = base.fit_reference_mass(base.fit_hour_distribution(ev)).first()
    assert fitted.night_mass == pytest.approx(masses["night_mass"])
    assert fitted.evening_mass == pytest.approx(masses["evening_mass"])


def test_baseline_round_trip(events, spark, tmp_path):
    fitted = base.fit_baseline(events({}, {"distinct_id": "u2", "hour_time": 4}))
    fitted.save(spark, str(tmp_path / "b"))
    assert base.Baseline.load(spark, str(tmp_path / "b")) == fitted


def test_hour_profile(events):
    ev = events({"hour_time": 3}, {"hour_time": None}, {"distinct_id": "none", "hour_time": None})
    rows = by_user(f.hour_profile(ev, flat((10,))))
    # half of the views at hour 3, which the reference does not know
    assert rows["u1"]["time_kl_dist"] == pytest.approx(0.5 * math.log((0.5 + 1e-8) / (1e-6 + 1e-8)))
    assert rows["u1"]["user_night_density"] == pytest.approx(0.5)
    assert rows["u1"]["evening_relative_risk"] == 0.0
    assert rows["none"]["time_kl_dist"] is None
    assert rows["none"]["night_relative_risk"] is None


def test_clone_key_rounds_half_to_even_and_compares_ratios(events):
    ev = events(
        {"distinct_id": "a", "hour_time": 2}, {"distinct_id": "a", "hour_time": 3},
        {"distinct_id": "b", "hour_time": 2}, {"distinct_id": "b", "hour_time": 2},
        {"distinct_id": "c", "hour_time": 2, "referrer": ""},
        {"distinct_id": "d", "hour_time": None},
    )
    rows = by_user(f.clone_clusters(ev))
    assert (rows["a"]["hour_bin"], rows["a"]["cluster_size"]) == (2.0, 2)
    assert rows["b"]["cluster_size"] == 2 and rows["c"]["cluster_size"] == 1
    assert rows["d"]["hour_bin"] is None and rows["d"]["cluster_size"] is None
    halves = events(
        *[{"distinct_id": "x", "referrer": r} for r in ("", "r")],
        *[{"distinct_id": "y", "referrer": r} for r in ("", "r", "", "r")],
    )
    assert {r["cluster_size"] for r in f.clone_clusters(halves).collect()} == {2}


def test_each_rule_adds_its_points(spark):
    columns = "total_pv long, is_direct_ratio double, attack_block_ratio double, user_night_density double, user_evening_density double, cluster_size long, final_time_risk double"
    cases = [
        ((3, 0.8, 0.8, 0.0, 0.0, 1, 1.0), 26.0),
        ((2, 0.0, 0.0, 0.0, 0.0, 51, 1.0), 21.0),
        ((1, 0.7, 0.0, 0.5, 0.0, 1, 1.0), 16.0),
        ((1, 1.0, 0.0, 0.0, 0.6, 21, 1.0), 11.0),
        ((1, 1.0, 0.8, 0.5, 0.6, 51, 1.0), 71.0),
        ((3, 0.7, 0.7, 0.4, 0.5, 50, 1.0), 1.0),
        ((1, 1.0, 0.8, 0.5, 0.6, None, None), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], columns)
    got = [r["final_time_risk"] for r in f.apply_rules(df).collect()]
    assert got == [e for _, e in cases]


def test_final_risk_skips_nulls(spark):
    columns = "time_kl_dist double, total_pv long, max_exact_ip_uv long, max_c_zscore double, night_relative_risk double, evening_relative_risk double"
    df = spark.createDataFrame([(1.0, 1, None, 0.0, 0.2, None)], columns)
    row = f.risk_scores(df).first()
    assert row["env_risk"] is None and row["final_time_risk"] == pytest.approx(math.log(2))


@pytest.mark.parametrize("salts", [1, 2])
def test_salted_joins_give_the_same_features(inputs, salts):
    events = inputs.all_pageviews
    fitted = base.fit_baseline(events)
    plain = f.base_features(events, fitted)
    assert rows_of(plain) == rows_of(f.base_features(events, fitted, salts=salts))


def test_all_features_are_there_and_finite_z(inputs):
    events = inputs.all_pageviews
    shares = res.fit_resolution(events, ResolutionParams(min_user_days=5)).persist()
    out = f.user_day_features(events, base.fit_baseline(events), shares)
    assert out.columns == ["date", "distinct_id", *FEATURES]
    assert out.where(~F.col(RESOLUTION_Z).between(0, 10)).count() == 0
    assert out.where(F.col("time_kl_dist") < -1e-6).count() == 0
    assert out.count() == events.select("date", "distinct_id").distinct().count()


# ------------------------------------------------------------------ resolution


def days(events, plan):
    """plan: {day number: {resolution width: users}}"""
    rows = []
    for d, widths in plan.items():
        for w, users in widths.items():
            rows += [
                {"date": D1 + timedelta(days=d), "distinct_id": f"{w}-{i}", "screen_width": w} for i in range(users)
            ]
    return events(*rows)


LOOSE = ResolutionParams(min_days=2, min_user_days=4)


def test_main_resolution_mode_and_ties(events):
    ev = events(
        {"screen_width": "400"}, {"screen_width": "400"}, {"screen_width": "360"},
        {"distinct_id": "tie", "screen_width": "500"}, {"distinct_id": "tie", "screen_width": "400"},
        {"distinct_id": "bad", "screen_width": "x"},
    )
    got = {r[1]: r[2] for r in res.main_resolution(ev).collect()}
    assert got == {"u1": "400x800", "tie": "400x800", "bad": None}


def test_vocabulary_and_grid(events):
    ev = days(events, {0: {"360": 3, "400": 1}, 1: {"360": 2}, 2: {"500": 1, "bad": 4}, 3: {"bad": 2}})
    daily = res.daily_resolutions(res.main_resolution(ev))
    vocab = res.fit_resolution_vocab(daily, LOOSE)
    assert [tuple(r) for r in vocab.collect()] == [("360x800", 5, 2)]
    grid = {(r["date"].day, r["resolution_bucket"]): r["daily_share"] for r in res.daily_share_grid(daily, vocab).collect()}
    assert grid == {
        (1, "360x800"): 0.75, (1, res.OTHER): 0.25, (2, "360x800"): 1.0,
        (2, res.OTHER): 0.0, (3, "360x800"): 0.0, (3, res.OTHER): 1.0,
    }
    everything = res.daily_share_grid(daily, vocab, only_valid_days=False)
    assert everything.where(F.col("date") == F.lit("2024-01-04").cast("date")).count() == 2
    assert rows_of(res.fit_resolution(ev, LOOSE).grid()) == rows_of(res.daily_share_grid(daily, vocab))


def test_scale_falls_back_from_mad_to_deviation_to_floor(spark):
    def row(name, shares):
        entry = [(D1 + timedelta(days=i), s, 1, 10) for i, s in enumerate(shares)]
        return (name, entry, 0.01)

    rows = spark.createDataFrame(
        [row("mad", [0.1, 0.2, 0.4, 0.6]), row("std", [0.0, 0.0, 0.0, 0.5]), row("floor", [0.3, 0.3, 0.3])],
        "resolution string, days array<struct<date: date, daily_share: double, resolution_user_days: long, valid_user_days: long>>, share_scale_floor double",
    )
    got = {r["resolution"]: r for r in res.summarize_shares(rows).collect()}
    assert got["mad"]["scale_source"] == "MAD"
    assert got["mad"]["daily_share_median"] == pytest.approx(0.3)
    assert got["mad"]["daily_share_scale"] == pytest.approx(1.4826 * 0.15)
    assert got["std"]["scale_source"] == "STD_FALLBACK" and got["std"]["daily_share_scale"] == pytest.approx(0.25)
    assert got["floor"]["scale_source"] == "FLOOR" and got["floor"]["daily_share_scale"] == 0.01


def test_training_needs_days(events):
    with pytest.raises(ValueError, match="covers 2 days"):
        res.fit_resolution(days(events, {0: {"360": 1}, 1: {"360": 1}}), LOOSE, check=True)
    with pytest.raises(ValueError, match="no valid"):
        res.fit_resolution(days(events, {0: {"bad": 1}}), LOOSE, check=True)


def test_leave_one_day_out_equals_refitting_without_the_day(events):
    plan = {0: {"360": 6, "400": 4}, 1: {"360": 5, "400": 4}, 2: {"360": 6, "400": 3}, 3: {"360": 1, "400": 9}, 4: {"360": 4, "400": 6}}
    ev = days(events, plan)
    fitted = res.fit_resolution(ev, LOOSE).persist()
    scores = {(r["date"], r["resolution"]): r[RESOLUTION_Z] for r in res.resolution_scores(
        res.daily_resolutions(res.main_resolution(ev)), fitted, leave_one_day_out=True).collect()}
    floor = fitted.shares.first()["share_scale_floor"]
    for bucket in ("360x800", "400x800"):
        shares = {r["date"]: r["daily_share"] for r in fitted.grid().where(F.col("resolution_bucket") == bucket).collect()}
        for day, share in shares.items():
            others = sorted(v for d, v in shares.items() if d != day)
            med = (others[1] + others[2]) / 2
            dev = sorted(abs(v - med) for v in others)
            mad = 1.4826 * (dev[1] + dev[2]) / 2
            mean = sum(others) / 4
            std = math.sqrt(sum((v - mean) ** 2 for v in others) / 3)
            scale = mad if mad > floor else std if std > floor else floor
            assert scores[(day, bucket)] == pytest.approx(min(max((share - med) / scale, 0), 10))


def test_users_without_resolution_stay_and_are_neutral(events):
    ev = days(events, {0: {"360": 6, "bad": 1, "777": 1}, 1: {"360": 5}, 2: {"360": 6}})
    fitted = res.fit_resolution(ev, LOOSE).persist()
    users = ev.select("date", "distinct_id").distinct()
    got = {(r[0].day, r[1]): r[2] for r in res.attach_resolution_feature(users, ev, fitted).collect()}
    assert len(got) == users.count()
    assert got[(1, "bad-0")] == 0.0
    assert got[(1, "777-0")] > 0  # the rare bucket is over-represented that day


def test_resolution_baseline_round_trip(events, spark, tmp_path):
    fitted = res.fit_resolution(days(events, {d: {"360": 3} for d in range(3)}), LOOSE)
    fitted.save(str(tmp_path / "r"))
    again = res.ResolutionBaseline.load(spark, str(tmp_path / "r"), LOOSE)
    assert rows_of(again.summary()) == rows_of(fitted.summary())
