"""Labels, reports, cohort, network and red-team arithmetic on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from traffic_risk import labels as L
from traffic_risk.operators import cohort, labeling, network, redteam, reports
from traffic_risk.params import RiskParams
from tests.conftest import rows_of

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
SCORES = "date date, distinct_id string, model_anomaly int, {} double"


def traffic(spark, events, scores, params=RiskParams()):
    """scores: (user, anomaly, risk, gbt anomaly, probability)"""
    iforest = spark.createDataFrame([(D1, u, a, r) for u, a, r, _, _ in scores], SCORES.format("final_time_risk"))
    gbt = spark.createDataFrame([(D1, u, g, p) for u, _, _, g, p in scores], SCORES.format("xgb_bot_prob"))
    ev = events(*[{"distinct_id": u} for u, *_ in scores])
    return labeling.label_traffic(ev, iforest, gbt, params)


CASES = [
    ("a", -1, 1.0, 1, 0.50, L.GROUP_A),
    ("b", 1, 1.0, 1, 0.95, L.GROUP_B),
    ("c", 1, 1.0, 1, 0.90, L.GROUP_C),
    ("d", 1, 1.0, 1, 0.89, L.GROUP_D),
    ("e", -1, 1.0, 1, 0.49, L.GROUP_E),
    ("f", 1, 1.0, 1, 0.49, L.GROUP_F),
    ("u", None, 1.0, 1, 0.99, L.GROUP_UNKNOWN),
    ("p", 1, 1.0, -1, None, L.GROUP_B),
    ("q", 1, 1.0, 1, None, L.GROUP_F),
]


def test_groups_actions_and_pools(spark, events):
    rows = {r["distinct_id"]: r for r in traffic(spark, events, [c[:5] for c in CASES]).user_days.collect()}
    assert {u: r["risk_group"] for u, r in rows.items()} == {c[0]: c[5] for c in CASES}
    assert rows["b"]["action"] == L.ACTION_REVIEW_B and rows["b"]["final_label"] is False
    assert rows["u"]["action"] == L.GROUP_UNKNOWN
    on = traffic(spark, events, [c[:5] for c in CASES], RiskParams(block_b=True))
    blocked = {r["distinct_id"]: r for r in on.user_days.collect()}["b"]
    assert blocked["action"] == L.ACTION_BLOCK_B and blocked["final_label"] is True


def test_thresholds_must_be_ordered():
    with pytest.raises(ValueError):
        RiskParams(edge=0.9, mid=0.5)


def test_unknown_risk_makes_an_unknown_label(spark, events):
    """Counted in the total, in neither kept nor removed, and in the passed pool of the trend."""
    t = traffic(spark, events, [("x", 1, None, 1, 0.1), ("a", -1, None, 1, 0.9)])
    rows = {r["distinct_id"]: r["final_label"] for r in t.user_days.collect()}
    assert rows == {"x": None, "a": True}
    day = reports.daily_summary(t).first()
    assert (day["total_dau"], day["kept_dau"], day["removed_dau"]) == (2, 0, 1)
    pools = {r["user_type"]: r["dau"] for r in reports.dau_trend(t).collect()}
    assert pools == {L.POOL_PASS: 1, L.POOL_BLOCKED: 1}


def test_dedup_keeps_the_highest_and_puts_null_last(spark):
    rows = [(D1, "a", 1, 2.0), (D1, "a", -1, 5.0), (D1, "a", 1, None), (D1, "n", 1, None), (D2, "a", 1, 0.0)]
    df = spark.createDataFrame(rows, SCORES.format("final_time_risk"))
    assert rows_of(labeling.dedup_scores(df, "final_time_risk")) == sorted(
        [(D1, "a", -1, 5.0), (D1, "n", 1, None), (D2, "a", 1, 0.0)], key=repr
    )


def test_duplicates_of_a_hot_key_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(D1, "a", 1, 2.0)], SCORES.format("final_time_risk"))
    plan = labeling.dedup_scores(df, "final_time_risk")._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert partial, plan


def test_manual_rule_covers_the_whole_user_day(spark, events):
    ev = events(
        {"os": "Android", "browser": "Chrome Webview", "manufacturer": None},
        {},
        {"distinct_id": "v", "os": "Android", "browser": "Chrome Webview", "manufacturer": " "},
    )
    assert rows_of(labeling.manual_rule_users(ev)) == [(D1, "u1")]
    scores = [(D1, u, 1, 0.0) for u in ("u1", "v")]
    t = labeling.label_traffic(
        ev,
        spark.createDataFrame(scores, SCORES.format("final_time_risk")),
        spark.createDataFrame(scores, SCORES.format("xgb_bot_prob")),
    )
    assert {(r["distinct_id"], r["final_label"]) for r in t.rows().collect()} == {("u1", True), ("v", False)}


@pytest.mark.parametrize("salts", [None, 1])
def test_events_keep_their_number_when_labelled(inputs, salts):
    t = labeling.label_traffic(inputs.pageviews, inputs.iforest, inputs.xgb)
    rows = t.rows(salts)
    assert rows.count() == 869
    scored = labeling.scored_events(inputs.pageviews, inputs.iforest, inputs.xgb, salts)
    assert scored.count() == 869


def test_report_invariants(inputs):
    t = labeling.label_traffic(inputs.pageviews, inputs.iforest, inputs.xgb).persist()
    trend = reports.dau_trend(t).groupBy("date").agg(F.sum("dau").alias("dau"))
    daily = reports.daily_summary(t).select("date", F.col("total_dau").alias("dau"))
    assert rows_of(trend) == rows_of(daily)
    for share in (reports.kept_share_waterfall(t), reports.blocked_share_waterfall(t)):
        assert share.agg(F.sum("share")).first()[0] == pytest.approx(100)
    histogram = reports.c_segment_histogram(t).agg(F.sum("users")).first()[0]
    assert histogram == reports.c_segment_users(t).count()
    last = daily.agg(F.max("date")).first()[0]
    assert rows_of(reports.headline_metrics(t)) == rows_of(reports.headline_metrics(t, as_of=last))
    t.user_days.unpersist()


def test_empty_slice_is_refused(inputs):
    t = labeling.label_traffic(inputs.pageviews.limit(0), inputs.iforest, inputs.xgb)
    with pytest.raises(ValueError):
        t.require_rows()
    assert reports.headline_metrics(t).first()["total_dau"] == 0


def test_label_reports_do_not_read_event_columns(inputs):
    """Daily counts need no url, title or province, so the scan must not read them."""
    t = labeling.label_traffic(inputs.pageviews, inputs.iforest, inputs.xgb)
    plan = reports.daily_summary(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "province" not in plan and "title" not in plan and "Expand" not in plan


# ------------------------------------------------------------------ cohort
RESULT = (
    "date string, distinct_id string, hour_time int, province_display string, browser_display string, os_display string, "
    "manufacturer_display string, seek_report_pv long, iforest_anomaly int, final_time_risk double, xgb_model_anomaly int, "
    "xgb_bot_prob_raw double, has_model_result boolean"
)


def result_row(user, hour=1, anomaly=1, risk=0.0, p=0.1, known=True, os="iOS", browser="Safari", maker=L.UNKNOWN_TEXT):
    return ("2024-01-01", user, hour, "p", browser, os, maker, 2, anomaly, risk, 1, p, known)


def test_cohort_labels_are_per_row_and_unmatched_is_its_own_group(spark):
    rows = [
        result_row("m", os="Android", browser="Chrome Webview"),
        result_row("m", hour=2),
        result_row("x", known=False, anomaly=-1, p=0.99),
        result_row("n", risk=None),
    ]
    df = cohort.cohort_labels(spark.createDataFrame(rows, RESULT)).cache()
    got = {(r["distinct_id"], r["hour_time"]): r for r in df.collect()}
    assert got[("m", 1)]["final_label"] is True and got[("m", 2)]["final_label"] is False
    assert got[("x", 1)]["risk_group"] == got[("x", 1)]["user_type"] == L.UNMATCHED
    assert got[("x", 1)]["final_label"] is False
    assert got[("n", 1)]["final_label"] is None and got[("n", 1)]["user_type"] == L.NOT_BLOCKED
    user_days = {r["distinct_id"]: r for r in cohort.cohort_user_days(df).collect()}
    assert user_days["m"]["final_label"] is True and user_days["m"]["seek_report_pv"] == 4
    assert user_days["m"]["classification_bucket"] == L.POOL_BLOCKED
    metrics = cohort.cohort_metrics(cohort.cohort_user_days(df)).first()
    assert metrics.asDict() == {
        "target_user_days": 3, "target_users": 3, "target_pv": 8, "matched_user_days": 2,
        "direct_block_user_days": 1, "unmatched_user_days": 1,
    }


def test_cohort_summary_order_and_share(spark):
    rows = [result_row("f"), result_row("a", anomaly=-1, p=0.9), result_row("x", known=False), result_row("f2")]
    days = cohort.cohort_user_days(cohort.cohort_labels(spark.createDataFrame(rows, RESULT)))
    got = [(r["risk_group"], r["risk_order"], r["share_pct"]) for r in cohort.cohort_risk_summary(days).collect()]
    assert got == [(L.GROUP_A, 1, 25.0), (L.GROUP_F, 6, 50.0), (L.UNMATCHED, 98, 25.0)]


def test_cohort_page_view_defaults(spark):
    df = spark.createDataFrame([("2024-01-01", "u", "many")], "date string, distinct_id string, seek_report_pv string")
    assert cohort.cohort_normalize(df, pv_default=0).first()["seek_report_pv"] == 0
    assert cohort.cohort_normalize(df).first()["seek_report_pv"] == 1
    bare = cohort.cohort_normalize(df.drop("seek_report_pv"), result=True).first()
    assert bare["seek_report_pv"] == 1 and bare["has_model_result"] is False
    assert bare["os_display"] == L.UNKNOWN_TEXT


def test_cohort_refresh_clears_a_range_without_visits(spark):
    stored = spark.createDataFrame([result_row("a"), ("2024-01-05",) + result_row("b")[1:]], RESULT)
    fresh = spark.createDataFrame([], RESULT)
    out = cohort.cohort_refresh(stored, fresh, "2024-01-01", "2024-01-02")
    assert [r["distinct_id"] for r in out.collect()] == ["b"]


# ------------------------------------------------------------------ network
BASE = "date date, distinct_id string, is_bot boolean, ip string, os string"


def members(flags, ip="1.2.3.4", day=D1):
    return [(day, f"u{i}", flag, ip, "iOS") for i, flag in enumerate(flags)]


def test_contaminated_cluster_catches_its_clean_users(spark):
    rows = members([True, None, False, False, False]) + members([False] * 4, "5.6.7.8", D2)
    roi = {r["date"]: r for r in network.network_roi(spark.createDataFrame(rows, BASE), 0.2).collect()}
    assert (roi[D1]["dau"], roi[D1]["blocked"], roi[D1]["new_catch"], roi[D1]["impact_pct"]) == (5, 1, 4, 80.0)
    assert (roi[D2]["eligible_dau"], roi[D2]["new_catch"], roi[D2]["impact_pct"]) == (4, 0, 0.0)


def test_user_with_both_flags_counts_on_both_sides(spark):
    rows = members([True, False, False, False, False]) + [(D1, "u0", False, "1.2.3.9", "iOS")]
    got = network.cluster_contamination(network.network_fields(spark.createDataFrame(rows, BASE))).first()
    assert (got["users"], got["bot_users"], got["clean_users"], got["total"]) == (5, 1, 5, 6)


def test_network_fields_are_kept_derived_or_refused(spark):
    rows = spark.createDataFrame(members([True, False]) + members([False], "fe80::1", D2), BASE)
    assert network.network_fields(rows).count() == 2  # no C segment, no cluster
    blank = rows.withColumn("ip_c_segment", F.lit(" ")).withColumn("soft_fp", F.lit("given"))
    got = network.network_fields(blank).collect()
    assert {(r["ip_c_segment"], r["soft_fp"]) for r in got} == {("1.2.3", "given")}
    with pytest.raises(ValueError, match="ip"):
        network.network_fields(rows.drop("ip"))
    with pytest.raises(ValueError, match="soft_fp"):
        network.network_fields(rows.drop("os"))


@pytest.mark.parametrize("salts", [1, 5])
def test_salted_catch_is_the_same(inputs, salts):
    t = labeling.label_traffic(inputs.pageviews, inputs.iforest, inputs.xgb)
    fields = network.network_fields(network.network_base(t)).cache()
    plain = rows_of(network.network_new_catch(fields, 0.01, min_users=2))
    assert plain and plain == rows_of(network.network_new_catch(fields, 0.01, 2, salts))


# ------------------------------------------------------------------ red team
# The published counts of the four scenarios and of the normal pool.
NAMES = ("cheap bot", "夜间空降", "C 段团伙", "高度拟真人")
COLUMNS = "scenario string, user_days long, iforest_black long, xgb_05_black long, xgb_09_black long, xgb_095_black long, both_black long, xgb_high_new long, xgb_mid_new long, xgb_edge long"
ATTACK = [
    (1000, 1000, 1000, 1000, 1000, 1000, 0, 0, 0),
    (1000, 958, 1000, 958, 958, 958, 0, 0, 42),
    (1000, 642, 902, 639, 543, 642, 3, 24, 233),
    (1000, 0, 1, 0, 0, 0, 0, 0, 1),
]
NORMAL = [
    (7662, 335, 922, 726, 277, 332, 66, 361, 163),
    (7662, 333, 667, 246, 133, 333, 4, 15, 315),
    (7662, 338, 666, 252, 144, 338, 4, 15, 309),
    (7662, 331, 665, 246, 132, 331, 4, 15, 315),
]


def test_redteam_rates_of_the_published_counts(spark):
    attack = redteam.redteam_rates(spark.createDataFrame([(n, *c) for n, c in zip(NAMES, ATTACK)], COLUMNS))
    normal = redteam.redteam_rates(
        spark.createDataFrame([(n, *c) for n, c in zip(NAMES, NORMAL)], COLUMNS), normal_pool=True
    )
    rates = {r["scenario"]: r for r in attack.collect()}
    assert [round(rates[n]["risk_pool_rate"], 3) for n in NAMES] == [1.0, 1.0, 0.902, 0.001]
    assert rates["C 段团伙"]["bypass_rate"] == pytest.approx(0.098)
    assert rates["C 段团伙"]["resolution_z_mean"] is None
    summary = {r["scenario"]: r for r in redteam.redteam_summary(attack, normal).collect()}
    assert [round(100 * summary[n]["normal_pool_direct_hit_rate"], 2) for n in NAMES] == [4.33, 4.35, 4.41, 4.32]
    assert [round(100 * summary[n]["normal_pool_xgb_added_hit_rate"], 2) for n in NAMES] == [7.70, 4.36, 4.28, 4.36]
    extremes = redteam.redteam_extremes(attack, normal).first()
    assert (extremes["max_recall"], extremes["min_recall"]) == (1.0, 0.001)
    assert extremes["max_bypass"] == pytest.approx(0.999)


def test_network_estimate_without_usable_columns(inputs):
    base = network.network_base(labeling.label_traffic(inputs.pageviews, inputs.iforest, inputs.xgb))
    bare = base.select("date", "distinct_id", "is_bot")
    full, zero = (network.network_roi(b, 0.2).orderBy("date").collect() for b in (base, bare))
    assert [(r["date"], r["dau"], r["blocked"]) for r in zero] == [(r["date"], r["dau"], r["blocked"]) for r in full]
    assert {(r["eligible_dau"], r["new_catch"], r["impact_pct"]) for r in zero} == {(0, 0, 0.0)}
