"""Visitors of one landing page, with their model results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traffic_risk import labels
from traffic_risk.columns import COHORT_DISPLAY, COHORT_RESULT, COHORT_USER, USER_DAY
from traffic_risk.functions import (
    attach,
    blank_to_unknown,
    normalize_date,
    parse_match_flag,
    to_number_or,
)
from traffic_risk.operators import labeling
from traffic_risk.operators.labeling import MANUAL_BROWSER, MANUAL_OS, user_day_scores
from traffic_risk.operators.sketches import only_members
from traffic_risk.params import RiskParams

MODEL_COLUMNS = ("iforest_anomaly", "final_time_risk", "xgb_model_anomaly", "xgb_bot_prob_raw")


def cohort_normalize(df: DataFrame, pv_default: int = 1, result: bool = False) -> DataFrame:
    """Bring a stored or fetched cohort table into its fixed columns.

    Missing columns get defaults. The page-view default is 0 for a fresh source and 1 when a stored
    table is repaired. ``result`` also repairs the model columns.
    """
    have = set(df.columns)
    unknown = F.lit(labels.UNKNOWN_TEXT)
    cols: dict[str, Column] = {
        "date": normalize_date("date"),
        "distinct_id": F.col("distinct_id"),
        "hour_time": to_number_or("hour_time", None, "int") if "hour_time" in have else F.lit(None).cast("int"),
        **{c: blank_to_unknown(c) if c in have else unknown for c in COHORT_DISPLAY},
        "seek_report_pv": to_number_or("seek_report_pv", pv_default, "bigint")
        if "seek_report_pv" in have
        else F.lit(1).cast("long"),
    }
    if result:
        for c in MODEL_COLUMNS:
            cols[c] = to_number_or(c, None) if c in have else F.lit(None).cast("double")
        cols["has_model_result"] = (
            parse_match_flag(df, "has_model_result") if "has_model_result" in have else F.lit(False)
        )
    out = df.select(*[e.alias(n) for n, e in cols.items()])
    return out.where(F.col("date").isNotNull() & F.col("distinct_id").isNotNull())


def cohort_scores(cohort: DataFrame, iforest: DataFrame, gbt: DataFrame, prefilter: bool = False) -> DataFrame:
    """Page views per cohort key, left-joined with the user-day's scores.

    With ``prefilter`` a bitmap of the cohort's user-days is read at the scan of the score tables, if its size allows, see ``sketches.only_members``;
    that counts the cohort's user-days first, and pays where score tables hold many more days and users than the cohort.

    A landing page has few of all users, so the score tables are cut to the cohort's user-days before
    anything else; when those are few enough to broadcast, the score tables are not shuffled at
    all. The two tables are joined first, so the cohort is shuffled once; the pre-aggregation
    leaves a user-day only as many rows as it has device and hour values.
    """
    keys = [c for c in COHORT_USER if c != "seek_report_pv"]
    views = cohort_normalize(cohort).groupBy(*keys).agg(F.sum("seek_report_pv").alias("seek_report_pv"))
    visitors = views.select(*USER_DAY).distinct()
    n = visitors.count() if prefilter else None

    def of_visitors(scores: DataFrame) -> DataFrame:
        if prefilter:
            scores = only_members(scores, visitors, USER_DAY, n=n)
        return attach(scores, visitors, USER_DAY, scores.columns, how="inner")

    scores = user_day_scores(of_visitors(iforest), of_visitors(gbt), "full_outer")
    matched = F.coalesce(F.col("in_iforest") & F.col("in_gbt"), F.lit(False))
    return (
        attach(views, scores, USER_DAY, ["hour_time", *COHORT_DISPLAY])
        .withColumn("has_model_result", matched)
        .select(*COHORT_RESULT)
    )


def cohort_labels(result: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Groups and flags per cohort row. Rows without a model result get their own label.

    The manual rule looks at the row's own display columns.
    """
    known = F.col("has_model_result")
    unmatched = F.lit(labels.UNMATCHED)
    manual = (
        (F.col("os_display") == MANUAL_OS)
        & (F.col("browser_display") == MANUAL_BROWSER)
        & (
            F.col("manufacturer_display").isNull()
            | F.col("manufacturer_display").isin("", labels.UNKNOWN_TEXT)
        )
    )
    rows = cohort_normalize(result, result=True)
    out = (
        rows.withColumn("iforest_bot", F.col("iforest_anomaly") == -1)
        .withColumn("xgb_bot_prob", labeling.safe_probability())
        .withColumn("is_rule_bot", labeling.rule_bot(params))
        .withColumn("is_manual_bot", manual)
        .withColumn("risk_group", F.when(~known, unmatched).otherwise(labeling.risk_group(params)))
        .withColumn(
            "action",
            F.when(F.col("risk_group") == unmatched, unmatched).otherwise(labeling.risk_action(params)),
        )
    )
    flagged = labeling.block_flags(out, params)
    blocked = F.col("final_label")
    bucket = F.when(~known, unmatched).otherwise(labeling.pool_bucket())
    kind = F.when(~known, unmatched).otherwise(labeling.blocked_or_not())
    return (
        flagged.withColumn("classification_bucket", bucket)
        .withColumn("user_type", kind)
        .withColumn("is_model_block", known & F.col("is_model_block"))
        .withColumn("is_auto_bot", known & F.col("is_auto_bot"))
        .withColumn("final_label", known & blocked)
        .select(
            *COHORT_USER,
            "has_model_result",
            "iforest_bot",
            "xgb_bot_prob",
            "final_time_risk",
            "is_rule_bot",
            "is_manual_bot",
            "risk_group",
            "action",
            "is_model_block",
            "is_auto_bot",
            "final_label",
            "classification_bucket",
            "user_type",
        )
    )


def cohort_user_days(labeled: DataFrame) -> DataFrame:
    """Roll rows up to user-days; group, action and dimensions take their string maximum."""

    def any_row(rule: Column) -> Column:
        return F.coalesce(F.max(rule.cast("int")) == 1, F.lit(False))

    known, blocked = any_row(F.col("has_model_result")), any_row(F.col("final_label"))
    unmatched = F.lit(labels.UNMATCHED)
    return labeled.groupBy(*USER_DAY).agg(
        F.sum("seek_report_pv").alias("seek_report_pv"),
        F.max("risk_group").alias("risk_group"),
        F.max("action").alias("action"),
        F.when(~known, unmatched)
        .when(blocked, labels.POOL_BLOCKED)
        .when(any_row(F.col("risk_group").isin(*labels.AUDIT_GROUPS)), labels.POOL_AUDIT)
        .when(any_row(F.col("risk_group").isin(*labels.OBSERVE_GROUPS)), labels.POOL_OBSERVE)
        .otherwise(labels.POOL_PASS)
        .alias("classification_bucket"),
        F.when(~known, unmatched)
        .when(blocked, labels.POOL_BLOCKED)
        .otherwise(labels.NOT_BLOCKED)
        .alias("user_type"),
        known.alias("has_model_result"),
        any_row(F.col("iforest_bot")).alias("iforest_bot"),
        F.max("xgb_bot_prob").alias("xgb_bot_prob"),
        F.max("final_time_risk").alias("final_time_risk"),
        blocked.alias("final_label"),
        *[F.max(c).alias(c) for c in COHORT_DISPLAY],
    )


def cohort_metrics(user_days: DataFrame) -> DataFrame:
    """User-days, users, page views, matched, blocked and unmatched user-days."""
    # per user first: distinct users become a count that combines on the map side
    per_user = user_days.groupBy("distinct_id").agg(
        F.count("*").alias("d"),
        F.sum("seek_report_pv").alias("pv"),
        F.count(F.when(F.col("has_model_result"), 1)).alias("matched"),
        F.count(F.when(F.col("final_label"), 1)).alias("blocked"),
    )
    zero = F.lit(0).cast("long")
    return per_user.agg(
        F.coalesce(F.sum("d"), zero).alias("target_user_days"),
        F.count("*").alias("target_users"),
        F.coalesce(F.sum("pv"), zero).alias("target_pv"),
        F.coalesce(F.sum("matched"), zero).alias("matched_user_days"),
        F.coalesce(F.sum("blocked"), zero).alias("direct_block_user_days"),
    ).withColumn("unmatched_user_days", F.col("target_user_days") - F.col("matched_user_days"))


def severity(group: str = "risk_group") -> Column:
    order = (
        labels.GROUP_A,
        labels.GROUP_B,
        labels.GROUP_C,
        labels.GROUP_D,
        labels.GROUP_E,
        labels.GROUP_F,
    )
    rank = F.array_position(F.array(*[F.lit(g) for g in order]), F.col(group)).cast("int")
    return (
        F.when(rank > 0, rank).when(F.col(group) == labels.UNMATCHED, F.lit(98)).otherwise(F.lit(99))
    )


def cohort_risk_summary(user_days: DataFrame, digits: int = 4) -> DataFrame:
    """Per (group, action): user-days, users, page views, mean probability and share in percent."""
    unmatched = F.lit(labels.UNMATCHED)
    by = ["risk_group", "action"]
    per_user = (
        user_days.withColumn("risk_group", F.coalesce("risk_group", unmatched))
        .withColumn("action", F.coalesce("action", unmatched))
        .groupBy(*by, "distinct_id")
        .agg(
            F.count("*").alias("d"),
            F.sum("seek_report_pv").alias("pv"),
            F.sum("xgb_bot_prob").alias("p"),
            F.count("xgb_bot_prob").alias("n"),
        )
    )
    everything = Window.partitionBy(F.lit(1))  # over the groups: a dozen rows
    return (
        per_user.groupBy(*by)
        .agg(
            F.sum("d").alias("user_days"),
            F.count("*").alias("users"),
            F.sum("pv").alias("seek_report_pv"),
            F.round(F.sum("p") / F.sum("n"), digits).alias("avg_xgb_prob"),
        )
        .withColumn(
            "share_pct", F.bround(F.col("user_days") / F.sum("user_days").over(everything) * F.lit(100.0), 2)
        )
        .withColumn("risk_order", severity())
        .orderBy("risk_order", "action")
    )


def cohort_daily_groups(user_days: DataFrame) -> DataFrame:
    group = F.coalesce(F.col("risk_group"), F.lit(labels.UNMATCHED))
    return user_days.groupBy("date", group.alias("risk_group")).agg(F.count("*").alias("user_days"))


def cohort_block_rate(user_days: DataFrame) -> DataFrame:
    blocked = F.count(F.when(F.col("final_label"), 1))
    return user_days.groupBy("date").agg(
        F.count("*").alias("target_user_days"),
        blocked.alias("direct_block_user_days"),
        F.round(blocked * F.lit(100.0) / F.count("*"), 2).alias("direct_block_rate"),
    )


def cohort_hours(labeled: DataFrame) -> DataFrame:
    return (
        labeled.where(F.col("hour_time").between(0, 23))
        .groupBy("hour_time", "user_type")
        .agg(F.sum("seek_report_pv").alias("event_count"))
    )


def cohort_top_provinces(labeled: DataFrame, n: int = 12) -> DataFrame:
    """Views per (province, user type) within the ``n`` most viewed provinces."""
    by_type = labeled.groupBy("province_display", "user_type").agg(
        F.sum("seek_report_pv").alias("event_count")
    )
    top = (
        by_type.groupBy("province_display")
        .agg(F.sum("event_count").alias("total_events"))
        .orderBy(F.col("total_events").desc(), "province_display")
        .limit(n)
    )
    return by_type.join(F.broadcast(top), "province_display").orderBy(
        F.col("total_events").desc(), F.col("event_count").desc()
    )


def cohort_detail(labeled: DataFrame, n: int = 300) -> DataFrame:
    """Top rows by day, page views and probability; ties in key order."""
    return (
        labeled.orderBy(
            F.col("date").desc(),
            F.col("seek_report_pv").desc(),
            F.coalesce("xgb_bot_prob", F.lit(0.0)).desc(),
            "distinct_id",
            "hour_time",
            *COHORT_DISPLAY,
        )
        .limit(n)
        .select(
            "date",
            "distinct_id",
            "hour_time",
            "seek_report_pv",
            "user_type",
            "classification_bucket",
            "risk_group",
            "action",
            "iforest_bot",
            F.round("xgb_bot_prob", 4).alias("xgb_bot_prob"),
            "final_time_risk",
            *COHORT_DISPLAY,
        )
    )


def cohort_export(labeled: DataFrame) -> DataFrame:
    return labeled.orderBy(F.col("date").desc(), F.col("seek_report_pv").desc())


def cohort_refresh(stored: DataFrame, fresh: DataFrame, start, end) -> DataFrame:
    """Replace a date range of the stored result table; no fresh rows just clears the range."""
    old = cohort_normalize(stored, result=True)
    new = cohort_normalize(fresh, result=True)
    outside = ~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return old.where(outside).unionByName(new).orderBy("date", "hour_time", "distinct_id")
