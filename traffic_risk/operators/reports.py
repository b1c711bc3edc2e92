"""Aggregates over labelled traffic.

Reports on user-days read the label table alone. Reports on event columns first make (user-day,
column) distinct, after which distinct users are plain counts that combine on the map side.
Everything with a limit is a top list, and ends in TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traffic_risk import labels
from traffic_risk.columns import USER_DAY
from traffic_risk.functions import (
    attach,
    blank_to_unknown,
    c_segment_regex,
    counted_values,
    first_day_flag,
    quantiles_of_counts,
)
from traffic_risk.operators.labeling import LabeledTraffic, blocked_or_not, pool_bucket

HUNDRED = 100.0


def _count_if(rule: Column) -> Column:
    return F.count(F.when(rule, F.lit(1)))


def _blocked() -> Column:
    return F.col("final_label")


def _kept_in(*groups: str) -> Column:
    return F.col("risk_group").isin(*groups) & ~F.col("final_label")


def headline_metrics(traffic: LabeledTraffic, as_of=None) -> DataFrame:
    """Users of the latest day by pool. Users without a final label are only in the total."""
    return traffic.latest(as_of).user_days.agg(
        F.count("*").alias("total_dau"),
        _count_if(_blocked()).alias("direct_block_dau"),
        _count_if(_kept_in(*labels.AUDIT_GROUPS)).alias("audit_dau"),
        _count_if(_kept_in(*labels.OBSERVE_GROUPS)).alias("observe_review_dau"),
        _count_if(_kept_in(labels.GROUP_F)).alias("pass_dau"),
    )


def dau_trend(traffic: LabeledTraffic) -> DataFrame:
    return traffic.user_days.groupBy("date", pool_bucket().alias("user_type")).agg(
        F.count("*").alias("dau")
    )


def daily_summary(traffic: LabeledTraffic) -> DataFrame:
    counts = traffic.user_days.groupBy("date").agg(
        F.count("*").alias("total_dau"),
        _count_if(~_blocked()).alias("kept_dau"),
        _count_if(_blocked()).alias("removed_dau"),
        _count_if(F.col("is_manual_bot") & ~F.col("is_auto_bot")).alias("manual_removed_dau"),
        _count_if(_kept_in(*labels.AUDIT_GROUPS)).alias("audit_dau"),
        _count_if(_kept_in(labels.GROUP_D)).alias("tag_dau"),
        _count_if(_kept_in(labels.GROUP_E)).alias("dispute_dau"),
    )
    return counts.withColumn(
        "direct_block_rate", F.col("removed_dau") / F.col("total_dau") * F.lit(HUNDRED)
    ).withColumn("audit_pool_rate", F.col("audit_dau") / F.col("total_dau") * F.lit(HUNDRED))


def daily_detail(traffic: LabeledTraffic) -> DataFrame:
    """The daily summary's counts, newest day first."""
    return (
        daily_summary(traffic)
        .select("date", "total_dau", "kept_dau", "removed_dau", "audit_dau", "tag_dau", "dispute_dau")
        .orderBy(F.col("date").desc())
    )


def risk_summary(traffic: LabeledTraffic, digits: int = 4) -> DataFrame:
    """User-days, users and probabilities per (group, action), with exact median and p95."""
    days = traffic.user_days.select("distinct_id", "risk_group", "action", "xgb_bot_prob").persist(StorageLevel.MEMORY_AND_DISK)
    by = ["risk_group", "action"]
    # one aggregate by value serves counts, mean and quantiles; only distinct users need another
    values = counted_values(days, by, "xgb_bot_prob")
    counts = values.groupBy(*by).agg(
        F.sum("_n").alias("user_days"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("avg_xgb_prob")
    )
    users = days.groupBy(*by).agg(F.count_distinct("distinct_id").alias("users"))
    quantiles = quantiles_of_counts(values, by, {"p50_xgb_prob": 0.50, "p95_xgb_prob": 0.95}, 0.0, 1.0)
    out = counts.join(F.broadcast(users), by).join(F.broadcast(quantiles), by)  # a row for each group and action
    return out.select(
        *by,
        "user_days",
        "users",
        *[F.bround(c, digits).alias(c) for c in ("avg_xgb_prob", "p50_xgb_prob", "p95_xgb_prob")],
    )


def risk_samples(traffic: LabeledTraffic, group: str, n: int = 200) -> DataFrame:
    """Events of the riskiest user-days of a group.

    The top ``n`` events lie within the top ``n`` user-days, because a user-day's events share its
    scores; so the events are joined to at most ``n`` labelled rows.
    """
    order = [
        F.col("xgb_bot_prob").desc_nulls_last(),
        F.col("final_time_risk").desc_nulls_last(),
        F.col("date"),
        F.col("distinct_id"),
    ]
    top = traffic.user_days.where(F.col("risk_group") == group).orderBy(*order).limit(n)
    return (
        traffic.events.select(*USER_DAY)
        .join(F.broadcast(top), list(USER_DAY))
        .orderBy(*order)
        .limit(n)
        .select(
            "date",
            "distinct_id",
            "risk_group",
            "action",
            "iforest_bot",
            F.round("xgb_bot_prob", 4).alias("xgb_bot_prob"),
            "final_time_risk",
            "final_label",
        )
    )


def _provinces(traffic: LabeledTraffic, as_of=None) -> DataFrame:
    """Users of the latest day per province, split by the final label."""
    users = traffic.latest(as_of).users_by(province_display=blank_to_unknown("province"))
    return users.groupBy("province_display").agg(
        F.count("*").alias("before_count"),
        _count_if(~_blocked()).alias("after_count"),
        _count_if(_blocked()).alias("removed_count"),
    )


def province_before_after(traffic: LabeledTraffic, n: int = 15, as_of=None) -> DataFrame:
    return (
        _provinces(traffic, as_of).orderBy(F.col("before_count").desc(), "province_display").limit(n)
    )


def province_unpivot(traffic: LabeledTraffic, n: int = 15, as_of=None) -> DataFrame:
    long = province_before_after(traffic, n, as_of).unpivot(
        "province_display", ["before_count", "after_count"], "stage", "user_count"
    )
    stage = F.when(F.col("stage") == "before_count", labels.STAGE_BEFORE).otherwise(labels.STAGE_AFTER)
    return long.withColumn("stage", stage)


def province_removal_rate(traffic: LabeledTraffic, n: int = 15, as_of=None) -> DataFrame:
    rate = F.col("removed_count") / F.col("before_count") * F.lit(HUNDRED)
    return (
        province_before_after(traffic, n, as_of)
        .withColumn("removal_rate", rate)
        .orderBy(F.col("removal_rate").desc(), "province_display")
    )


def top_removed_provinces(traffic: LabeledTraffic, n: int = 8, as_of=None) -> DataFrame:
    return (
        _provinces(traffic, as_of)
        .where(F.col("removed_count") > 0)
        .select(F.col("province_display").alias("province"), F.col("removed_count").alias("user_count"))
        .orderBy(F.col("user_count").desc(), "province")
        .limit(n)
    )


def _with_totals(provinces: DataFrame, *columns: str) -> DataFrame:
    """Add each column's total, summed by all tasks: a client can send any number of province names."""
    return provinces.select(
        "*", *[provinces.agg(F.sum(c)).scalar().alias(f"total_{c}") for c in columns]
    )


def province_share_shift(traffic: LabeledTraffic, n: int = 15, as_of=None) -> DataFrame:
    """Each province's share of all users and of the kept users."""
    rows = _with_totals(_provinces(traffic, as_of), "before_count", "after_count")
    kept = F.nullif(F.col("total_after_count"), F.lit(0).cast("long"))
    return (
        rows.select(
            F.col("province_display").alias("province"),
            (F.col("before_count") / F.col("total_before_count") * F.lit(HUNDRED)).alias("percent_before"),
            (F.col("after_count") / kept * F.lit(HUNDRED)).alias("percent_after"),
        )
        .orderBy(F.col("percent_before").desc(), "province")
        .limit(n)
    )


def _share_waterfall(traffic: LabeledTraffic, count: str, name: str, n: int, as_of) -> DataFrame:
    """Top provinces with their share, and one row for all others."""
    rows = (
        _with_totals(_provinces(traffic, as_of).where(F.col(count) > 0), count)
        .withColumn("share", F.col(count) * F.lit(HUNDRED) / F.col(f"total_{count}"))
        .orderBy(F.col(count).desc(), "province_display")
        .limit(n)
    )
    top = rows.select(F.col("province_display").alias("province"), F.col(count).alias(name), "share")
    rest = rows.agg(
        F.lit(labels.REMAINDER).alias("province"),
        (F.max(f"total_{count}") - F.sum(count)).alias(name),
        (F.lit(HUNDRED) - F.sum("share")).alias("share"),
    )
    return top.unionByName(rest)


def kept_share_waterfall(traffic: LabeledTraffic, n: int = 10, as_of=None) -> DataFrame:
    return _share_waterfall(traffic, "after_count", "human_count", n, as_of)


def blocked_share_waterfall(traffic: LabeledTraffic, n: int = 10, as_of=None) -> DataFrame:
    return _share_waterfall(traffic, "removed_count", "bot_count", n, as_of)


def hourly_users(traffic: LabeledTraffic, as_of=None) -> DataFrame:
    users = traffic.latest(as_of).users_by(hour_time=F.col("hour_time"))
    return users.groupBy("hour_time", blocked_or_not().alias("user_type")).agg(
        F.count("*").alias("user_count")
    )


def browser_distribution(traffic: LabeledTraffic, blocked: bool, as_of=None) -> DataFrame:
    users = traffic.latest(as_of).users_by(browser_display=blank_to_unknown("browser"))
    return (
        users.where(F.col("final_label") == F.lit(blocked))
        .groupBy("browser_display")
        .agg(F.count("*").alias("user_count"))
        .orderBy(F.col("user_count").desc(), "browser_display")
    )


def first_day_distribution(traffic: LabeledTraffic, blocked: bool, as_of=None) -> DataFrame:
    users = traffic.latest(as_of).users_by(first_day_display=first_day_flag("is_first_day"))
    return (
        users.where(F.col("final_label") == F.lit(blocked))
        .groupBy("first_day_display")
        .agg(F.count("*").alias("user_count"))
    )


def c_segment_users(traffic: LabeledTraffic, as_of=None, salts: int | None = None) -> DataFrame:
    """For each user of the latest day, the user count of its most populated C segment."""
    pairs = (
        traffic.latest(as_of)
        .users_by(ip_c=c_segment_regex("ip"))
        .where(F.col("ip_c").isNotNull())
        .select("distinct_id", blocked_or_not().alias("user_type"), "ip_c")
    )
    sizes = pairs.groupBy("ip_c").agg(F.count("*").alias("c_segment_user_count"))
    return (
        attach(pairs, sizes, ["ip_c"], ["distinct_id"], salts, "inner")
        .groupBy("distinct_id", "user_type")
        .agg(F.max("c_segment_user_count").alias("c_segment_user_count"))
    )


def c_segment_histogram(traffic: LabeledTraffic, bins: int = 30, as_of=None) -> DataFrame:
    """Equal-width histogram of the C-segment user counts, one series per user type."""
    # equal counts collapse first; what is left has one row per distinct count
    counts = (
        c_segment_users(traffic, as_of)
        .groupBy("user_type", "c_segment_user_count")
        .agg(F.count("*").alias("users"))
    )
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min("c_segment_user_count"), F.max("c_segment_user_count")
    rows = counts.select("*", low.over(everything).alias("low"), high.over(everything).alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    position = F.floor((F.col("c_segment_user_count") - F.col("low")) / F.col("width"))
    bin_ = F.when(F.col("width") > 0, F.least(position, F.lit(bins - 1).cast("long"))).otherwise(
        F.lit(0).cast("long")
    )
    return (
        rows.withColumn("width", width)
        .withColumn("bin", bin_)
        .groupBy("user_type", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"))
        .agg(F.sum("users").alias("users"))
    )


def title_url_uv_pv(
    traffic: LabeledTraffic, blocked: bool, home_title: str, n: int = 20, as_of=None
) -> DataFrame:
    """Most viewed (title, url) of the latest day, without the home page title pattern."""
    day = traffic.latest(as_of)
    views = (
        day.events.where(~F.col("title").like(home_title))
        .groupBy(*USER_DAY, "title", "url")
        .agg(F.count("url").alias("pv"))
    )
    wanted = day.user_days.where(F.col("final_label") == F.lit(blocked)).select(*USER_DAY, "n_events")
    return (
        attach(views, wanted, USER_DAY, ["title", "url"], how="inner")
        .groupBy("title", "url")
        .agg(F.count("*").alias("uv"), F.sum("pv").alias("pv"))
        .orderBy(F.col("pv").desc(), F.col("uv").desc(), "title", "url")
        .limit(n)
    )


def risk_list_export(traffic: LabeledTraffic) -> DataFrame:
    """All labelled events that are blocked or outside the normal group."""
    risky = traffic.user_days.where(F.col("final_label") | (F.col("risk_group") != labels.GROUP_F))
    return LabeledTraffic(traffic.events, risky).rows()
