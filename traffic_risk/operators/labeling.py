"""Risk groups, actions and the final block label.

Everything a label depends on (both scores, the manual rule) is the same for all events of a
user-day, so labels are computed once per user-day. Events are reduced to one row per user-day on
the map side first, and only reports that need event columns join them back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traffic_risk import labels
from traffic_risk.columns import RESOLUTION_Z, USER_DAY
from traffic_risk.functions import attach, blank_to_unknown, first_day_flag
from traffic_risk.params import RiskParams

# The device combination of the manual rule.
MANUAL_OS = "Android"
MANUAL_BROWSER = "Chrome Webview"


def dedup_scores(scores: DataFrame, by: str) -> DataFrame:
    """One row per user-day: the highest ``by``, null last.

    Spark limits each map task to one row per key before the shuffle, so duplicates of a hot key do
    not meet in one task. Ties are broken by the other columns, larger first.
    """
    rest = [c for c in scores.columns if c not in (*USER_DAY, by)]
    order = [F.col(c).desc_nulls_last() for c in (by, *rest)]
    rank = F.row_number().over(Window.partitionBy(*USER_DAY).orderBy(*order))
    return scores.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def user_day_scores(iforest: DataFrame, gbt: DataFrame, how: str = "inner") -> DataFrame:
    """Both scores of a user-day under the names of the labelled view."""
    i_cols = [F.col("model_anomaly").alias("iforest_anomaly"), F.col("final_time_risk")]
    if RESOLUTION_Z in iforest.columns:
        i_cols.append(F.col(RESOLUTION_Z))
    i = dedup_scores(iforest, "final_time_risk").select(*USER_DAY, *i_cols, F.lit(True).alias("in_iforest"))
    x = dedup_scores(gbt, "xgb_bot_prob").select(
        *USER_DAY,
        F.col("model_anomaly").alias("xgb_model_anomaly"),
        F.col("xgb_bot_prob").alias("xgb_bot_prob_raw"),
        F.lit(True).alias("in_gbt"),
    )
    both = i.join(x, list(USER_DAY), how)
    return both.drop("in_iforest", "in_gbt") if how == "inner" else both


def _user_day_counts(events: DataFrame) -> DataFrame:
    """Events and manual-rule hits per user-day, in one pass with map-side combine."""
    return events.groupBy(*USER_DAY).agg(
        F.count("*").alias("n_events"),
        F.max(manual_rule().cast("int")).alias("manual"),
    )


def manual_rule() -> Column:
    blank = F.col("manufacturer").isNull() | (F.col("manufacturer") == "")
    hit = (F.col("os") == MANUAL_OS) & (F.col("browser") == MANUAL_BROWSER) & blank
    return F.coalesce(hit, F.lit(False))


def manual_rule_users(events: DataFrame) -> DataFrame:
    """User-days with at least one event that fits the manual rule."""
    return events.where(manual_rule()).select(*USER_DAY).distinct()


def scored_events(
    events: DataFrame, iforest: DataFrame, gbt: DataFrame, salts: int | None = None
) -> DataFrame:
    """Events whose user-day has both scores, with the scores."""
    scores = user_day_scores(iforest, gbt)
    known = scores.join(_user_day_counts(events).drop("manual"), list(USER_DAY))
    return attach(events, known, USER_DAY, events.columns, salts, "inner").drop("n_events")


def safe_probability(raw: str = "xgb_bot_prob_raw", anomaly: str = "xgb_model_anomaly") -> Column:
    fallback = F.when(F.col(anomaly) == -1, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.coalesce(F.col(raw).try_cast("double"), fallback)


def rule_bot(params: RiskParams) -> Column:
    """Null when the risk is unknown; that null reaches the final label."""
    return F.col("final_time_risk") >= F.lit(float(params.rule_threshold))


def risk_group(
    params: RiskParams, anomaly: Column | None = None, prob: Column | None = None
) -> Column:
    odd = F.col("iforest_bot") if anomaly is None else anomaly
    p = F.col("xgb_bot_prob") if prob is None else prob
    edge, mid, high = F.lit(params.edge), F.lit(params.mid), F.lit(params.high)
    return (
        F.when(odd & (p >= edge), labels.GROUP_A)
        .when(~odd & (p >= high), labels.GROUP_B)
        .when(~odd & (p >= mid), labels.GROUP_C)
        .when(~odd & (p >= edge), labels.GROUP_D)
        .when(odd & (p < edge), labels.GROUP_E)
        .when(~odd & (p < edge), labels.GROUP_F)
        .otherwise(labels.GROUP_UNKNOWN)
    )


def risk_action(params: RiskParams, group: Column | None = None) -> Column:
    g = F.col("risk_group") if group is None else group
    actions = {
        labels.GROUP_A: labels.ACTION_BLOCK_A,
        labels.GROUP_B: labels.ACTION_BLOCK_B if params.block_b else labels.ACTION_REVIEW_B,
        labels.GROUP_C: labels.ACTION_SAMPLE_C,
        labels.GROUP_D: labels.ACTION_TAG_D,
        labels.GROUP_E: labels.ACTION_RECHECK_E,
        labels.GROUP_F: labels.ACTION_PASS_F,
    }
    start = F.when(F.lit(False), "")
    case = reduce(lambda c, kv: c.when(g == kv[0], kv[1]), actions.items(), start)
    return case.otherwise(labels.GROUP_UNKNOWN)


def model_block(params: RiskParams) -> Column:
    blocked = [labels.GROUP_A] + ([labels.GROUP_B] if params.block_b else [])
    return F.col("risk_group").isin(*blocked)


def block_flags(df: DataFrame, params: RiskParams) -> DataFrame:
    """Model, automatic and final block flags in three-valued logic."""
    return (
        df.withColumn("is_model_block", model_block(params))
        .withColumn("is_auto_bot", F.col("is_model_block") | F.col("is_rule_bot"))
        .withColumn("final_label", F.col("is_auto_bot") | F.col("is_manual_bot"))
    )


def pool_bucket() -> Column:
    return (
        F.when(F.col("final_label"), labels.POOL_BLOCKED)
        .when(F.col("risk_group").isin(*labels.AUDIT_GROUPS), labels.POOL_AUDIT)
        .when(F.col("risk_group").isin(*labels.OBSERVE_GROUPS), labels.POOL_OBSERVE)
        .otherwise(labels.POOL_PASS)
    )


def blocked_or_not() -> Column:
    return F.when(F.col("final_label"), labels.POOL_BLOCKED).otherwise(labels.NOT_BLOCKED)


def label_user_days(scored: DataFrame, params: RiskParams) -> DataFrame:
    """Groups, actions and flags for rows that carry both scores and ``is_manual_bot``."""
    out = (
        scored.withColumn("iforest_bot", F.col("iforest_anomaly") == -1)
        .withColumn("xgb_bot_prob", safe_probability())
        .withColumn("is_rule_bot", rule_bot(params))
        .withColumn("risk_group", risk_group(params))
        .withColumn("action", risk_action(params))
    )
    return block_flags(out, params)


@dataclass(frozen=True)
class LabeledTraffic:
    """Page views of a slice together with one labelled row per user-day."""

    events: DataFrame
    user_days: DataFrame

    def rows(self, salts: int | None = None) -> DataFrame:
        """Labelled events: every event of a labelled user-day, with display columns."""
        events = self.events
        out = attach(events, self.user_days, USER_DAY, events.columns, salts, "inner")
        return out.drop("n_events").withColumns(
            {
                "province_display": blank_to_unknown("province"),
                "browser_display": blank_to_unknown("browser"),
                "first_day_display": first_day_flag("is_first_day"),
            }
        )

    def users_by(self, **dims: Column) -> DataFrame:
        """Distinct (user-day, dimensions) with the labels.

        The events are made distinct before they meet the labels, so what is shuffled is user-days
        times the dimension values of a user-day.
        """
        pairs = self.events.select(*USER_DAY, *[c.alias(n) for n, c in dims.items()]).distinct()
        return attach(pairs, self.user_days, USER_DAY, list(dims), how="inner")

    def newest_day(self):
        """The last day with labelled rows (None without any).

        The events' last day nearly always is; only days that turn out to have no labels are stepped over.
        """
        day = self.events.agg(F.max("date")).first()[0]
        while day is not None and self.user_days.where(F.col("date") == F.lit(day)).isEmpty():
            day = self.events.where(F.col("date") < F.lit(day)).agg(F.max("date")).first()[0]
        return day

    def latest(self, as_of=None) -> LabeledTraffic:
        """The last labelled day, or a given one; a literal, which prunes partitions when planning."""
        day = F.lit(self.newest_day() if as_of is None else as_of).cast("date")
        return LabeledTraffic(
            self.events.where(F.col("date") == day), self.user_days.where(F.col("date") == day)
        )

    def persist(self) -> LabeledTraffic:
        """Keep the label table for many reports; a lost executor only costs its recomputation."""
        return LabeledTraffic(self.events, self.user_days.persist())

    def require_rows(self) -> LabeledTraffic:
        if self.user_days.isEmpty():
            raise ValueError("the slice has no labelled user-day")
        return self


def label_traffic(
    events: DataFrame, iforest: DataFrame, gbt: DataFrame, params: RiskParams = RiskParams()
) -> LabeledTraffic:
    counts = _user_day_counts(events)
    scored = (
        user_day_scores(iforest, gbt)
        .join(counts, list(USER_DAY))
        .withColumn("is_manual_bot", F.col("manual") == 1)
        .drop("manual")
    )
    return LabeledTraffic(events, label_user_days(scored, params))


def labeled_events(
    events: DataFrame, iforest: DataFrame, gbt: DataFrame, params: RiskParams = RiskParams()
) -> DataFrame:
    return label_traffic(events, iforest, gbt, params).rows()
