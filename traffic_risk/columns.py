"""Column names of the tables."""

from __future__ import annotations

USER_DAY = ("date", "distinct_id")

PAGEVIEW = (
    "date",
    "distinct_id",
    "hour_time",
    "city",
    "os",
    "province",
    "browser",
    "ip",
    "is_first_day",
    "is_first_time",
    "title",
    "url",
    "referrer",
    "is_login_id",
    "manufacturer",
    "screen_width",
    "screen_height",
)
RAW_REQUIRED = ("date", "distinct_id", "screen_width", "screen_height")

FINAL_RISK = "final_time_risk"
RESOLUTION_Z = "resolution_share_positive_zscore"

FEATURES = (
    "total_pv",
    "is_direct_ratio",
    "max_c_zscore",
    "max_exact_ip_uv",
    "max_block_pv",
    "avg_block_pv",
    "max_growth_rate",
    "max_uv_pv_ratio",
    "max_target_1pv_ratio",
    "max_target_direct_ratio",
    "attack_block_ratio",
    "time_kl_dist",
    "user_night_density",
    "user_evening_density",
    "night_relative_risk",
    "evening_relative_risk",
    "cluster_size",
    "time_risk",
    "env_risk",
    FINAL_RISK,
    RESOLUTION_Z,
)

IFOREST_REQUIRED = ("model_anomaly", FINAL_RISK, RESOLUTION_Z)
GBT_REQUIRED = ("model_anomaly", "xgb_bot_prob", RESOLUTION_Z)

COHORT_USER = (
    "date",
    "distinct_id",
    "hour_time",
    "province_display",
    "browser_display",
    "os_display",
    "manufacturer_display",
    "seek_report_pv",
)
COHORT_RESULT = COHORT_USER + (
    "iforest_anomaly",
    "final_time_risk",
    "xgb_model_anomaly",
    "xgb_bot_prob_raw",
    "has_model_result",
)
COHORT_DISPLAY = ("province_display", "browser_display", "os_display", "manufacturer_display")

FINGERPRINT = (
    "os",
    "browser",
    "manufacturer",
    "province",
    "is_first_day",
    "is_login_id",
    "province_display",
    "browser_display",
)
