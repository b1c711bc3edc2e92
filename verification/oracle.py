"""SQL that DuckDB runs over the same tables, one statement per query.

Written from the definitions, not from the Spark plans: straightforward joins, distinct counts and
windows. ``statement`` puts the views a query needs in front of it.
"""

from __future__ import annotations

import re

from traffic_risk import labels as L
from verification import fixtures as fx

PAGEVIEW_COLUMNS = (
    "date, distinct_id, hour_time, os, province, browser, ip, is_first_day, title, url, referrer, "
    "is_login_id, manufacturer, screen_width, screen_height"
)
SOURCE = f"SELECT {PAGEVIEW_COLUMNS} FROM raw WHERE event='pageview' AND bot_name IS NULL AND lib='js'"

VIEWS: dict[str, str] = {
    "raw": fx.PAGEVIEWS_RAW.replace("{events}", "events"),
    "pv": f"{SOURCE} AND url NOT LIKE '%{fx.EXCLUDED_HOST}%'",
    "pva": SOURCE,
    "ud": fx.USER_DAYS.replace("{pageviews}", "pv"),
    "ifs": fx.IFOREST_SCORES.replace("{user_days}", "ud"),
    "xgs": fx.XGB_SCORES.replace("{user_days}", "ud"),
    "di": """SELECT * FROM ifs QUALIFY row_number() OVER (PARTITION BY date, distinct_id
        ORDER BY final_time_risk DESC NULLS LAST, model_anomaly DESC NULLS LAST) = 1""",
    "dx": """SELECT * FROM xgs QUALIFY row_number() OVER (PARTITION BY date, distinct_id
        ORDER BY xgb_bot_prob DESC NULLS LAST, model_anomaly DESC NULLS LAST) = 1""",
    "scored": """SELECT p.*, i.model_anomaly AS iforest_anomaly, i.final_time_risk,
        x.model_anomaly AS xgb_model_anomaly, x.xgb_bot_prob AS xgb_bot_prob_raw
        FROM pv p JOIN di i ON p.date = i.date AND p.distinct_id = i.distinct_id
        JOIN dx x ON p.date = x.date AND p.distinct_id = x.distinct_id""",
    "manual": """SELECT DISTINCT date, distinct_id, true AS hit FROM scored WHERE os = 'Android'
        AND browser = 'Chrome Webview' AND (manufacturer IS NULL OR manufacturer = '')""",
}


def _labeled(threshold: float, block_b: bool) -> tuple[str, str]:
    b = "true" if block_b else "false"
    base = f"""SELECT s.*, coalesce(m.hit, false) AS is_manual_bot, s.iforest_anomaly = -1 AS iforest_bot,
        coalesce(s.xgb_bot_prob_raw, CASE WHEN s.xgb_model_anomaly = -1 THEN 1.0 ELSE 0.0 END) AS xgb_bot_prob,
        s.final_time_risk >= {threshold} AS is_rule_bot,
        coalesce(nullif(trim(s.province), ''), '{L.UNKNOWN_TEXT}') AS province_display,
        coalesce(nullif(trim(s.browser), ''), '{L.UNKNOWN_TEXT}') AS browser_display,
        CASE WHEN lower(trim(s.is_first_day)) IN ('1', 'true', 't', 'yes') THEN '{L.FIRST_DAY}' ELSE '{L.NOT_FIRST_DAY}' END AS first_day_display
        FROM scored s LEFT JOIN manual m ON s.date = m.date AND s.distinct_id = m.distinct_id"""
    grouped = f"""SELECT *, CASE
        WHEN iforest_bot AND xgb_bot_prob >= 0.5 THEN '{L.GROUP_A}'
        WHEN NOT iforest_bot AND xgb_bot_prob >= 0.95 THEN '{L.GROUP_B}'
        WHEN NOT iforest_bot AND xgb_bot_prob >= 0.9 AND xgb_bot_prob < 0.95 THEN '{L.GROUP_C}'
        WHEN NOT iforest_bot AND xgb_bot_prob >= 0.5 AND xgb_bot_prob < 0.9 THEN '{L.GROUP_D}'
        WHEN iforest_bot AND xgb_bot_prob < 0.5 THEN '{L.GROUP_E}'
        WHEN NOT iforest_bot AND xgb_bot_prob < 0.5 THEN '{L.GROUP_F}'
        ELSE 'UNKNOWN' END AS risk_group FROM ({base})"""
    blocked = f"(risk_group = '{L.GROUP_A}' OR ({b} AND risk_group = '{L.GROUP_B}'))"
    full = f"""SELECT *, CASE risk_group
        WHEN '{L.GROUP_A}' THEN '{L.ACTION_BLOCK_A}'
        WHEN '{L.GROUP_B}' THEN CASE WHEN {b} THEN '{L.ACTION_BLOCK_B}' ELSE '{L.ACTION_REVIEW_B}' END
        WHEN '{L.GROUP_C}' THEN '{L.ACTION_SAMPLE_C}'
        WHEN '{L.GROUP_D}' THEN '{L.ACTION_TAG_D}'
        WHEN '{L.GROUP_E}' THEN '{L.ACTION_RECHECK_E}'
        WHEN '{L.GROUP_F}' THEN '{L.ACTION_PASS_F}' ELSE 'UNKNOWN' END AS action,
        {blocked} AS is_model_block, {blocked} OR is_rule_bot AS is_auto_bot,
        {blocked} OR is_rule_bot OR is_manual_bot AS final_label FROM ({grouped})"""
    return full, blocked


VIEWS["lab"] = _labeled(999, False)[0]
VIEWS["lab_rules"] = _labeled(50, True)[0]
VIEWS["latest"] = "SELECT * FROM lab WHERE date = (SELECT max(date) FROM lab)"
VIEWS["prov"] = """SELECT province_display, count(DISTINCT distinct_id) AS before_count,
    count(DISTINCT CASE WHEN NOT final_label THEN distinct_id END) AS after_count,
    count(DISTINCT CASE WHEN final_label THEN distinct_id END) AS removed_count FROM latest GROUP BY 1"""
VIEWS["prov15"] = "SELECT * FROM prov ORDER BY before_count DESC, province_display LIMIT 15"

POOL = f"""CASE WHEN final_label THEN '{L.POOL_BLOCKED}'
    WHEN risk_group IN ('{L.GROUP_B}', '{L.GROUP_C}') THEN '{L.POOL_AUDIT}'
    WHEN risk_group IN ('{L.GROUP_D}', '{L.GROUP_E}') THEN '{L.POOL_OBSERVE}' ELSE '{L.POOL_PASS}' END"""
BLOCKED = f"CASE WHEN final_label THEN '{L.POOL_BLOCKED}' ELSE '{L.NOT_BLOCKED}' END"

# --- features ------------------------------------------------------------------------------
NIGHT = "exp(-pow(hour_time - 3.0, 2) / 6.0)"
EVENING = "exp(-pow(hour_time - 21.0, 2) / 4.0)"
SEGMENT = r"regexp_replace(coalesce(ip, 'nan'), '\.[^.]*$', '')"
DIRECT = "CASE WHEN referrer IS NULL OR referrer = '' THEN 1 ELSE 0 END"
CANONICAL = """CASE WHEN try_cast(screen_width AS DOUBLE) BETWEEN 100 AND 10000 AND try_cast(screen_height AS DOUBLE) BETWEEN 100 AND 10000
    THEN concat(CAST(CAST(round_even(least(try_cast(screen_width AS DOUBLE), try_cast(screen_height AS DOUBLE)), 0) AS BIGINT) AS VARCHAR), 'x',
    CAST(CAST(round_even(greatest(try_cast(screen_width AS DOUBLE), try_cast(screen_height AS DOUBLE)), 0) AS BIGINT) AS VARCHAR)) END"""

VIEWS.update(
    {
        "hour_days": "SELECT date, hour_time, count(*) AS n FROM pva WHERE hour_time IS NOT NULL GROUP BY ALL",
        "hour_ref": """SELECT hour_time, m / sum(m) OVER () AS ratio FROM (
            SELECT hour_time, greatest(quantile_cont(r, 0.5), 1e-6) AS m FROM (
            SELECT *, n / (sum(n) OVER (PARTITION BY date) + 1e-12) AS r FROM hour_days) GROUP BY 1)""",
        "mass": f"SELECT sum(ratio * {NIGHT}) AS night_mass, sum(ratio * {EVENING}) AS evening_mass FROM hour_ref",
        "ev": f"SELECT *, {SEGMENT} AS seg, {DIRECT} AS direct FROM pva",
        "seg_users": "SELECT date, seg, count(DISTINCT distinct_id) AS cnt FROM ev GROUP BY ALL",
        "seg_stats": """SELECT avg(md) AS c_mean, CASE WHEN avg(sd) = 0 THEN 1.0 ELSE avg(sd) END AS c_std
            FROM (SELECT date, quantile_cont(cnt, 0.5) AS md, stddev_samp(cnt) AS sd FROM seg_users GROUP BY 1)""",
        "upv": "SELECT date, distinct_id, count(*) AS user_total_pv, CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS is_1pv_user FROM pva GROUP BY 1, 2",
        "blk0": """SELECT e.date, e.url, e.hour_time, count(*) AS block_pv, count(DISTINCT e.distinct_id) AS block_uv,
            CAST(sum(u.is_1pv_user) AS BIGINT) AS block_1pv_uv, CAST(sum(e.direct) AS BIGINT) AS block_direct_pv
            FROM ev e JOIN upv u ON e.date = u.date AND e.distinct_id = u.distinct_id
            WHERE e.url IS NOT NULL AND e.hour_time IS NOT NULL GROUP BY ALL""",
        "blk1": """SELECT *, least(block_pv / (prev_pv + 1e-6), 50.0) AS growth_rate FROM (
            SELECT *, coalesce(lag(block_pv) OVER (PARTITION BY date, url ORDER BY hour_time), 0) AS prev_pv FROM blk0)""",
        "blk2": """SELECT *, block_uv / (block_pv + 1e-6) AS uv_pv_ratio, block_1pv_uv / (block_uv + 1e-6) AS target_1pv_ratio,
            block_direct_pv / (block_pv + 1e-6) AS target_direct_ratio FROM blk1""",
        "blk": """SELECT *, CASE WHEN growth_rate > 3.0 AND uv_pv_ratio > 0.9 AND target_1pv_ratio > 0.2 THEN 1 ELSE 0 END AS is_suspicious_block FROM blk2""",
        "ip_users": "SELECT date, ip, count(DISTINCT distinct_id) AS exact_ip_uv FROM ev WHERE ip IS NOT NULL GROUP BY ALL",
        "seg_z": "SELECT date, seg AS ip_c_segment, cnt, (cnt - c_mean) / c_std AS c_zscore FROM seg_users, seg_stats",
        "user_hours": """SELECT h.date, h.distinct_id, h.hour_time, n / (user_total_pv + 1e-12) AS share, coalesce(r.ratio, 1e-6) AS ratio
            FROM (SELECT date, distinct_id, hour_time, count(*) AS n FROM ev WHERE hour_time IS NOT NULL GROUP BY ALL) h
            JOIN upv u ON h.date = u.date AND h.distinct_id = u.distinct_id LEFT JOIN hour_ref r ON h.hour_time = r.hour_time""",
        "hours0": f"""SELECT date, distinct_id, sum(share * ln((share + 1e-8) / (ratio + 1e-8))) AS time_kl_dist,
            sum(share * {NIGHT}) AS user_night_density, sum(share * {EVENING}) AS user_evening_density FROM user_hours GROUP BY 1, 2""",
        "hours": """SELECT h.*, greatest(ln(user_night_density + 1e-7) - ln(night_mass + 1e-7), 0.0) AS night_relative_risk,
            greatest(ln(user_evening_density + 1e-7) - ln(evening_mass + 1e-7), 0.0) AS evening_relative_risk FROM hours0 h, mass""",
        "sig": """SELECT date, distinct_id, round_even(avg(hour_time), 0) AS hour_bin, count(DISTINCT url) AS url_nunique,
            sum(direct) / count(*) AS is_direct, min(seg) AS ip_c FROM ev GROUP BY 1, 2""",
        "clones": """SELECT *, CASE WHEN hour_bin IS NOT NULL THEN count(*) OVER (PARTITION BY date, hour_bin, url_nunique, is_direct) END AS cluster_size FROM sig""",
        "rollup": """SELECT e.date, e.distinct_id, count(*) AS total_pv, sum(direct) / count(*) AS is_direct_ratio,
            max(z.c_zscore) AS z0, max(exact_ip_uv) AS max_exact_ip_uv, max(block_pv) AS max_block_pv, avg(block_pv) AS avg_block_pv,
            max(growth_rate) AS max_growth_rate, max(uv_pv_ratio) AS max_uv_pv_ratio, max(target_1pv_ratio) AS max_target_1pv_ratio,
            max(target_direct_ratio) AS max_target_direct_ratio, avg(coalesce(is_suspicious_block, 0)) AS attack_block_ratio
            FROM ev e LEFT JOIN blk b ON e.date = b.date AND e.url = b.url AND e.hour_time = b.hour_time
            LEFT JOIN ip_users i ON e.date = i.date AND e.ip = i.ip LEFT JOIN seg_z z ON e.date = z.date AND e.seg = z.ip_c_segment
            GROUP BY 1, 2""",
        "env": """SELECT date, distinct_id, max_exact_ip_uv, CASE WHEN z0 < 0 THEN 0.0 ELSE z0 END AS max_c_zscore FROM rollup""",
        "feat0": """SELECT r.*, CASE WHEN z0 < 0 THEN 0.0 ELSE z0 END AS max_c_zscore, time_kl_dist, user_night_density, user_evening_density,
            night_relative_risk, evening_relative_risk, cluster_size FROM rollup r
            LEFT JOIN hours h ON r.date = h.date AND r.distinct_id = h.distinct_id
            LEFT JOIN clones c ON r.date = c.date AND r.distinct_id = c.distinct_id""",
        "feat1": """SELECT *, time_kl_dist * ln(1 + total_pv) AS time_risk,
            ln(1 + max_exact_ip_uv) * 0.5 + ln(1 + max_c_zscore) * 0.5 AS env_risk FROM feat0""",
        "feat2": """SELECT *, greatest(time_risk, night_relative_risk, evening_relative_risk, env_risk) AS risk0,
            CASE WHEN attack_block_ratio > 0.7 AND total_pv <= 3 AND is_direct_ratio > 0.7 THEN 25.0 ELSE 0.0 END AS block_bonus,
            CASE WHEN cluster_size > 50 AND total_pv <= 2 THEN 20.0 ELSE 0.0 END AS clone_bonus,
            CASE WHEN total_pv = 1 AND is_direct_ratio > 0.6 AND user_night_density > 0.4 THEN 15.0 ELSE 0.0 END AS night_bonus,
            CASE WHEN user_evening_density > 0.5 AND total_pv = 1 AND is_direct_ratio = 1.0 AND cluster_size > 20 THEN 10.0 ELSE 0.0 END AS evening_bonus
            FROM feat1""",
        # --- resolution
        "res_counts": f"SELECT date, distinct_id, {CANONICAL} AS resolution, count(*) AS n FROM pva GROUP BY ALL",
        "main_res": """SELECT u.date, u.distinct_id, r.resolution AS main_resolution_canonical FROM upv u LEFT JOIN (
            SELECT * FROM res_counts WHERE resolution IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY date, distinct_id ORDER BY n DESC, resolution) = 1) r
            ON u.date = r.date AND u.distinct_id = r.distinct_id""",
        "vocab": """SELECT main_resolution_canonical AS resolution, count(*) AS total_user_days, count(DISTINCT date) AS days_present
            FROM main_res WHERE main_resolution_canonical IS NOT NULL GROUP BY 1 HAVING count(*) >= {min_users} AND count(DISTINCT date) >= 7""",
        "buckets": f"""SELECT date, distinct_id, main_resolution_canonical, CASE WHEN main_resolution_canonical IS NULL THEN NULL
            WHEN main_resolution_canonical IN (SELECT resolution FROM vocab) THEN main_resolution_canonical ELSE '{L.OTHER_RESOLUTION}' END AS resolution_bucket FROM main_res""",
        "bucket_names": f"SELECT resolution AS resolution_bucket FROM vocab UNION ALL SELECT '{L.OTHER_RESOLUTION}'",
        "grid": """SELECT d.date, b.resolution_bucket, coalesce(c.n, 0) AS resolution_user_days, coalesce(t.n, 0) AS valid_user_days,
            CASE WHEN t.n > 0 THEN coalesce(c.n, 0) / t.n ELSE 0.0 END AS daily_share
            FROM (SELECT DISTINCT date FROM buckets WHERE resolution_bucket IS NOT NULL) d CROSS JOIN bucket_names b
            LEFT JOIN (SELECT date, resolution_bucket, count(*) AS n FROM buckets GROUP BY 1, 2) c ON d.date = c.date AND b.resolution_bucket = c.resolution_bucket
            LEFT JOIN (SELECT date, count(*) AS n FROM buckets WHERE resolution_bucket IS NOT NULL GROUP BY 1) t ON d.date = t.date""",
        "floor": """SELECT greatest(0.5 / greatest(quantile_cont(n, 0.5), 1.0), 1e-6) AS share_scale_floor FROM (
            SELECT date, count(*) AS n FROM buckets WHERE resolution_bucket IS NOT NULL GROUP BY 1)""",
        "base0": """SELECT resolution_bucket, quantile_cont(daily_share, 0.5) AS md, avg(daily_share) AS mean, coalesce(stddev_samp(daily_share), 0.0) AS sd,
            count(*) AS baseline_days, CAST(sum(resolution_user_days) AS BIGINT) AS total_user_days,
            count(CASE WHEN resolution_user_days > 0 THEN 1 END) AS days_present FROM grid GROUP BY 1""",
        "base1": """SELECT b.*, d.mad FROM base0 b JOIN (SELECT g.resolution_bucket, quantile_cont(abs(daily_share - md), 0.5) AS mad
            FROM grid g JOIN base0 b ON g.resolution_bucket = b.resolution_bucket GROUP BY 1) d ON b.resolution_bucket = d.resolution_bucket""",
        "base": """SELECT *, CASE WHEN 1.4826 * mad > share_scale_floor THEN 'MAD' WHEN sd > share_scale_floor THEN 'STD_FALLBACK' ELSE 'FLOOR' END AS scale_source,
            CASE WHEN 1.4826 * mad > share_scale_floor THEN 1.4826 * mad WHEN sd > share_scale_floor THEN sd ELSE share_scale_floor END AS scale
            FROM base1, floor""",
        "zs": """SELECT g.date, g.resolution_bucket, g.resolution_user_days, g.daily_share, least(greatest((daily_share - md) / scale, 0.0), 10.0) AS z
            FROM grid g JOIN base b ON g.resolution_bucket = b.resolution_bucket""",
        "loo0": """SELECT a.date, a.resolution_bucket, quantile_cont(b.daily_share, 0.5) AS md, coalesce(stddev_samp(b.daily_share), 0.0) AS sd
            FROM grid a JOIN grid b ON a.resolution_bucket = b.resolution_bucket AND a.date <> b.date GROUP BY 1, 2""",
        "loo1": """SELECT l.date, l.resolution_bucket, any_value(l.md) AS md, any_value(l.sd) AS sd, quantile_cont(abs(b.daily_share - l.md), 0.5) AS mad
            FROM loo0 l JOIN grid b ON l.resolution_bucket = b.resolution_bucket AND l.date <> b.date GROUP BY 1, 2""",
        "zs_loo": """SELECT g.date, g.resolution_bucket, g.resolution_user_days, g.daily_share,
            least(greatest((daily_share - md) / CASE WHEN 1.4826 * mad > share_scale_floor THEN 1.4826 * mad WHEN sd > share_scale_floor THEN sd ELSE share_scale_floor END, 0.0), 10.0) AS z
            FROM grid g JOIN loo1 l ON g.date = l.date AND g.resolution_bucket = l.resolution_bucket, floor""",
        "z_users": """SELECT b.date, b.distinct_id, coalesce(z.z, 0.0) AS z FROM buckets b
            LEFT JOIN zs z ON b.date = z.date AND b.resolution_bucket = z.resolution_bucket""",
        "z_users_loo": """SELECT b.date, b.distinct_id, coalesce(z.z, 0.0) AS z FROM buckets b
            LEFT JOIN zs_loo z ON b.date = z.date AND b.resolution_bucket = z.resolution_bucket""",
        # --- cohort
        "cohort": f"""SELECT date, distinct_id, hour_time, coalesce(nullif(trim(province), ''), '{L.UNKNOWN_TEXT}') AS province_display,
            coalesce(nullif(trim(browser), ''), '{L.UNKNOWN_TEXT}') AS browser_display, coalesce(nullif(trim(os), ''), '{L.UNKNOWN_TEXT}') AS os_display,
            coalesce(nullif(trim(manufacturer), ''), '{L.UNKNOWN_TEXT}') AS manufacturer_display, seek_report_pv FROM (
            SELECT date, distinct_id, hour_time, province, browser, os, manufacturer, count(*) AS seek_report_pv FROM raw
            WHERE event = 'pageview' AND date BETWEEN DATE '{fx.FIRST_DAY}' AND DATE '{fx.LAST_DAY}' AND app_version IS NULL AND bot_name IS NULL
            AND url_path = '{fx.TARGET_PATH}' AND title = '{fx.TARGET_TITLE}' GROUP BY ALL)""",
        "cohort_stored": fx.COHORT_STORED.replace("{cohort}", "cohort"),
        "cohort_result": """SELECT c.*, i.model_anomaly AS iforest_anomaly, i.final_time_risk, x.model_anomaly AS xgb_model_anomaly,
            x.xgb_bot_prob AS xgb_bot_prob_raw, i.distinct_id IS NOT NULL AND x.distinct_id IS NOT NULL AS has_model_result FROM (
            SELECT date, distinct_id, hour_time, province_display, browser_display, os_display, manufacturer_display, CAST(sum(seek_report_pv) AS BIGINT) AS seek_report_pv
            FROM cohort GROUP BY ALL) c LEFT JOIN di i ON c.date = i.date AND c.distinct_id = i.distinct_id
            LEFT JOIN dx x ON c.date = x.date AND c.distinct_id = x.distinct_id""",
    }
)
VIEWS["vocab"] = VIEWS["vocab"].replace("{min_users}", "100")


def _cohort_labeled(threshold: float, block_b: bool) -> str:
    b = "true" if block_b else "false"
    hit = f"(risk_group = '{L.GROUP_A}' OR ({b} AND risk_group = '{L.GROUP_B}'))"
    any_hit = f"({hit} OR is_rule_bot OR is_manual_bot)"
    return f"""SELECT *, CASE risk_group WHEN '{L.UNMATCHED}' THEN '{L.UNMATCHED}'
        WHEN '{L.GROUP_A}' THEN '{L.ACTION_BLOCK_A}'
        WHEN '{L.GROUP_B}' THEN CASE WHEN {b} THEN '{L.ACTION_BLOCK_B}' ELSE '{L.ACTION_REVIEW_B}' END
        WHEN '{L.GROUP_C}' THEN '{L.ACTION_SAMPLE_C}' WHEN '{L.GROUP_D}' THEN '{L.ACTION_TAG_D}'
        WHEN '{L.GROUP_E}' THEN '{L.ACTION_RECHECK_E}' WHEN '{L.GROUP_F}' THEN '{L.ACTION_PASS_F}' ELSE 'UNKNOWN' END AS action,
        has_model_result AND {hit} AS is_model_block, has_model_result AND ({hit} OR is_rule_bot) AS is_auto_bot,
        has_model_result AND {any_hit} AS final_label,
        CASE WHEN NOT has_model_result THEN '{L.UNMATCHED}' WHEN {any_hit} THEN '{L.POOL_BLOCKED}'
        WHEN risk_group IN ('{L.GROUP_B}', '{L.GROUP_C}') THEN '{L.POOL_AUDIT}'
        WHEN risk_group IN ('{L.GROUP_D}', '{L.GROUP_E}') THEN '{L.POOL_OBSERVE}' ELSE '{L.POOL_PASS}' END AS classification_bucket,
        CASE WHEN NOT has_model_result THEN '{L.UNMATCHED}' WHEN {any_hit} THEN '{L.POOL_BLOCKED}' ELSE '{L.NOT_BLOCKED}' END AS user_type
        FROM (SELECT *, CASE WHEN NOT has_model_result THEN '{L.UNMATCHED}'
        WHEN iforest_bot AND xgb_bot_prob >= 0.5 THEN '{L.GROUP_A}' WHEN NOT iforest_bot AND xgb_bot_prob >= 0.95 THEN '{L.GROUP_B}'
        WHEN NOT iforest_bot AND xgb_bot_prob >= 0.9 THEN '{L.GROUP_C}' WHEN NOT iforest_bot AND xgb_bot_prob >= 0.5 THEN '{L.GROUP_D}'
        WHEN iforest_bot AND xgb_bot_prob < 0.5 THEN '{L.GROUP_E}' WHEN NOT iforest_bot AND xgb_bot_prob < 0.5 THEN '{L.GROUP_F}' ELSE 'UNKNOWN' END AS risk_group
        FROM (SELECT date, distinct_id, hour_time, province_display, browser_display, os_display, manufacturer_display, seek_report_pv, has_model_result,
        iforest_anomaly = -1 AS iforest_bot, coalesce(xgb_bot_prob_raw, CASE WHEN xgb_model_anomaly = -1 THEN 1.0 ELSE 0.0 END) AS xgb_bot_prob,
        final_time_risk, final_time_risk >= {threshold} AS is_rule_bot,
        os_display = 'Android' AND browser_display = 'Chrome Webview' AND (manufacturer_display IS NULL OR manufacturer_display IN ('', '{L.UNKNOWN_TEXT}')) AS is_manual_bot
        FROM cohort_result))"""


VIEWS["cohort_lab"] = _cohort_labeled(999, False)
VIEWS["cohort_lab_rules"] = _cohort_labeled(50, True)
VIEWS["cohort_days"] = f"""SELECT date, distinct_id, CAST(sum(seek_report_pv) AS BIGINT) AS seek_report_pv, max(risk_group) AS risk_group, max(action) AS action,
    CASE WHEN max(CASE WHEN has_model_result THEN 1 ELSE 0 END) = 0 THEN '{L.UNMATCHED}' WHEN max(CASE WHEN final_label THEN 1 ELSE 0 END) = 1 THEN '{L.POOL_BLOCKED}'
    WHEN max(CASE WHEN risk_group IN ('{L.GROUP_B}', '{L.GROUP_C}') THEN 1 ELSE 0 END) = 1 THEN '{L.POOL_AUDIT}'
    WHEN max(CASE WHEN risk_group IN ('{L.GROUP_D}', '{L.GROUP_E}') THEN 1 ELSE 0 END) = 1 THEN '{L.POOL_OBSERVE}' ELSE '{L.POOL_PASS}' END AS classification_bucket,
    CASE WHEN max(CASE WHEN has_model_result THEN 1 ELSE 0 END) = 0 THEN '{L.UNMATCHED}' WHEN max(CASE WHEN final_label THEN 1 ELSE 0 END) = 1 THEN '{L.POOL_BLOCKED}'
    ELSE '{L.NOT_BLOCKED}' END AS user_type,
    max(CASE WHEN has_model_result THEN 1 ELSE 0 END) = 1 AS has_model_result, max(CASE WHEN iforest_bot THEN 1 ELSE 0 END) = 1 AS iforest_bot,
    max(xgb_bot_prob) AS xgb_bot_prob, max(final_time_risk) AS final_time_risk, max(CASE WHEN final_label THEN 1 ELSE 0 END) = 1 AS final_label,
    max(province_display) AS province_display, max(browser_display) AS browser_display, max(os_display) AS os_display,
    max(manufacturer_display) AS manufacturer_display FROM cohort_lab GROUP BY 1, 2"""

# --- network
_FP = ("os", "browser", "manufacturer", "province", "is_first_day", "is_login_id", "province_display", "browser_display")
FINGERPRINT = " || '|' || ".join(
    f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{L.UNKNOWN_TEXT}{c}' ELSE trim({c}) END" for c in _FP
)
IPV4 = r"regexp_extract(ip, '^(\d+\.\d+\.\d+)', 1)"
VIEWS.update(
    {
        "net": f"SELECT DISTINCT date, distinct_id, final_label AS is_bot, ip, {', '.join(_FP)} FROM lab",
        "net_fields": rf"""SELECT *, coalesce(is_bot, false) AS flag FROM (SELECT *, regexp_extract(trim(coalesce(ip, '')), '^(\d+\.\d+\.\d+)', 1) AS ip_c_segment,
            {FINGERPRINT} AS soft_fp FROM net) WHERE ip_c_segment <> '' AND soft_fp <> ''""",
        "net_daily": """SELECT date, count(*) AS dau, count(CASE WHEN b THEN 1 END) AS blocked FROM (
            SELECT date, distinct_id, bool_or(coalesce(is_bot, false)) AS b FROM net GROUP BY 1, 2) GROUP BY 1""",
        "net_eligible": "SELECT date, count(DISTINCT distinct_id) AS eligible_dau FROM net_fields GROUP BY 1",
        "net_heavy": """SELECT date, ip_c_segment, soft_fp, count(DISTINCT distinct_id) AS users,
            count(DISTINCT CASE WHEN flag THEN distinct_id END) AS bot_users, count(DISTINCT CASE WHEN NOT flag THEN distinct_id END) AS clean_users
            FROM net_fields GROUP BY 1, 2, 3 HAVING count(DISTINCT distinct_id) >= 5""",
        "net_ratio": "SELECT *, bot_users + clean_users AS total, bot_users / (bot_users + clean_users) AS ratio FROM net_heavy",
        "net_caught": """SELECT DISTINCT f.date, f.distinct_id FROM net_fields f JOIN net_ratio r ON f.date = r.date
            AND f.ip_c_segment = r.ip_c_segment AND f.soft_fp = r.soft_fp WHERE NOT flag AND ratio >= 0.2""",
        "net_roi": """SELECT d.date, d.dau, d.blocked, coalesce(e.eligible_dau, 0) AS eligible_dau, coalesce(n.c, 0) AS new_catch,
            round_even(coalesce(n.c, 0) / d.dau * 100, 2) AS impact_pct FROM net_daily d LEFT JOIN net_eligible e ON d.date = e.date
            LEFT JOIN (SELECT date, count(*) AS c FROM net_caught GROUP BY 1) n ON d.date = n.date""",
        "pool": fx.REDTEAM_POOL.replace("{user_days}", "ud"),
        "pool_p": "SELECT *, coalesce(xgb_bot_prob_raw, CASE WHEN xgb_model_anomaly = -1 THEN 1.0 ELSE 0.0 END) AS p, coalesce(iforest_anomaly = -1, false) AS odd FROM pool",
        "counts": """SELECT scenario, pool, count(*) AS user_days, count(CASE WHEN odd THEN 1 END) AS iforest_black,
            count(CASE WHEN p >= 0.5 THEN 1 END) AS xgb_05_black, count(CASE WHEN p >= 0.9 THEN 1 END) AS xgb_09_black,
            count(CASE WHEN p >= 0.95 THEN 1 END) AS xgb_095_black, count(CASE WHEN odd AND p >= 0.5 THEN 1 END) AS both_black,
            count(CASE WHEN NOT odd AND p >= 0.95 THEN 1 END) AS xgb_high_new, count(CASE WHEN NOT odd AND p >= 0.9 AND p < 0.95 THEN 1 END) AS xgb_mid_new,
            count(CASE WHEN NOT odd AND p >= 0.5 AND p < 0.9 THEN 1 END) AS xgb_edge, avg(resolution_share_positive_zscore) AS resolution_z_mean,
            quantile_cont(resolution_share_positive_zscore, 0.95) AS resolution_z_p95 FROM pool_p GROUP BY 1, 2""",
        "rates": """SELECT *, (both_black + xgb_high_new + xgb_mid_new + xgb_edge + iforest_only) AS risk_pool_hits,
            (both_black + xgb_high_new + xgb_mid_new + xgb_edge + iforest_only) / user_days AS risk_pool_rate, iforest_black / user_days AS iforest_rate,
            xgb_05_black / user_days AS xgb_05_rate, xgb_09_black / user_days AS xgb_09_rate, xgb_095_black / user_days AS xgb_095_rate
            FROM (SELECT *, greatest(iforest_black - both_black, 0) AS iforest_only FROM counts)""",
        "attack": "SELECT * EXCLUDE (pool), 1 - risk_pool_rate AS bypass_rate FROM rates WHERE pool = 'attack'",
        "normal": """SELECT * EXCLUDE (pool), both_black / user_days AS normal_pool_direct_hit_rate,
            (xgb_high_new + xgb_mid_new + xgb_edge) / user_days AS normal_pool_xgb_added_hit_rate FROM rates WHERE pool = 'normal'""",
        "raw_manifest": fx.RAW_MANIFEST.replace("{pageviews}", "pv"),
        "feature_manifest": fx.FEATURE_MANIFEST.replace("{pageviews}", "pv"),
    }
)

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def _needed(body: str, found: list[str]) -> None:
    for name in dict.fromkeys(_WORD.findall(body)):
        if name in VIEWS and name not in found and re.search(rf"\b(from|join|,)\s+\(?{name}\b", body, re.I):
            _needed(VIEWS[name], found)
            found.append(name)


def statement(body: str) -> str:
    """The query with the views it reads, in order, as common table expressions."""
    found: list[str] = []
    _needed(body, found)
    if not found:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in found) + "\n" + body
