"""One query per operator, each with the SQL it is checked against (or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traffic_risk import labels as L
from traffic_risk.columns import FEATURES, RAW_REQUIRED, RESOLUTION_Z, USER_DAY
from traffic_risk.functions import (
    blank_to_unknown,
    bool_flag,
    c_segment_regex,
    c_segment_rsplit,
    canonical_resolution,
    first_day_flag,
    hour_weight,
    is_direct,
    normalize_date,
    parse_match_flag,
    select_features,
    soft_fingerprint,
    to_number_or,
)
from traffic_risk.operators import (
    baseline,
    cohort,
    features,
    labeling,
    models,
    network,
    partials,
    redteam,
    reports,
    resolution,
    sketches,
)
from traffic_risk.params import RiskParams
from traffic_risk.plans import cohort as cohort_plan
from traffic_risk.plans import rolling, scoring
from traffic_risk.session import scratch_dir
from traffic_risk.sources import bucketed, pageviews, store
from traffic_risk.sources import redteam as redteam_source
from traffic_risk.streaming import ingest
from verification import fixtures as fx
from verification import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

RULES_ON = RiskParams(rule_threshold=50.0, block_b=True)
KEYS = "date, distinct_id"


def query(check: str | None = None, name: str | None = None):
    def register(fn: Callable[[fx.Inputs], DataFrame]) -> Callable[[fx.Inputs], DataFrame]:
        key = name or fn.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fx.Inputs(spark, sf_dir))

        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = o.statement(check)
        return fn

    return register


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums and logarithms differ in the last bits between engines."""
    doubles = {
        f.name: F.round(f.name, digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(doubles) if doubles else df


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_dir(spark, name)


def _traffic(t: fx.Inputs, params: RiskParams = RiskParams()) -> labeling.LabeledTraffic:
    return labeling.label_traffic(
        t.pageviews, t.iforest, t.xgb, params
    )


# ---------------------------------------------------------------- sources, sinks, maintenance
PV = o.PAGEVIEW_COLUMNS


@query(f"SELECT {PV} FROM pv WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'")
def scan_pageviews(t):
    return pageviews.scan_pageviews(
        t.raw, "2024-01-03", "2024-01-25", fx.EXCLUDED_HOST
    )


@query("SELECT * FROM cohort")
def scan_cohort_events(t):
    return t.cohort


@query(f"SELECT {PV} FROM pv WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def read_table(t):
    path = _scratch(t.spark, "read_table")
    pv = t.pageviews
    store.write_partitions(pv, path)
    return store.read_table(t.spark, path, pv.schema, "2024-01-12", "2024-01-05")


@query(f"SELECT {PV} FROM pv")
def write_partitions(t):
    path = _scratch(t.spark, "write_partitions")
    store.write_partitions(t.pageviews, path)
    return store.read_table(t.spark, path)


REPLACED = ("2024-01-04", "2024-01-09", "2024-01-10")
REPLACED_SQL = ", ".join(f"DATE '{x}'" for x in REPLACED)


@query(
    f"""SELECT {KEYS}, url, title, hour_time FROM pv WHERE date NOT IN ({REPLACED_SQL}) UNION ALL
    SELECT {KEYS}, url, NULL, hour_time + 1 FROM pv WHERE date IN ({REPLACED_SQL})"""
)
def replace_dates(t):
    table = t.pageviews.select(*USER_DAY, "url", "title", "hour_time")
    new = table.select("hour_time", "url", *USER_DAY).withColumn("hour_time", F.col("hour_time") + 1)
    return store.replace_dates(table, new, REPLACED)


@query(
    f"""SELECT {KEYS}, hour_time FROM pv WHERE date NOT IN ({REPLACED_SQL}) UNION ALL
    SELECT {KEYS}, hour_time + 1 FROM pv WHERE date IN ({REPLACED_SQL}) AND date <> DATE '2024-01-09'"""
)
def replace_dates_on_disk(t):
    path = _scratch(t.spark, "replace_dates")
    table = t.pageviews.select(*USER_DAY, "hour_time")
    store.write_partitions(table, path)
    new = table.withColumn("hour_time", F.col("hour_time") + 1).where(
        F.col("date") != F.lit("2024-01-09").cast("date")
    )
    store.replace_dates_on_disk(new, path, REPLACED, check=False)
    return store.read_table(t.spark, path)


DAILY = f"""SELECT date, count(DISTINCT distinct_id) AS total_dau,
    count(DISTINCT CASE WHEN NOT final_label THEN distinct_id END) AS kept_dau,
    count(DISTINCT CASE WHEN final_label THEN distinct_id END) AS removed_dau,
    count(DISTINCT CASE WHEN is_manual_bot AND NOT is_auto_bot THEN distinct_id END) AS manual_removed_dau,
    count(DISTINCT CASE WHEN risk_group IN ('{L.GROUP_B}', '{L.GROUP_C}') AND NOT final_label THEN distinct_id END) AS audit_dau,
    count(DISTINCT CASE WHEN risk_group = '{L.GROUP_D}' AND NOT final_label THEN distinct_id END) AS tag_dau,
    count(DISTINCT CASE WHEN risk_group = '{L.GROUP_E}' AND NOT final_label THEN distinct_id END) AS dispute_dau"""


@query(f"{DAILY} FROM lab GROUP BY 1")
def export_csv(t):
    path = _scratch(t.spark, "export_csv")
    daily = reports.daily_detail(_traffic(t)).join(
        reports.daily_summary(_traffic(t)).select("date", "manual_removed_dau"), "date"
    )
    store.export_csv(daily, path)
    return t.spark.read.schema(daily.schema).option("header", True).csv(path)


def _counts(t) -> DataFrame:
    return redteam.redteam_counts(t.redteam_pool)


@query(
    f"""SELECT '{redteam_source.UNKNOWN_VERSION}' AS model_version, scenario, user_days, iforest_black, xgb_05_black,
    both_black, CAST(NULL AS VARCHAR) AS verdict FROM counts WHERE pool = 'attack'"""
)
def read_redteam_json(t):
    path = _scratch(t.spark, "redteam")
    counts = _counts(t)

    def records(pool):  # a row per scenario: four entries
        return F.collect_list(F.when(F.col("pool") == pool, F.struct(*counts.columns)))

    payload = counts.agg(
        records("attack").alias("attack_results"), records("normal").alias("normal_results")
    )
    payload.coalesce(1).write.json(path)
    attack, _ = redteam_source.read_redteam_json(t.spark, path)
    return attack.select(
        "model_version", "scenario", "user_days", "iforest_black", "xgb_05_black", "both_black", "verdict"
    )


@query("SELECT date, distinct_id, screen_width, screen_height FROM pv")
def require_columns(t):
    return store.require_columns(t.pageviews, RAW_REQUIRED, "raw events").select(*RAW_REQUIRED)


@query(f"SELECT {PV} FROM pv WHERE date >= DATE '2024-02-25' - 45")
def retain_window(t):
    return store.retain_window(t.pageviews, "2024-02-25")


@query(
    """SELECT c.date, coalesce(n, 0) AS row_count, coalesce(n, 0) > 0 AS covered,
    CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total_rows
    FROM (SELECT CAST(unnest(range(DATE '2023-12-28', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS date) c
    LEFT JOIN (SELECT date, count(*) AS n FROM pv GROUP BY 1) p ON c.date = p.date"""
)
def day_coverage(t):
    return store.day_coverage(t.pageviews, "2023-12-28", "2024-01-19")


GAPS = "extract(day FROM date) % 7 IN (2, 3, 5)"


def _ranges(first: str, last: str, names: tuple[str, str]) -> str:
    return f"""SELECT min(day) AS {names[0]}, max(day) AS {names[1]} FROM (
    SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS island FROM (
    SELECT CAST(unnest(range(DATE '{first}', DATE '{last}' + 1, INTERVAL 1 DAY)) AS DATE) AS day) c
    WHERE day NOT IN (SELECT DISTINCT date FROM pv WHERE NOT ({GAPS}))) GROUP BY island"""


def _with_gaps(t) -> DataFrame:
    return t.pageviews.where(~F.expr(GAPS))


@query(_ranges("2024-01-01", "2024-02-04", ("range_start", "range_end")))
def missing_date_ranges(t):
    return store.missing_date_ranges(_with_gaps(t), "2024-01-01", "2024-02-04")


@query(_ranges("2023-12-23", "2024-02-05", ("fetch_start", "fetch_end")))
def fetch_plan(t):
    return store.fetch_plan(_with_gaps(t), "2024-02-06")


@query(
    """SELECT CASE WHEN max(date) >= DATE '2024-02-13' AND min(date) <= DATE '2023-12-31' THEN NULL
    WHEN min(date) IS NULL OR min(date) > DATE '2024-01-05' THEN DATE '2024-01-05' ELSE max(date) + 1 END AS fetch_start FROM pv"""
)
def first_fetch_date(t):
    return store.first_fetch_date(t.pageviews, "2024-02-19")


@query(
    """SELECT r.date FROM raw_manifest r LEFT JOIN feature_manifest f ON r.date = f.date
    WHERE f.date IS NULL OR r.loaded_at > f.built_at OR f.model_version <> 'new'"""
)
def stale_dates(t):
    return store.stale_dates(
        store.day_manifest(t.raw_manifest, "loaded_at"),
        store.day_manifest(t.feature_manifest, "built_at", "model_version"),
        "new",
    )


@query(
    """SELECT greatest((SELECT min(date) FROM ifs WHERE date >= DATE '2024-01-04'), (SELECT min(date) FROM xgs)) AS min_d,
    least((SELECT max(date) FROM ifs), (SELECT max(date) FROM xgs WHERE date <= DATE '2024-01-28')) AS max_d"""
)
def common_date_range(t):
    a = store.date_range(t.iforest, start="2024-01-04")
    return store.common_date_range(a, store.date_range(t.xgb, end="2024-01-28"))


@query(f"SELECT {PV} FROM pv WHERE date >= (SELECT max(date) FROM pv) - 3")
def date_slice(t):
    return store.date_slice(t.pageviews)


# ---------------------------------------------------------------- scalar functions


@query(
    """SELECT try_cast(t AS DATE) AS day, count(*) AS n FROM (SELECT CASE WHEN hour_time % 5 = 0 THEN 'soon'
    WHEN hour_time % 5 = 1 THEN '2024-02-30' ELSE CAST(date AS VARCHAR) END AS t FROM pva) GROUP BY 1"""
)
def normalize_date_(t):
    h = F.col("hour_time") % 5
    text = F.when(h == 0, "soon").when(h == 1, "2024-02-30").otherwise(F.col("date").cast("string"))
    rows = t.all_pageviews.select(text.alias("t"))
    return rows.groupBy(normalize_date("t").alias("day")).agg(F.count("*").alias("n"))


def _projection(name: str, sql: str, by: str, expression: Callable[[], F.Column]) -> None:
    """A scalar function over all events, counted per input and output value."""
    cols = [c.strip() for c in by.split(",")]

    def run(t):
        rows = t.all_pageviews.groupBy(*cols).agg(F.count("*").alias("n"))
        return _rounded(rows.withColumn("result", expression()))

    query(f"SELECT {by}, count(*) AS n, {sql} AS result FROM pva GROUP BY ALL", name)(run)


_projection(
    "canonical_resolution",
    o.CANONICAL,
    "screen_width, screen_height",
    lambda: canonical_resolution("screen_width", "screen_height"),
)
_projection("c_segment_rsplit", o.SEGMENT, "ip", lambda: c_segment_rsplit("ip"))
_projection("c_segment_regex", o.IPV4, "ip", lambda: c_segment_regex("ip"))
_projection("is_direct", o.DIRECT, "referrer", lambda: is_direct("referrer"))
_projection(
    "blank_to_unknown",
    f"coalesce(nullif(trim(browser), ''), '{L.UNKNOWN_TEXT}')",
    "browser",
    lambda: blank_to_unknown("browser"),
)
_projection(
    "first_day_flag",
    f"CASE WHEN lower(trim(is_first_day)) IN ('1', 'true', 't', 'yes') THEN '{L.FIRST_DAY}' ELSE '{L.NOT_FIRST_DAY}' END",
    "is_first_day",
    lambda: first_day_flag("is_first_day"),
)
_projection(
    "parse_bool",
    "coalesce(lower(trim(is_first_day)) IN ('1', 'true', 't', 'yes'), false)",
    "is_first_day",
    lambda: bool_flag("is_first_day"),
)
_projection(
    "to_number_or",
    "coalesce(try_cast(screen_width AS DOUBLE), 1.0)",
    "screen_width",
    lambda: to_number_or("screen_width", 1),
)
_projection(
    "hour_weight",
    "round(exp(-pow(hour_time - 3.0, 2) / 6.0) + exp(-pow(hour_time - 21.0, 2) / 4.0), 6)",
    "hour_time",
    lambda: hour_weight("hour_time", "night") + hour_weight("hour_time", "evening"),
)


@query(
    f"""SELECT fp, count(*) AS n FROM (SELECT {o.FINGERPRINT} AS fp FROM lab) GROUP BY 1"""
)
def soft_fingerprint_(t):
    fp = soft_fingerprint(
        ["os", "browser", "manufacturer", "province", "is_first_day", "is_login_id", "province_display", "browser_display"]
    )
    return _traffic(t).rows().groupBy(fp.alias("fp")).agg(F.count("*").alias("n"))


@query(
    """SELECT has_model_result AS text, count(*) AS n,
    coalesce(lower(trim(has_model_result)) IN ('1', 'true', 'yes'), false) AS flag FROM cohort_stored GROUP BY ALL"""
)
def parse_match_flag_(t):
    stored = t.cohort_stored
    return stored.groupBy(
        F.col("has_model_result").alias("text"), parse_match_flag(stored, "has_model_result").alias("flag")
    ).agg(F.count("*").alias("n"))


@query(f"SELECT {KEYS}, user_total_pv AS total_pv, CAST(0 AS DOUBLE) AS cluster_size, CAST(0 AS DOUBLE) AS final_time_risk FROM upv")
def select_features_(t):
    pv = features.user_total_pv(t.all_pageviews)
    return select_features(
        pv.withColumnRenamed("user_total_pv", "total_pv"), ["total_pv", "cluster_size"]
    )


# ---------------------------------------------------------------- baseline


@query(f"SELECT hour_time, {_r('ratio', digits=9)} FROM hour_ref")
def fit_hour_distribution(t):
    return _rounded(baseline.fit_hour_distribution(t.all_pageviews), 9)


@query(f"SELECT {_r('night_mass', 'evening_mass', digits=9)} FROM mass")
def fit_reference_mass(t):
    hours = baseline.fit_hour_distribution(t.all_pageviews)
    return _rounded(baseline.fit_reference_mass(hours), 9)


@query(f"SELECT {_r('c_mean', 'c_std')} FROM seg_stats")
def fit_c_segment(t):
    return _rounded(baseline.fit_c_segment(t.all_pageviews))


def _daily_resolutions(t) -> DataFrame:
    return resolution.daily_resolutions(resolution.main_resolution(t.all_pageviews))


@query("SELECT * FROM main_res")
def main_resolution(t):
    return resolution.main_resolution(t.all_pageviews)


@query("SELECT * FROM vocab")
def fit_resolution_vocab(t):
    return resolution.fit_resolution_vocab(_daily_resolutions(t))


@query("SELECT * FROM buckets")
def resolution_bucket(t):
    main = resolution.main_resolution(t.all_pageviews)
    return resolution.resolution_bucket(
        main, resolution.fit_resolution_vocab(resolution.daily_resolutions(main))
    )


@query("SELECT * FROM grid")
def daily_share_grid(t):
    daily = _daily_resolutions(t)
    return resolution.daily_share_grid(daily, resolution.fit_resolution_vocab(daily))


@query("SELECT * FROM floor")
def share_scale_floor(t):
    return resolution.share_scale_floor(_daily_resolutions(t))


CHECKS_OF_SHARES = """SELECT resolution_bucket AS resolution, round(mean, 9) AS daily_share_mean, round(md, 9) AS daily_share_median,
    round(sd, 9) AS daily_share_std, round(mad, 9) AS daily_share_mad, scale_source, round(scale, 9) AS daily_share_scale,
    baseline_days, total_user_days, days_present FROM base"""


@query(CHECKS_OF_SHARES)
def fit_share_baseline(t):
    return _rounded(resolution.fit_resolution(t.all_pageviews).summary(), 9)


# ---------------------------------------------------------------- features


def _base(t) -> baseline.Baseline:
    return baseline.fit_baseline(t.all_pageviews)


@query(f"SELECT * FROM upv")
def user_total_pv(t):
    return features.user_total_pv(t.all_pageviews)


@query("SELECT * FROM blk0")
def block_stats(t):
    return features.block_stats(t.all_pageviews)


@query("SELECT * FROM blk1")
def block_growth(t):
    return features.block_growth(features.block_stats(t.all_pageviews))


@query("SELECT * EXCLUDE (prev_pv, growth_rate) FROM blk2")
def block_ratios(t):
    return features.block_ratios(features.block_stats(t.all_pageviews))


@query(
    """SELECT e.date, e.distinct_id, e.url, e.hour_time, coalesce(is_suspicious_block, 0) AS is_suspicious_block FROM ev e
    LEFT JOIN blk b ON e.date = b.date AND e.url = b.url AND e.hour_time = b.hour_time"""
)
def suspicious_blocks(t):
    events = t.all_pageviews.select(*USER_DAY, "url", "hour_time", "referrer")
    return features.suspicious_events(events).drop("referrer")


@query("SELECT * FROM ip_users")
def exact_ip_users(t):
    return features.exact_ip_users(t.all_pageviews)


@query(f"SELECT date, ip_c_segment, cnt, {_r('c_zscore')} FROM seg_z")
def c_segment_zscore(t):
    return _rounded(features.c_segment_zscore(t.all_pageviews, _base(t)))


HOUR_COLUMNS = (
    "time_kl_dist",
    "user_night_density",
    "user_evening_density",
    "night_relative_risk",
    "evening_relative_risk",
)


@query(f"SELECT {KEYS}, {_r(*HOUR_COLUMNS[:3])} FROM hours")
def hour_profile(t):
    profile = features.hour_profile(t.all_pageviews, _base(t))
    return _rounded(profile.select(*USER_DAY, *HOUR_COLUMNS[:3]))


@query(f"SELECT {KEYS}, {_r(*HOUR_COLUMNS[3:])} FROM hours")
def relative_hour_risk(t):
    profile = features.hour_profile(t.all_pageviews, _base(t))
    return _rounded(profile.select(*USER_DAY, *HOUR_COLUMNS[3:]))


@query("SELECT * FROM clones")
def clone_clusters(t):
    return features.clone_clusters(t.all_pageviews)


ROLLUP = FEATURES[:11]


def _base_features(t) -> DataFrame:
    return features.base_features(t.all_pageviews, _base(t))


@query(f"SELECT {KEYS}, total_pv, max_exact_ip_uv, max_block_pv, {_r(*[c for c in ROLLUP if c not in ('total_pv', 'max_exact_ip_uv', 'max_block_pv')])}, cluster_size FROM feat0")
def user_day_features(t):
    return _rounded(_base_features(t).select(*USER_DAY, *ROLLUP, "cluster_size"))


@query(f"SELECT {KEYS}, {_r('time_risk', 'env_risk')}, round(risk0 + block_bonus + clone_bonus + night_bonus + evening_bonus, 6) AS final_time_risk FROM feat2")
def risk_scores(t):
    return _rounded(_base_features(t).select(*USER_DAY, "time_risk", "env_risk", "final_time_risk"))


def _rule(name: str, rule: Callable, bonus: str) -> None:
    def run(t):
        return _base_features(t).where(rule()).select(*USER_DAY)

    query(f"SELECT {KEYS} FROM feat2 WHERE {bonus} > 0", name)(run)


_rule("rule_block_attack", features.rule_block_attack, "block_bonus")
_rule("rule_clone_attack", features.rule_clone_attack, "clone_bonus")
_rule("rule_night_attack", features.rule_night_attack, "night_bonus")
_rule("rule_evening_stealth", features.rule_evening_stealth, "evening_bonus")


def _scored_shares(t, score) -> DataFrame:
    fitted = resolution.fit_resolution(t.all_pageviews).persist()
    return _rounded(score(fitted.grid().drop("valid_user_days"), fitted))


Z_COLUMNS = f"date, resolution_bucket, resolution_user_days, {_r('daily_share')}, round(z, 6) AS {RESOLUTION_Z}"


@query(f"SELECT {Z_COLUMNS} FROM zs")
def resolution_zscore(t):
    return _scored_shares(t, resolution.resolution_zscore)


@query(f"SELECT {Z_COLUMNS} FROM zs_loo")
def resolution_zscore_loo(t):
    return _scored_shares(t, resolution.resolution_zscore_loo)


@query(f"SELECT {KEYS}, round(z, 6) AS {RESOLUTION_Z} FROM z_users")
def attach_resolution_feature(t):
    events = t.all_pageviews
    users = events.select(*USER_DAY).distinct()
    out = resolution.attach_resolution_feature(users, events, resolution.fit_resolution(events).persist())
    return _rounded(out)


ALL_FEATURES = f"""SELECT f.date, f.distinct_id, total_pv, max_exact_ip_uv, max_block_pv, cluster_size,
    {_r(*[c for c in FEATURES if c not in ("total_pv", "max_exact_ip_uv", "max_block_pv", "cluster_size", "final_time_risk", RESOLUTION_Z)])},
    round(risk0 + block_bonus + clone_bonus + night_bonus + evening_bonus, 6) AS final_time_risk, round(u.z, 6) AS {RESOLUTION_Z}
    FROM feat2 f JOIN {{}} u ON f.date = u.date AND f.distinct_id = u.distinct_id"""


@query(ALL_FEATURES.format("z_users"))
def all_features(t):
    return _rounded(scoring.fit_features(t.all_pageviews)[2])


@query(ALL_FEATURES.format("z_users_loo"))
def training_features(t):
    return _rounded(scoring.fit_features(t.all_pageviews, leave_one_day_out=True, check=True)[2])


# ---------------------------------------------------------------- labels
LABEL_COLUMNS = (
    "iforest_anomaly, final_time_risk, xgb_model_anomaly, xgb_bot_prob_raw, is_manual_bot, iforest_bot, xgb_bot_prob, "
    "is_rule_bot, risk_group, action, is_model_block, is_auto_bot, final_label"
)
EVENT_LABELS = f"SELECT {PV}, {LABEL_COLUMNS}, province_display, browser_display, first_day_display"


@query("SELECT * FROM di")
def dedup_scores(t):
    return labeling.dedup_scores(t.iforest, "final_time_risk")


@query("SELECT * FROM scored")
def scored_events(t):
    return labeling.scored_events(
        t.pageviews, t.iforest, t.xgb
    )


@query(
    f"""SELECT DISTINCT {KEYS} FROM pv WHERE os = 'Android' AND browser = 'Chrome Webview'
    AND (manufacturer IS NULL OR manufacturer = '')"""
)
def manual_rule_users(t):
    return labeling.manual_rule_users(t.pageviews)


@query(
    f"""SELECT DISTINCT {KEYS}, coalesce(xgb_bot_prob_raw, CASE WHEN xgb_model_anomaly = -1 THEN 1.0 ELSE 0.0 END) AS xgb_bot_prob,
    final_time_risk >= 50 AS is_rule_bot FROM scored"""
)
def safe_probability(t):
    rows = labeling.user_day_scores(t.iforest, t.xgb)
    return rows.select(
        *USER_DAY,
        labeling.safe_probability().alias("xgb_bot_prob"),
        labeling.rule_bot(RULES_ON).alias("is_rule_bot"),
    )


def _user_day_query(name: str, columns: str, view: str, params: RiskParams) -> None:
    names = [c.strip() for c in columns.split(",")]

    def run(t):
        return _traffic(t, params).user_days.select(*USER_DAY, *names)

    query(f"SELECT DISTINCT {KEYS}, {columns} FROM {view}", name)(run)


_user_day_query("risk_group", "risk_group", "lab", RiskParams())
_user_day_query("risk_action", "risk_group, action", "lab", RiskParams())
_user_day_query("risk_action_block_b", "risk_group, action", "lab_rules", RULES_ON)
_user_day_query("block_flags", "is_model_block, is_auto_bot, final_label", "lab", RiskParams())
_user_day_query("block_flags_rules_on", "is_model_block, is_auto_bot, final_label", "lab_rules", RULES_ON)


@query(f"SELECT DISTINCT {KEYS}, {o.POOL} AS pool FROM lab")
def pool_bucket(t):
    return _traffic(t).user_days.select(*USER_DAY, labeling.pool_bucket().alias("pool"))


@query(f"{EVENT_LABELS} FROM lab")
def labeled_events(t):
    return _traffic(t).rows()


@query(f"{EVENT_LABELS} FROM lab_rules")
def labeled_events_rules_on(t):
    return _traffic(t, RULES_ON).rows()


@query(f"{EVENT_LABELS} FROM latest")
def latest_day(t):
    return _traffic(t).latest().rows()


# ---------------------------------------------------------------- reports


@query(
    f"""SELECT count(DISTINCT distinct_id) AS total_dau, count(DISTINCT CASE WHEN final_label THEN distinct_id END) AS direct_block_dau,
    count(DISTINCT CASE WHEN risk_group IN ('{L.GROUP_B}', '{L.GROUP_C}') AND NOT final_label THEN distinct_id END) AS audit_dau,
    count(DISTINCT CASE WHEN risk_group IN ('{L.GROUP_D}', '{L.GROUP_E}') AND NOT final_label THEN distinct_id END) AS observe_review_dau,
    count(DISTINCT CASE WHEN risk_group = '{L.GROUP_F}' AND NOT final_label THEN distinct_id END) AS pass_dau FROM latest"""
)
def headline_metrics(t):
    return reports.headline_metrics(_traffic(t))


@query(f"SELECT date, {o.POOL} AS user_type, count(DISTINCT distinct_id) AS dau FROM lab GROUP BY 1, 2")
def dau_trend(t):
    return reports.dau_trend(_traffic(t))


DAILY_RATES = f"""SELECT *, removed_dau / total_dau * 100 AS direct_block_rate, audit_dau / total_dau * 100 AS audit_pool_rate FROM ({DAILY} FROM {{}} GROUP BY 1)"""


@query(DAILY_RATES.format("lab"))
def daily_summary(t):
    return reports.daily_summary(_traffic(t))


@query(DAILY_RATES.format("lab_rules"))
def daily_summary_rules_on(t):
    return reports.daily_summary(_traffic(t, RULES_ON))


@query(
    """SELECT risk_group, action, count(*) AS user_days, count(DISTINCT distinct_id) AS users, round_even(avg(xgb_bot_prob), 9) AS avg_xgb_prob,
    round_even(quantile_cont(xgb_bot_prob, 0.5), 9) AS p50_xgb_prob, round_even(quantile_cont(xgb_bot_prob, 0.95), 9) AS p95_xgb_prob
    FROM (SELECT DISTINCT date, distinct_id, risk_group, action, xgb_bot_prob FROM lab) GROUP BY 1, 2"""
)
def risk_summary(t):
    # nine digits: at four, an average such as 0.43625 lands on either side with the order of its sum
    return reports.risk_summary(_traffic(t), digits=9)


@query(
    f"""SELECT {KEYS}, risk_group, action, iforest_bot, round(xgb_bot_prob, 4) AS xgb_bot_prob, final_time_risk, final_label
    FROM (SELECT * FROM lab WHERE risk_group = '{L.GROUP_B}'
    ORDER BY lab.xgb_bot_prob DESC NULLS LAST, final_time_risk DESC NULLS LAST, date, distinct_id LIMIT 200)"""
)
def risk_samples(t):
    return reports.risk_samples(_traffic(t), L.GROUP_B)


@query("SELECT * FROM prov15")
def province_before_after(t):
    return reports.province_before_after(_traffic(t))


@query(
    f"""SELECT province_display, '{L.STAGE_BEFORE}' AS stage, before_count AS user_count FROM prov15
    UNION ALL SELECT province_display, '{L.STAGE_AFTER}', after_count FROM prov15"""
)
def province_unpivot(t):
    return reports.province_unpivot(_traffic(t))


@query("SELECT *, removed_count / before_count * 100 AS removal_rate FROM prov15")
def province_removal_rate(t):
    return reports.province_removal_rate(_traffic(t))


@query(
    "SELECT province_display AS province, removed_count AS user_count FROM prov WHERE removed_count > 0 ORDER BY 2 DESC, 1 LIMIT 8"
)
def top_removed_provinces(t):
    return reports.top_removed_provinces(_traffic(t))


@query(
    """SELECT province_display AS province, before_count / (SELECT sum(before_count) FROM prov) * 100 AS percent_before,
    after_count / (SELECT sum(after_count) FROM prov) * 100 AS percent_after FROM prov ORDER BY percent_before DESC, province LIMIT 15"""
)
def province_share_shift(t):
    return reports.province_share_shift(_traffic(t))


def _waterfall(count: str, name: str) -> str:
    return f"""WITH c AS (SELECT province_display AS province, {count} AS n FROM prov WHERE {count} > 0),
    t AS (SELECT province, n, n * 100.0 / (SELECT sum(n) FROM c) AS share FROM c ORDER BY n DESC, province LIMIT 10)
    SELECT province, n AS {name}, round(share, 9) AS share FROM t UNION ALL
    SELECT '{L.REMAINDER}', CAST((SELECT sum(n) FROM c) - sum(n) AS BIGINT), round(100.0 - sum(share), 9) FROM t"""


def _nested(sql: str) -> str:
    """A statement with its own WITH becomes a subquery, so views can be put in front."""
    return f"SELECT * FROM ({sql}) w"


@query(_nested(_waterfall("after_count", "human_count")))
def kept_share_waterfall(t):
    return _rounded(reports.kept_share_waterfall(_traffic(t)), 9)


@query(_nested(_waterfall("removed_count", "bot_count")))
def blocked_share_waterfall(t):
    return _rounded(reports.blocked_share_waterfall(_traffic(t)), 9)


@query(f"SELECT hour_time, {o.BLOCKED} AS user_type, count(DISTINCT distinct_id) AS user_count FROM latest GROUP BY 1, 2")
def hourly_users(t):
    return reports.hourly_users(_traffic(t))


for _blocked in (True, False):
    _suffix, _flag = ("blocked", "true") if _blocked else ("kept", "false")

    def _browser(t, blocked=_blocked):
        return reports.browser_distribution(_traffic(t), blocked)

    def _first_day(t, blocked=_blocked):
        return reports.first_day_distribution(_traffic(t), blocked)

    def _titles(t, blocked=_blocked):
        return reports.title_url_uv_pv(_traffic(t), blocked, fx.HOME_TITLE)

    query(
        f"SELECT browser_display, count(DISTINCT distinct_id) AS user_count FROM latest WHERE final_label = {_flag} GROUP BY 1",
        f"browser_distribution_{_suffix}",
    )(_browser)
    query(
        f"SELECT first_day_display, count(DISTINCT distinct_id) AS user_count FROM latest WHERE final_label = {_flag} GROUP BY 1",
        f"first_day_distribution_{_suffix}",
    )(_first_day)
    query(
        f"""SELECT title, url, count(DISTINCT distinct_id) AS uv, count(url) AS pv FROM latest WHERE final_label = {_flag}
        AND title NOT LIKE '{fx.HOME_TITLE}' GROUP BY 1, 2 ORDER BY pv DESC, uv DESC, title, url LIMIT 20""",
        f"title_url_uv_pv_{_suffix}",
    )(_titles)

C_USERS = f"""SELECT b.distinct_id, b.user_type, max(c.n) AS c_segment_user_count FROM (
    SELECT distinct_id, {o.BLOCKED} AS user_type, {o.IPV4} AS ip_c FROM latest) b
    JOIN (SELECT {o.IPV4} AS ip_c, count(DISTINCT distinct_id) AS n FROM latest GROUP BY 1) c ON b.ip_c = c.ip_c GROUP BY 1, 2"""


@query(C_USERS)
def c_segment_users(t):
    return reports.c_segment_users(_traffic(t))


@query(
    f"""SELECT user_type, bin, bin_start, count(*) AS users FROM (SELECT user_type,
    CASE WHEN hi > lo THEN least(CAST(floor((c_segment_user_count - lo) / ((hi - lo) / 30.0)) AS BIGINT), 29) ELSE 0 END AS bin,
    lo + CASE WHEN hi > lo THEN least(CAST(floor((c_segment_user_count - lo) / ((hi - lo) / 30.0)) AS BIGINT), 29) ELSE 0 END * ((hi - lo) / 30.0) AS bin_start
    FROM (SELECT *, min(c_segment_user_count) OVER () AS lo, max(c_segment_user_count) OVER () AS hi FROM ({C_USERS}))) GROUP BY ALL"""
)
def c_segment_histogram(t):
    return reports.c_segment_histogram(_traffic(t))


@query("SELECT date, total_dau, kept_dau, removed_dau, audit_dau, tag_dau, dispute_dau FROM (" + DAILY + " FROM lab GROUP BY 1)")
def daily_detail(t):
    return reports.daily_detail(_traffic(t))


@query(f"{EVENT_LABELS} FROM lab WHERE final_label OR risk_group <> '{L.GROUP_F}'")
def risk_list_export(t):
    return reports.risk_list_export(_traffic(t))


# ---------------------------------------------------------------- cohort
STORED_COLUMNS = f"""try_cast(date AS DATE) AS date, distinct_id, try_cast(hour_time AS INT) AS hour_time, province_display,
    coalesce(nullif(trim(browser_display), ''), '{L.UNKNOWN_TEXT}') AS browser_display, '{L.UNKNOWN_TEXT}' AS os_display, manufacturer_display,
    coalesce(try_cast(seek_report_pv AS BIGINT), 1) AS seek_report_pv, CAST(NULL AS DOUBLE) AS iforest_anomaly, CAST(NULL AS DOUBLE) AS final_time_risk,
    CAST(NULL AS DOUBLE) AS xgb_model_anomaly, CAST(NULL AS DOUBLE) AS xgb_bot_prob_raw,
    coalesce(lower(trim(has_model_result)) IN ('1', 'true', 'yes'), false) AS has_model_result"""
RESULT_COLUMNS = "date, distinct_id, hour_time, province_display, browser_display, os_display, manufacturer_display, seek_report_pv, CAST(iforest_anomaly AS DOUBLE) AS iforest_anomaly, final_time_risk, CAST(xgb_model_anomaly AS DOUBLE) AS xgb_model_anomaly, xgb_bot_prob_raw, has_model_result"


@query(f"SELECT {STORED_COLUMNS} FROM cohort_stored WHERE try_cast(date AS DATE) IS NOT NULL")
def cohort_normalize(t):
    return cohort.cohort_normalize(t.cohort_stored, result=True)


def _cohort_result(t) -> DataFrame:
    return cohort.cohort_scores(t.cohort, t.iforest, t.xgb)


def _cohort_labeled(t: fx.Inputs, params: RiskParams = RiskParams()) -> DataFrame:
    return cohort.cohort_labels(_cohort_result(t), params)


def _cohort_days(t) -> DataFrame:
    return cohort.cohort_user_days(_cohort_labeled(t))


@query("SELECT * FROM cohort_result")
def cohort_scores(t):
    return _cohort_result(t)


@query("SELECT * FROM cohort_lab")
def cohort_labels(t):
    return _cohort_labeled(t)


@query("SELECT * FROM cohort_lab_rules")
def cohort_labels_rules_on(t):
    return _cohort_labeled(t, RULES_ON)


@query("SELECT * FROM cohort_days")
def cohort_user_days(t):
    return _cohort_days(t)


@query(
    """SELECT count(*) AS target_user_days, count(DISTINCT distinct_id) AS target_users, CAST(coalesce(sum(seek_report_pv), 0) AS BIGINT) AS target_pv,
    count(CASE WHEN has_model_result THEN 1 END) AS matched_user_days, count(CASE WHEN final_label THEN 1 END) AS direct_block_user_days,
    count(*) - count(CASE WHEN has_model_result THEN 1 END) AS unmatched_user_days FROM cohort_days"""
)
def cohort_metrics(t):
    return cohort.cohort_metrics(_cohort_days(t))


@query(
    f"""SELECT *, round_even(user_days / sum(user_days) OVER () * 100, 2) AS share_pct FROM (SELECT risk_group, action, count(*) AS user_days,
    count(DISTINCT distinct_id) AS users, CAST(sum(seek_report_pv) AS BIGINT) AS seek_report_pv, round(avg(xgb_bot_prob), 9) AS avg_xgb_prob,
    CASE risk_group WHEN '{L.GROUP_A}' THEN 1 WHEN '{L.GROUP_B}' THEN 2 WHEN '{L.GROUP_C}' THEN 3 WHEN '{L.GROUP_D}' THEN 4 WHEN '{L.GROUP_E}' THEN 5
    WHEN '{L.GROUP_F}' THEN 6 WHEN '{L.UNMATCHED}' THEN 98 ELSE 99 END AS risk_order FROM cohort_days GROUP BY 1, 2, 7)"""
)
def cohort_risk_summary(t):
    return cohort.cohort_risk_summary(_cohort_days(t), digits=9)


@query("SELECT date, risk_group, count(*) AS user_days FROM cohort_days GROUP BY 1, 2")
def cohort_daily_groups(t):
    return cohort.cohort_daily_groups(_cohort_days(t))


@query(
    """SELECT date, count(*) AS target_user_days, count(CASE WHEN final_label THEN 1 END) AS direct_block_user_days,
    round(count(CASE WHEN final_label THEN 1 END) * 100.0 / count(*), 2) AS direct_block_rate FROM cohort_days GROUP BY 1"""
)
def cohort_block_rate(t):
    return cohort.cohort_block_rate(_cohort_days(t))


@query(
    "SELECT hour_time, user_type, CAST(sum(seek_report_pv) AS BIGINT) AS event_count FROM cohort_lab WHERE hour_time BETWEEN 0 AND 23 GROUP BY 1, 2"
)
def cohort_hours(t):
    return cohort.cohort_hours(_cohort_labeled(t))


@query(
    """SELECT b.province_display, b.user_type, CAST(sum(b.seek_report_pv) AS BIGINT) AS event_count, max(p.total) AS total_events
    FROM cohort_lab b JOIN (SELECT province_display, CAST(sum(seek_report_pv) AS BIGINT) AS total FROM cohort_lab GROUP BY 1
    ORDER BY total DESC, province_display LIMIT 12) p ON b.province_display = p.province_display GROUP BY 1, 2"""
)
def cohort_top_provinces(t):
    return cohort.cohort_top_provinces(_cohort_labeled(t))


@query(
    f"""SELECT {KEYS}, hour_time, seek_report_pv, user_type, classification_bucket, risk_group, action, iforest_bot,
    round(xgb_bot_prob, 4) AS xgb_bot_prob, final_time_risk, province_display, browser_display, os_display, manufacturer_display FROM (
    SELECT * FROM cohort_lab ORDER BY date DESC, seek_report_pv DESC, coalesce(cohort_lab.xgb_bot_prob, 0) DESC, distinct_id, hour_time,
    province_display, browser_display, os_display, manufacturer_display LIMIT 300)"""
)
def cohort_detail(t):
    return cohort.cohort_detail(_cohort_labeled(t))


@query("SELECT * FROM cohort_lab")
def cohort_export(t):
    return cohort.cohort_export(_cohort_labeled(t))


@query(
    """SELECT c.date, coalesce(h.n, 0) AS row_count, h.n IS NOT NULL AS covered,
    h.n IS NOT NULL AND coalesce(f.built_at <= h.date + 1, true) AS current FROM (
    SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS date) c
    LEFT JOIN (SELECT date, count(*) AS n FROM cohort WHERE date < DATE '2024-01-20' GROUP BY 1) h ON c.date = h.date
    LEFT JOIN (SELECT date, min(built_at) + CAST(extract(day FROM date) AS INT) % 4 - 2 AS built_at FROM feature_manifest GROUP BY 1) f ON c.date = f.date"""
)
def cohort_cache_check(t):
    cached = t.cohort.where(F.col("date") < F.lit("2024-01-20").cast("date"))
    scored = t.feature_manifest.withColumn(
        "scored_at", F.date_add("built_at", F.dayofmonth("date") % 4 - 2)
    )
    return cohort_plan.cohort_cache_check(
        cached.withColumn("built_at", F.date_add("date", 1)), scored, "2024-01-01", "2024-02-02"
    )


@query(
    f"""SELECT * FROM (SELECT {STORED_COLUMNS} FROM cohort_stored) WHERE date IS NOT NULL AND date NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'
    UNION ALL SELECT {RESULT_COLUMNS} FROM cohort_result WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'"""
)
def cohort_refresh(t):
    fresh = store.date_range(_cohort_result(t), "2024-01-10", "2024-01-15")
    return cohort.cohort_refresh(t.cohort_stored, fresh, "2024-01-10", "2024-01-15")


@query(f"SELECT {RESULT_COLUMNS} FROM cohort_result WHERE date NOT BETWEEN DATE '2024-01-25' AND DATE '2024-01-26'")
def refresh_cohort_store(t):
    path = _scratch(t.spark, "cohort")
    scores = t.iforest, t.xgb
    visits = t.cohort
    cohort_plan.refresh_cohort_store(visits, *scores, path, fx.FIRST_DAY, fx.LAST_DAY)
    late = visits.where(F.col("date") > F.lit("2024-01-26").cast("date"))
    cohort_plan.refresh_cohort_store(late, *scores, path, "2024-01-25", "2024-01-28")
    return cohort.cohort_normalize(store.read_table(t.spark, path), result=True)


# ---------------------------------------------------------------- relation network


def _network(t) -> DataFrame:
    return network.network_base(_traffic(t))


def _fields(t) -> DataFrame:
    return network.network_fields(_network(t))


@query("SELECT * FROM net")
def network_base(t):
    return _network(t)


@query("SELECT * EXCLUDE (flag) FROM net_fields")
def network_fields(t):
    return _fields(t)


@query("SELECT * FROM net_daily")
def network_daily_totals(t):
    return network.network_daily_totals(_network(t))


@query("SELECT * FROM net_eligible")
def network_eligible(t):
    return network.network_eligible(_fields(t))


@query("SELECT * FROM net_heavy")
def heavy_clusters(t):
    return network.heavy_clusters(_fields(t))


@query("SELECT * FROM net_ratio")
def cluster_contamination(t):
    return network.cluster_contamination(_fields(t))


@query("SELECT * FROM net_caught")
def network_new_catch(t):
    return network.network_new_catch(_fields(t), 0.2)


@query("SELECT * FROM net_roi")
def network_roi(t):
    return network.network_roi(_network(t), 0.2)


@query("SELECT date, dau, blocked, eligible_dau, 0 AS new_catch, CAST(0 AS DOUBLE) AS impact_pct FROM net_roi")
def network_roi_off(t):
    return network.network_roi(_network(t))


@query("SELECT round(avg(impact_pct), 6) AS mean_impact_pct FROM net_roi")
def network_mean_impact(t):
    return _rounded(network.network_mean_impact(network.network_roi(_network(t), 0.2)))


# ---------------------------------------------------------------- red team


@query("SELECT * EXCLUDE (resolution_z_mean, resolution_z_p95), round(resolution_z_mean, 6) AS resolution_z_mean, round(resolution_z_p95, 6) AS resolution_z_p95 FROM counts")
def redteam_counts(t):
    return _rounded(_counts(t))


def _pools(t) -> tuple[DataFrame, DataFrame]:
    counts = _counts(t)
    attack = counts.where(F.col("pool") == "attack").drop("pool")
    normal = counts.where(F.col("pool") == "normal").drop("pool")
    return redteam.redteam_rates(attack), redteam.redteam_rates(normal, normal_pool=True)


@query("SELECT scenario, iforest_only, risk_pool_hits, " + _r("risk_pool_rate", "iforest_rate", "xgb_05_rate", "xgb_09_rate", "xgb_095_rate", "bypass_rate", digits=9) + " FROM attack")
def redteam_rates(t):
    attack, _ = _pools(t)
    names = ("risk_pool_rate", "iforest_rate", "xgb_05_rate", "xgb_09_rate", "xgb_095_rate", "bypass_rate")
    return _rounded(attack.select("scenario", "iforest_only", "risk_pool_hits", *names), 9)


@query(
    """SELECT a.scenario, a.user_days, round(a.risk_pool_rate, 9) AS risk_pool_rate, round(n.normal_pool_direct_hit_rate, 9) AS normal_pool_direct_hit_rate,
    round(n.normal_pool_xgb_added_hit_rate, 9) AS normal_pool_xgb_added_hit_rate, round(n.risk_pool_rate, 9) AS normal_risk_pool_rate
    FROM attack a JOIN normal n ON a.scenario = n.scenario"""
)
def redteam_summary(t):
    out = redteam.redteam_summary(*_pools(t))
    return _rounded(
        out.select(
            "scenario",
            "user_days",
            "risk_pool_rate",
            "normal_pool_direct_hit_rate",
            "normal_pool_xgb_added_hit_rate",
            "normal_risk_pool_rate",
        ),
        9,
    )


@query(
    """SELECT round(max(risk_pool_rate), 9) AS max_recall, round(min(risk_pool_rate), 9) AS min_recall, round(max(bypass_rate), 9) AS max_bypass,
    (SELECT round(avg(normal_pool_xgb_added_hit_rate), 9) FROM normal) AS mean_normal_added_hit_rate FROM attack"""
)
def redteam_extremes(t):
    return _rounded(redteam.redteam_extremes(*_pools(t)), 9)


# ---------------------------------------------------------------- models and pipelines


@query(
    """SELECT model_anomaly, count(*) AS n, CASE WHEN model_anomaly = -1 THEN -1 ELSE 1 END AS signed_anomaly,
    CASE WHEN coalesce(xgb_bot_prob, 0) >= 0.5 THEN -1 ELSE 1 END AS binary_anomaly FROM xgs GROUP BY ALL"""
)
def normalize_anomaly(t):
    rows = t.xgb.select(
        "model_anomaly",
        models.normalize_anomaly(F.col("model_anomaly"), "signed").alias("signed_anomaly"),
        models.normalize_anomaly(F.col("xgb_bot_prob"), "binary").alias("binary_anomaly"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(
    f"SELECT {KEYS}, least(greatest(coalesce(xgb_bot_prob, 0.0) * 1.5 - 0.2, 0.0), 1.0) AS p FROM xgs WHERE xgb_bot_prob IS NOT NULL UNION ALL SELECT {KEYS}, 0.0 FROM xgs WHERE xgb_bot_prob IS NULL"
)
def clip_probability(t):
    p = F.col("xgb_bot_prob") * F.lit(1.5) - F.lit(0.2)
    return t.xgb.select(*USER_DAY, models.clip_probability(p).alias("p"))


RULE = "CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END"
"""What the classifier learns here: an exact rule on one feature, so that SQL can say what it must answer."""


def _table(t) -> tuple[DataFrame, object, DataFrame]:
    """The stored feature table of all user-days, and the fits it comes from."""
    events = t.all_pageviews
    base, shares = _base(t), resolution.fit_resolution(events).persist()
    path = _scratch(t.spark, "features")
    store.write_partitions(features.user_day_features(events, base, shares), path)
    return store.read_table(t.spark, path), base, shares


def _training(t) -> tuple[DataFrame, scoring.Models]:
    """Features and both models, fitted on this table's own user-days."""
    stored, base, shares = _table(t)
    return stored, scoring.Models(base, shares, models.iforest_fit(stored), _trees(stored), "v1")


def _trees(stored: DataFrame) -> models.BoostedTrees:
    return models.gbt_fit(stored.withColumn("label", (F.col("total_pv") >= 2).cast("int")), "label")


def _bots(scored: DataFrame) -> DataFrame:
    bots = F.sum((F.col("model_anomaly") == -1).cast("long")).alias("bots")
    return scored.groupBy("date").agg(F.count("*").alias("user_days"), bots)


def _differing(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Per day: user-days, bots, and rows of ``a`` that ``b`` lacks or has other values for."""
    left = a.select(*USER_DAY, "model_anomaly", *[F.round(c, 9).alias(f"a_{c}") for c in columns])
    right = b.select(*USER_DAY, *[F.round(c, 9).alias(f"b_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    rows = left.join(right, list(USER_DAY), "left").withColumn("other", (~same).cast("long"))
    return _bots(rows).join(rows.groupBy("date").agg(F.sum("other").alias("differing")), "date")


_FAR = "CAST(substring(distinct_id, 2) AS BIGINT) % 97 = 5"


@query(f"SELECT date, concat('x', distinct_id) AS distinct_id FROM upv WHERE {_FAR}")
def iforest_fit(t):
    """Of a table with planted far user-days: which of those the fitted forest flags."""
    stored, *_ = _table(t)
    keys = stored.where(F.expr(_FAR))
    far = {c: F.lit(1e4) + F.pmod(F.xxhash64(*USER_DAY, F.lit(c)), F.lit(10_000)) for c in FEATURES}
    planted = keys.withColumns(far).withColumn("distinct_id", F.concat(F.lit("x"), "distinct_id"))
    whole = stored.select(*USER_DAY, *FEATURES).unionByName(planted.select(*USER_DAY, *FEATURES))
    flagged = models.iforest_score(whole, models.iforest_fit(whole)).where("model_anomaly = -1")
    return flagged.where(F.col("distinct_id").startswith("x")).select(*USER_DAY)


@query("SELECT bots, count(*) AS user_days FROM (SELECT count(*) >= 2 AS bots FROM pva GROUP BY date, distinct_id) GROUP BY 1")
def gbt_fit(t):
    """User-days by the class that the fitted trees give them."""
    stored, *_ = _table(t)
    scored = models.gbt_score(stored, _trees(stored))
    return scored.groupBy((F.col("model_anomaly") == -1).alias("bots")).agg(F.count("*").alias("user_days"))


_SMALL_FOREST = (
    (0, 0, 0, 2.5, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 0.9), (0, 2, -1, 0.0, 2, 2, 0.4),
    (1, 0, 1, 0.5, 1, 4, 0.0), (1, 1, 0, 1.5, 2, 3, 0.0), (1, 2, -1, 0.0, 2, 2, 1.25), (1, 3, -1, 0.0, 3, 3, 0.75),
    (1, 4, -1, 0.0, 4, 4, 0.3),
)


@query(
    """SELECT date, distinct_id, round(s, 9) AS anomaly_score, CASE WHEN s > 0.6 THEN -1 ELSE 1 END AS model_anomaly FROM (
    SELECT date, distinct_id, power(2.0, -(CASE WHEN total_pv <= 2.5 THEN 0.9 ELSE 0.4 END + CASE WHEN is_direct_ratio > 0.5 THEN 0.3
    WHEN total_pv <= 1.5 THEN 1.25 ELSE 0.75 END) / 2) AS s FROM rollup)"""
)
def iforest_score(t):
    """A forest of two small trees that SQL can walk, too."""
    stored, *_ = _table(t)
    names = ["tree", "node", "feature", "threshold", "left", "right", "path"]
    forest = models.IsolationForest(("total_pv", "is_direct_ratio"), pd.DataFrame(_SMALL_FOREST, columns=names), 0.6)
    return _rounded(models.iforest_score(stored, forest).select(*USER_DAY, "anomaly_score", "model_anomaly"), 9)


@query(f"SELECT {KEYS}, CASE WHEN count(*) >= 2 THEN -1 ELSE 1 END AS model_anomaly FROM pva GROUP BY ALL")
def gbt_score(t):
    stored, *_ = _table(t)
    return models.gbt_score(stored, _trees(stored)).select(*USER_DAY, "model_anomaly")


_RULED = f"SELECT date, distinct_id, {RULE} AS bot FROM {{}} GROUP BY ALL"
_COUNTED = f"SELECT date, count(*) AS user_days, CAST(sum(bot) AS BIGINT) AS bots, {{}} FROM ({_RULED.format('pva')}) GROUP BY 1"


@query(_COUNTED.format("count(*) AS scored_by_both"))
def score_features(t):
    stored, fitted = _training(t)
    both = models.score_features(stored, fitted.iforest).withColumnRenamed("model_anomaly", "forest")
    scored = models.score_features(both, fitted.gbt)
    counted = scored.where("forest IN (-1, 1) AND xgb_bot_prob BETWEEN 0 AND 1").groupBy("date")
    return _bots(scored).join(counted.agg(F.count("*").alias("scored_by_both")), "date")


@query(_COUNTED.format("0 AS differing"))
def build_scores(t):
    """Scores from the events against scores from the stored features."""
    stored, fitted = _training(t)
    iforest, gbt = scoring.build_scores(t.all_pageviews, fitted)
    again = models.score_features(models.score_features(stored, fitted.iforest), fitted.gbt)
    both = gbt.join(iforest.select(*USER_DAY, "anomaly_score"), list(USER_DAY))
    again = again.join(models.iforest_score(stored, fitted.iforest).select(*USER_DAY, "anomaly_score"), list(USER_DAY))
    return _differing(both, again, "anomaly_score", "xgb_bot_prob")


@query(_COUNTED.format("0 AS differing"))
def rescore_dates(t):
    """Scores with some days derived again against those of the full build."""
    stored, fitted = _training(t)
    iforest = models.score_features(stored, fitted.iforest)
    gbt = models.score_features(stored, fitted.gbt)
    again = scoring.rescore_dates(t.all_pageviews, iforest, gbt, REPLACED, fitted)[1]
    return _differing(again, gbt, "xgb_bot_prob")


def _store(t, fitted: scoring.Models | None = None) -> tuple[scoring.Models, scoring.Store]:
    return fitted or _training(t)[1], scoring.Store(_scratch(t.spark, "store"))


def _stored_days(t, tables: scoring.Store) -> DataFrame:
    """Per day: raw events, scored user-days and those the classifier calls bots."""
    raw = store.read_batches(t.spark, tables.raw).groupBy("date").agg(F.count("*").alias("n_events"))
    return raw.join(_bots(store.read_table(t.spark, tables.gbt)), "date", "full_outer")


def _stored_sql(table: str, where: str = "true") -> str:
    return (
        f"SELECT date, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS user_days, CAST(sum(bot) AS BIGINT) AS bots FROM (SELECT date, distinct_id, "
        f"count(*) AS n, {RULE} AS bot FROM {table} WHERE {where} GROUP BY 1, 2) GROUP BY 1"
    )


@query(_stored_sql("pva", "date <> DATE '2024-01-09' OR hour_time < 12"))
def backfill_day(t):
    fitted, tables = _store(t)
    events = t.all_pageviews
    store.append_batch(events, tables.raw, "load")
    scoring.build_store(t.spark, tables, fitted)
    day = events.where((F.col("date") == F.lit("2024-01-09").cast("date")) & (F.col("hour_time") < 12))
    scoring.backfill_day(t.spark, tables, day, "2024-01-09", fitted)
    store.append_batch(events, tables.raw, "load")  # a repeated load must not bring the replaced day back
    return _stored_days(t, tables)


@query(_stored_sql("pv"))
def stream_ingest_rescore(t):
    fitted, tables = _store(t)

    def prepare(files):
        rows = t.spark.sql(fx.PAGEVIEWS_RAW, events=files)
        return pageviews.scan_pageviews(rows, excluded_host=fx.EXCLUDED_HOST)

    # one half is loaded before, the other comes by the stream
    early = F.pmod(F.xxhash64("distinct_id", "hour_time"), F.lit(2)) == 0
    store.append_batch(t.pageviews.where(early), tables.raw, "load")
    run = ingest.stream_ingest_rescore(
        t.spark,
        t.sf_dir,
        t.events.schema,
        tables.raw,
        _scratch(t.spark, "stream-state"),
        lambda files: prepare(files).where(~early | early.isNull()),
        lambda days: scoring.rescore_store(t.spark, tables, days, fitted),
        glob="events.parquet",
        name="events",
    )
    run.awaitTermination()
    return _stored_days(t, tables)


@query(_stored_sql("pva", "date BETWEEN DATE '2024-01-06' AND DATE '2024-01-25'"))
def sync_window(t):
    """A store with gaps, days that expire and one day by an older model, brought up to date."""
    fitted, tables = _store(t)
    events = t.all_pageviews
    kept = F.col("date").between(F.lit("2024-01-02").cast("date"), F.lit("2024-01-22").cast("date"))
    gap = F.dayofmonth("date").isin(8, 9, 15)
    store.append_batch(events.where(kept & ~gap), tables.raw, "load")
    scoring.build_store(t.spark, tables, replace(fitted, version="v0"))
    days = scoring.sync_window(t.spark, tables, lambda a, b: store.date_range(events, a, b), "2024-01-26", fitted, 20)
    assert days[0] == ["2024-01-08", "2024-01-09", "2024-01-15", "2024-01-23", "2024-01-24", "2024-01-25"]
    assert scoring.sync_window(t.spark, tables, lambda a, b: events.limit(0), "2024-01-26", fitted, 20) == ([], [], [])
    return _stored_days(t, tables)


@query("SELECT date, count(*) AS n_events FROM pva WHERE date >= DATE '2024-01-11' GROUP BY 1")
def drop_expired(t):
    path = _scratch(t.spark, "expiring")
    store.append_batch(t.all_pageviews, path, "load")
    store.drop_expired(t.spark, path, "2024-01-21", 10)
    return store.read_batches(t.spark, path).groupBy("date").agg(F.count("*").alias("n_events"))


# ---------------------------------------------------------------- versions, partial aggregates, statistics of days


def _third(n: int):
    return F.pmod(F.coalesce(F.xxhash64("distinct_id", "hour_time", "url"), F.lit(0)), F.lit(3)) == n


def _in_three_batches(t, events: DataFrame) -> scoring.Store:
    tables = scoring.Store(_scratch(t.spark, "store"))
    for n in range(3):
        scoring.append_events(events.where(_third(n)), tables, "part", n)
    return tables


@query(ALL_FEATURES.format("z_users"))
def features_from_partials(t):
    """Features of all days from the merged partial aggregates of three batches; events are not read again."""
    tables = _in_three_batches(t, t.all_pageviews)
    fitted = scoring.Models(_base(t), resolution.fit_resolution(t.all_pageviews).persist(), None, None)
    return _rounded(scoring.day_features(t.spark, tables, store.stored_days(t.spark, tables.raw), fitted))


@query(_stored_sql("pva"))
def late_batch(t):
    """Two thirds are scored, then the last third comes for two days, which alone are scored again, and then for all others."""
    fitted, tables = _store(t)
    events = t.all_pageviews
    scoring.append_events(events.where(~_third(2)), tables, "load")
    scoring.build_store(t.spark, tables, fitted)
    late = F.dayofmonth("date").isin(4, 11)
    days = scoring.append_events(events.where(_third(2) & late), tables, "late")
    assert scoring.stale_store_dates(t.spark, tables, fitted) == days
    scoring.rescore_store(t.spark, tables, days, fitted)
    others = scoring.append_events(events.where(_third(2) & ~late), tables, "rest")
    scoring.rescore_store(t.spark, tables, others, fitted)
    assert scoring.stale_store_dates(t.spark, tables, fitted) == []
    return _stored_days(t, tables)


@query(
    """SELECT 'before' AS seen, date, count(*) AS n_events FROM pva GROUP BY ALL
    UNION ALL SELECT 'after', date, count(*) FROM pva WHERE date <> DATE '2024-01-09' OR hour_time < 12 GROUP BY ALL"""
)
def replaced_day_versions(t):
    """What a reader sees that began before a day was replaced, and one that began after it."""
    path = _scratch(t.spark, "versioned")
    store.append_batch(t.all_pageviews, path, "load")
    before = store.read_batches(t.spark, path)
    part = t.all_pageviews.where((F.col("date") == F.lit("2024-01-09").cast("date")) & (F.col("hour_time") < 12))
    store.replace_batches(part, path, ["2024-01-09"])
    both = before.select(F.lit("before").alias("seen"), "date").unionAll(store.read_batches(t.spark, path).select(F.lit("after"), "date"))
    return both.groupBy("seen", "date").agg(F.count("*").alias("n_events"))


@query("SELECT date, count(*) AS n_rows, true AS same_content FROM pva GROUP BY 1")
def content_digest(t):
    """Digests of days written at once against those of three batches in another order: the same, with the same rows."""
    from traffic_risk.sources import versions

    at_once = versions.content_digest(t.all_pageviews)
    tables = _in_three_batches(t, t.all_pageviews.orderBy(F.desc("distinct_id")))
    stored = versions.current(t.spark, tables.raw)
    rows = [(d, stored.digest(d), sum(e.rows for e in own.values())) for d, own in stored.days.items()]
    kept = t.spark.createDataFrame(rows, "day string, kept string, n bigint")
    same = (F.col("digest") == F.col("kept")) & (F.col("rows") == F.col("n"))
    return at_once.join(kept, F.col("date") == F.col("day").cast("date"), "full_outer").select("date", F.col("rows").alias("n_rows"), same.alias("same_content"))


@query("SELECT DISTINCT date FROM pva WHERE day(date) IN (5, 6)")
def stale_by_content(t):
    """Days to score again after one batch came twice, one day was fetched again unchanged, one lost rows and one got some."""
    tables = _in_three_batches(t, t.all_pageviews)
    fitted = scoring.Models(_base(t), None, _AlwaysNormal(), _AlwaysNormal(), "v1")
    scoring.build_store(t.spark, tables, fitted)
    scoring.append_events(t.all_pageviews.where(_third(1)), tables, "part", 1)
    on = lambda n: t.all_pageviews.where(F.dayofmonth("date") == n)
    for day, rows in (("2024-01-04", on(4)), ("2024-01-05", on(5).where("hour_time < 20"))):
        store.replace_batches(rows, tables.raw, [day], partials.stored)
    scoring.append_events(on(6).where(_third(0)), tables, "more")
    days = scoring.stale_store_dates(t.spark, tables, fitted)
    return t.spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date").alias("date"))


class _AlwaysNormal:
    """A model that finds nothing, where only the days of the scores matter."""

    features = FEATURES

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"model_anomaly": F.lit(1), "xgb_bot_prob": F.lit(0.0)})


def _window(t):
    """Fits over the whole month from the stored statistics of its days, made in two steps."""
    tables = scoring.Store(_scratch(t.spark, "store"))
    early = F.col("date") < F.lit("2024-01-17").cast("date")
    scoring.append_events(t.all_pageviews.where(early), tables, "load")
    rolling.refresh_statistics(t.spark, tables)
    scoring.append_events(t.all_pageviews.where(~early), tables, "rest")
    return rolling.fit_window(t.spark, tables, "2024-01-31", 30)


@query(f"SELECT h.hour_time, {_r('ratio', digits=9)}, {_r('night_mass', 'evening_mass', digits=9)}, {_r('c_mean', 'c_std', digits=9)} FROM hour_ref h, mass, seg_stats WHERE h.hour_time BETWEEN 0 AND 23")
def rolling_baseline(t):
    base, _ = _window(t)
    rows = [(h, r, base.night_mass, base.evening_mass, base.c_mean, base.c_std) for h, r in base.hours.items()]
    names = "hour_time int, ratio double, night_mass double, evening_mass double, c_mean double, c_std double"
    return _rounded(t.spark.createDataFrame(rows, names), 9)


@query(CHECKS_OF_SHARES)
def rolling_shares(t):
    return _rounded(_window(t)[1].summary(), 9)


# ---------------------------------------------------------------- buckets, membership filter, sketches of days


@query(f"{EVENT_LABELS} FROM lab")
def labeled_events_bucketed(t):
    """Labelled events of tables that are stored in buckets by user-day: nothing is shuffled."""
    path = _scratch(t.spark, "buckets")
    events, iforest, gbt = (bucketed.write_bucketed(df, f"{path}/{name}", 8) for name, df in (("events", t.pageviews), ("iforest", t.iforest), ("gbt", t.xgb)))
    return labeling.label_traffic(events, iforest, gbt).rows(salts=0)


@query("SELECT * FROM cohort_result")
def cohort_scores_prefiltered(t):
    """The cohort's scores, with a bitmap of its user-days read at the scan of the score tables."""
    return cohort.cohort_scores(t.cohort, t.iforest, t.xgb, prefilter=True)


RANGES = {"first_week": ("2024-01-01", "2024-01-07"), "middle": ("2024-01-10", "2024-01-21"), "all": (None, None)}
_RANGES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS span, * FROM {{table}}" + (f" WHERE date BETWEEN DATE '{a}' AND DATE '{b}'" if a else "") for name, (a, b) in RANGES.items()
)


def _of_ranges(make: Callable) -> DataFrame:
    parts = [make(a, b).withColumn("span", F.lit(name)) for name, (a, b) in RANGES.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT span, url, count(DISTINCT distinct_id) AS users, true AS within_error FROM ({_RANGES_SQL.format(table='pv')}) WHERE url IS NOT NULL GROUP BY 1, 2")
def range_users(t):
    """Distinct users per url over ranges of days, from sketches of days, beside the exact numbers."""
    days = sketches.distinct_sketches(t.pageviews.where("url IS NOT NULL"), ["url"]).persist()
    exact = _of_ranges(lambda a, b: store.date_range(t.pageviews, a, b).groupBy("url").agg(F.count_distinct("distinct_id").alias("users")))
    told = _of_ranges(lambda a, b: sketches.range_distinct(days, ["url"], a, b))
    within = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(2.0), F.col("users") * 2 * sketches.distinct_error())
    return exact.join(told, ["span", "url"], "full_outer").where("url IS NOT NULL").select("span", "url", "users", within.alias("within_error"))


@query(f"SELECT span, count(xgb_bot_prob) AS n, true AS p50_within, true AS p95_within FROM ({_RANGES_SQL.format(table='(SELECT date, xgb_bot_prob FROM xgs)')}) GROUP BY 1")
def range_quantiles(t):
    """Median and 95 % point of probabilities over ranges of days, from sketches of days: their exact ranks are near the wanted ones."""
    probs = {"p50": 0.50, "p95": 0.95}
    days = sketches.quantile_sketches(t.xgb, [], "xgb_bot_prob").persist()

    def ranked(a, b) -> DataFrame:
        told = sketches.range_quantiles(days, [], probs, a, b).first()  # two numbers
        values = store.date_range(t.xgb, a, b).where("xgb_bot_prob IS NOT NULL").select(F.col("xgb_bot_prob").cast("double").alias("v"))
        n = F.count("*")
        near = []
        for name, p in probs.items():
            below, upto = F.sum((F.col("v") < told[name]).cast("int")) / n, F.sum((F.col("v") <= told[name]).cast("int")) / n
            near.append(((below <= p + 2 * sketches.rank_error()) & (upto >= p - 2 * sketches.rank_error())).alias(f"{name}_within"))
        return values.agg(n.alias("n"), *near)

    return _of_ranges(ranked)
