"""Input tables of the checks, as views over the driver's ``events`` table.

Plain SQL that Spark and DuckDB both read, so each query and its check start from the same
rows. See FIXTURES.md for what the tables contain.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from traffic_risk.sources.pageviews import scan_cohort_events, scan_pageviews

EXCLUDED_HOST = "eu.example.com"
HOME_TITLE = "Home"
TARGET_PATH = "/target-page"
TARGET_TITLE = "Target page"
FIRST_DAY = "2024-01-01"
LAST_DAY = "2024-01-30"

PAGEVIEWS_RAW = """
SELECT CAST(ts AS DATE) AS date,
 CASE WHEN event_type IN ('error','signup') THEN concat('b', CAST(event_id AS STRING)) ELSE concat('u', CAST(user_id AS STRING)) END AS distinct_id,
 CASE WHEN event_type='error' THEN 3 WHEN event_type='signup' THEN 21 ELSE CAST(extract(hour FROM ts) AS INT) END AS hour_time,
 CASE WHEN event_type='purchase' AND event_id % 10 = 0 THEN 'AppStart' ELSE 'pageview' END AS event,
 CASE WHEN event_id % 31 = 0 THEN 'Android' ELSE 'js' END AS lib,
 CASE WHEN event_id % 53 = 0 THEN 'somebot' END AS bot_name,
 CASE WHEN event_id % 37 = 0 THEN '9.1' END AS app_version,
 CASE WHEN event_type='error' THEN concat('https://www.example.com/p/', CAST(event_id % 2 AS STRING))
      WHEN event_type='signup' THEN 'https://www.example.com/target-page'
      WHEN event_id % 97 = 0 THEN NULL
      WHEN event_id % 41 = 0 THEN 'https://eu.example.com/p/1'
      ELSE concat('https://www.example.com/p/', CAST(event_id % 23 AS STRING)) END AS url,
 CASE WHEN event_type='signup' THEN '/target-page' ELSE '/p' END AS url_path,
 CASE WHEN event_type='signup' THEN 'Target page' WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'Home' ELSE concat('t', CAST(event_id % 23 AS STRING)) END AS title,
 CASE WHEN event_type IN ('error','signup') THEN NULL WHEN event_id % 3 = 0 THEN '' ELSE 'https://ref.example.org/' END AS referrer,
 CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 'fe80::1'
      WHEN event_type='error' THEN concat('203.0.', CAST(event_id % 3 AS STRING), '.', CAST(event_id % 200 AS STRING))
      WHEN event_type='signup' THEN concat('198.51.', CAST(event_id % 3 AS STRING), '.', CAST(event_id % 40 AS STRING))
      ELSE concat('10.', CAST(user_id % 5 AS STRING), '.', CAST(user_id % 7 AS STRING), '.', CAST(user_id % 251 AS STRING)) END AS ip,
 CASE WHEN event_type='error' THEN 'Android' WHEN event_type='signup' THEN 'iOS' WHEN user_id % 2 = 0 THEN 'iOS' ELSE 'Windows' END AS os,
 CASE WHEN event_type='error' THEN 'Chrome Webview' WHEN event_type='signup' THEN 'Safari' WHEN user_id % 4 = 0 THEN ' ' ELSE 'Chrome' END AS browser,
 CASE WHEN event_type='error' AND event_id % 4 = 0 THEN NULL WHEN event_type='error' AND event_id % 4 = 1 THEN '' ELSE 'Acme' END AS manufacturer,
 CASE WHEN event_type IN ('error','signup') THEN concat('prov', CAST(event_id % 2 AS STRING)) WHEN user_id % 13 = 0 THEN NULL ELSE concat('prov', CAST(user_id % 17 AS STRING)) END AS province,
 CASE WHEN event_type='error' THEN '1' WHEN event_type='signup' THEN 'TRUE' WHEN user_id % 3 = 0 THEN 'yes' ELSE '0' END AS is_first_day,
 CASE WHEN event_type='purchase' THEN 'true' ELSE 'false' END AS is_login_id,
 CASE WHEN event_id % 50 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN '40' WHEN event_id % 151 = 0 THEN CAST(500 + event_id % 40 AS STRING) ELSE CAST(360 + 12 * (user_id % 3) AS STRING) END AS screen_width,
 CASE WHEN event_id % 60 = 0 THEN NULL ELSE CAST(800 - 20 * (user_id % 3) AS STRING) END AS screen_height
FROM {events}
"""

USER_DAYS = """
SELECT DISTINCT date, distinct_id, CAST(substring(distinct_id, 2) AS BIGINT) AS k, CAST(extract(day FROM date) AS INT) AS dd FROM {pageviews}
"""

IFOREST_SCORES = """
SELECT date, distinct_id, CASE WHEN (k+dd) % 29 = 1 THEN NULL WHEN (k+dd) % 5 = 0 THEN -1 ELSE 1 END AS model_anomaly,
 CASE WHEN k % 71 = 0 THEN NULL ELSE CAST((k*13+dd) % 97 AS DOUBLE) END AS final_time_risk FROM {user_days} t
 UNION ALL SELECT date, distinct_id, 1, CAST(-1 AS DOUBLE) FROM {user_days} t WHERE k % 19 = 0
"""

XGB_SCORES = """
SELECT date, distinct_id, CASE WHEN (k*37+dd*11) % 101 >= 50 THEN -1 ELSE 1 END AS model_anomaly,
 CASE WHEN (k*7+dd) % 31 = 0 THEN NULL ELSE CAST((k*37+dd*11) % 101 AS DOUBLE)/100 END AS xgb_bot_prob FROM {user_days} t WHERE k % 43 <> 0
"""

# a scored pool for the red-team evaluation: four scenarios, each with attack and normal user-days
REDTEAM_POOL = """
SELECT date, distinct_id, concat('scenario ', CAST(k % 4 AS STRING)) AS scenario,
 CASE WHEN k % 3 = 0 THEN 'normal' ELSE 'attack' END AS pool,
 CASE WHEN (k+dd) % 29 = 1 THEN NULL WHEN (k+dd) % 5 = 0 THEN -1 ELSE 1 END AS iforest_anomaly,
 CASE WHEN (k*37+dd*11) % 101 >= 50 THEN -1 ELSE 1 END AS xgb_model_anomaly,
 CASE WHEN (k*7+dd) % 31 = 0 THEN NULL ELSE CAST((k*37+dd*11) % 101 AS DOUBLE)/100 END AS xgb_bot_prob_raw,
 CAST((k*17+dd*3) % 83 AS DOUBLE)/8 AS resolution_share_positive_zscore
FROM {user_days} t
"""

# a stored cohort table in need of repair: bad days, text numbers, a missing column, mixed flags
COHORT_STORED = """
SELECT CASE WHEN hour_time = 0 AND seek_report_pv > 0 THEN 'no day' ELSE CAST(date AS STRING) END AS date,
 distinct_id, CAST(hour_time AS STRING) AS hour_time, province_display,
 CASE WHEN CAST(substring(distinct_id, 2) AS BIGINT) % 3 = 0 THEN '  ' ELSE browser_display END AS browser_display,
 manufacturer_display,
 CASE WHEN CAST(substring(distinct_id, 2) AS BIGINT) % 5 = 0 THEN 'many' WHEN CAST(substring(distinct_id, 2) AS BIGINT) % 7 = 0 THEN NULL ELSE CAST(seek_report_pv AS STRING) END AS seek_report_pv,
 CASE WHEN CAST(substring(distinct_id, 2) AS BIGINT) % 4 = 0 THEN 'TRUE' WHEN CAST(substring(distinct_id, 2) AS BIGINT) % 4 = 1 THEN 't' WHEN CAST(substring(distinct_id, 2) AS BIGINT) % 4 = 2 THEN ' yes ' END AS has_model_result
FROM {cohort}
"""

# load and build times per day, as a table of files would have them
RAW_MANIFEST = """
SELECT date, max(date + CAST(CAST(extract(day FROM date) AS INT) % 5 AS INT)) AS loaded_at FROM {pageviews} GROUP BY date
"""
FEATURE_MANIFEST = """
SELECT date, max(date + 2) AS built_at, max(CASE WHEN CAST(extract(day FROM date) AS INT) % 4 = 0 THEN 'old' ELSE 'new' END) AS model_version
FROM {pageviews} WHERE CAST(extract(day FROM date) AS INT) % 6 <> 0 GROUP BY date
"""


class Inputs:
    """The input tables of one query, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return self._sql(PAGEVIEWS_RAW, events=self.events)

    @cached_property
    def pageviews(self) -> DataFrame:
        return scan_pageviews(self.raw, excluded_host=EXCLUDED_HOST)

    @cached_property
    def all_pageviews(self) -> DataFrame:
        """Without the host filter, so that events without a url stay in."""
        return scan_pageviews(self.raw)

    @cached_property
    def user_days(self) -> DataFrame:
        return self._sql(USER_DAYS, pageviews=self.pageviews)

    @cached_property
    def iforest(self) -> DataFrame:
        return self._sql(IFOREST_SCORES, user_days=self.user_days)

    @cached_property
    def xgb(self) -> DataFrame:
        return self._sql(XGB_SCORES, user_days=self.user_days)

    @cached_property
    def cohort(self) -> DataFrame:
        return scan_cohort_events(self.raw, FIRST_DAY, LAST_DAY, TARGET_PATH, TARGET_TITLE)

    @cached_property
    def cohort_stored(self) -> DataFrame:
        return self._sql(COHORT_STORED, cohort=self.cohort)

    @cached_property
    def redteam_pool(self) -> DataFrame:
        return self._sql(REDTEAM_POOL, user_days=self.user_days)

    @cached_property
    def raw_manifest(self) -> DataFrame:
        return self._sql(RAW_MANIFEST, pageviews=self.pageviews)

    @cached_property
    def feature_manifest(self) -> DataFrame:
        return self._sql(FEATURE_MANIFEST, pageviews=self.pageviews)
