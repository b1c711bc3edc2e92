"""Guilt by association over (C segment, soft fingerprint) clusters.

Members are made distinct per (day, cluster, user) once; cluster sizes, contamination and eligible
users are sums over those rows, so a cluster of any size is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.columns import FINGERPRINT, USER_DAY
from traffic_risk.functions import (
    attach,
    blank_to_unknown,
    bool_flag,
    c_segment_regex,
    soft_fingerprint,
)
from traffic_risk.operators.labeling import LabeledTraffic
from traffic_risk.params import CONTAMINATION_OFF

CLUSTER = ("date", "ip_c_segment", "soft_fp")
MIN_USERS = 5
OPTIONAL = ("ip_c_segment", "soft_fp", "ip") + FINGERPRINT


def network_base(traffic: LabeledTraffic) -> DataFrame:
    """Distinct (day, user, flag) with whichever optional dimensions the events have."""
    display = {"province_display": "province", "browser_display": "browser"}
    dims = {}
    for name in OPTIONAL:
        if name in traffic.events.columns:
            dims[name] = F.col(name)
        elif name in display and display[name] in traffic.events.columns:
            dims[name] = blank_to_unknown(display[name])
    # users_by is distinct already, and the flag is the user-day's
    return traffic.users_by(**dims).select(*USER_DAY, F.col("final_label").alias("is_bot"), *dims)


def _stripped(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _derive_if_blank(base: DataFrame, name: str, derived: Column | None, why: str) -> Column:
    """Column ``name``, or ``derived`` where the table lacks it or has it blank throughout."""
    if name not in base.columns:
        if derived is None:
            raise ValueError(why)
        return derived
    if derived is None:
        return _stripped(name)
    filled = base.agg(F.coalesce(F.max(_stripped(name) != ""), F.lit(False))).scalar()
    return F.when(filled, _stripped(name)).otherwise(derived)


def _with_keys(base: DataFrame) -> tuple[DataFrame, Column]:
    """The table with C segment and fingerprint, and the condition that both can be used."""
    missing = [c for c in (*USER_DAY, "is_bot") if c not in base.columns]
    if missing:
        raise ValueError(f"network estimate needs columns {missing}")
    dims = [c for c in FINGERPRINT if c in base.columns]
    segment = c_segment_regex(_stripped("ip")) if "ip" in base.columns else None
    fingerprint = soft_fingerprint(dims) if dims else None
    keys = {
        "ip_c_segment": _derive_if_blank(base, "ip_c_segment", segment, "neither ip_c_segment nor ip"),
        "soft_fp": _derive_if_blank(base, "soft_fp", fingerprint, "neither soft_fp nor device columns"),
    }
    usable = (
        F.col("date").isNotNull() & F.col("distinct_id").isNotNull() & (F.col("ip_c_segment") != "")
    )
    if "soft_fp" in base.columns:  # a derived fingerprint is never blank
        usable = usable & (F.col("soft_fp") != "")
    return base.withColumns(keys), usable


def has_network_columns(base: DataFrame) -> bool:
    """Whether segment and fingerprint can be found or derived."""
    have = set(base.columns)
    return bool(have & {"ip", "ip_c_segment"}) and bool(have & {"soft_fp", *FINGERPRINT})


def network_fields(base: DataFrame) -> DataFrame:
    """Rows with a usable C segment and fingerprint; both are derived where needed.

    Raises when a needed column can be neither found nor derived.
    """
    rows, usable = _with_keys(base)
    return rows.where(usable)


def network_daily_totals(base: DataFrame) -> DataFrame:
    """Users and blocked users per day; a user-day is blocked if any of its rows is."""
    return (
        base.where(F.col("date").isNotNull() & F.col("distinct_id").isNotNull())
        .groupBy(*USER_DAY)
        .agg(F.max(bool_flag("is_bot").cast("int")).alias("bot"))
        .groupBy("date")
        .agg(F.count("*").alias("dau"), F.sum("bot").alias("blocked"))
    )


def network_eligible(fields: DataFrame) -> DataFrame:
    """Users per day with usable keys."""
    return (
        fields.select(*USER_DAY)
        .distinct()
        .groupBy("date")
        .agg(F.count("*").alias("eligible_dau"))
    )


def cluster_members(fields: DataFrame) -> DataFrame:
    """One row per (cluster, user): seen blocked, seen unblocked."""
    flag = bool_flag("is_bot").cast("int")
    return fields.groupBy(*CLUSTER, "distinct_id").agg(
        F.max(flag).alias("bot"), F.max(1 - flag).alias("clean")
    )


def heavy_clusters(fields: DataFrame, min_users: int = MIN_USERS) -> DataFrame:
    return (
        cluster_members(fields)
        .groupBy(*CLUSTER)
        .agg(
            F.count("*").alias("users"),
            F.sum("bot").alias("bot_users"),
            F.sum("clean").alias("clean_users"),
        )
        .where(F.col("users") >= min_users)
    )


def cluster_contamination(fields: DataFrame, min_users: int = MIN_USERS) -> DataFrame:
    """Blocked share of each heavy cluster. A user seen with both flags counts on both sides."""
    return (
        heavy_clusters(fields, min_users)
        .withColumn("total", F.col("bot_users") + F.col("clean_users"))
        .withColumn("ratio", F.col("bot_users") / F.col("total"))
    )


def network_new_catch(
    fields: DataFrame,
    ratio: float = CONTAMINATION_OFF,
    min_users: int = MIN_USERS,
    salts: int | None = None,
) -> DataFrame:
    """Unblocked users of contaminated clusters, once per day."""
    dirty = cluster_contamination(fields, min_users).where(F.col("ratio") >= F.lit(float(ratio)))
    clean = cluster_members(fields).where(F.col("clean") == 1).select(*CLUSTER, "distinct_id")
    return (
        attach(
            clean,
            dirty.select(*CLUSTER, "clean_users"),
            CLUSTER,
            ["distinct_id"],
            salts,
            "inner",
        )
        .select(*USER_DAY)
        .distinct()
    )


def network_roi(base: DataFrame, ratio: float = CONTAMINATION_OFF, salts: int | None = None) -> DataFrame:
    """Per day: users, blocked, eligible, newly caught and their share of all users in percent.

    Without the columns for segments or fingerprints no user is eligible and none is caught.
    """
    zero = F.lit(0).cast("long")
    if not has_network_columns(base):
        nothing = {"eligible_dau": zero, "new_catch": zero, "impact_pct": F.lit(0.0)}
        return network_daily_totals(base).withColumns(nothing)
    rows, usable = _with_keys(base)
    daily = (  # totals and eligible users in one pass
        rows.where(F.col("date").isNotNull() & F.col("distinct_id").isNotNull())
        .groupBy(*USER_DAY)
        .agg(
            F.max(bool_flag("is_bot").cast("int")).alias("bot"),
            F.max(F.coalesce(usable, F.lit(False)).cast("int")).alias("eligible"),
        )
        .groupBy("date")
        .agg(
            F.count("*").alias("dau"),
            F.sum("bot").alias("blocked"),
            F.sum("eligible").alias("eligible_dau"),
        )
    )
    caught = (
        network_new_catch(rows.where(usable), ratio, salts=salts)
        .groupBy("date")
        .agg(F.count("*").alias("new_catch"))
    )
    return (
        daily.join(caught, "date", "left")
        .withColumn("new_catch", F.coalesce("new_catch", zero))
        .withColumn("impact_pct", F.bround(F.col("new_catch") / F.col("dau") * F.lit(100.0), 2))
    )


def network_mean_impact(roi: DataFrame) -> DataFrame:
    return roi.agg(F.avg("impact_pct").alias("mean_impact_pct"))
