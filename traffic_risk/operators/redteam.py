"""Evaluation of attack scenarios against a pool of normal user-days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.columns import RESOLUTION_Z
from traffic_risk.functions import exact_quantiles
from traffic_risk.operators.labeling import safe_probability
from traffic_risk.params import RiskParams

MAX_Z = 10.0


def redteam_counts(
    scored: DataFrame, by: tuple[str, ...] = ("scenario", "pool"), params: RiskParams = RiskParams()
) -> DataFrame:
    """Hits per scenario and pool from scored user-days.

    ``scored`` has ``iforest_anomaly``, ``xgb_model_anomaly``, ``xgb_bot_prob_raw`` and the
    resolution z-score. The groups are scenarios: a small, fixed set.
    """
    rows = scored.withColumn("p", safe_probability()).withColumn(
        "odd", F.coalesce(F.col("iforest_anomaly") == -1, F.lit(False))
    )
    p, odd = F.col("p"), F.col("odd")

    def hits(rule: Column) -> Column:
        return F.count(F.when(rule, 1))

    counts = rows.groupBy(*by).agg(
        F.count("*").alias("user_days"),
        hits(odd).alias("iforest_black"),
        hits(p >= params.edge).alias("xgb_05_black"),
        hits(p >= params.mid).alias("xgb_09_black"),
        hits(p >= params.high).alias("xgb_095_black"),
        hits(odd & (p >= params.edge)).alias("both_black"),
        hits(~odd & (p >= params.high)).alias("xgb_high_new"),
        hits(~odd & (p >= params.mid) & (p < params.high)).alias("xgb_mid_new"),
        hits(~odd & (p >= params.edge) & (p < params.mid)).alias("xgb_edge"),
        F.avg(RESOLUTION_Z).alias("resolution_z_mean"),
    )
    p95 = exact_quantiles(rows, by, RESOLUTION_Z, {"resolution_z_p95": 0.95}, 0.0, MAX_Z)
    return counts.join(p95, list(by), "left")


def redteam_rates(counts: DataFrame, normal_pool: bool = False) -> DataFrame:
    """Risk-pool, model and bypass rates; for the normal pool its hit rates instead of the bypass."""
    out = counts
    for c in ("resolution_z_mean", "resolution_z_p95"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    zero = F.lit(0).cast("long")

    def per_day(c: str) -> Column:
        return F.col(c) / F.col("user_days")

    out = (
        out.withColumn("iforest_only", F.greatest(F.col("iforest_black") - F.col("both_black"), zero))
        .withColumn(
            "risk_pool_hits",
            F.col("both_black")
            + F.col("xgb_high_new")
            + F.col("xgb_mid_new")
            + F.col("xgb_edge")
            + F.col("iforest_only"),
        )
        .withColumn("risk_pool_rate", per_day("risk_pool_hits"))
        .withColumn("iforest_rate", per_day("iforest_black"))
        .withColumn("xgb_05_rate", per_day("xgb_05_black"))
        .withColumn("xgb_09_rate", per_day("xgb_09_black"))
        .withColumn("xgb_095_rate", per_day("xgb_095_black"))
    )
    if not normal_pool:
        return out.withColumn("bypass_rate", F.lit(1.0) - F.col("risk_pool_rate"))
    added = F.col("xgb_high_new") + F.col("xgb_mid_new") + F.col("xgb_edge")
    return out.withColumn("normal_pool_direct_hit_rate", per_day("both_black")).withColumn(
        "normal_pool_xgb_added_hit_rate", added / F.col("user_days")
    )


def redteam_summary(attack: DataFrame, normal: DataFrame) -> DataFrame:
    """Attack rates next to the normal pool's rates of the same scenario."""
    pool = normal.select(
        "scenario",
        "normal_pool_direct_hit_rate",
        "normal_pool_xgb_added_hit_rate",
        F.col("risk_pool_rate").alias("normal_risk_pool_rate"),
    )
    return attack.join(pool, "scenario")


def redteam_extremes(attack: DataFrame, normal: DataFrame) -> DataFrame:
    added = normal.agg(F.avg("normal_pool_xgb_added_hit_rate")).scalar()
    return attack.agg(
        F.max("risk_pool_rate").alias("max_recall"),
        F.min("risk_pool_rate").alias("min_recall"),
        F.max("bypass_rate").alias("max_bypass"),
    ).withColumn("mean_normal_added_hit_rate", added)
