"""Behavioural features, one row per user-day.

Layout of the work: events are first reduced to *cells* (user, url, hour), which makes distinct
users per block a plain count and lets every aggregation combine on the map side. Look-ups of block,
address and clone statistics go through ``attach``, which keeps hot urls, addresses and
signatures balanced. The per-user-day parts all come out of aggregations on the same
two keys, so joining them needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traffic_risk.columns import FEATURES, RESOLUTION_Z, USER_DAY
from traffic_risk.functions import attach, c_segment_rsplit, hour_weight, is_direct, select_features
from traffic_risk.operators.baseline import RATIO_FLOOR, Baseline

BLOCK = ("date", "url", "hour_time")
SIGNATURE = ("date", "hour_bin", "url_nunique", "is_direct")
MAX_GROWTH = 50.0


def _with_user(events: DataFrame) -> DataFrame:
    return events.where(F.col("date").isNotNull() & F.col("distinct_id").isNotNull())


def cells(events: DataFrame) -> DataFrame:
    """Page views per (day, user, url, hour); url and hour may be null."""
    return (
        _with_user(events)
        .groupBy(*USER_DAY, "url", "hour_time")
        .agg(F.count("*").alias("pv"), F.sum(is_direct("referrer")).alias("direct_pv"))
    )


def _views() -> Column:
    """Views of a cell, never fewer than the direct ones.

    Reading both columns lets all readers of the cells share one shuffle: a reader that leaves one out would get a shuffle
    without it, and a scan of the events of its own.
    """
    return F.greatest("pv", "direct_pv")


def user_total_pv(events: DataFrame) -> DataFrame:
    return (
        _with_user(events)
        .groupBy(*USER_DAY)
        .agg(F.count("*").alias("user_total_pv"))
        .withColumn("is_1pv_user", (F.col("user_total_pv") == 1).cast("int"))
    )


def block_stats(events: DataFrame, by_cell: DataFrame | None = None) -> DataFrame:
    """Views, users, one-view users and direct views per (day, url, hour).

    A one-view user's only event names its block, so those users are counted from a user-day
    aggregate instead of joining user totals back to the events.
    """
    by_cell = cells(events) if by_cell is None else by_cell
    zero = F.lit(0).cast("long")
    placed = F.col("url").isNotNull() & F.col("hour_time").isNotNull()
    # Rows without a url or hour are left out of the sums rather than filtered: a filter would
    # move into the scan, and the cells would be shuffled once for this and once for ``user_blocks``.
    block = ("date", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("hour_time", F.lit(-1)).alias("hour_time"))

    def part(name: str, value: Column) -> Column:
        return F.when(placed, value).otherwise(zero).alias(name)

    one = F.lit(1).cast("long")
    visits = by_cell.select(
        *block, part("pv", F.col("pv")), part("uv", one), part("direct_pv", F.col("direct_pv")), zero.alias("single")
    )
    singles = (
        by_cell.groupBy(*USER_DAY)
        .agg(F.sum(_views()).alias("n"), F.min("url").alias("url"), F.min("hour_time").alias("hour_time"))
        .where(F.col("n") == 1)
        .select(*block, zero.alias("pv"), zero.alias("uv"), zero.alias("direct_pv"), part("single", one))
    )
    return (
        visits.unionByName(singles)
        .groupBy(*BLOCK)
        .agg(
            F.sum("pv").alias("block_pv"),
            F.sum("uv").alias("block_uv"),
            F.sum("single").alias("block_1pv_uv"),
            F.sum("direct_pv").alias("block_direct_pv"),
        )
        .where(F.col("block_pv") > 0)
    )


def block_growth(blocks: DataFrame) -> DataFrame:
    """Views against the previous hour in which the url was seen; at most 24 rows per window."""
    previous = F.lag("block_pv").over(Window.partitionBy("date", "url").orderBy("hour_time"))
    return blocks.withColumn("prev_pv", F.coalesce(previous, F.lit(0).cast("long"))).withColumn(
        "growth_rate",
        F.least(F.col("block_pv") / (F.col("prev_pv") + F.lit(1e-6)), F.lit(MAX_GROWTH)),
    )


def block_ratios(blocks: DataFrame) -> DataFrame:
    def per(part: str, whole: str) -> Column:
        return F.col(part) / (F.col(whole) + F.lit(1e-6))

    return (
        blocks.withColumn("uv_pv_ratio", per("block_uv", "block_pv"))
        .withColumn("target_1pv_ratio", per("block_1pv_uv", "block_uv"))
        .withColumn("target_direct_ratio", per("block_direct_pv", "block_pv"))
    )


def suspicious_blocks(blocks: DataFrame) -> DataFrame:
    rule = (
        (F.col("growth_rate") > 3.0)
        & (F.col("uv_pv_ratio") > 0.9)
        & (F.col("target_1pv_ratio") > 0.2)
    )
    return blocks.withColumn("is_suspicious_block", F.coalesce(rule, F.lit(False)).cast("int"))


def block_table(events: DataFrame, by_cell: DataFrame | None = None) -> DataFrame:
    return suspicious_blocks(block_ratios(block_growth(block_stats(events, by_cell))))


def suspicious_events(events: DataFrame, salts: int | None = None) -> DataFrame:
    """Events with the flag of their block; an event without a block is not suspicious."""
    flags = block_table(events).select(*BLOCK, "block_pv", "is_suspicious_block")
    out = attach(events, flags, BLOCK, USER_DAY, salts)
    return out.withColumn(
        "is_suspicious_block", F.coalesce(F.col("is_suspicious_block"), F.lit(0))
    ).drop("block_pv")


def user_addresses(events: DataFrame) -> DataFrame:
    """Distinct (day, user, ip) with the C segment."""
    return (
        _with_user(events)
        .select(*USER_DAY, "ip")
        .distinct()
        .withColumn("ip_c_segment", c_segment_rsplit("ip"))
    )


def exact_ip_users(events: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Distinct users per day and address; events without an address are left out."""
    addresses = user_addresses(events) if addresses is None else addresses
    # counted, not filtered, for the same reason as in ``block_stats``
    return (
        addresses.groupBy("date", F.coalesce("ip", F.lit("")).alias("ip"))
        .agg(F.count("ip").alias("exact_ip_uv"))
        .where(F.col("exact_ip_uv") > 0)
    )


def _segment_counts(addresses: DataFrame) -> DataFrame:
    return addresses.groupBy("date", "ip_c_segment").agg(
        F.count_distinct("distinct_id").alias("cnt"), F.count("*").alias("pairs")
    )


def _zscore(cnt: Column, baseline: Baseline) -> Column:
    return (cnt - baseline.number("c_mean")) / baseline.number("c_std")


def c_segment_zscore(events: DataFrame, baseline: Baseline) -> DataFrame:
    return (
        _segment_counts(user_addresses(events))
        .drop("pairs")
        .withColumn("c_zscore", _zscore(F.col("cnt"), baseline))
    )


def user_environment(
    events: DataFrame, baseline: Baseline, salts: int | None = None, addresses: DataFrame | None = None
) -> DataFrame:
    """Largest shared-address count and C-segment z-score of each user-day.

    The z-score grows with the segment's count, so the maximum is taken on counts.
    """
    addresses = user_addresses(events) if addresses is None else addresses
    by_ip = exact_ip_users(events, addresses)
    by_segment = _segment_counts(addresses)
    pairs = attach(addresses, by_ip, ("date", "ip"), ("distinct_id",), salts)
    pairs = attach(pairs, by_segment, ("date", "ip_c_segment"), ("distinct_id", "ip"), salts)
    z = _zscore(F.col("max_cnt"), baseline)
    return (
        pairs.groupBy(*USER_DAY)
        .agg(
            F.max("exact_ip_uv").alias("max_exact_ip_uv"),
            F.max("cnt").alias("max_cnt"),
        )
        .withColumn("max_c_zscore", floor_at_zero(z))
        .drop("max_cnt")
    )


def floor_at_zero(c: Column) -> Column:
    """Lower bound 0 that keeps null (``greatest`` would turn it into 0)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def hour_profile(events: DataFrame, baseline: Baseline, by_cell: DataFrame | None = None) -> DataFrame:
    """Distance of a user-day's hours from normal traffic, and its night and evening density.

    One window per user-day over at most 25 rows (24 hours and null). Shares are of all views,
    including those without an hour.
    """
    whole_day = Window.partitionBy(*USER_DAY)
    by_cell = cells(events) if by_cell is None else by_cell
    hours = (
        by_cell.groupBy(*USER_DAY, "hour_time")
        .agg(F.sum(_views()).alias("pv"))
        .withColumn("share", F.col("pv") / (F.sum("pv").over(whole_day) + F.lit(1e-12)))
        .withColumn("ratio", baseline.hour_ratio(F.col("hour_time")))
    )
    known = F.col("hour_time").isNotNull()
    ratio = F.coalesce(F.col("ratio"), F.lit(RATIO_FLOOR))
    kl = F.col("share") * F.log((F.col("share") + F.lit(1e-8)) / (ratio + F.lit(1e-8)))
    in_day = known & F.col("hour_time").between(0, 23)
    has_hour = F.max(known.cast("int")) == 1
    profile = hours.groupBy(*USER_DAY).agg(
        F.sum(F.when(known, kl)).alias("time_kl_dist"),
        *[
            F.when(
                has_hour,
                F.coalesce(
                    F.sum(F.when(in_day, F.col("share") * hour_weight("hour_time", period))), F.lit(0.0)
                ),
            ).alias(f"user_{period}_density")
            for period in ("night", "evening")
        ],
        F.sum(F.when(known, F.col("hour_time") * F.col("pv"))).alias("hour_sum"),
        F.sum(F.when(known, F.col("pv"))).alias("hour_pv"),
    )
    return relative_hour_risk(profile, baseline)


def relative_hour_risk(profile: DataFrame, baseline: Baseline) -> DataFrame:
    out = profile
    for period in ("night", "evening"):
        mass = baseline.number(f"{period}_mass")
        excess = F.log(F.col(f"user_{period}_density") + F.lit(1e-7)) - F.log(mass + F.lit(1e-7))
        out = out.withColumn(f"{period}_relative_risk", floor_at_zero(excess))
    return out


def user_blocks(
    events: DataFrame, by_cell: DataFrame | None = None, salts: int | None = None
) -> DataFrame:
    """User-day roll-up of the blocks the user touched, weighted by its views."""
    by_cell = cells(events) if by_cell is None else by_cell
    blocks = block_table(events, by_cell).select(
        *BLOCK,
        "block_pv",
        "block_uv",
        "growth_rate",
        "uv_pv_ratio",
        "target_1pv_ratio",
        "target_direct_ratio",
        "is_suspicious_block",
    )
    placed = attach(by_cell, blocks, BLOCK, ("distinct_id",), salts)
    pv = F.col("pv")
    in_block = F.when(F.col("block_pv").isNotNull(), pv)
    return placed.groupBy(*USER_DAY).agg(
        F.sum("pv").alias("total_pv"),
        (F.sum("direct_pv") / F.sum("pv")).alias("is_direct_ratio"),
        F.max("block_pv").alias("max_block_pv"),
        (F.sum(pv * F.col("block_pv")) / F.sum(in_block)).alias("avg_block_pv"),
        F.max("growth_rate").alias("max_growth_rate"),
        F.max("uv_pv_ratio").alias("max_uv_pv_ratio"),
        F.max("target_1pv_ratio").alias("max_target_1pv_ratio"),
        F.max("target_direct_ratio").alias("max_target_direct_ratio"),
        (F.sum(pv * F.coalesce(F.col("is_suspicious_block"), F.lit(0))) / F.sum("pv")).alias(
            "attack_block_ratio"
        ),
        F.count_distinct("url").alias("url_nunique"),
    )


def user_signature(events: DataFrame, by_cell: DataFrame | None = None) -> DataFrame:
    """Behaviour signature per user-day: rounded mean hour, distinct urls, direct share."""
    by_cell = cells(events) if by_cell is None else by_cell
    pv = F.col("pv")
    hour = F.sum(F.col("hour_time") * pv) / F.sum(F.when(F.col("hour_time").isNotNull(), pv))
    return by_cell.groupBy(*USER_DAY).agg(
        F.bround(hour, 0).alias("hour_bin"),
        F.count_distinct("url").alias("url_nunique"),
        (F.sum("direct_pv") / F.sum("pv")).alias("is_direct"),
    )


def _cluster_sizes(signatures: DataFrame) -> DataFrame:
    return (
        signatures.where(F.col("hour_bin").isNotNull())
        .groupBy(*SIGNATURE)
        .agg(F.count("*").alias("cluster_size"))
    )


def clone_clusters(events: DataFrame, salts: int | None = None) -> DataFrame:
    """User-days with the number of user-days of the same day and signature.

    ``ip_c`` is the smallest C segment of the user-day (the reference carries whichever came first).
    """
    signatures = user_signature(events)
    segments = _with_user(events).groupBy(*USER_DAY).agg(F.min(c_segment_rsplit("ip")).alias("ip_c"))
    return attach(
        signatures.join(segments, list(USER_DAY)),
        _cluster_sizes(signatures),
        SIGNATURE,
        ("distinct_id",),
        salts,
    )


def risk_scores(features: DataFrame) -> DataFrame:
    """Time and environment risk; the final risk is the largest of four, nulls ignored."""
    half = F.lit(0.5)
    return (
        features.withColumn("time_risk", F.col("time_kl_dist") * F.log1p(F.col("total_pv").cast("double")))
        .withColumn(
            "env_risk",
            F.log1p(F.col("max_exact_ip_uv").cast("double")) * half + F.log1p("max_c_zscore") * half,
        )
        .withColumn(
            "final_time_risk",
            F.greatest("time_risk", "night_relative_risk", "evening_relative_risk", "env_risk"),
        )
    )


def _is(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def rule_block_attack() -> Column:
    return _is(
        (F.col("attack_block_ratio") > 0.7) & (F.col("total_pv") <= 3) & (F.col("is_direct_ratio") > 0.7)
    )


def rule_clone_attack() -> Column:
    return _is((F.col("cluster_size") > 50) & (F.col("total_pv") <= 2))


def rule_night_attack() -> Column:
    return _is(
        (F.col("total_pv") == 1) & (F.col("is_direct_ratio") > 0.6) & (F.col("user_night_density") > 0.4)
    )


def rule_evening_stealth() -> Column:
    return _is(
        (F.col("user_evening_density") > 0.5)
        & (F.col("total_pv") == 1)
        & (F.col("is_direct_ratio") == 1.0)
        & (F.col("cluster_size") > 20)
    )


RULES = (
    (rule_block_attack, 25.0),
    (rule_clone_attack, 20.0),
    (rule_night_attack, 15.0),
    (rule_evening_stealth, 10.0),
)


def apply_rules(features: DataFrame) -> DataFrame:
    """Add each rule's points to the final risk; a null risk stays null."""
    points = F.col("final_time_risk")
    for rule, bonus in RULES:
        points = points + F.when(rule(), F.lit(bonus)).otherwise(F.lit(0.0))
    return features.withColumn("final_time_risk", points)


def base_features(
    events: DataFrame,
    baseline: Baseline,
    salts: int | None = None,
    partials=None,
) -> DataFrame:
    """All behaviour features without the resolution z-score, one row per user-day."""
    by_cell = cells(events) if partials is None else partials.cells
    blocks = user_blocks(events, by_cell, salts)
    hours = hour_profile(events, baseline, by_cell)
    environment = user_environment(events, baseline, salts, None if partials is None else partials.addresses)
    joined = (
        blocks.join(hours, list(USER_DAY))
        .join(environment, list(USER_DAY))
        .withColumn("hour_bin", F.bround(F.col("hour_sum") / F.col("hour_pv"), 0))
        .withColumn("is_direct", F.col("is_direct_ratio"))
        .drop("hour_sum", "hour_pv")
    )
    sizes = _cluster_sizes(user_signature(events, by_cell))
    sized = attach(joined, sizes, SIGNATURE, ("distinct_id",), salts)
    return apply_rules(risk_scores(sized.drop("hour_bin", "is_direct", "url_nunique")))


def user_day_features(
    events: DataFrame,
    baseline: Baseline,
    resolution=None,
    leave_one_day_out: bool = False,
    salts: int | None = None,
    partials=None,
) -> DataFrame:
    """All 21 features. Without a resolution baseline the z-score column is 0.

    With ``partials`` (see ``partials.Partials``) events are not read; they may be null then.
    """
    from traffic_risk.operators.resolution import attach_resolution_feature

    out = base_features(events, baseline, salts, partials)
    if resolution is None:
        out = out.withColumn(RESOLUTION_Z, F.lit(0.0))
    else:
        screens = None if partials is None else partials.screens
        out = attach_resolution_feature(out, events, resolution, leave_one_day_out, salts=salts, by_resolution=screens)
    return select_features(out, FEATURES, strict=True)
