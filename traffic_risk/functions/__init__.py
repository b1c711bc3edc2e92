from traffic_risk.functions.normalize import (
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
from traffic_risk.functions.quantiles import counted_values, exact_quantiles, quantiles_of_counts
from traffic_risk.functions.skew import attach

__all__ = [
    "attach",
    "blank_to_unknown",
    "bool_flag",
    "c_segment_regex",
    "c_segment_rsplit",
    "canonical_resolution",
    "counted_values",
    "exact_quantiles",
    "first_day_flag",
    "hour_weight",
    "is_direct",
    "normalize_date",
    "parse_match_flag",
    "quantiles_of_counts",
    "select_features",
    "soft_fingerprint",
    "to_number_or",
]
