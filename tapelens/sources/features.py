"""The dictionary of measured features: unit, normalization family and source family of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATR = "atr_5m_24_arithmetic_true_range"
#: The active vocabulary, by name: unit, normalization family, source family.
_MEASURED = f"""
atr_5m_24 native_price {ATR} volatility
bar_close_outside_value_ratio completed_bar_ratio completed_fast_bar_closes auction_profile
consecutive_minutes_outside minutes elapsed_session auction_profile
distance_to_current_poc_ticks raw_ticks raw_ticks auction_profile
distance_to_current_poc_vol atr_units {ATR} auction_profile
distance_to_prior_poc_vol atr_units {ATR} auction_profile
distance_to_vah_vol atr_units {ATR} auction_profile
distance_to_val_vol atr_units {ATR} auction_profile
iae_absorption_confirmed boolean iae_absorption_guard iae_l1
iae_close_position_raw dimensionless_ratio gap_geometry iae_l1
iae_close_position_score bounded_ratio_0_1 gap_geometry_score_input iae_l1
iae_displacement_efficiency dimensionless_ratio bar_geometry iae_l1
iae_formation_quality dimensionless_score iae_formation iae_l1
iae_gap_age_bars completed_5m_bars elapsed_bars iae_l1
iae_gap_width_atr atr_units {ATR} iae_l1
iae_impulse_body_atr atr_units {ATR} iae_l1
iae_retest_depth_ratio dimensionless_ratio gap_geometry iae_l1
iae_score_effective dimensionless_score iae_absorption iae_l1
iae_score_raw dimensionless_score iae_absorption iae_l1
iae_time_decay dimensionless_ratio elapsed_bars iae_l1
iae_tod_volume_score_input non_negative_score_input prior_session_slot_floor_v1 iae_l1
iae_tod_volume_z_raw z_score prior_session_slot iae_l1
iae_wick_rejection_ratio dimensionless_ratio bar_geometry iae_l1
icm_curvature_normalized residual_scale_units_per_bar_squared quadratic_residual_scale icm
icm_curvature_per_bar2 native_price_per_bar_squared quadratic_window icm
icm_fair_value native_price quadratic_window icm
icm_fair_value_distance_vol atr_units {ATR} icm
icm_r_ratio dimensionless_ratio residual_scale_ratio icm
icm_residual_autocorrelation correlation_minus1_1 current_window_residuals icm
icm_sigma_blend native_price quadratic_residual_scale icm
icm_sigma_mad native_price quadratic_residual_scale icm
icm_sigma_ols native_price quadratic_residual_scale icm
icm_slope_normalized residual_scale_units_per_bar quadratic_residual_scale icm
icm_slope_per_bar native_price_per_bar quadratic_window icm
icm_z_capped z_score quadratic_residual_scale icm
icm_z_effective z_score quadratic_residual_scale icm
icm_z_raw z_score quadratic_residual_scale icm
imsi_covariance_condition_number dimensionless_ratio prior_state_ewma_shrinkage imsi
imsi_covariance_effective_sample_size effective_observation_count prior_state_ewma_shrinkage imsi
imsi_covariance_shrinkage_delta dimensionless_ratio prior_state_ewma_shrinkage imsi
imsi_dist_vwap_pct percentage_points session_vwap imsi
imsi_mahalanobis_distance distance prior_state_covariance imsi
imsi_neighbor_distance_mean distance prior_state_covariance imsi
imsi_neighbor_distance_p90 distance prior_state_covariance imsi
imsi_neighbor_support count prior_state_count imsi
imsi_state_rarity_percentile percentile_0_1 prior_distance_rank imsi
imsi_vwrsi_raw oscillator_0_100 volume_weighted_rsi imsi
imsi_vwrsi_tod_adjusted oscillator_points prior_session_slot imsi
poc_migration_vol atr_units {ATR} auction_profile
profile_entropy dimensionless_ratio normalized_distribution auction_profile
profile_kurtosis standardized_moment volume_weighted_moment auction_profile
profile_overlap_ratio dimensionless_ratio value_area_overlap auction_profile
profile_skew standardized_moment volume_weighted_moment auction_profile
reentry_count count elapsed_session auction_profile
value_area_width_vol atr_units {ATR} auction_profile
value_mid_migration_vol atr_units {ATR} auction_profile
volume_above_poc_ratio dimensionless_ratio elapsed_volume auction_profile
volume_outside_value_ratio session_normalized_ratio elapsed_volume auction_profile
"""


def feature_rows() -> list[tuple[str, str, str, str]]:
    return [tuple(line.split()) for line in _MEASURED.strip().splitlines()]


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """(feature, unit, normalization_family, source_family) of every measured feature of the active version."""
    names = ("feature", "unit", "normalization_family", "source_family")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in feature_rows()])))
