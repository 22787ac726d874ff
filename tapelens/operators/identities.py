"""Ids of measurements: the hash of what a snapshot says, so a replay that says the same has the same id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import identity, instant, listing, listing_of, number, whole, word

#: The versions that go into the ids.
PROFILE_VERSION = "volume_profile_math_v2"
IMSI_VERSION = "imsi_state_core_math_v3|ewma_diagonal_shrinkage_spec_v1"
ICM_VERSION = "icm_quadratic_geometry_math_v3|pinv_solver_v1"

SESSION = ("root", "contract_symbol", "session_id")


def _bound() -> dict[str, Column]:
    return {n: word(F.col(n)) for n in SESSION}


def profile_id(kind: str) -> Column:
    """The id of a profile row: as_of, available_at, current_price_tick, minimum_tick, val_tick, vah_tick and the histogram."""
    pairs = listing_of(F.col("histogram"), lambda x: listing(whole(x["tick"]), number(x["volume"])))
    return identity(
        "profile",
        _bound()
        | {
            "as_of_utc": instant(F.col("as_of")), "available_at_utc": instant(F.col("available_at")), "current_price_tick": whole(F.col("current_price_tick")), "definition_version": word(F.lit(PROFILE_VERSION)),
            "profile_kind": word(F.lit(kind)), "tick_size": number(F.col("minimum_tick")), "value_area": listing(whole(F.col("val_tick")), whole(F.col("vah_tick"))), "volume_by_tick": pairs,
        },
    )


def imsi_id() -> Column:
    """The id of a momentum state: imsi() rows."""
    numbers = {
        "covariance_condition_number": "condition", "covariance_effective_sample_size": "effective_size", "covariance_shrinkage_delta": "delta", "dist_vwap_pct": "vwap_distance", "mahalanobis_distance": "distance",
        "neighbor_distance_mean": "neighbour_mean", "neighbor_distance_p90": "neighbour_p90", "session_vwap": "session_vwap", "state_rarity_percentile": "rarity", "vwrsi_raw": "vwrsi", "vwrsi_tod_adjusted": "adjusted",
    }
    own = {"as_of_utc": instant(F.col("end")), "neighbor_support": whole(F.col("neighbour_support")), "version": word(F.lit(IMSI_VERSION))}
    return identity("imsi", _bound() | own | {k: number(F.col(c)) for k, c in numbers.items()})


def icm_id() -> Column:
    """The id of a price-geometry state: icm() rows."""
    same = ("curvature_per_bar2", "fair_value_distance_vol", "residual_autocorrelation", "sigma_blend", "slope_per_bar", "z_capped", "z_effective", "z_raw")
    own = {
        "as_of_utc": instant(F.col("end")), "coefficients": listing(*[number(F.col(f"beta{k}")) for k in range(3)]), "quality_flags": listing_of(F.col("quality_flags"), word), "version": word(F.lit(ICM_VERSION)),
        "window_size": whole(F.col("window_size")),
    }
    return identity("icm", _bound() | own | {c: number(F.col(c)) for c in same})


def with_last_tick(finals: DataFrame, admitted: DataFrame) -> DataFrame:
    """Final profiles with the tick of their session's last admitted trade and its price grid."""
    last = admitted.filter("admitted").groupBy(*SESSION).agg(F.max_by("tick", "arrival").alias("current_price_tick"), F.min("minimum_tick").alias("minimum_tick"))
    return finals.join(last, list(SESSION))
