"""Measurements in long form: one row per feature of a snapshot, with why a value is missing, and their coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

KEY = ("root", "contract_symbol", "session_id", "end")
#: The name of a feature where it is not its column's: source, column.
NAMED = {
    "auction": {"atr": "atr_5m_24"},
    "imsi": {
        "condition": "imsi_covariance_condition_number", "effective_size": "imsi_covariance_effective_sample_size", "delta": "imsi_covariance_shrinkage_delta", "vwap_distance": "imsi_dist_vwap_pct",
        "distance": "imsi_mahalanobis_distance", "neighbour_mean": "imsi_neighbor_distance_mean", "neighbour_p90": "imsi_neighbor_distance_p90", "neighbour_support": "imsi_neighbor_support",
        "rarity": "imsi_state_rarity_percentile", "vwrsi": "imsi_vwrsi_raw", "adjusted": "imsi_vwrsi_tod_adjusted",
    },
    "iae": {
        "z_gap": "iae_gap_width_atr", "z_displacement": "iae_impulse_body_atr", "efficiency": "iae_displacement_efficiency", "quality": "iae_formation_quality", "age": "iae_gap_age_bars", "depth": "iae_retest_depth_ratio",
        "wick": "iae_wick_rejection_ratio", "close_position": "iae_close_position_raw", "decay": "iae_time_decay", "volume_z": "iae_tod_volume_z_raw", "score": "iae_score_raw", "absorbed": "iae_absorption_confirmed",
    },
}
#: Columns of the tables that are clocks, keys, prices or states, not features.
NOT_FEATURES = frozenset(
    "period_minutes open high low close volume n_trades minimum_tick closed_by true_range atr_ready measurement_ready degenerate slot tod_n tod_median idx gap_idx segment reset window_size beta0 beta1 beta2 "
    "total_volume mean_tick poc_tick val_tick vah_tick prior_poc_tick prior_val_tick prior_vah_tick close_tick price_tick session_vwap new_segment".split()
)


def melt(rows: DataFrame, source: str) -> DataFrame:
    """(root, contract_symbol, session_id, end, source, feature, value, missing_reason): every number of a snapshot table, by its schema.

    Numbers and booleans that are no key, clock or price are features, those of structs
    by the struct's name and theirs. A missing value has the snapshot's own first quality
    flag as its reason, or `unexplained`.
    """
    names = NAMED.get(source, {})
    columns: dict[str, Column] = {}
    for f in rows.schema:
        inner = [(f"{f.name}_{g.name}", f"{f.name}.{g.name}", g.dataType) for g in f.dataType] if f.dataType.typeName() == "struct" else [(f.name, f.name, f.dataType)]
        for name, path, kind in inner:
            if name in NOT_FEATURES or name in KEY or not isinstance(kind, NumericType | BooleanType):
                continue
            known = source if source in ("icm", "imsi", "iae") else ""
            columns[names.get(name, f"{known}_{name}" if known else name)] = F.col(path).cast("double")
    flags = F.filter("quality_flags", lambda x: ~x.startswith("ROLL:")) if "quality_flags" in rows.columns else F.array().cast("array<string>")
    long = rows.select(*KEY, F.get(flags, F.lit(0)).alias("__flag"), *[c.alias(n) for n, c in columns.items()])
    # stack keeps nulls as rows, in one pass over the table
    pairs = ", ".join(f"'{n}', `{n}`" for n in columns)
    out = long.select(*KEY, "__flag", F.expr(f"stack({len(columns)}, {pairs})").alias("feature", "value"))
    value = F.when(~F.isnan("value"), F.col("value"))
    return out.select(*KEY, F.lit(source).alias("source"), "feature", value.alias("value"), F.when(value.isNull(), F.coalesce("__flag", F.lit("unexplained"))).alias("missing_reason"))


def coverage(melted: list[DataFrame], dictionary: DataFrame) -> DataFrame:
    """Per feature: unit and families, rows, values present, the most common reason of missing ones, and its standing.

    standing: measured, or unmeasured (in the dictionary, in no table), or unknown (measured, not in the dictionary).
    """
    rows = reduce(DataFrame.unionByName, melted)
    by_reason = rows.groupBy("feature", "missing_reason").agg(F.count("*").alias("n"))
    seen = by_reason.groupBy("feature").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("missing_reason").isNull(), F.col("n")).otherwise(0)).alias("n_present"),
        F.max(F.when(F.col("missing_reason").isNotNull(), F.struct("n", "missing_reason"))).alias("most"),
    )
    both = dictionary.join(seen, "feature", "full")
    standing = F.when(F.col("n_rows").isNull(), "unmeasured").when(F.col("unit").isNull(), "unknown").otherwise("measured")
    zero = F.lit(0).cast("long")
    return both.select("feature", "unit", "normalization_family", "source_family", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_present", zero).alias("n_present"), F.col("most.missing_reason").alias("missing_reason"), standing.alias("standing"))
