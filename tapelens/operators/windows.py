"""Sliding measurements on bars: true range, time-of-day normals, VWAP, quadratic price geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import PRODUCTION, Policy
from .sessions import slot

CONTRACT = ("root", "contract_symbol")


def atr(bars: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """bars with true_range, atr (mean of the last true ranges, null until there are enough) and atr_ready."""
    w = Window.partitionBy(*CONTRACT).orderBy("end")
    last = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))
    out = bars.withColumn("true_range", F.when(last.isNotNull(), true_range))  # a contract's first bar has no previous close
    recent = w.rowsBetween(-(policy.atr_bars - 1), 0)
    n = F.count("true_range").over(recent)
    value = F.greatest(F.avg("true_range").over(recent), F.lit(policy.atr_floor))
    return out.withColumn("atr", F.when(n == policy.atr_bars, value)).withColumn("atr_ready", F.col("atr").isNotNull())


def session_vwap(bars: DataFrame) -> DataFrame:
    """bars with the running volume-weighted price of their session and the percent distance of the close from it."""
    w = Window.partitionBy(*CONTRACT, "session_id").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    vwap = F.sum(F.col("close") * F.col("volume")).over(w) / F.sum("volume").over(w)
    return bars.withColumn("session_vwap", vwap).withColumn("vwap_distance", (F.col("close") - F.col("session_vwap")) / F.col("session_vwap") * 100.0)


def tod_volume_z(bars: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """bars with volume_z against the last sessions' volumes at the same session type and slot, and tod_flag where it is withheld."""
    out = bars.withColumn("slot", slot(F.col("start"), F.col("session_start"), policy.fast))
    prior = Window.partitionBy(*CONTRACT, "session_type", "slot").orderBy("end").rowsBetween(-policy.tod_sessions, -1)
    n, mean, spread = F.count("volume").over(prior), F.avg("volume").over(prior), F.stddev_pop("volume").over(prior)
    out = out.withColumn("tod_n", n).withColumn("tod_mean", mean).withColumn("tod_sd", spread)
    warm, flat = F.col("tod_n") < policy.tod_min, F.col("tod_sd") * F.col("tod_sd") <= policy.epsilon
    flag = F.when(warm, "IAE_TOD_WARMUP").when(flat, "IAE_TOD_DEGENERATE")
    z = F.when(~warm & ~flat, (F.col("volume") - F.col("tod_mean")) / (F.col("tod_sd") + policy.epsilon))
    return out.withColumn("volume_z", z).withColumn("tod_flag", flag).drop("tod_mean", "tod_sd")


def _dot(values: Column, row: Column) -> Column:
    return F.aggregate(F.zip_with(values, row, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _numbers(values) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _median(sorted_values: Column, n: int) -> Column:
    return (F.get(sorted_values, F.lit((n - 1) // 2)) + F.get(sorted_values, F.lit(n // 2))) / 2


def icm(bars: DataFrame, scales: DataFrame | None = None, policy: Policy = PRODUCTION) -> DataFrame:
    """Quadratic price geometry of each full window of closes of a contract: coefficients, residual scales, Z and guards.

    The window's time runs from -1 to 0, the pseudoinverse of its design is folded
    into literal arrays, so a fit is three dot products. scales(root,
    contract_symbol, end, atr) gives the distance from fair value in local units
    where a fast bar ends together with the window.
    """
    sizes = sorted({policy.icm_windows[r] for r in policy.icm_windows})
    parts = []
    for size in sizes:
        roots = [r for r, n in policy.icm_windows.items() if n == size]
        w = Window.partitionBy(*CONTRACT).orderBy("end").rowsBetween(-(size - 1), 0)
        rows = bars.filter(F.col("root").isin(roots)).withColumn("closes", F.collect_list("close").over(w)).filter(F.size("closes") == size)
        parts.append(_icm_size(rows, size, policy))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if scales is None:
        out = out.withColumn("atr", F.lit(None).cast("double"))
    else:
        out = out.join(scales.select(*CONTRACT, "end", "atr"), [*CONTRACT, "end"], "left")
    out = out.withColumn("fair_value_distance_vol", (F.col("close") - F.col("fair_value")) / F.col("atr"))
    flags = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("sigma_blend") <= policy.epsilon, "ICM_FLAT_SCALE_GUARD"),
                F.when(F.col("r_ratio") > policy.regime_ratio, "ICM_REGIME_GUARD"),
                F.when(F.col("residual_autocorrelation").isNull(), "ICM_RESIDUAL_AUTOCORRELATION_DEGENERATE"),
                F.when(F.col("atr").isNull(), "ICM_LOCAL_SCALE_UNAVAILABLE"),
            )
        )
    )
    return out.withColumn("quality_flags", flags).withColumn("measurement_ready", F.col("z_effective").isNotNull())


def _icm_size(rows: DataFrame, size: int, policy: Policy) -> DataFrame:
    tau = (np.arange(size) - (size - 1)) / (size - 1)
    design = np.column_stack([np.ones(size), tau, tau**2])
    inverse = np.linalg.pinv(design)
    out = rows
    for k in range(3):
        out = out.withColumn(f"beta{k}", _dot(F.col("closes"), _numbers(inverse[k])))
    fitted = F.zip_with(F.col("closes"), _numbers(tau), lambda y, t: y - (F.col("beta0") + F.col("beta1") * t + F.col("beta2") * t * t))
    out = out.withColumn("residuals", fitted)
    rss = F.aggregate("residuals", F.lit(0.0), lambda s, x: s + x * x)
    out = out.withColumn("sigma_ols", F.sqrt(rss / (size - 3)))
    out = out.withColumn("middle", _median(F.sort_array("residuals"), size))
    out = out.withColumn("sigma_mad", 1.4826 * _median(F.sort_array(F.transform("residuals", lambda x: F.abs(x - F.col("middle")))), size))
    out = out.withColumn("sigma_blend", (F.col("sigma_ols") + F.col("sigma_mad")) / 2).withColumn("r_ratio", F.col("sigma_ols") / (F.col("sigma_mad") + policy.epsilon))
    out = out.withColumn("fair_value", F.col("beta0")).withColumn("slope_per_bar", F.col("beta1") / (size - 1)).withColumn("curvature_per_bar2", 2 * F.col("beta2") / (size - 1) ** 2)
    blend = F.col("sigma_blend")
    out = out.withColumn("slope_normalized", F.when(blend > 0, F.col("slope_per_bar") / blend)).withColumn("curvature_normalized", F.when(blend > 0, F.col("curvature_per_bar2") / blend))
    out = out.withColumn("z_raw", F.when(blend > policy.epsilon, (F.col("close") - F.col("fair_value")) / (blend + policy.epsilon)))
    out = out.withColumn("z_capped", F.when(F.col("z_raw").isNotNull(), F.least(F.greatest("z_raw", F.lit(-policy.z_cap)), F.lit(policy.z_cap))))
    out = out.withColumn("z_effective", F.when((blend > policy.epsilon) & (F.col("r_ratio") <= policy.regime_ratio), F.col("z_capped")))
    left, right = F.slice("residuals", 1, size - 1), F.slice("residuals", 2, size - 1)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / (size - 1)
    out = out.withColumn("ml", mean(left)).withColumn("mr", mean(right))
    shared = F.aggregate(F.zip_with(left, right, lambda a, b: (a - F.col("ml")) * (b - F.col("mr"))), F.lit(0.0), lambda s, x: s + x)
    square = lambda a, m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - F.col(m)) * (x - F.col(m)))
    bottom = F.sqrt(square(left, "ml") * square(right, "mr"))
    out = out.withColumn("bottom", bottom).withColumn("shared", shared)
    value = F.least(F.greatest(F.col("shared") / F.col("bottom"), F.lit(-1.0)), F.lit(1.0))
    out = out.withColumn("residual_autocorrelation", F.when(F.col("bottom") > policy.epsilon, value))
    return out.withColumn("window_size", F.lit(size)).drop("closes", "residuals", "middle", "ml", "mr", "bottom", "shared")
