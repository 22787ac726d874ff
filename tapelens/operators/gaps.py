"""Three-bar gaps and what becomes of them.

A gap's fate depends on later bars of its segment alone, never on other gaps, so
its life is an interval join of gaps with the bars that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import PRODUCTION, Policy

CONTRACT = ("root", "contract_symbol")


def segments(bars: DataFrame) -> DataFrame:
    """bars with idx (place in the contract), segment and reset: a new segment starts with a session, or where a bar is missing (a reset)."""
    w = Window.partitionBy(*CONTRACT).orderBy("end")
    last_session, last_end = F.lag("session_id").over(w), F.lag("end").over(w)
    missing = F.coalesce((last_session == F.col("session_id")) & (last_end != F.col("start")), F.lit(False))
    new = last_session.isNull() | (last_session != F.col("session_id")) | missing
    out = bars.withColumn("reset", missing).withColumn("new_segment", new.cast("int")).withColumn("idx", F.row_number().over(w))
    return out.withColumn("segment", F.sum("new_segment").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_segment")


def formations(segmented: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Every three-bar gap at a warm scale: direction, edges, gates and quality, with formed and guard."""
    w = Window.partitionBy(*CONTRACT, "segment").orderBy("idx")
    first = {c: F.lag(c, 2).over(w) for c in ("high", "low")}
    impulse = {c: F.lag(c, 1).over(w) for c in ("open", "high", "low", "close")}
    out = segmented.select("*", *[v.alias(f"first_{k}") for k, v in first.items()], *[v.alias(f"impulse_{k}") for k, v in impulse.items()])
    bull = (F.col("low") > F.col("first_high")) & (F.col("impulse_close") > F.col("first_high")) & (F.col("low") - F.col("first_high") >= F.col("minimum_tick"))
    bear = (F.col("high") < F.col("first_low")) & (F.col("impulse_close") < F.col("first_low")) & (F.col("first_low") - F.col("high") >= F.col("minimum_tick"))
    out = out.withColumn("direction", F.when(bull, "bullish").when(bear, "bearish")).filter("direction is not null and atr is not null")
    up = F.col("direction") == "bullish"
    out = out.withColumn("gap_bot", F.when(up, F.col("first_high")).otherwise(F.col("high"))).withColumn("gap_top", F.when(up, F.col("low")).otherwise(F.col("first_low")))
    span, body = F.col("impulse_high") - F.col("impulse_low"), F.abs(F.col("impulse_close") - F.col("impulse_open"))
    scale = F.col("atr") + policy.epsilon
    out = out.withColumn("z_displacement", body / scale).withColumn("z_gap", (F.col("gap_top") - F.col("gap_bot")) / scale).withColumn("efficiency", body / (span + policy.epsilon))
    eligible = (F.col("z_displacement") > policy.min_z_displacement) & (F.col("efficiency") > policy.min_efficiency) & (F.col("z_gap") > policy.min_z_gap)
    guard = F.when(span <= 0, "IAE_FORMATION_DEGENERATE").when(~eligible, "IAE_FORMATION_GATED")
    out = out.withColumn("guard", guard).withColumn("formed", F.col("guard").isNull())
    quality = F.pow("z_displacement", F.lit(0.4)) * F.pow("z_gap", F.lit(0.4)) * F.pow("efficiency", F.lit(0.2))
    out = out.withColumn("quality", F.when(F.col("formed"), quality))
    return out.select(*CONTRACT, "session_id", "segment", "idx", F.col("end").alias("created_at"), "direction", "gap_bot", "gap_top", "z_displacement", "z_gap", "efficiency", "quality", "guard", "formed")


def gap_bars(gaps: DataFrame, segmented: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Each formed gap with each later bar of its segment up to its end: age, what happened, retest measures.

    happened is expired, invalidated, absorbed, tested or null; the first three end
    the gap, and alive tells whether it lives on after the bar.
    """
    g = gaps.filter("formed").select(*CONTRACT, "segment", F.col("idx").alias("gap_idx"), "created_at", "direction", "gap_bot", "gap_top", "quality")
    b = segmented.select(*CONTRACT, "segment", "session_id", "idx", "end", "open", "high", "low", "close", "volume_z")
    last = policy.gap_max_age + 1
    rows = g.join(b, [*CONTRACT, "segment"]).filter((F.col("idx") > F.col("gap_idx")) & (F.col("idx") <= F.col("gap_idx") + last))
    rows = rows.withColumn("age", F.col("idx") - F.col("gap_idx"))
    up = F.col("direction") == "bullish"
    expired = F.col("age") == last
    invalid = ~expired & F.when(up, F.col("close") < F.col("gap_bot")).otherwise(F.col("close") > F.col("gap_top"))
    touch = F.when(up, (F.col("low") <= F.col("gap_top")) & (F.col("close") >= F.col("gap_bot"))).otherwise((F.col("high") >= F.col("gap_bot")) & (F.col("close") <= F.col("gap_top")))
    rows = rows.withColumn("retest", ~expired & ~invalid & touch)
    width = F.col("gap_top") - F.col("gap_bot")
    body = F.abs(F.col("close") - F.col("open"))
    wick = F.when(up, F.least("open", "close") - F.col("low")).otherwise(F.col("high") - F.greatest("open", "close"))
    raw = F.when(up, F.col("close") - F.col("gap_bot")).otherwise(F.col("gap_top") - F.col("close")) / (width + policy.epsilon)
    seen = F.col("retest")
    rows = rows.withColumn("depth", F.when(seen, F.greatest(F.lit(0.0), F.least("high", "gap_top") - F.greatest("low", "gap_bot")) / width))
    rows = rows.withColumn("wick", F.when(seen & (body > 0), wick / (body + policy.epsilon))).withColumn("close_position", F.when(seen, raw))
    rows = rows.withColumn("decay", F.when(seen, F.exp(-policy.decay * F.col("age"))))
    bracket = F.log1p("quality") + F.log1p("wick") + F.log1p(F.greatest("volume_z", F.lit(policy.volume_z_floor))) + 0.5 * F.least(F.greatest("close_position", F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("score", F.when(F.col("wick").isNotNull() & F.col("volume_z").isNotNull(), bracket * F.col("decay")))
    rows = rows.withColumn("guard", F.when(seen & (body <= 0), "IAE_DEGENERATE_BODY").when(seen & F.col("volume_z").isNull(), "IAE_SCORE_TOD_UNAVAILABLE"))
    toward = F.when(up, F.col("close") > F.col("open")).otherwise(F.col("close") < F.col("open"))
    absorbed = seen & F.coalesce((F.col("score") > policy.score_threshold) & (F.col("wick") > policy.min_wick), F.lit(False)) & toward
    rows = rows.withColumn("happened", F.when(expired, "expired").when(invalid, "invalidated").when(absorbed, "absorbed").when(seen, "tested"))
    ends = F.col("happened").isin("expired", "invalidated", "absorbed")
    end = F.min(F.when(ends, F.col("age"))).over(Window.partitionBy(*CONTRACT, "gap_idx"))
    rows = rows.withColumn("end_age", end).filter(F.col("end_age").isNull() | (F.col("age") <= F.col("end_age")))
    first = F.min(F.when(F.col("retest"), F.col("age"))).over(Window.partitionBy(*CONTRACT, "gap_idx"))
    rows = rows.withColumn("first_retest", F.coalesce(F.col("retest") & (F.col("age") == first), F.lit(False)))
    return rows.withColumn("alive", F.coalesce(~F.col("happened").isin("expired", "invalidated", "absorbed"), F.lit(True)))


def lifecycle(rows: DataFrame) -> DataFrame:
    """One row per gap that met a bar: its last state, age there, and its retests."""
    last = F.max_by("happened", F.when(F.col("happened").isNotNull(), F.col("age")))
    return rows.groupBy(*CONTRACT, "gap_idx", "created_at", "direction").agg(
        F.coalesce(last, F.lit("open")).alias("state"), F.max("end_age").alias("end_age"), F.count_if("retest").alias("retests"), F.min(F.when(F.col("retest"), F.col("age"))).alias("first_retest_age")
    )


def first_retests(rows: DataFrame) -> DataFrame:
    """The first retest of each gap, with the number of active gaps at that point of the bar's walk through the gaps.

    Gaps made earlier are counted after this bar, later ones before it; guards holds
    the retest guards of the bar's gaps up to this one.
    """
    w = Window.partitionBy(*CONTRACT, "idx")
    before = w.orderBy("gap_idx").rowsBetween(Window.unboundedPreceding, 0)
    active = F.sum(F.col("alive").cast("int")).over(before) + F.count("*").over(w) - F.count("*").over(before)
    return rows.withColumn("active_gaps", active).withColumn("guards", F.collect_set("guard").over(before)).filter("first_retest")


def bar_flags():
    """What a bar itself says before its gaps are looked at: a missing bar before it, no time-of-day baseline, no scale."""
    return F.array_compact(F.array(F.when(F.col("reset"), "IAE_BAR_GAP_RESET"), F.col("tod_flag"), F.when(~F.col("atr_ready"), "IAE_ATR_WARMUP")))


def bar_states(rows: DataFrame, gaps: DataFrame, segmented: DataFrame) -> DataFrame:
    """Each bar's gap: the last made of those with an event on it, else the one formed now, else the newest still active; and the active gaps after it."""
    event = F.struct(F.when(F.col("happened").isNotNull(), 3).when(F.col("alive"), 1).otherwise(0).alias("rank"), "gap_idx", F.coalesce("happened", F.lit("open")).alias("what"), "direction", "age", "score")
    old = rows.select(*CONTRACT, "idx", event.alias("c"), F.col("alive").cast("int").alias("alive"), "guard")
    now = F.struct(F.lit(2).alias("rank"), F.col("idx").alias("gap_idx"), F.lit("open").alias("what"), "direction", F.lit(0).alias("age"), F.lit(None).cast("double").alias("score"))
    made = gaps.filter("formed").select(*CONTRACT, "idx", now.alias("c"), F.lit(1).alias("alive"), F.lit(None).cast("string").alias("guard"))
    # a gap without an event keeps the state that its last retest left
    best = old.unionByName(made).groupBy(*CONTRACT, "idx").agg(F.max("c").alias("c"), F.sum("alive").alias("active_gaps"), F.collect_set("guard").alias("guards"))
    out = segmented.select(*CONTRACT, "session_id", "idx", "end", "reset", "tod_flag", "atr_ready").join(best, [*CONTRACT, "idx"], "left")
    formation = gaps.filter("guard is not null").select(*CONTRACT, "idx", F.col("guard").alias("formation_guard"))
    out = out.join(formation, [*CONTRACT, "idx"], "left")
    flags = F.array_sort(F.array_union(F.array_compact(F.array_append(bar_flags(), F.col("formation_guard"))), F.coalesce("guards", F.array().cast("array<string>"))))
    shown = F.col("c.rank") > 0
    return out.select(
        *CONTRACT, "session_id", "idx", "end", F.when(shown, F.col("c.gap_idx")).alias("gap_idx"), F.when(shown, F.col("c.what")).alias("gap_event"), F.when(shown, F.col("c.direction")).alias("direction"),
        F.coalesce("active_gaps", F.lit(0)).alias("active_gaps"), flags.alias("quality_flags"), "atr_ready",
    )
