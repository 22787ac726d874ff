"""Where price stands against earlier value: references, location, features and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import utc_text
from ..functions.ids import list_id
from ..functions.prices import price_to_tick
from ..policy import PRODUCTION, Policy

CONTRACT = ("root", "contract_symbol")
SESSION = (*CONTRACT, "session_id")


def references(finals: DataFrame) -> DataFrame:
    """Per session: the prior final profile of its type, and the ids of the latest RTH and ETH sessions before it, in its contract."""
    by_type = Window.partitionBy(*CONTRACT, "session_type").orderBy("session_start")
    before = Window.partitionBy(*CONTRACT).orderBy("session_start").rowsBetween(Window.unboundedPreceding, -1)

    def last_of(kind: str):
        return F.last(F.when(F.col("session_type") == kind, F.col("session_id")), ignorenulls=True).over(before)

    prior = {f"prior_{c}": F.lag(c).over(by_type) for c in ("session_id", "poc_tick", "val_tick", "vah_tick")}
    return finals.select(*SESSION, "session_type", "session_start", *[v.alias(k) for k, v in prior.items()], last_of("rth").alias("prior_rth_id"), last_of("eth").alias("prior_eth_id"))


def located(bars: DataFrame, refs: DataFrame) -> DataFrame:
    """bars with the prior profile and their location against it, by the completed close; a close that is not on the contract's price grid is `off_grid`."""
    out = bars.join(refs.drop("session_type", "session_start"), list(SESSION), "left")
    out = out.withColumn("close_tick", price_to_tick(F.col("close"), F.col("minimum_tick")))
    where = (
        F.when(F.col("prior_vah_tick").isNull(), "no_reference")
        .when(F.col("close_tick").isNull(), "off_grid")
        .when(F.col("close_tick") > F.col("prior_vah_tick"), "above_value")
        .when(F.col("close_tick") < F.col("prior_val_tick"), "below_value")
        .otherwise("inside_value")
    )
    return out.withColumn("location", where)


def transitions(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """located rows with poc_tick (developing): exits, reentries, migrations, the excursion and the counters.

    An excursion is a stretch of a session between two exits. Its reentry is the
    first return to value in its direction; its migration the first bar from the
    exit on, before the reentry, whose point of control crosses the prior value
    area's edge.
    """
    w = Window.partitionBy(*SESSION).orderBy("end")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("last_location", F.lag("location").over(w)).withColumn("last_poc", F.lag("poc_tick").over(w))
    inside = F.col("last_location") == "inside_value"
    exit_dir = F.when(inside & (F.col("location") == "above_value"), 1).when(inside & (F.col("location") == "below_value"), -1)
    out = out.withColumn("exit", exit_dir)
    out = out.withColumn("excursion", F.count("exit").over(so_far)).withColumn("dir", F.last("exit", ignorenulls=True).over(so_far))
    kind = F.when(F.col("exit") == 1, "value_exit_up").when(F.col("exit") == -1, "value_exit_down")
    exit_id = F.when(F.col("exit").isNotNull(), event_id(kind, F.lit(None).cast("string")))
    out = out.withColumn("exit_id", F.last(exit_id, ignorenulls=True).over(so_far))
    back = (F.col("location") == "inside_value") & (
        ((F.col("last_location") == "above_value") & (F.col("dir") == 1)) | ((F.col("last_location") == "below_value") & (F.col("dir") == -1))
    )
    e = Window.partitionBy(*SESSION, "excursion").orderBy("end")
    seen = e.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("back", F.coalesce(back, F.lit(False)).cast("int")).withColumn("backs", F.sum("back").over(seen))
    out = out.withColumn("reentry", (F.col("back") == 1) & (F.col("backs") == 1) & (F.col("excursion") > 0))
    open_now = (F.col("excursion") > 0) & (F.col("backs") == 0)
    cross = F.when(F.col("dir") == 1, (F.col("last_poc") <= F.col("prior_vah_tick")) & (F.col("poc_tick") > F.col("prior_vah_tick"))).otherwise(
        (F.col("last_poc") >= F.col("prior_val_tick")) & (F.col("poc_tick") < F.col("prior_val_tick"))
    )
    out = out.withColumn("cross", (open_now & F.coalesce(cross, F.lit(False))).cast("int")).withColumn("crosses", F.sum("cross").over(seen))
    out = out.withColumn("migration", (F.col("cross") == 1) & (F.col("crosses") == 1))
    out = out.withColumn("active_excursion_id", F.when(open_now, F.col("exit_id")))
    outside = F.col("location").isin("above_value", "below_value")
    out = out.withColumn("reentry_count", F.sum(F.col("reentry").cast("int")).over(so_far)).withColumn("outside", outside.cast("int"))
    island = F.sum(1 - F.col("outside")).over(so_far)
    out = out.withColumn("island", island)
    streak = F.sum("outside").over(Window.partitionBy(*SESSION, "island").orderBy("end").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("consecutive_minutes_outside", streak * policy.fast)
    return out.drop("back", "backs", "cross", "crosses", "island")


def event_id(kind, parent):
    return list_id("event", [F.col("root"), F.col("contract_symbol"), kind, utc_text(F.col("end")), parent])


def transition_events(rows: DataFrame) -> DataFrame:
    """One row per event of transitions(): event_id, event_type, direction, parent_event_id."""
    up = F.col("dir") == 1
    kinds = {
        "exit": (F.col("exit").isNotNull(), F.when(up, "value_exit_up").otherwise("value_exit_down"), F.col("dir"), F.lit(None).cast("string")),
        "reentry": (F.col("reentry"), F.when(up, "value_reentry_from_above").otherwise("value_reentry_from_below"), -F.col("dir"), F.col("exit_id")),
        "migration": (F.col("migration"), F.when(up, "poc_migration_above_prior_vah").otherwise("poc_migration_below_prior_val"), F.col("dir"), F.col("exit_id")),
    }
    made = F.array_compact(F.array(*[F.when(c, F.struct(k.alias("event_type"), d.alias("direction"), p.alias("parent_event_id"))) for c, k, d, p in kinds.values()]))
    out = rows.select(*SESSION, "end", "available_at", F.explode(made).alias("e")).select(*SESSION, "end", "available_at", "e.*")
    return out.withColumn("event_id", event_id(F.col("event_type"), F.col("parent_event_id")))


def features(rows: DataFrame) -> DataFrame:
    """Measures of each bar's developing profile against its own and the prior value; null where prior or scale is missing.

    rows has the developing profile (histogram, total_volume, poc_tick, val_tick,
    vah_tick), the prior's ticks, price_tick (last admitted trade), close_tick, atr
    and minimum_tick.
    """
    now, scale, tick = F.col("price_tick"), F.col("atr"), F.col("minimum_tick")
    known = F.col("prior_vah_tick").isNotNull()

    def away(ref):
        return (now - F.col(ref)) * tick / scale

    w = Window.partitionBy(*SESSION).orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    beyond = (F.col("close_tick") < F.col("prior_val_tick")) | (F.col("close_tick") > F.col("prior_vah_tick"))

    def share(test):
        return F.aggregate(F.filter("histogram", test), F.lit(0.0), lambda s, x: s + x["volume"]) / F.col("total_volume")

    common = F.greatest(F.lit(0), F.least("vah_tick", "prior_vah_tick") - F.greatest("val_tick", "prior_val_tick") + 1)
    joint = F.greatest("vah_tick", "prior_vah_tick") - F.least("val_tick", "prior_val_tick") + 1
    mid = (F.col("vah_tick") + F.col("val_tick")) / 2 - (F.col("prior_vah_tick") + F.col("prior_val_tick")) / 2
    return (
        rows.withColumn("distance_to_current_poc_ticks", (now - F.col("poc_tick")).cast("double"))
        .withColumn("distance_to_current_poc_vol", away("poc_tick"))
        .withColumn("distance_to_prior_poc_vol", away("prior_poc_tick"))
        .withColumn("distance_to_vah_vol", away("prior_vah_tick"))
        .withColumn("distance_to_val_vol", away("prior_val_tick"))
        .withColumn("value_area_width_vol", F.when(known, (F.col("vah_tick") - F.col("val_tick")) * tick / scale))
        .withColumn("poc_migration_vol", (F.col("poc_tick") - F.col("prior_poc_tick")) * tick / scale)
        .withColumn("value_mid_migration_vol", mid * tick / scale)
        .withColumn("volume_above_poc_ratio", share(lambda x: x["tick"] > F.col("poc_tick")))
        .withColumn("volume_outside_value_ratio", F.when(known, share(lambda x: (x["tick"] < F.col("prior_val_tick")) | (x["tick"] > F.col("prior_vah_tick")))))
        .withColumn("bar_close_outside_value_ratio", F.when(known, F.avg(beyond.cast("double")).over(w)))
        .withColumn("profile_overlap_ratio", F.when(known, common / joint))
    )
