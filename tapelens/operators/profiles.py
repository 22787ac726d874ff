"""Volume profiles: minute histograms, session and rolling profiles, point of control, value area, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import from_micros, micros, minute_end

SESSION = ("root", "contract_symbol", "session_id")


def minute_bins(admitted: DataFrame) -> DataFrame:
    """Admitted volume by session, minute end and tick: the table that all profiles are summed from."""
    rows = admitted.filter("admitted").withColumn("minute_end", minute_end(F.col("exchange_time")))
    return rows.groupBy(*SESSION, "session_type", "session_start", "minute_end", "tick").agg(F.sum("quantity").alias("volume"))


def _first_end(minutes: int) -> Column:
    """The first bar end at or after minute_end, on the grid that starts with the session, in microseconds."""
    step = minutes * 60_000_000
    start = micros(F.col("session_start"))
    return start + F.ceil((micros(F.col("minute_end")) - start) / F.lit(step)) * step


def developing(bins: DataFrame, bars: DataFrame, period: int) -> DataFrame:
    """(session, end, tick, volume): at each bar end the volume of the session so far; bars are of `period` minutes.

    Minutes are summed to the bar that takes them in, a running sum by tick gives
    each change of a tick's volume, and a change holds for the bars up to the next
    one. So rows are made once each: as many as the profiles have ticks.
    """
    ends = bars.select(*SESSION, "end", F.row_number().over(Window.partitionBy(*SESSION).orderBy("end")).alias("n"))
    listed = bars.groupBy(*SESSION).agg(F.array_sort(F.collect_list("end")).alias("ends"))  # the bars of one session
    summed = bins.groupBy(*SESSION, "tick", from_micros(_first_end(period)).alias("due")).agg(F.sum("volume").alias("volume"))
    # without trades a period has no bar; the next bar takes its minutes in
    placed = summed.join(listed, list(SESSION)).select(*SESSION, "tick", "volume", (F.size(F.filter("ends", lambda e: e < F.col("due"))) + 1).alias("n"), F.size("ends").alias("bars"))
    deltas = placed.filter("n <= bars").groupBy(*SESSION, "tick", "n", "bars").agg(F.sum("volume").alias("volume"))
    by_tick = Window.partitionBy(*SESSION, "tick").orderBy("n")
    held = deltas.select(*SESSION, "tick", "n", "bars", F.sum("volume").over(by_tick).alias("volume"), F.lead("n").over(by_tick).alias("until"))
    spread = held.select(*SESSION, "tick", "volume", F.explode(F.sequence("n", F.coalesce(F.col("until") - 1, F.col("bars")))).alias("n"))
    return spread.join(ends, [*SESSION, "n"]).select(*SESSION, "end", "tick", "volume")


def rolling(bins: DataFrame, bars: DataFrame, minutes: int, period: int) -> DataFrame:
    """(session, end, tick, volume): at each bar end the volume of the last `minutes` of the same session; bars are of `period` minutes.

    A minute goes to the ends it serves, minutes / period of them, so work grows with the minutes alone.
    """
    first, span = _first_end(period), minutes * 60_000_000
    last = micros(F.col("minute_end")) + span - 1
    served = bins.select(*SESSION, "tick", "volume", first.alias("first"), last.alias("last")).filter("first <= last")
    served = served.withColumn("at", F.explode(F.sequence("first", "last", F.lit(period * 60_000_000).cast("long"))))
    summed = served.groupBy(*SESSION, from_micros(F.col("at")).alias("end"), "tick").agg(F.sum("volume").alias("volume"))
    return summed.join(bars.select(*SESSION, "end"), [*SESSION, "end"])


def final(bins: DataFrame) -> DataFrame:
    """(session, tick, volume) of whole sessions."""
    return bins.groupBy(*SESSION, "tick").agg(F.sum("volume").alias("volume"))


def value_area(histogram: Column, poc: Column, target: Column) -> Column:
    """struct(lo, hi): from the point of control outward, each time to the larger side (both if equal), until the target is held.

    histogram is a sorted array of struct(tick, volume) without gaps filled: a tick
    that is not there has volume 0, and a stretch that is empty on both sides is
    crossed in one step. So the walk takes at most two steps for each entry.
    """
    n = F.size(histogram)
    at = F.size(F.filter(histogram, lambda x: x["tick"] < poc))
    start = F.struct(poc.alias("lo"), poc.alias("hi"), (at - 1).alias("below"), (at + 1).alias("above"), F.get(histogram, at)["volume"].alias("cum"))

    def step(s: Column, _: Column) -> Column:
        under, over = F.get(histogram, s["below"]), F.get(histogram, s["above"])  # null past an end
        # ticks to the next entry of each side
        down, up = s["lo"] - under["tick"], over["tick"] - s["hi"]
        v_down = F.when(under.isNotNull(), F.when(down == 1, under["volume"]).otherwise(0.0))
        v_up = F.when(over.isNotNull(), F.when(up == 1, over["volume"]).otherwise(0.0))
        empty = F.coalesce((down > 1) & (up > 1), F.lit(False))
        only_down, only_up = over.isNull() & under.isNotNull(), under.isNull() & over.isNotNull()
        take_down = only_down | F.coalesce(~empty & (v_down >= v_up), F.lit(False))
        take_up = only_up | F.coalesce(~empty & (v_up >= v_down), F.lit(False))
        far = F.least(down, up) - 1
        reach_down = F.when(empty, far).when(only_down, down).when(take_down, 1).otherwise(0)
        reach_up = F.when(empty, far).when(only_up, up).when(take_up, 1).otherwise(0)
        hit_down, hit_up = take_down & (reach_down == down), take_up & (reach_up == up)
        grown = F.struct(
            (s["lo"] - reach_down).cast("long").alias("lo"),
            (s["hi"] + reach_up).cast("long").alias("hi"),
            (s["below"] - hit_down.cast("int")).alias("below"),
            (s["above"] + hit_up.cast("int")).alias("above"),
            (s["cum"] + F.when(hit_down, under["volume"]).otherwise(0.0) + F.when(hit_up, over["volume"]).otherwise(0.0)).alias("cum"),
        )
        return F.when(s["cum"] < target, grown).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), 2 * n), start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def profiles(histograms: DataFrame, keys: list[str], fraction: float = 0.70) -> DataFrame:
    """One row per profile: keys, total_volume, poc_tick, val_tick, vah_tick, moments and the sorted histogram.

    Point of control: most volume, then nearest to the volume-weighted mean, then
    the lower tick. Entropy is over ln(ticks), skew and kurtosis are weighted
    (kurtosis 3 for a normal); a profile of one tick has null moments and the flag.
    """
    grouped = histograms.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("tick", "volume"))).alias("histogram"), F.sum("volume").alias("total_volume"), F.sum(F.col("tick") * F.col("volume")).alias("weighted")
    )
    h = F.col("histogram")
    out = grouped.withColumn("mean_tick", F.col("weighted") / F.col("total_volume"))
    best = F.array_min(F.transform(h, lambda x: F.struct((-x["volume"]).alias("v"), F.abs(x["tick"] - F.col("mean_tick")).alias("d"), x["tick"].alias("tick"))))
    out = out.withColumn("poc_tick", best["tick"]).withColumn("target", F.col("total_volume") * fraction)
    out = out.withColumn("area", value_area(h, F.col("poc_tick"), F.col("target")))
    out = out.withColumn("val_tick", F.col("area.lo")).withColumn("vah_tick", F.col("area.hi"))

    def weighted(f) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda s, x: s + x["volume"] * f(x["tick"])) / F.col("total_volume")

    out = out.withColumn("variance", weighted(lambda t: (t - F.col("mean_tick")) * (t - F.col("mean_tick"))))
    entropy = -F.aggregate(h, F.lit(0.0), lambda s, x: s + x["volume"] / F.col("total_volume") * F.log(x["volume"] / F.col("total_volume"))) / F.log(F.size(h).cast("double"))
    out = out.withColumn("profile_entropy", F.when(F.size(h) == 1, 0.0).otherwise(entropy))
    deviation = F.sqrt("variance")
    spread = F.col("variance") > 0
    for name, power in (("profile_skew", 3), ("profile_kurtosis", 4)):
        out = out.withColumn(name, F.when(spread, weighted(lambda t, p=power: F.pow((t - F.col("mean_tick")) / deviation, F.lit(p)))))
    return out.withColumn("degenerate", ~spread).drop("area", "target", "weighted", "variance")


def volume_conservation(profiles: DataFrame, admitted: DataFrame) -> DataFrame:
    """Sessions whose final profile does not hold the admitted volume."""
    volume = admitted.filter("admitted").groupBy(*SESSION).agg(F.sum("quantity").alias("admitted_volume"))
    both = profiles.select(*SESSION, "total_volume").join(volume, list(SESSION), "full")
    wrong = F.abs(F.coalesce("total_volume", F.lit(0.0)) - F.coalesce("admitted_volume", F.lit(0.0))) > 1e-12 * F.coalesce("admitted_volume", F.lit(1.0))
    return both.filter(wrong)


def final_profiles(admitted: DataFrame, bins: DataFrame | None = None, fraction: float = 0.70) -> DataFrame:
    """Final profiles with as_of (the session's end, or a later last trade) and available_at (the first arrival of the contract's next session).

    The contract's last session has no next arrival and a null available_at.
    """
    shape = profiles(final(minute_bins(admitted) if bins is None else bins), list(SESSION), fraction)
    ends = admitted.groupBy(*SESSION, "session_type", "session_start", "session_end").agg(
        F.min("available_at").alias("first_at"), F.max(F.when(F.col("admitted"), F.col("exchange_time"))).alias("last_trade")
    )
    by_contract = Window.partitionBy("root", "contract_symbol").orderBy("session_start")
    ends = ends.withColumn("available_at", F.lead("first_at").over(by_contract)).withColumn("as_of", F.greatest("last_trade", "session_end"))
    return shape.join(ends.drop("first_at", "last_trade"), list(SESSION))


