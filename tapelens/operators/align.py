"""Alignment of the three state tables with each auction row, and candidate events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import minutes_between
from ..functions.ids import list_id
from ..policy import PRODUCTION, Policy

SESSION = ("root", "contract_symbol", "session_id")


def _first_known(states: DataFrame) -> DataFrame:
    """Of states that became known at one instant the first one: the one that alignment takes."""
    w = Window.partitionBy(*SESSION, "available_at").orderBy("end")
    return states.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def align(auction: DataFrame, imsi: DataFrame, icm: DataFrame, iae: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """auction(session, end, measurement_ready, quality_flags) with the latest state of each kind of the same session, known and processed by then.

    Missing states stay null and the row is kept. States are (session, end,
    available_at, measurement_ready, quality_flags).
    """
    kinds = {f.name: f.dataType for f in auction.schema}
    rows = auction.select(*SESSION, F.col("end").alias("__at"), F.lit(1).alias("__side"), F.struct(*auction.columns).alias("__row"))
    names = {"imsi": imsi, "icm": icm, "iae": iae}
    for name, states in names.items():
        state = F.struct(F.col("end").alias("state_end"), "measurement_ready", "quality_flags").alias(name)
        rows = rows.unionByName(_first_known(states).select(*SESSION, F.col("end").alias("__at"), F.lit(0).alias("__side"), state), allowMissingColumns=True)
    # all states in one stream with the rows they are bound to: one sort, whatever their number
    so_far = Window.partitionBy(*SESSION).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    bound = rows.select("__row", "__side", *[F.last(n, ignorenulls=True).over(so_far).alias(n) for n in names]).filter("__side = 1")
    out = bound.select(*[F.col(f"__row.{c}").cast(kinds[c]).alias(c) for c in auction.columns], *names)
    return _judged(out, policy)


def _judged(out: DataFrame, policy: Policy) -> DataFrame:
    """Whether the bound states are there, fresh and ready, and the flags of all."""
    ages = {"imsi": policy.medium, "icm": policy.medium, "iae": policy.fast}
    here = {n: F.col(n).isNotNull() for n in ages}
    fresh = {n: F.coalesce(minutes_between(F.col(f"{n}.state_end"), F.col("end")).between(0, m), F.lit(False)) for n, m in ages.items()}
    ready = {n: F.coalesce(F.col(f"{n}.measurement_ready"), F.lit(False)) for n in ages}
    out = out.withColumn("present", here["imsi"] & here["icm"] & here["iae"]).withColumn("fresh", fresh["imsi"] & fresh["icm"] & fresh["iae"])
    out = out.withColumn("ready", F.col("present") & F.col("fresh") & F.col("measurement_ready") & ready["imsi"] & ready["icm"] & ready["iae"])

    def prefixed(flags, source: str):
        own = lambda f: f.startswith("DATA:") | f.startswith("ROLL:") | f.startswith("SESSION:")
        return F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.when(own(f), f).otherwise(F.concat(F.lit(f"{source}:"), f)))

    component = prefixed(F.col("quality_flags"), "AUCTION")
    blocking = [F.when(~F.col("measurement_ready"), "AUCTION:MEASUREMENT_NOT_READY")]
    marks = []
    for n in ages:
        upper = n.upper()
        component = F.array_union(component, prefixed(F.col(f"{n}.quality_flags"), upper))
        marks += [F.when(~here[n], f"{upper}:MISSING"), F.when(here[n] & ~fresh[n], f"{upper}:STALE")]
        blocking.append(F.when(here[n] & ~ready[n], f"{upper}:MEASUREMENT_NOT_READY"))
    both = F.array_compact(F.array(*marks))
    out = out.withColumn("component_quality_flags", F.array_sort(F.array_union(component, both)))
    out = out.withColumn("blocking_quality_flags", F.array_sort(F.array_union(both, F.array_compact(F.array(*blocking)))))
    out = out.withColumn("all_quality_flags", F.array_sort(F.array_union("component_quality_flags", "blocking_quality_flags")))
    bound = [F.date_format(F.col(f"{n}.state_end"), "yyyy-MM-dd'T'HH:mm:ss") for n in ages]
    gap = [F.col("gap_id")] if "gap_id" in out.columns else []
    return out.withColumn("synergy_id", list_id("synergy", [F.col("auction_id"), *bound, *gap]))


def align_exact(synergy: DataFrame, states: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """synergy's rows of the bars of states(session, end, gap_id, measurement_ready, quality_flags), each bound to that state in place of the latest gap state.

    One row per state: a bar on which two gaps are first retested has two.
    """
    exact = states.select(*SESSION, "end", "gap_id", F.struct(F.col("end").alias("state_end"), "measurement_ready", "quality_flags").alias("exact"))
    rows = synergy.join(exact, [*SESSION, "end"]).withColumn("iae", F.col("exact")).drop("exact", "present", "fresh", "ready", "component_quality_flags", "blocking_quality_flags", "all_quality_flags", "synergy_id")
    return _judged(rows, policy)


def candidate_events(transition_events: DataFrame, retests: DataFrame, synergy: DataFrame, retest_synergy: DataFrame | None = None) -> DataFrame:
    """Transition events and first retests with the alignment of their bar; a retest has that of its own gap, where retest_synergy is given.

    retests has end, event_type, direction, parent_event_id (its gap), event_id.
    data_hash covers what the event was made from, so a replay gives it again.
    """
    columns = [*SESSION, "end", "event_id", "event_type", "direction", "parent_event_id"]
    taken = ["available_at", "auction_id", "synergy_id", "present", "fresh", "ready", *[F.col(n).isNotNull().alias(f"has_{n}") for n in ("imsi", "icm", "iae")]]
    bar = synergy.select(*SESSION, "end", *taken)
    if retest_synergy is None:
        out = transition_events.select(columns).unionByName(retests.select(columns)).join(bar, [*SESSION, "end"])
    else:
        own = retest_synergy.select(*SESSION, "end", F.col("gap_id").alias("parent_event_id"), *taken)
        out = transition_events.select(columns).join(bar, [*SESSION, "end"]).unionByName(retests.select(columns).join(own, [*SESSION, "end", "parent_event_id"]))
    made_of = [F.col("event_id"), F.col("auction_id"), F.col("synergy_id"), F.col("parent_event_id"), F.col("direction").cast("string")]
    return out.withColumn("research_ready", F.col("ready")).withColumn("data_hash", list_id("data", made_of))


def event_duplicates(events: DataFrame) -> DataFrame:
    """Event ids that were made more than once: an error in any run."""
    return events.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 1")
