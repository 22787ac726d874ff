"""Coverage, quality and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dimension


def coverage_by_dim(events: DataFrame) -> DataFrame:
    """Event counts by month, contract, type, root and session type, in one grouping-sets aggregate."""
    e = events.select(F.date_format("end", "yyyy-MM").alias("month"), "contract_symbol", "event_type", "root", F.coalesce("session_type", F.lit("unknown")).alias("session_type"))
    dims = ["month", "contract_symbol", "event_type", "root", "session_type"]
    grouped = e.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.coalesce(*[F.when(F.col("g") == sum(1 << (4 - j) for j in range(5) if j != i), d) for i, d in enumerate(dims)])
    return grouped.select(name.alias("dim"), F.coalesce(*dims).alias("value"), "n")


def coverage_totals(events: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    everything = F.col("has_imsi") & F.col("has_icm") & F.col("has_iae")
    totals = events.agg(
        F.count("*").alias("raw_events"), F.count_distinct("event_id").alias("unique_events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("parent_event_id").alias("parents"),
        *[count(F.col(f"has_{n}")).alias(f"with_{n}") for n in ("imsi", "icm", "iae")], *[count(~F.col(f"has_{n}")).alias(f"missing_{n}") for n in ("imsi", "icm", "iae")],
        count(everything).alias("all_present"), count(F.col("ready")).alias("ready"), count(~F.col("ready")).alias("not_ready"),
    )
    # without sessions there is nothing to share events among
    return totals.withColumn("events_per_session", F.when(F.col("sessions") > 0, F.col("raw_events") / F.col("sessions")).otherwise(0.0))


def reconcile(totals: DataFrame) -> DataFrame:
    """Faults of a coverage row: counts that do not add up."""
    faults = {"raw_is_unique": F.col("raw_events") != F.col("unique_events"), "ready_adds_up": F.col("ready") + F.col("not_ready") != F.col("unique_events")}
    faults |= {f"{n}_adds_up": F.col(f"with_{n}") + F.col(f"missing_{n}") != F.col("unique_events") for n in ("imsi", "icm", "iae")}
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), c.cast("int").alias("failed")) for k, c in faults.items()])
    return totals.select(F.inline(rows))


def flag_histogram(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """How often each quality flag occurs in each table of (name, rows with quality_flags)."""
    parts = [df.select(F.lit(n).alias("source"), F.explode("quality_flags").alias("flag")) for n, df in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "flag").agg(F.count("*").alias("n"))


def minute_gaps(trades: DataFrame) -> DataFrame:
    """Per root: distinct minutes, and stretches of more than one minute between neighbours, counted but not judged."""
    minutes = trades.select("root", F.date_trunc("minute", F.col("exchange_time").cast("timestamp")).alias("m")).distinct()
    step = (F.unix_seconds("m") - F.unix_seconds(F.lag("m").over(Window.partitionBy("root").orderBy("m")))) / 60
    return minutes.withColumn("step", step).groupBy("root").agg(F.count("*").alias("minutes"), F.count_if(F.col("step") > 1).alias("gaps"), F.coalesce(F.max("step"), F.lit(0.0)).alias("longest_gap_minutes"))


def probe_coverage(trades: DataFrame, gaps: DataFrame, markets: DataFrame) -> DataFrame:
    """Per market: first and last time, rows, gaps, contracts, flags and status (no rows: REJECTED, any flag: PARTIAL, else VALID)."""
    seen = trades.groupBy("root").agg(
        F.min("exchange_time").alias("first_time"), F.max("exchange_time").alias("last_time"), F.count("*").alias("n_rows"), F.count_distinct("contract_symbol").alias("contracts"),
        F.count_if(F.array_contains("source_flags", "SOURCE_SUSPICIOUS")).alias("suspicious"),
    )
    out = dimension(markets.select("root", "minimum_tick", "multiplier")).join(seen, "root", "left").join(gaps.select("root", "gaps"), "root", "left")
    n = F.coalesce("n_rows", F.lit(0))
    flags = F.array_sort(F.array_compact(F.array(F.when(n == 0, "NO_ROWS"), F.when(F.col("gaps") > 0, "MINUTE_GAPS"), F.when(F.col("suspicious") > 0, "SUSPICIOUS_ROWS"), F.when(F.col("contracts") > 1, "SEVERAL_CONTRACTS"))))
    status = F.when(n == 0, "REJECTED").when(F.size(flags) > 0, "PARTIAL").otherwise("VALID")
    return out.select("root", "minimum_tick", "multiplier", "first_time", "last_time", n.alias("n_rows"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("contracts", F.lit(0)).alias("contracts"), flags.alias("flags"), status.alias("status"))


def delivery_audit(schedule: DataFrame, roots: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Each scheduled release and root with its last delivery of that day, and whether it came before the official time; absent ones are flagged.

    schedule(release_date, official_time) and roots(root) are the audit grid, of a
    few hundred rows; deliveries(root, release_date, delivered_at).
    """
    last = deliveries.groupBy("root", "release_date").agg(F.max("delivered_at").alias("delivered_at"))
    grid = schedule.crossJoin(dimension(roots))  # dates x roots: both are dimensions
    out = last.join(dimension(grid), ["root", "release_date"], "right")
    return out.select(
        "root", "release_date", "official_time", "delivered_at", F.coalesce(F.col("delivered_at") < F.col("official_time"), F.lit(False)).alias("delivery_precedes_official"),
        F.when(F.col("delivered_at").isNull(), "delivery_absent").alias("flag"),
    )


def delivery_summary(positions: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Per key: rows, first and last delivery, non-null observations of the fields, and the fields that were ever null."""
    n = sum((F.count(c) for c in fields[1:]), F.count(fields[0]))
    nulls = F.array_compact(F.array(*[F.when(F.count_if(F.col(c).isNull()) > 0, c) for c in fields]))
    return positions.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("delivered_at").alias("first_delivery"), F.max("delivered_at").alias("last_delivery"), n.alias("observations"), F.array_sort(nulls).alias("null_fields"))


def open_interest_coverage(rows: DataFrame) -> DataFrame:
    """rows(root, contract_symbol, day, open_interest, expiry): what of open interest and expiries was ever seen."""
    seen = F.struct("contract_symbol", "day")
    return rows.groupBy("root").agg(
        (F.count("open_interest") > 0).alias("any_open_interest"), F.count_distinct(seen).alias("contract_days"), F.count_distinct(F.when(F.col("open_interest").isNotNull(), seen)).alias("contract_days_with_oi"),
        F.sort_array(F.collect_set("expiry")).alias("expiries"),
    )


def market_evidence(trades: DataFrame, mappings: DataFrame, interest: DataFrame, gaps: DataFrame) -> DataFrame:
    """What a run has seen of each root: times, contracts, sessions, roll states, mapping changes, open interest, expiries, gaps, and flags for what is missing.

    trades(root, contract_symbol, session_type, roll_state, exchange_time),
    mappings(root, observed_at), interest as of open_interest_coverage(), gaps as of
    minute_gaps(). Only the trades are large; each part is one aggregate by root.
    """
    seen = trades.groupBy("root").agg(
        F.min("exchange_time").alias("first_time"), F.max("exchange_time").alias("last_time"), F.count("*").alias("n_rows"), F.sort_array(F.collect_set("contract_symbol")).alias("contracts"),
        F.sort_array(F.collect_set("session_type")).alias("session_types"), F.sort_array(F.collect_set("roll_state")).alias("roll_states"),
    )
    mapped = mappings.groupBy("root").agg(F.count("*").alias("mapping_events"), F.min("observed_at").alias("first_mapping_time"), F.max("observed_at").alias("last_mapping_time"))
    out = seen.join(mapped, "root", "left").join(open_interest_coverage(interest), "root", "left").join(gaps.select("root", "gaps"), "root", "left")
    flags = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.coalesce("contract_days_with_oi", F.lit(0)) == 0, "NO_OPEN_INTEREST_OBSERVATION"), F.when(F.size(F.coalesce("expiries", F.array().cast("array<string>"))) == 0, "NO_CONTRACT_EXPIRY_OBSERVED"),
                F.when(F.size("session_types") == 0, "NO_SESSION_OBSERVED"), F.when(F.size("roll_states") == 0, "NO_ROLL_STATE_OBSERVED"), F.when(F.col("mapping_events").isNull(), "NO_MAPPING_EVENT_OBSERVED"), F.when(F.col("gaps") > 0, "MINUTE_GAPS"),
            )
        )
    )
    return out.withColumn("mapping_events", F.coalesce("mapping_events", F.lit(0))).withColumn("flags", flags)


def auction_clock_faults(states: DataFrame, priors: DataFrame) -> DataFrame:
    """(rule, violations) of auction rows: a prior profile of another contract or that is not over, a row that was known before its bar or after a later one.

    states(root, contract_symbol, session_id, end, available_at, prior_session_id),
    priors(root, contract_symbol, session_id, as_of): the final profiles.
    """
    from .bars import check_table

    prior = priors.select("root", "contract_symbol", F.col("session_id").alias("prior_session_id"), F.col("as_of").alias("prior_as_of"))
    last = Window.partitionBy("root", "contract_symbol").orderBy("end")
    rows = states.withColumn("before", F.lag("available_at").over(last)).join(prior, ["root", "contract_symbol", "prior_session_id"], "left")
    rules = {
        "known_before_its_bar": F.col("available_at") < F.col("end"),
        "prior_of_another_contract": F.col("prior_session_id").isNotNull() & F.col("prior_as_of").isNull(),
        "prior_not_over": F.coalesce(F.col("prior_as_of") >= F.col("end"), F.lit(False)),
        "known_before_an_earlier_bar": F.coalesce(F.col("available_at") < F.col("before"), F.lit(False)),
    }
    return check_table(rows, rules)
