"""Point-in-time normalization of raw records, and the gate that releases them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import utc_text
from ..functions.ids import canonical_json
from ..storage import dimension


def usable_from(raw: DataFrame, manual: Column | None = None) -> DataFrame:
    """raw with usable_from: the latest of release, vendor receipt (if any), delivery and a manual exception."""
    clocks = [F.col("release_time"), F.col("vendor_time"), F.col("delivery_time")] + ([manual] if manual is not None else [])
    known = F.col("release_time").isNotNull() & F.col("delivery_time").isNotNull()
    return raw.withColumn("usable_from", F.when(known, F.greatest(*clocks)))


def weekly_rule(raw: DataFrame) -> DataFrame:
    """raw with rule_fault: an observation that is no Tuesday, a release that is no Friday, or one before its observation; null if it fits."""
    fault = (
        F.when(F.col("release_time").isNull(), "release_missing")
        .when(F.weekday("observation_time") != 1, "observation_not_tuesday")
        .when(F.weekday("release_time") != 4, "release_not_friday")
        .when(F.col("release_time") < F.col("observation_time"), "release_before_observation")
    )
    return raw.withColumn("rule_fault", fault)


def scheduled_release(raw: DataFrame, schedule: DataFrame) -> DataFrame:
    """raw with scheduled_time and schedule_fault: unscheduled, or another time than scheduled. The schedule is one row a date and is broadcast."""
    s = schedule.select(F.col("observation_date").alias("s_date"), F.col("release_time").alias("scheduled_time"))
    out = raw.join(dimension(s), F.to_date("observation_time") == F.col("s_date"), "left").drop("s_date")
    return out.withColumn("schedule_fault", F.when(F.col("scheduled_time").isNull(), "unscheduled").when(~F.col("release_time").eqNullSafe(F.col("scheduled_time")), "release_differs"))


def lineage_hash(dataset: Column, observation: Column, payload: Column, series: Column, version: Column) -> Column:
    text = canonical_json({"dataset_id": dataset, "observation_time_utc": utc_text(observation), "payload": payload, "series_id": series, "source_version": version})
    return F.sha2(text.cast("binary"), 256)


def quality_status(flags: Column, missing: Column) -> Column:
    return F.when(missing.isNotNull(), "WITHHELD").when(F.size(flags) > 0, "PARTIAL").otherwise("VALID")


def normalize(raw: DataFrame, policies: DataFrame, retrieved_at: Column) -> DataFrame:
    """Point-in-time rows: clocks, flags, status and lineage; records of unknown datasets or without a release are left out (see rejected()).

    raw(dataset_id, series_id, observation_time, release_time, vendor_time,
    delivery_time, source_version, value string); policies(dataset_id, extra_flag)
    is one row a dataset and is broadcast. A missing value is withheld, never filled.
    """
    out = usable_from(raw.join(dimension(policies), "dataset_id")).filter("usable_from is not null")
    flags = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit("dataset_certification_under_review"), F.col("extra_flag"), F.when(F.col("vendor_time").isNull(), "vendor_receipt_unavailable")))))
    out = out.withColumn("quality_flags", flags).withColumn("missing_reason", F.when(F.col("value").isNull(), "policy_normalized_value_missing"))
    out = out.withColumn("quality_status", quality_status(F.col("quality_flags"), F.col("missing_reason"))).withColumn("revision_id", F.lit(None).cast("string"))
    out = out.withColumn("retrieved_at", retrieved_at)
    return out.withColumn("lineage_hash", lineage_hash(F.col("dataset_id"), F.col("observation_time"), F.col("value"), F.col("series_id"), F.col("source_version"))).drop("extra_flag")


def rejected(raw: DataFrame, policies: DataFrame) -> DataFrame:
    """The records that normalize() leaves out, with the reason."""
    known = raw.join(dimension(policies.select("dataset_id", F.lit(True).alias("known"))), "dataset_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown_dataset").when(F.col("release_time").isNull(), "release_missing").when(F.col("delivery_time").isNull(), "delivery_missing")
    return known.withColumn("reason", reason).filter("reason is not null").drop("known")


def clock_violations(pit: DataFrame) -> DataFrame:
    """(rule, violations) of the clock order."""
    rules = {
        "delivery_after_usable": F.col("delivery_time") > F.col("usable_from"),
        "vendor_after_usable": F.coalesce(F.col("vendor_time") > F.col("usable_from"), F.lit(False)),
        "release_after_usable": F.col("release_time") > F.col("usable_from"),
        "retrieved_before_delivery": F.col("retrieved_at") < F.col("delivery_time"),
    }
    counted = pit.select(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))


def quality_upgrades(source: DataFrame, out: DataFrame) -> DataFrame:
    """Rows whose source was stale, withheld or rejected and that came out valid or partial."""
    joined = source.select("lineage_hash", F.col("quality_status").alias("source_status")).join(out.select("lineage_hash", "quality_status"), "lineage_hash")
    return joined.filter("source_status in ('STALE', 'WITHHELD', 'REJECTED') and quality_status in ('VALID', 'PARTIAL')")


def release(pit: DataFrame, now: Column) -> DataFrame:
    """The rows usable by now, stamped with it, in release order."""
    out = pit.filter(F.col("usable_from") <= now).withColumn("released_at", now)
    return out.orderBy("usable_from", "dataset_id", "series_id", "observation_time", "lineage_hash")


def pending(pit: DataFrame, now: Column) -> DataFrame:
    waits = F.col("usable_from") > now
    return pit.agg(F.count_if(waits).alias("n_pending"), F.min(F.when(waits, F.col("usable_from"))).alias("earliest_pending"))


def duplicate_lineage(pit: DataFrame) -> DataFrame:
    return pit.groupBy("lineage_hash").agg(F.count("*").alias("n")).filter("n > 1")
