"""Readers of side sources: roll evidence, weekly positions, release schedules. Rows that break a rule come back as faults, never mended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clocks import to_utc
from .dims import NEW_YORK

#: The fields of a weekly position row.
POSITION_FIELDS = (
    "asset_manager_long", "asset_manager_short", "asset_manager_spread", "dealer_long", "dealer_short", "dealer_spread", "leveraged_funds_long", "leveraged_funds_short", "leveraged_funds_spread",
    "non_reportable_long", "non_reportable_short", "open_interest", "other_reportable_long", "other_reportable_short", "other_reportable_spread",
)
ROLL_SCHEMA = "root string, old_mapped_symbol string, new_mapped_symbol string, observed_at_utc string, effective_at_utc string, _corrupt_record string"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def _instant(text: str):
    """The UTC instant of ISO-8601 text with an offset, else null: a clock without one is never guessed."""
    return F.when(F.col(text).rlike(_ISO), F.try_to_timestamp(F.col(text)).cast("timestamp_ntz"))


def roll_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, faults) of raw roll rows, whose clocks are text.

    mappings(root, old_mapped_symbol, new_mapped_symbol, observed_at, effective_at)
    are the rows without a fault; faults(root, observed_at_utc, fault) names a blank
    field, a clock that is no ISO-8601 text with an offset, two symbols that are one,
    or a row that stands before an earlier one of its root (by the place that
    `position` gives, where it is there).
    """
    clocks = rows.withColumn("observed_at", _instant("observed_at_utc")).withColumn("effective_at", _instant("effective_at_utc"))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    fault = (
        F.when(blank("root") | blank("new_mapped_symbol"), "blank_field")
        .when(F.trim("old_mapped_symbol") == "", "blank_old_symbol")
        .when(F.col("observed_at").isNull() | F.col("effective_at").isNull(), "clock_not_iso_8601_with_offset")
        .when(F.col("old_mapped_symbol") == F.col("new_mapped_symbol"), "symbol_unchanged")
    )
    if "position" in rows.columns:
        before = F.max("observed_at").over(Window.partitionBy("root").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
        fault = fault.when(F.col("observed_at") < before, "out_of_order")
    judged = clocks.withColumn("fault", fault)
    good = judged.filter("fault is null").select("root", "old_mapped_symbol", "new_mapped_symbol", "observed_at", "effective_at")
    return good, judged.filter("fault is not null").select("root", "observed_at_utc", "fault")


def read_roll_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """roll_evidence() of JSON lines with a `position` in each; lines that cannot be read are faults too."""
    raw = spark.read.schema(ROLL_SCHEMA + ", position long").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return roll_evidence(raw.drop("_corrupt_record"))


def positions(rows: DataFrame) -> DataFrame:
    """Weekly positions from raw rows: the two source clocks, naive New York time, as UTC, the delivery clock in UTC as it is, the release day in New York.

    rows(root, data_time, data_end_time, delivered_at, and the position fields, each
    nullable); a field that is missing is null, never 0.
    """
    zone = F.lit(NEW_YORK)
    fields = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in POSITION_FIELDS]
    return rows.select(
        "root", to_utc(F.col("data_time"), zone).alias("data_time"), to_utc(F.col("data_end_time"), zone).alias("data_end_time"), "delivered_at", F.to_date("data_end_time").alias("release_date"), *fields
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """positions() of a Parquet table."""
    schema = "root string, data_time timestamp_ntz, data_end_time timestamp_ntz, delivered_at timestamp_ntz, " + ", ".join(f"{c} double" for c in POSITION_FIELDS)
    return positions(spark.read.schema(schema).parquet(path))


def release_schedule(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schedule, faults) of rows(observation_date, release_date, delayed_dates, manual_exception): one release for each observation at 15:30 New York time.

    delayed_dates lists the release days that a holiday moved. A date with two rows,
    a release before its observation and an exception before its release are faults.
    """
    at = F.timestamp_micros(F.unix_micros(F.col("release_date").cast("timestamp")) + F.lit((15 * 3600 + 30 * 60) * 1_000_000)).cast("timestamp_ntz")
    timed = rows.withColumn("release_time", to_utc(at, F.lit(NEW_YORK))).withColumn("holiday_delayed", F.coalesce(F.array_contains("delayed_dates", F.col("release_date")), F.lit(False)))
    n = F.count("*").over(Window.partitionBy("observation_date"))
    fault = (
        F.when(n > 1, "two_rows_of_a_date")
        .when(F.col("release_date") < F.col("observation_date"), "release_before_observation")
        .when(F.col("manual_exception") < F.col("release_time"), "exception_before_release")
    )
    judged = timed.withColumn("fault", fault)
    columns = ["observation_date", "release_time", "holiday_delayed", "manual_exception"]
    return judged.filter("fault is null").select(columns), judged.filter("fault is not null").select(*columns, "fault")


def read_release_schedule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """release_schedule() of a JSON file {"releases": {"yyyy-MM": [days]}, "holiday_delayed_release_dates": [dates]}: releases of Tuesday observations.

    A release belongs to the last Tuesday that is three days before it or more, so
    one that a holiday moved on keeps its observation.
    """
    raw = spark.read.option("multiLine", True).schema("releases map<string, array<int>>, holiday_delayed_release_dates array<date>").json(path)
    days = raw.select("holiday_delayed_release_dates", F.explode("releases").alias("month", "days")).select("holiday_delayed_release_dates", "month", F.explode("days").alias("day"))
    dated = days.select(F.to_date(F.concat("month", F.lit("-"), F.lpad(F.col("day").cast("string"), 2, "0"))).alias("release_date"), F.col("holiday_delayed_release_dates").alias("delayed_dates"))
    back = F.pmod(F.weekday(F.date_sub("release_date", 3)) - 1, F.lit(7))
    return release_schedule(dated.select(F.expr("date_sub(release_date, 3)").alias("x"), back.alias("back"), "release_date", "delayed_dates").select(F.expr("date_sub(x, back)").alias("observation_date"), "release_date", "delayed_dates", F.lit(None).cast("timestamp_ntz").alias("manual_exception")))
