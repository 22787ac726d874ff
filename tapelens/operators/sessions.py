"""Sessions: which window of the exchange's day an instant lies in, its id, bounds and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import micros, seconds_of_day, to_local, to_utc
from ..functions.ids import content_id
from ..sources.dims import session_windows
from ..storage import dimension


def _local_to_utc(date, seconds, zone):
    return to_utc(F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + seconds.cast("long") * 1_000_000).cast("timestamp_ntz"), zone)


def with_session(rows: DataFrame, at: str = "exchange_time", windows: DataFrame | None = None, closures: DataFrame | None = None) -> DataFrame:
    """rows(root, at, ...) with session_name, session_type, session_id, session_start and session_end.

    The windows of a root cover its whole exchange day, half-open, so each row
    gets one; rows of unknown roots are dropped. An instant inside a closure is of
    type `closed` and has no bounds; other bounds are clipped to the open stretch
    between closures. Both dimensions are a few rows a root and are broadcast.
    """
    fit = F.broadcast if windows is None else dimension  # the library's own windows are some forty rows
    windows = session_windows(rows.sparkSession) if windows is None else windows
    # one row a root and zone with its windows, so that a row's clock is converted once and not for each window
    w = windows.groupBy(F.col("root").alias("w_root"), "zone").agg(F.collect_list(F.struct("session_name", "session_type", "start_sec", "end_sec", "crosses_midnight", "policy_version")).alias("w"))
    out = rows.join(fit(w), F.col("root") == F.col("w_root")).withColumn("local", to_local(F.col(at), F.col("zone"))).withColumn("sod", seconds_of_day(F.col("local")))

    def inside(x):
        after, before = F.col("sod") >= x["start_sec"], F.col("sod") < x["end_sec"]
        return F.when(x["crosses_midnight"], after | before).otherwise(after & before)

    own = ("local", "sod", "w", "w_root")
    out = out.withColumn("hit", F.explode(F.filter("w", inside))).select(*[c for c in out.columns if c not in own], "local", "sod", "hit.*")
    early = F.col("crosses_midnight") & (F.col("sod") < F.col("end_sec"))
    out = out.withColumn("anchor", F.date_sub(F.to_date("local"), early.cast("int")))
    out = out.withColumn("session_start", _local_to_utc(F.col("anchor"), F.col("start_sec"), F.col("zone")))
    out = out.withColumn("session_end", _local_to_utc(F.date_add("anchor", F.col("crosses_midnight").cast("int")), F.col("end_sec"), F.col("zone")))
    if closures is not None:
        out = _apply_closures(out, at, closures)
    fields = {k: F.col(k) for k in ("root", "session_name", "session_type", "policy_version")} | {"anchor_date": F.date_format("anchor", "yyyy-MM-dd")}
    out = out.withColumn("session_id", content_id("session", fields))
    return out.drop("zone", "start_sec", "end_sec", "crosses_midnight", "policy_version", "local", "sod", "anchor")


def _apply_closures(out: DataFrame, at: str, closures: DataFrame) -> DataFrame:
    """Closures of the days around each row as UTC intervals; they close rows and clip sessions."""
    c = closures.select(
        F.col("root").alias("c_root"),
        F.struct(
            F.col("local_date").alias("d"), F.when(F.col("all_day"), 0).otherwise(F.col("start_sec")).alias("a"), F.when(F.col("all_day"), 86400).otherwise(F.col("end_sec")).alias("b"),
            "exception_name", "closure_name", "calendar_version",
        ).alias("c"),
    ).groupBy("c_root").agg(F.collect_list("c").alias("cs"))  # a calendar of some dozen entries a root
    out = out.join(dimension(c), F.col("root") == F.col("c_root"), "left").drop("c_root")
    t = micros(F.col("local"))

    def edge(x, part):
        return F.unix_micros(x["d"].cast("timestamp")) + x[part].cast("long") * 1_000_000

    none = F.coalesce("cs", F.array().cast(out.schema["cs"].dataType))
    out = out.withColumn("cs", none)
    hit = F.filter("cs", lambda x: (edge(x, "a") <= t) & (t < edge(x, "b")))
    before = F.array_max(F.transform(F.filter("cs", lambda x: edge(x, "b") <= t), lambda x: edge(x, "b")))
    after = F.array_min(F.transform(F.filter("cs", lambda x: edge(x, "a") > t), lambda x: edge(x, "a")))
    utc = lambda x: to_utc(F.timestamp_micros(x).cast("timestamp_ntz"), F.col("zone"))
    out = out.withColumn("hit", F.get(hit, F.lit(0)))
    out = out.withColumn("session_start", F.when(F.col("hit").isNull(), F.greatest("session_start", utc(before))))
    out = out.withColumn("session_end", F.when(F.col("hit").isNull(), F.least("session_end", utc(after))))
    closed = F.col("hit").isNotNull()
    out = out.withColumn("session_name", F.when(closed, F.concat(F.lit("calendar_exception:"), "hit.exception_name", F.lit(":"), "hit.closure_name")).otherwise(F.col("session_name")))
    out = out.withColumn("session_type", F.when(closed, "closed").otherwise(F.col("session_type")))
    out = out.withColumn("policy_version", F.when(closed, F.concat("policy_version", F.lit("|"), "hit.calendar_version")).otherwise(F.col("policy_version")))
    return out.withColumn("anchor", F.when(closed, F.col("hit.d")).otherwise(F.col("anchor"))).drop("cs", "hit")


def slot(start, session_start, period_minutes: int):
    """The place of a bar in its session, from 0."""
    return F.floor((micros(start) - micros(session_start)) / F.lit(period_minutes * 60_000_000)).cast("int")


def session_counts(rows: DataFrame, at: str = "exchange_time") -> DataFrame:
    """Rows and distinct minutes of each root and session type."""
    minute = F.date_trunc("minute", F.col(at).cast("timestamp"))
    return rows.groupBy("root", "session_type").agg(F.count("*").alias("n_rows"), F.count_distinct(minute).alias("n_minutes"))


def session_overlaps(windows: DataFrame) -> DataFrame:
    """Faults of a window table: overlaps of a root's windows, several zones or versions, a midnight mark that does not fit the times."""
    parts = windows.select(
        "root", "session_name",
        F.explode(
            F.when(F.col("crosses_midnight"), F.array(F.struct(F.col("start_sec").alias("a"), F.lit(86400).alias("b")), F.struct(F.lit(0).alias("a"), F.col("end_sec").alias("b"))))
            .otherwise(F.array(F.struct(F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))))
        ).alias("x"),
    ).select("root", "session_name", "x.a", "x.b")
    before = F.max("b").over(Window.partitionBy("root").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    overlap = parts.withColumn("before", before).filter("before > a").select("root", "session_name", F.lit("overlap").alias("fault"))
    wrong = windows.filter(F.col("crosses_midnight") != (F.col("end_sec") < F.col("start_sec"))).select("root", "session_name", F.lit("midnight_mark").alias("fault"))
    mixed = windows.groupBy("root").agg(F.count_distinct("zone").alias("z"), F.count_distinct("policy_version").alias("v")).filter("z > 1 or v > 1")
    return overlap.unionByName(wrong).unionByName(mixed.select("root", F.lit(None).cast("string").alias("session_name"), F.lit("mixed_policy").alias("fault")))


def closure_overlaps(closures: DataFrame) -> DataFrame:
    """Faults of a closure table (root, exception_name, local_date, closure_name, start_sec, end_sec, all_day): those that begin before an earlier one of their root has ended.

    A closure that ends at or before its start ends on the next day, an all-day one at
    the next midnight. fault is overlap within one exception, or exceptions_overlap.
    """
    day = F.unix_date("local_date").cast("long") * 86_400
    begin = day + F.when(F.col("all_day"), 0).otherwise(F.col("start_sec"))
    end = day + F.when(F.col("all_day"), 86_400).otherwise(F.col("end_sec") + F.when(F.col("end_sec") <= F.col("start_sec"), 86_400).otherwise(0))
    past = Window.partitionBy("root").orderBy("begin", "end", "exception_name", "closure_name").rowsBetween(Window.unboundedPreceding, -1)
    rows = closures.withColumns({"begin": begin, "end": end}).withColumn("before", F.max(F.struct("end", "exception_name")).over(past))
    fault = F.when(F.col("before.exception_name") == F.col("exception_name"), "overlap").otherwise("exceptions_overlap")
    return rows.filter(F.col("begin") < F.col("before.end")).select("root", "exception_name", "local_date", "closure_name", F.col("before.exception_name").alias("with_exception"), fault.alias("fault"))
