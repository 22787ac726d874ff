"""Session-anchored trade bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import from_micros, micros, plus_minutes

SESSION = ("root", "contract_symbol", "session_id", "session_name", "session_type", "session_start", "session_end")


def bucketed(trades: DataFrame, minutes: int) -> DataFrame:
    """trades with the start and end of their bucket, counted from the session's start."""
    step = minutes * 60_000_000
    t, start = micros(F.col("exchange_time")), micros(F.col("session_start"))
    bucket = from_micros(start + F.floor((t - start) / F.lit(step)) * step)
    return trades.withColumn("start", bucket).withColumn("end", plus_minutes(F.col("start"), minutes))


def closings(admitted: DataFrame) -> DataFrame:
    """(session, next_arrival, next_at): the first arrival of the contract's next session, which closes the last bars of a session."""
    first = admitted.groupBy("root", "contract_symbol", "session_id").agg(F.min("arrival").alias("first_arrival"), F.min_by("available_at", "arrival").alias("first_at"))
    w = Window.partitionBy("root", "contract_symbol").orderBy("first_arrival")
    return first.select("root", "contract_symbol", "session_id", F.lead("first_arrival").over(w).alias("later_arrival"), F.lead("first_at").over(w).alias("later_at"))


def bars(admitted: DataFrame, minutes: int, finalize_at=None) -> DataFrame:
    """OHLCV bars of admitted trades with the time from which each could be known.

    A bar is known when the first trade, admitted or not, arrives at or after its
    end, at the earliest at its end; closed_by is that trade's arrival. The last
    bars of a contract, which no trade closes, come only with finalize_at (a
    timestamp_ntz column), if they are due then. A bucket that ends after its
    session gives no bar. Arrivals are looked at within a session, so a window
    holds a session's ticks; what comes after a session is a join of session rows.
    """
    arrivals = Window.partitionBy("root", "contract_symbol", "session_id").orderBy("arrival")
    rows = bucketed(admitted, minutes).withColumn("next", F.lead(F.struct("arrival", "available_at")).over(arrivals)).filter(F.col("end") <= F.col("session_end"))
    ok = F.col("admitted")
    out = rows.groupBy(*SESSION, "start", "end").agg(
        F.min_by(F.when(ok, F.col("price")), F.when(ok, F.col("arrival"))).alias("open"),
        F.max(F.when(ok, F.col("price"))).alias("high"),
        F.min(F.when(ok, F.col("price"))).alias("low"),
        F.max_by(F.when(ok, F.col("price")), F.when(ok, F.col("arrival"))).alias("close"),
        F.sum(F.when(ok, F.col("quantity"))).alias("volume"),
        F.count_if(ok).alias("n_trades"),
        F.max_by(F.when(ok, F.col("exchange_time")), F.when(ok, F.col("arrival"))).alias("last_trade_at"),
        F.min("minimum_tick").alias("minimum_tick"),
        F.max_by("next", "arrival").alias("next"),
    )
    out = out.filter("n_trades > 0").join(closings(admitted), ["root", "contract_symbol", "session_id"], "left")
    next_at = F.coalesce("next.available_at", "later_at")
    known = next_at if finalize_at is None else F.coalesce(next_at, F.when(F.col("end") <= finalize_at, finalize_at))
    out = out.withColumn("closed_by", F.coalesce("next.arrival", "later_arrival")).withColumn("available_at", F.greatest(known, F.when(known.isNotNull(), F.col("end"))))
    return out.filter("available_at is not null").withColumn("period_minutes", F.lit(minutes)).drop("next", "later_arrival", "later_at")


def session_tail_counts(admitted: DataFrame, minutes: int) -> DataFrame:
    """Admitted trades whose bucket would end after their session, by root."""
    cut = bucketed(admitted.filter("admitted"), minutes)
    return cut.groupBy("root").agg(F.count_if(F.col("end") > F.col("session_end")).alias("incomplete_tail_trades"), F.count("*").alias("admitted_trades"))


def bar_constraints(bars: DataFrame) -> DataFrame:
    """(rule, violations) of a bar table, counted in one scan."""
    rules = {
        "high_is_highest": (F.col("high") < F.greatest("open", "close", "low")),
        "low_is_lowest": (F.col("low") > F.least("open", "close", "high")),
        "positive_volume": ~(F.col("volume") > 0),
        "positive_price": ~(F.col("low") > 0),
        "duration_is_period": micros(F.col("end")) - micros(F.col("start")) != F.col("period_minutes").cast("long") * 60_000_000,
        "end_before_available": F.col("available_at") < F.col("end"),
        "inside_session": (F.col("start") < F.col("session_start")) | (F.col("end") > F.col("session_end")),
    }
    return check_table(bars, rules)


def check_table(rows: DataFrame, rules: dict) -> DataFrame:
    """(rule, violations) for boolean columns that mark a fault; a null is one too."""
    counted = rows.select(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()])
    pairs = [F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules]
    return counted.select(F.inline(F.array(*pairs)))
