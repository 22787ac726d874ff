"""Trade admission: ordered checks, of which the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import micros
from ..functions.prices import price_to_tick
from ..shipping import ship
from ..storage import dimension, store

KEYS = ("root", "contract_symbol", "session_id")
FLAG = {
    "suspicious": "DATA:SOURCE_SUSPICIOUS", "price": "DATA:NON_POSITIVE_PRICE", "quantity": "DATA:NON_POSITIVE_QUANTITY", "id": "DATA:DUPLICATE_SOURCE_ID",
    "sequence": "DATA:DUPLICATE_SOURCE_SEQUENCE", "late": "DATA:LATE", "order": "DATA:OUT_OF_ORDER", "grid": "DATA:OFF_TICK_GRID",
}


def _arrivals():
    return Window.partitionBy(*KEYS).orderBy("arrival")


def _screened(trades: DataFrame) -> DataFrame:
    """trades with tick, t (microseconds), after_final, late, and able: sound, on the grid and not late, which no other row's admission changes."""
    t = micros(F.col("exchange_time"))
    out = trades.withColumn("tick", price_to_tick(F.col("price"), F.col("minimum_tick"))).withColumn("t", t)
    out = out.withColumn("seen", F.max("t").over(_arrivals().rowsBetween(Window.unboundedPreceding, -1)))
    after_final = F.coalesce(F.col("arrival") > F.col("final_at"), F.lit(False)) if "final_at" in trades.columns else F.lit(False)
    out = out.withColumn("after_final", after_final)
    out = out.withColumn("late", F.col("after_final") | F.coalesce(F.col("t") < F.col("seen") - F.col("seen") % 60_000_000, F.lit(False)))
    sound = ~_suspicious() & _positive("price") & _positive("quantity")
    return out.withColumn("able", sound & F.col("tick").isNotNull() & ~F.col("late"))


def _suspicious() -> Column:
    return F.coalesce(F.array_contains("source_flags", "SOURCE_SUSPICIOUS"), F.lit(False))


def _positive(name: str) -> Column:
    return F.coalesce((F.col(name) > 0) & ~F.isnan(name), F.lit(False))


def _ahead(took: Column) -> Column:
    """The latest exchange time of the rows taken before."""
    return F.max(F.when(took, F.col("t"))).over(_arrivals().rowsBetween(Window.unboundedPreceding, -1))


def _repeated(key: str, of: Column) -> Column:
    """Whether an earlier row of the session that is one of `of` has the same key."""
    earlier = Window.partitionBy(*KEYS, key).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return F.col(key).isNotNull() & F.coalesce(F.max(of.cast("int")).over(earlier) == 1, F.lit(False))


def _reasons(rows: DataFrame) -> DataFrame:
    """rows with reject_flag, admitted and unverifiable, by late, behind, same_id and same_sequence."""
    reason = (
        F.when(_suspicious(), FLAG["suspicious"])
        .when(~_positive("price"), FLAG["price"])
        .when(~_positive("quantity"), FLAG["quantity"])
        .when(F.col("same_id"), FLAG["id"])
        .when(F.col("same_sequence"), FLAG["sequence"])
        .when(F.col("late"), FLAG["late"])
        .when(F.col("behind"), FLAG["order"])
        .when(F.col("tick").isNull(), FLAG["grid"])
    )
    out = rows.withColumn("reject_flag", reason).withColumn("admitted", F.col("reject_flag").isNull())
    return out.withColumn("unverifiable", F.col("source_event_id").isNull() & F.col("source_sequence").isNull())


def _windowed(trades: DataFrame) -> DataFrame:
    """trades with all columns of the rule, by windows alone; `leads` and `knot` mark rows after which the windows may judge wrongly.

    A row is behind if an able one before it was later. A repeat that is refused does
    not count for that rule: it leads if it is later than all able rows before it. A
    refused row does not make its id a repeat either: it is a knot if it was refused
    for the other of its two keys. See in_turn() for when this matters.
    """
    out = _screened(trades).withColumn("ahead", _ahead(F.col("able")))
    out = out.withColumn("behind", F.coalesce(F.col("t") < F.col("ahead"), F.lit(False))).withColumn("fit", F.col("able") & ~F.col("behind"))
    for name, key in (("id", "source_event_id"), ("sequence", "source_sequence")):
        out = out.withColumn(f"same_{name}", _repeated(key, F.col("fit"))).withColumn(f"met_{name}", _repeated(key, F.col("able")))
    out = out.withColumn("leads", F.col("able") & (F.col("met_id") | F.col("met_sequence")) & F.coalesce(F.col("t") > F.col("ahead"), F.lit(False)))
    other = (F.col("same_sequence") & ~F.col("same_id") & F.col("source_event_id").isNotNull()) | (F.col("same_id") & ~F.col("same_sequence") & F.col("source_sequence").isNotNull())
    return out.withColumn("knot", F.col("fit") & other).drop("seen", "ahead", "fit", "met_id", "met_sequence")


def in_turn(rows: DataFrame) -> DataFrame:
    """The sessions of _windowed() rows that the windows may judge wrongly: those with a knot, or with a minute that has both a row that leads and an able one that is behind.

    Able rows are never of an earlier minute than any row before them, so being behind
    is a matter of one minute. In a minute without rows that lead, the latest able time
    was that of a row which is no repeat, so the latest admitted time is no earlier; in
    one without rows behind, all are fit. Without a knot the first fit row of each id and
    sequence is admitted, so repeats are those of fit rows.
    """
    marked = rows.select(*KEYS, F.floor(F.col("t") / 60_000_000).alias("minute"), "leads", (F.col("able") & F.col("behind")).alias("back"), "knot").filter("leads or back or knot")
    minutes = marked.groupBy(*KEYS, "minute").agg(*[F.bool_or(c).alias(c) for c in ("leads", "back", "knot")])
    return minutes.filter("knot or (leads and back)").select(*KEYS).distinct()


WORKING = ("t", "late", "able", "behind", "same_id", "same_sequence", "leads", "knot", "final_at")


def admit_ordered(trades: DataFrame) -> DataFrame:
    """trades with tick, admitted, reject_flag and unverifiable, for tapes whose exchange times arrive in order.

    One shuffle by (contract, session) serves all windows. A late or disordered row
    of such a tape (see order_violations) is still rejected by the running clocks,
    but what follows it may differ from the sequential rule; use admit() for those.
    """
    return _reasons(_windowed(trades)).drop(*WORKING)


def arrival_flags() -> Column:
    """The quality flags that one admitted or rejected trade leaves on its session, as an array."""
    unsound = F.col("reject_flag").isin(*(FLAG[k] for k in ("suspicious", "price", "quantity", "id", "sequence")))
    own = F.array_compact(
        F.array(
            F.col("reject_flag"),
            F.when(F.col("unverifiable") & ~F.coalesce(unsound, F.lit(False)), "DATA:DEDUPLICATION_UNVERIFIABLE"),
            F.when(F.col("reject_flag") == FLAG["late"], F.when(F.col("after_final"), "DATA:LATE_TRADE_AFTER_FINAL_PROFILE").otherwise("DATA:LATE_TRADE_IGNORED")),
            F.when(F.col("reject_flag") == FLAG["order"], "DATA:OUT_OF_ORDER_TRADE_IGNORED"),
        )
    )
    return F.array_union(own, F.transform(F.coalesce("source_flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("DATA:"), f)))


def final_arrivals(trades: DataFrame) -> DataFrame:
    """(session, final_at): the first arrival of any later session of the contract, which makes the session's profile final."""
    first = trades.groupBy(*KEYS, "session_start").agg(F.min("arrival").alias("first_arrival"))
    later = Window.partitionBy("root", "contract_symbol").orderBy("session_start").rowsBetween(1, Window.unboundedFollowing)
    return first.select(*KEYS, F.min("first_arrival").over(later).alias("final_at"))


def identity_faults(trades: DataFrame) -> DataFrame:
    """(session, ticks, types): sessions whose trades differ in minimum_tick or session type, which no profile may mix."""
    kinds = trades.groupBy(*KEYS).agg(F.count_distinct("minimum_tick").alias("ticks"), F.count_distinct("session_type").alias("types"), F.count_if(F.col("minimum_tick").isNull()).alias("without_tick"))
    return kinds.filter("ticks <> 1 or types <> 1 or without_tick > 0")


def order_violations(trades: DataFrame) -> DataFrame:
    """(root, contract_symbol, session_id, n): the sessions in which an exchange time is behind one that arrived before."""
    past = Window.partitionBy(*KEYS).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    behind = trades.select(*KEYS, (F.col("exchange_time") < F.max("exchange_time").over(past)).alias("behind"))
    return behind.groupBy(*KEYS).agg(F.count_if("behind").alias("n")).filter("n > 0")


def admit_in_turn(able):
    """(session, arrival, took): which of one session's able trades are admitted, taken one at a time; a function of an Arrow table."""
    import pyarrow as pa

    able = able.sort_by("arrival")
    ids, sequences, last, took = set(), set(), None, []
    for t, i, s in zip(*[able.column(c).to_pylist() for c in ("t", "source_event_id", "source_sequence")], strict=True):
        good = i not in ids and s not in sequences and (last is None or t >= last)
        took.append(good)
        if good:
            last = t
            ids.update(() if i is None else (i,))
            sequences.update(() if s is None else (s,))
    return able.select([*KEYS, "arrival"]).append_column("took", pa.array(took, pa.bool_()))


def admit(trades: DataFrame) -> DataFrame:
    """Exact admission of any tape: by windows, and where these may be wrong the able trades of the session one at a time.

    A session of one contract is the unit of the sequential rule, as its clocks
    start afresh with each. Disorder alone does not need that rule, and late or
    faulty trades never take part in it. The rows are stored once, as it is they
    that tell which sessions need it.
    """
    ship(trades.sparkSession)
    rows = store(_windowed(trades.join(final_arrivals(trades), list(KEYS))), "admission")
    hard = in_turn(rows)
    if hard.isEmpty():
        return _reasons(rows).drop(*WORKING)
    hard = dimension(hard)
    mixed = rows.join(hard, list(KEYS), "left_semi").drop("behind", "same_id", "same_sequence")
    key_types = {f.name: f.dataType.simpleString() for f in rows.schema}
    turn = mixed.filter("able").select(*KEYS, "arrival", "t", "source_event_id", "source_sequence")
    turn = turn.groupBy(*KEYS).applyInArrow(admit_in_turn, ", ".join(f"{k} {key_types[k]}" for k in (*KEYS, "arrival")) + ", took boolean")
    mixed = mixed.join(turn, [*KEYS, "arrival"], "left").withColumn("took", F.coalesce("took", F.lit(False)))
    mixed = mixed.withColumn("behind", F.coalesce(F.col("t") < _ahead(F.col("took")), F.lit(False)))
    mixed = mixed.withColumn("same_id", _repeated("source_event_id", F.col("took"))).withColumn("same_sequence", _repeated("source_sequence", F.col("took")))
    sure = rows.join(hard, list(KEYS), "left_anti")
    return _reasons(sure.unionByName(mixed.select(rows.columns))).drop(*WORKING)


def rejection_counts(admitted: DataFrame) -> DataFrame:
    return admitted.filter("not admitted").groupBy("root", "contract_symbol", "reject_flag").agg(F.count("*").alias("n"))
