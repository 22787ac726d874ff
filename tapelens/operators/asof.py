"""As-of joins: by broadcast intervals for small right sides, else by union and window; no row explosion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import micros
from ..storage import is_small


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str], name: str = "hit") -> DataFrame:
    """left with `name`, a struct of right's `take` columns of the last right row with right_at <= at and equal keys; null if none.

    Several right rows at one instant must be settled before (the last is taken).
    One shuffle by the keys; for keys with few values and a small right side use
    asof_dimension.
    """
    kinds = {f.name: f.dataType for f in left.schema}
    packed = F.struct(*take)
    r = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), packed.alias(name), F.lit(None).cast(left.schema).alias("__row"))
    ls = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema[name].dataType).alias(name), F.struct(*left.columns).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(ls).withColumn(name, F.last(name, ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*[F.col(f"__row.{c}").cast(kinds[c]).alias(c) for c in left.columns], name)


def asof_dimension(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str], name: str = "hit") -> DataFrame:
    """asof() for a right side of dimension size: its rows become intervals [since, until) that are broadcast, so left is not shuffled.

    Time is cut into as many stretches as a key has rows at most, an interval is listed
    in each stretch that it touches, and a left row meets those of its own stretch alone:
    about two, however many rows a key has. The size of the right side is checked; a
    larger one is joined by asof().
    """
    if not is_small(right):
        return asof(left, right, keys, at, right_at, take, name)
    clock = micros(F.col(right_at))
    first, last, most = right.groupBy(*keys).agg(F.count("*").alias("n"), F.min(clock).alias("a"), F.max(clock).alias("b")).agg(F.min("a"), F.max("b"), F.max("n")).first()
    width = max(1, -(-((last or 0) - (first or 0)) // max(1, most or 0)))
    end = ((last or 0) - (first or 0)) // width

    def stretch(t):
        return F.least(F.greatest(F.floor((micros(t) - (first or 0)) / F.lit(width)), F.lit(0)), F.lit(end)).cast("long")

    until = F.lead(right_at).over(Window.partitionBy(*keys).orderBy(right_at))
    spans = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(right_at).alias("__since"), until.alias("__until"), F.struct(*take).alias(name))
    to = F.when(F.col("__until").isNull(), F.lit(end)).otherwise(stretch(F.col("__until")))
    spans = spans.withColumn("__stretch", F.explode(F.sequence(stretch(F.col("__since")), to)))
    on = (stretch(F.col(at)) == F.col("__stretch")) & (F.col(at) >= F.col("__since")) & (F.col("__until").isNull() | (F.col(at) < F.col("__until")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(F.broadcast(spans), on, "left").drop("__since", "__until", "__stretch", *[f"__{k}" for k in keys])
