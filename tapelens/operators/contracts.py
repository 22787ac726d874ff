"""Contract snapshots, mapping changes and roll states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_dimension


def contract_asof(left: DataFrame, contracts: DataFrame, at: str = "exchange_time") -> DataFrame:
    """left with the contract snapshot of its root as of its time; rows before the first snapshot have null (contract_rejects counts them).

    Snapshots that share an instant are a fault (snapshot_faults); one of them is taken.
    """
    return asof_dimension(left, contracts.dropDuplicates(["root", "as_of"]), ["root"], at, "as_of", ["as_of", "mapped_symbol", "expiry", "multiplier"], "contract")


def contract_rejects(joined: DataFrame) -> DataFrame:
    """(root, n): rows of contract_asof() that come before their root's first snapshot."""
    return joined.filter("contract is null").groupBy("root").agg(F.count("*").alias("n"))


def snapshot_faults(contracts: DataFrame) -> DataFrame:
    """(root, as_of, n): instants at which a root has several snapshots."""
    return contracts.groupBy("root", "as_of").agg(F.count("*").alias("n")).filter("n > 1")


def identity_violations(contracts: DataFrame) -> DataFrame:
    """Roots with a blank symbol, a continuous id that is the mapped one, or more than one continuous id."""
    bad = (F.trim("continuous_symbol") == "") | (F.trim("mapped_symbol") == "") | (F.col("continuous_symbol") == F.col("mapped_symbol"))
    return contracts.groupBy("root").agg(F.count_if(bad).alias("bad_rows"), F.count_distinct("continuous_symbol").alias("continuous_ids")).filter("bad_rows > 0 or continuous_ids > 1")


def visible(mappings: DataFrame) -> DataFrame:
    """mappings with visible_at (observed and effective) and their place n in their root."""
    out = mappings.withColumn("visible_at", F.greatest("observed_at", "effective_at"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("visible_at")))


def roll_state(left: DataFrame, mappings: DataFrame, at: str = "exchange_time") -> DataFrame:
    """left with mapped_symbol and roll_state: normal up to the first mapping, roll_transition at the instant of a later one, post_roll after it."""
    out = asof_dimension(left, visible(mappings), ["root"], at, "visible_at", ["visible_at", "n", "new_mapped_symbol"], "m")
    n = F.coalesce("m.n", F.lit(0))
    state = F.when(n <= 1, "normal").when(F.col(at) == F.col("m.visible_at"), "roll_transition").otherwise("post_roll")
    return out.select(*left.columns, F.col("m.new_mapped_symbol").alias("mapped_symbol"), state.alias("roll_state"))


def mapping_violations(mappings: DataFrame) -> DataFrame:
    """Faults of a mapping history: a first row with an old symbol, clocks that do not rise, an old symbol that is not the one before."""
    w = Window.partitionBy("root").orderBy("observed_at")
    v = mappings.withColumn("visible_at", F.greatest("observed_at", "effective_at"))
    v = v.select("*", F.row_number().over(w).alias("n"), *[F.lag(c).over(w).alias(f"last_{c}") for c in ("observed_at", "visible_at", "new_mapped_symbol")])
    fault = (
        F.when((F.col("n") == 1) & F.col("old_mapped_symbol").isNotNull(), "first_has_old_symbol")
        .when(F.col("observed_at") <= F.col("last_observed_at"), "observed_not_rising")
        .when(F.col("visible_at") <= F.col("last_visible_at"), "visible_not_rising")
        .when((F.col("n") > 1) & ~F.col("old_mapped_symbol").eqNullSafe(F.col("last_new_mapped_symbol")), "chain_broken")
    )
    return v.withColumn("fault", fault).filter("fault is not null").select("root", "observed_at", "fault")
