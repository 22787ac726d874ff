"""Integrity of published tables: hash chains, run fingerprints, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_hash(previous: Column, kind: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), kind, payload).cast("binary"), 256)


def chain_faults(ledger: DataFrame, kinds: tuple[str, ...] = ("registration", "decision"), chain: str = "chain") -> DataFrame:
    """Rows of ledger(chain, position, kind, payload, previous_hash, record_hash) whose hash, link or kind is wrong."""
    w = Window.partitionBy(chain).orderBy("position")
    fault = (
        F.when(~F.col("kind").isin(*kinds), "unknown_kind")
        .when(F.col("record_hash") != record_hash(F.col("previous_hash"), F.col("kind"), F.col("payload")), "content_changed")
        .when(~F.col("previous_hash").eqNullSafe(F.lag("record_hash").over(w)), "link_broken")
    )
    return ledger.withColumn("fault", fault).filter("fault is not null")


def semantic_faults(ledger: DataFrame) -> DataFrame:
    """Registrations that repeat an id, and decisions without or before their registration, or still pending. ledger(position, kind, subject_id, decision)."""
    first = ledger.filter("kind = 'registration'").groupBy("subject_id").agg(F.min("position").alias("registered"), F.count("*").alias("n"))
    repeats = first.filter("n > 1").select("subject_id", F.lit("registered_twice").alias("fault"))
    decided = ledger.filter("kind = 'decision'").join(first, "subject_id", "left")
    fault = F.when(F.col("registered").isNull(), "not_registered").when(F.col("position") < F.col("registered"), "decided_before").when(F.col("decision") == "pending", "pending_decision")
    return repeats.unionByName(decided.select("subject_id", fault.alias("fault")).filter("fault is not null"))


def run_fingerprint(rows: DataFrame, keys: list[str], order: list[str], content: list[str]) -> DataFrame:
    """One hash per key over the contents in order.

    Row hashes are taken first, then one hash for each key and day, then one over the days, so no
    list holds more than a day of a key.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in content]).cast("binary"), 256)
    place = F.struct(*order, "h")
    dated = rows.withColumn("h", line).withColumn("day", F.to_date(order[0]))
    day = dated.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(place)).alias("x")).withColumn("h", F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), "").cast("binary"), 256))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "h"))), lambda r: r["h"]), "")
    return day.groupBy(*keys).agg(F.sum(F.size("x")).cast("long").alias("n_rows"), F.sha2(whole.cast("binary"), 256).alias("fingerprint"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one of two tables alone, with repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def contract_fingerprints(registry: DataFrame) -> DataFrame:
    """registry(mode, root, contract_symbol, table_name, n_rows, fingerprint) as one hash per contract over its tables' counts and hashes, by name."""
    said = F.concat_ws(":", "table_name", F.col("n_rows").cast("string"), "fingerprint")
    return registry.groupBy("mode", "root", "contract_symbol").agg(F.sum("n_rows").alias("n_rows"), _hash_of(said).alias("fingerprint"))


def root_fingerprints(registry: DataFrame) -> DataFrame:
    """One hash per (mode, root) over its contracts' hashes, by contract."""
    return contract_fingerprints(registry).groupBy("mode", "root").agg(F.sum("n_rows").alias("n_rows"), _hash_of(F.concat_ws(":", "contract_symbol", "fingerprint")).alias("fingerprint"))


def _hash_of(texts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(texts)), "|").cast("binary"), 256)


def reconcile_runs(registry: DataFrame, declared: DataFrame) -> DataFrame:
    """Where a registry of runs and what was declared of them differ: (mode, root, table_name, fault).

    Both are (mode, root, contract_symbol, table_name, n_rows, fingerprint). A root that one
    side lacks is a missing run (declared, not there) or an extra one; else each table of a
    contract that one side lacks, that has another number of rows, or another content.
    """
    keys = ["mode", "root"]
    here, there = registry.select(*keys).distinct(), declared.select(*keys).distinct()
    none = F.lit(None).cast("string")
    gone = there.join(here, keys, "left_anti").select(*keys, none.alias("contract_symbol"), none.alias("table_name"), F.lit("missing_run").alias("fault"))
    extra = here.join(there, keys, "left_anti").select(*keys, none.alias("contract_symbol"), none.alias("table_name"), F.lit("extra_run").alias("fault"))
    both = here.join(there, keys)
    place = [*keys, "contract_symbol", "table_name"]
    a = registry.join(both, keys, "left_semi").select(*place, F.col("n_rows").alias("n"), F.col("fingerprint").alias("f"))
    b = declared.join(both, keys, "left_semi").select(*place, F.col("n_rows").alias("n_declared"), F.col("fingerprint").alias("f_declared"))
    fault = F.when(F.col("n").isNull(), "missing_table").when(F.col("n_declared").isNull(), "extra_table").when(F.col("n") != F.col("n_declared"), "row_count").when(F.col("f") != F.col("f_declared"), "content")
    wrong = a.join(b, place, "full").withColumn("fault", fault).filter("fault is not null").select(*place, "fault")
    return gone.unionByName(extra).unionByName(wrong)
