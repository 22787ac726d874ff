"""Registered queries over the driver's tables; their SQL twins are in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .functions.clocks import to_local, to_utc
from .functions.prices import price_to_tick
from .operators import align, auction, bars, constraints, contracts, features, gaps, identities, imsi, integrity, pit, profiles, reports, windows
from .operators.admission import admit, rejection_counts
from .operators.sessions import closure_overlaps, session_counts, session_overlaps, slot, with_session
from .plans.measurement import Measurement
from .policy import SPARSE
from .sources import dims, tape
from .sources.features import feature_dictionary
from .oracles import ORACLE_SQL
from .shipping import ship
from .storage import store


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all by default) with doubles rounded to 6 places."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, DoubleType)}
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in columns or df.columns])


def run_of(spark: SparkSession, sf_dir: str, stored: bool = False) -> Measurement:
    return Measurement(tape.events_tape(ship(spark), sf_dir), mappings_of(spark), SPARSE, ordered=True, stored=stored)


def mappings_of(spark: SparkSession) -> DataFrame:
    rows = [(r, o and r + o, r + n, a, b) for r in ("ES", "6E") for o, n, a, b in ((None, "H24", "2023-12-15 12:00:00", "2023-12-15 12:00:00"), ("H24", "M24", "2024-01-10 00:00:00", "2024-01-16 00:00:00"))]
    names = (("root", "string"), ("old_mapped_symbol", "string"), ("new_mapped_symbol", "string"), ("observed_at", "timestamp_ntz"), ("effective_at", "timestamp_ntz"))
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(r, names, strict=True)]) for r in rows])))


def contracts_of(spark: SparkSession) -> DataFrame:
    """Contract snapshots: two a root."""
    rows = [(r, f"{r}-CONT", r + m, a, e, x) for r, x in (("ES", 50.0), ("6E", 125000.0)) for m, a, e in (("H24", "2024-01-03 00:00:00", "2024-03-15 00:00:00"), ("M24", "2024-01-16 00:00:00", "2024-06-21 00:00:00"))]
    names = (("root", "string"), ("continuous_symbol", "string"), ("mapped_symbol", "string"), ("as_of", "timestamp_ntz"), ("expiry", "timestamp_ntz"), ("multiplier", "double"))
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(r, names, strict=True)]) for r in rows])))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations made from orders: observed at the order date, released days later, delivered hours after that."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    release = F.expr("o_orderdate + make_dt_interval(o_orderkey % 5, 0, 0, 0)")
    return o.select(
        F.when(F.col("o_orderkey") % 7 == 0, "unlisted").when(F.col("o_orderkey") % 2 == 0, "weekly").otherwise("daily").alias("dataset_id"),
        F.concat(F.lit("series-"), "o_orderstatus").alias("series_id"),
        F.col("o_orderkey").alias("record_key"),
        F.col("o_orderdate").alias("observation_time"),
        F.when(F.col("o_orderkey") % 11 != 0, release).alias("release_time"),
        F.when(F.col("o_orderkey") % 4 != 0, F.expr("o_orderdate + make_dt_interval(o_orderkey % 5, 1, 0, 0)")).alias("vendor_time"),
        F.expr("o_orderdate + make_dt_interval(o_orderkey % 5, o_orderkey % 3, 0, 0)").alias("delivery_time"),
        F.lit("v1").alias("source_version"),
        F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))).alias("value"),
    )


def policies_of(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(F.struct(F.lit("weekly").alias("dataset_id"), F.lit("synthetic_timing_only").alias("extra_flag")), F.struct(F.lit("daily").alias("dataset_id"), F.lit(None).cast("string").alias("extra_flag")))))


def _instant(text: str):
    return F.lit(text).cast("timestamp_ntz")


RETRIEVED, NOW = "2030-01-01 00:00:00", "1995-06-17 00:00:00"


def _pit(spark, d):
    return pit.normalize(raw_records(spark, d), policies_of(spark), _instant(RETRIEVED))


def _schedule(spark):
    """Fridays' releases of the first half of 1995, one row a date."""
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'1995-06-30')) AS observation_date")
    return days.filter(F.weekday("observation_date") == 1).select("observation_date", F.expr("cast(observation_date AS timestamp_ntz) + interval 3 days").alias("release_time"))


def _deliveries(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_quantity", "l_discount", "l_tax")  # noqa: E741
    root = F.when(F.col("l_suppkey") % 3 == 0, "ES").when(F.col("l_suppkey") % 3 == 1, "ZN").otherwise("6E")
    return l.select(root.alias("root"), F.to_date("l_shipdate").alias("release_date"), F.expr("l_shipdate + make_dt_interval(0, l_orderkey % 24, 0, 0)").alias("delivered_at"),
                    F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("long_all"), F.when(F.col("l_discount") > 0.0, F.col("l_discount")).alias("short_all"), F.col("l_tax").alias("spread"))


def _delivery_audit(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'1995-03-31')) AS release_date").filter(F.weekday("release_date") == 4)
    schedule = days.select("release_date", F.expr("cast(release_date AS timestamp_ntz) + interval 15 hours 30 minutes").alias("official_time"))
    roots = spark.range(1).select(F.explode(F.array(F.lit("ES"), F.lit("ZN"), F.lit("6E"))).alias("root"))
    return reports.delivery_audit(schedule, roots, _deliveries(spark, d))


BAR = ("root", "contract_symbol", "session_id", "start", "end", "available_at", "open", "high", "low", "close", "volume", "n_trades")
KEY = ("root", "contract_symbol", "session_id", "end")


def _profile_rows(df: DataFrame) -> DataFrame:
    return df.select("root", "contract_symbol", "session_id", "end", "tick", "volume")


def _q(f, stored: bool = False):
    """A query over the measurement tables of the events tape; stored, where several branches read the same tables."""
    return lambda spark, d: f(run_of(spark, d, stored))


def _features(m: Measurement) -> DataFrame:
    names = "distance_to_current_poc_ticks distance_to_current_poc_vol distance_to_prior_poc_vol distance_to_vah_vol distance_to_val_vol value_area_width_vol poc_migration_vol value_mid_migration_vol volume_above_poc_ratio volume_outside_value_ratio bar_close_outside_value_ratio profile_overlap_ratio".split()
    return rounded(m.features, *KEY, *names)


def _flags(c):
    return F.array_join(c, ",")


CUTS = ("2024-01-06 00:00:00", "2024-01-12 00:00:00", "2024-01-18 12:00:00")


def _replayed(m: Measurement, last: bool) -> dict[str, DataFrame]:
    """What a run says in each of its tables, by bar and with the time from which it was known; states and events at the last cut alone."""
    at, said = [*KEY, "available_at"], lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("null")) for x in c]).alias("said")
    known = m.fast.select(*KEY, "available_at")
    out = {
        "bars": m.fast.select(*at, said(*[c for c in BAR if c not in at])),
        "auction": m.auction_state.withColumn("f", _flags("quality_flags")).select(*at, said("location", "measurement_ready", "f")),
    }
    if last:
        out["imsi"] = rounded(m.imsi, *at, "adjusted", "distance", "rarity", "state_flag").select(*at, said("adjusted", "distance", "rarity", "state_flag"))
        out["icm"] = rounded(m.icm, *at, "fair_value", "z_effective").select(*at, said("fair_value", "z_effective"))
        out["iae"] = m.gap_states.join(known, list(KEY)).withColumn("f", _flags("quality_flags")).select(*at, said("gap_idx", "gap_event", "direction", "active_gaps", "f"))
        out["synergy"] = m.synergy.withColumn("f", _flags("all_quality_flags")).select(*at, said("present", "fresh", "ready", "f", "synergy_id"))
        out["events"] = m.events.select(*at, said("event_id", "event_type", "direction", "parent_event_id", "research_ready"))
    return out


def _replay(spark, d):
    """Prefix replay at several cuts: what the tape up to a cut gives, against the full run's rows that were known by then.

    As a planted fault, the short run of the last cut is compared with a full run
    from which the bars of one session have been taken out, so the check has rows.
    """
    full = run_of(spark, d, stored=True)
    out = None
    for i, text in enumerate(CUTS):
        cut, last = _instant(text), i == len(CUTS) - 1
        short = Measurement(full.tape.filter(F.col("available_at") < cut), full.mappings, SPARSE, ordered=True, stored=True)
        a, b = _replayed(full, last), _replayed(short, last)
        for name in a:
            known = a[name].filter(F.col("available_at") < cut)
            if name == "bars" and last:
                known = known.filter(~F.col("said").startswith("2024-01-10 15:00:00"))
            rows = integrity.differences(known, b[name]).select(*KEY, "side", F.lit(text).alias("cut"), F.lit(name).alias("table_name"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _ledger(spark, d):
    """Orders as the ledger of registrations and decisions about each customer."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 5 == 0, "decision").otherwise("registration").alias("kind"), F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("pass").alias("decision"))


def _chained(spark, d):
    """Orders as one hash chain for each customer, so chains stay short and grow in number; then some contents are changed and some rows taken out."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 83 == 0, "note").when(F.col("o_orderkey") % 5 == 0, "decision").otherwise("registration")
    rows = o.select(F.col("o_custkey").alias("chain"), F.struct(F.col("o_orderkey").alias("position"), kind.alias("kind"), F.concat_ws("/", "o_custkey", "o_orderstatus").alias("payload")).alias("r"))
    listed = rows.groupBy("chain").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    own = lambda s, r: integrity.record_hash(F.element_at(s, -1), r["kind"], r["payload"])
    hashes = F.aggregate("rows", F.array(F.lit(None).cast("string")), lambda s, r: F.array_append(s, own(s, r)))
    each = listed.withColumn("hashes", hashes).select("chain", "hashes", F.posexplode("rows").alias("i", "r"))
    ledger = each.select("chain", "r.*", F.get("hashes", F.col("i")).alias("previous_hash"), F.get("hashes", F.col("i") + 1).alias("record_hash"))
    changed = F.when(F.col("position") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return ledger.withColumn("payload", changed).filter("position % 89 <> 0")


def _hash_chain(spark, d):
    return integrity.chain_faults(_chained(spark, d)).select("chain", "position", "fault")


QUERIES = {
    "trade_tape": lambda s, d: tape.events_tape(s, d).select("root", "contract_symbol", "exchange_time", "available_at", "price", "quantity", "source_event_id", "tick_type", "arrival"),
    "tape_rejects": lambda s, d: tape.reject_counts(tape.judged(_bad_tape(s, d))),
    "front_contract_trades": lambda s, d: tape.front_contract(tape.events_tape(s, d), mappings_of(s)).select("root", "contract_symbol", "exchange_time", "price", "quantity", "arrival"),
    "mapped_contracts": lambda s, d: tape.mapped_contracts(_tape_mappings(s, d)),
    "session_windows": lambda s, d: _windows_used(s, d),
    "session_classify": lambda s, d: with_session(tape.events_tape(s, d)).select("root", "arrival", "exchange_time", "session_name", "session_type"),
    "session_id": lambda s, d: with_session(tape.events_tape(s, d)).select("root", "arrival", "session_id"),
    "session_bounds": lambda s, d: with_session(tape.events_tape(s, d)).select("root", "arrival", "session_start", "session_end"),
    "session_closures": lambda s, d: with_session(tape.events_tape(s, d), closures=dims.closures(s)).select("root", "arrival", "session_name", "session_type", "session_start", "session_end"),
    "session_bars": _q(lambda m: m.fast.select(*KEY, slot(F.col("start"), F.col("session_start"), SPARSE.fast).alias("slot"))),
    "session_counts": lambda s, d: session_counts(with_session(tape.events_tape(s, d))),
    "session_overlaps": lambda s, d: session_overlaps(_windows_of_roots(s, d)),
    "closure_overlaps": lambda s, d: closure_overlaps(_closures_of_roots(s, d)),
    "utc_normalize": lambda s, d: _utc(s, d),
    "price_ticks": lambda s, d: tape.events_tape(s, d).select("root", "arrival", "price", price_to_tick(F.col("price"), F.col("minimum_tick")).alias("tick")),
    "trade_admission": _q(lambda m: m.trades.select("root", "contract_symbol", "session_id", "arrival", "admitted", "reject_flag")),
    "trade_admission_exact": lambda s, d: admit(with_session(_hostile(s, d))).select("root", "contract_symbol", "session_id", "arrival", "admitted", "reject_flag"),
    "rejection_counts": _q(lambda m: rejection_counts(m.trades)),
    "bars_fast": _q(lambda m: m.fast.select(*BAR)),
    "bars_medium": _q(lambda m: m.medium.select(*BAR)),
    "bar_constraints": _q(lambda m: bars.bar_constraints(m.fast)),
    "table_constraints": lambda s, d: _constraints(s, d),
    "session_tail_counts": _q(lambda m: bars.session_tail_counts(m.trades, SPARSE.fast)),
    "minute_bins": _q(lambda m: m.bins.select("root", "contract_symbol", "session_id", "minute_end", "tick", "volume")),
    "profile_developing": _q(lambda m: _profile_rows(profiles.developing(m.bins, m.fast, SPARSE.fast))),
    **{f"profile_rolling_{n}": _q(lambda m, n=n: _profile_rows(profiles.rolling(m.bins, m.fast, n, SPARSE.fast))) for n in SPARSE.rolling},
    "profile_final": _q(lambda m: m.finals.select("root", "contract_symbol", "session_id", "as_of", "available_at", "total_volume", F.size("histogram").alias("n_ticks"))),
    "poc": _q(lambda m: m.finals.select("root", "contract_symbol", "session_id", "poc_tick")),
    "value_area": _q(lambda m: m.finals.select("root", "contract_symbol", "session_id", "val_tick", "vah_tick")),
    "volume_conservation": _q(lambda m: profiles.volume_conservation(m.finals, m.trades.withColumn("quantity", F.when(F.col("arrival") % 499 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))))),
    "profile_moments": _q(lambda m: rounded(m.finals, "root", "contract_symbol", "session_id", "profile_entropy", "profile_skew", "profile_kurtosis", "degenerate")),
    "profile_references": _q(lambda m: m.references.select("root", "contract_symbol", "session_id", "prior_session_id", "prior_poc_tick", "prior_val_tick", "prior_vah_tick", "prior_rth_id", "prior_eth_id")),
    "auction_location": _q(lambda m: m.located.select(*KEY, "close_tick", "location")),
    "auction_features": _q(_features, stored=True),
    "auction_state": _q(lambda m: m.auction_state.select(*KEY, "location", "measurement_ready", _flags("quality_flags").alias("quality_flags")), stored=True),
    "atr": _q(lambda m: rounded(windows.atr(m.fast, SPARSE), *KEY, "true_range", "atr", "atr_ready")),
    "session_vwap": _q(lambda m: rounded(windows.session_vwap(m.medium), *KEY, "session_vwap", "vwap_distance")),
    "tod_volume_z": _q(lambda m: rounded(windows.tod_volume_z(m.fast, SPARSE), *KEY, "slot", "tod_n", "volume_z", "tod_flag")),
    "icm_fit": _q(lambda m: rounded(m.icm, "root", "contract_symbol", "end", "fair_value", "slope_per_bar", "curvature_per_bar2", "sigma_ols", "sigma_mad", "r_ratio")),
    "icm_state": _q(lambda m: rounded(m.icm, "root", "contract_symbol", "end", "z_raw", "z_capped", "z_effective", "slope_normalized", "curvature_normalized", "residual_autocorrelation", "fair_value_distance_vol"), stored=True),
    "imsi_vwrsi": _q(lambda m: rounded(imsi.vwrsi(m.medium, SPARSE), "root", "contract_symbol", "end", "vwrsi")),
    "imsi_tod": _q(lambda m: rounded(imsi.tod_adjusted(imsi.vwrsi(m.medium, SPARSE), SPARSE), "root", "contract_symbol", "end", "slot", "tod_n", "adjusted")),
    "imsi_state": _q(lambda m: rounded(m.imsi, "root", "contract_symbol", "end", "adjusted", "vwap_distance", "distance", "rarity", "neighbour_mean", "neighbour_p90", "neighbour_support", "state_flag")),
    "bar_segments": _q(lambda m: m.segmented.select(*KEY, "idx", "segment", "reset")),
    "gap_formation": _q(lambda m: rounded(m.gaps, "root", "contract_symbol", "created_at", "direction", "gap_bot", "gap_top", "z_displacement", "z_gap", "efficiency", "quality", "guard")),
    "gap_retests": _q(lambda m: rounded(m.gap_bars.filter("retest"), "root", "contract_symbol", "created_at", "end", "age", "depth", "wick", "close_position", "decay", "score", "guard", "happened")),
    "gap_lifecycle": _q(lambda m: gaps.lifecycle(m.gap_bars).select("root", "contract_symbol", "created_at", "direction", "state", "end_age", "retests", "first_retest_age")),
    "gap_first_retest": _q(lambda m: gaps.first_retests(m.gap_bars).select("root", "contract_symbol", "created_at", "end", "age", "active_gaps"), stored=True),
    "gap_bar_state": _q(lambda m: m.gap_states.select("root", "contract_symbol", "end", "gap_idx", "gap_event", "direction", "active_gaps", _flags("quality_flags").alias("quality_flags")), stored=True),
    "value_exits": _q(lambda m: _events(m, "value_exit_up", "value_exit_down"), stored=True),
    "value_reentries": _q(lambda m: _events(m, "value_reentry_from_above", "value_reentry_from_below"), stored=True),
    "poc_migrations": _q(lambda m: _events(m, "poc_migration_above_prior_vah", "poc_migration_below_prior_val"), stored=True),
    "transition_counters": _q(lambda m: m.transitions.select(*KEY, F.col("reentry_count").cast("long").alias("reentry_count"), F.col("consecutive_minutes_outside").cast("long").alias("consecutive_minutes_outside")), stored=True),
    "synergy_align": _q(lambda m: m.synergy.select(*KEY, F.col("imsi.state_end").alias("imsi_end"), F.col("icm.state_end").alias("icm_end"), F.col("iae.state_end").alias("iae_end"), "present", "fresh"), stored=True),
    "synergy_flags": _q(lambda m: m.synergy.select(*KEY, _flags("blocking_quality_flags").alias("blocking"), _flags("all_quality_flags").alias("flags")), stored=True),
    "synergy_retest": _q(lambda m: m.retests.select(*KEY, "event_id", "parent_event_id", "event_type", "direction").join(m.retest_synergy.select(*KEY, F.col("gap_id").alias("parent_event_id"), "present", "fresh", "ready"), [*KEY, "parent_event_id"]), stored=True),
    "candidate_events": _q(lambda m: m.events.select(*KEY, "event_id", "event_type", "direction", "parent_event_id", "research_ready"), stored=True),
    "event_duplicates": _q(lambda m: align.event_duplicates(m.events.select("event_id").unionByName(m.events.filter("event_type = 'value_exit_up'").select("event_id"))), stored=True),
    "coverage_by_dim": _q(lambda m: reports.coverage_by_dim(_typed(m)), stored=True),
    "feature_coverage": lambda s, d: features.coverage(run_of(s, d, stored=True).melted(), feature_dictionary(s)).drop("missing_reason"),
    "coverage_totals": _q(lambda m: reports.coverage_totals(m.events), stored=True),
    "coverage_reconcile": _q(lambda m: reports.reconcile(reports.coverage_totals(m.events)), stored=True),
    "runtime_summary": _q(lambda m: m.summary(), stored=True),
    "flag_histogram": _q(lambda m: reports.flag_histogram([("auction", m.auction_state)]), stored=True),
    "flag_histogram_states": _q(lambda m: reports.flag_histogram([("iae", m.gap_states), ("icm", m.icm), ("imsi", m.imsi), ("synergy", m.synergy.withColumnRenamed("all_quality_flags", "flags").drop("quality_flags").withColumnRenamed("flags", "quality_flags"))]), stored=True),
    "minute_gaps": lambda s, d: rounded(reports.minute_gaps(tape.events_tape(s, d))),
    "probe_coverage": lambda s, d: _probe(s, d),
    "open_interest_coverage": lambda s, d: reports.open_interest_coverage(_open_interest(s, d)).withColumn("expiries", F.array_join("expiries", ",")),
    "market_evidence": lambda s, d: _market_evidence(s, d),
    "auction_clock": _q(lambda m: reports.auction_clock_faults(m.located.withColumn("available_at", F.when(F.hour("end") == 15, F.col("end") - F.expr("interval 1 minute")).otherwise(F.col("available_at"))), m.finals), stored=True),
    "usable_from": lambda s, d: pit.usable_from(raw_records(s, d)).select("record_key", "usable_from"),
    "weekly_release_rule": lambda s, d: pit.weekly_rule(raw_records(s, d)).select("record_key", "rule_fault"),
    "scheduled_release": lambda s, d: pit.scheduled_release(raw_records(s, d), _schedule(s)).select("record_key", "scheduled_time", "schedule_fault"),
    "pit_normalize": lambda s, d: _pit(s, d).select("record_key", "dataset_id", "usable_from", "quality_status", _flags("quality_flags").alias("quality_flags"), "missing_reason", "lineage_hash"),
    "pit_rejected": lambda s, d: pit.rejected(raw_records(s, d), policies_of(s)).select("record_key", "reason"),
    "clock_violations": lambda s, d: pit.clock_violations(_pit(s, d)),
    "quality_upgrades": lambda s, d: pit.quality_upgrades(_pit(s, d).withColumn("quality_status", F.when(F.col("record_key") % 17 == 0, "STALE").otherwise(F.col("quality_status"))), _pit(s, d)).select("lineage_hash", "source_status", "quality_status"),
    "gate_release": lambda s, d: pit.release(_pit(s, d), _instant(NOW)).select("record_key", "usable_from", "released_at", "quality_status"),
    "gate_pending": lambda s, d: pit.pending(_pit(s, d), _instant(NOW)),
    "gate_duplicates": lambda s, d: pit.duplicate_lineage(_pit(s, d).select("lineage_hash").unionByName(_pit(s, d).filter("record_key % 29 = 0").select("lineage_hash"))),
    "contract_asof": lambda s, d: contracts.contract_asof(tape.events_tape(s, d).select("root", "arrival", "exchange_time"), contracts_of(s)).select("root", "arrival", F.col("contract.mapped_symbol").alias("mapped_symbol"), F.col("contract.multiplier").alias("multiplier")),
    "contract_identity": lambda s, d: contracts.identity_violations(_contract_rows(s, d)),
    "roll_state": lambda s, d: contracts.roll_state(tape.events_tape(s, d).select("root", "arrival", "exchange_time"), mappings_of(s)).select("root", "arrival", "mapped_symbol", "roll_state"),
    "mapping_continuity": lambda s, d: contracts.mapping_violations(_tape_mappings(s, d).withColumn("old_mapped_symbol", F.when(F.col("old_mapped_symbol") == "6EH24", "6EZ23").otherwise(F.col("old_mapped_symbol")))),
    "delivery_audit": _delivery_audit,
    "delivery_summary": lambda s, d: reports.delivery_summary(_deliveries(s, d), ["long_all", "short_all", "spread"], ["root"]).withColumn("null_fields", _flags("null_fields")),
    "hash_chain": _hash_chain,
    "chain_semantics": lambda s, d: integrity.semantic_faults(_ledger(s, d)),
    "run_fingerprint": _q(lambda m: integrity.run_fingerprint(m.fast, ["root", "contract_symbol"], ["end"], ["session_id", "open", "high", "low", "close", "volume"])),
    "prefix_replay": _replay,
    "profile_ids": _q(lambda m: identities.with_last_tick(m.finals, m.trades).select("root", "contract_symbol", "session_id", identities.profile_id("final_session").alias("profile_id"))),
    "run_registry": _q(lambda m: m.registry("sparse"), stored=True),
    "run_reconcile": lambda s, d: _reconciled(s, d),
}


#: Tables whose rules are proved, and the clock that deals the planted faults.
PROVED = {"fast": "end", "medium": "end", "finals": "session_start", "auction_state": "end", "imsi": "end", "icm": "end", "gap_states": "end", "synergy": "end", "events": "end", "trades": "exchange_time"}


def _constraints(s, d):
    """Every rule of every published table: its violations there, and how many of its planted faults it finds."""
    m = run_of(s, d, stored=True)
    parts = [constraints.prove(getattr(m, name), name, at) for name, at in PROVED.items()]
    out = constraints.prove(_pit(s, d), "pit", "observation_time")
    for p in parts:
        out = out.unionByName(p)
    return out


def _reconciled(s, d):
    """The run's registry against a declaration in which 6E is of another mode, one table of ES lacks, one has a row more and one another content."""
    run = run_of(s, d, stored=True)
    has = store(run.registry("sparse"), "registry")
    name, root = F.col("table_name"), F.col("root")
    told = has.withColumn("mode", F.when(root == "6E", "other").otherwise(F.col("mode"))).filter(~((root == "ES") & (name == "icm")))
    told = told.withColumn("n_rows", F.col("n_rows") + (name == "event").cast("long")).withColumn("fingerprint", F.when(name == "profile", F.reverse("fingerprint")).otherwise(F.col("fingerprint")))
    return integrity.reconcile_runs(has, told)


def _events(m: Measurement, *kinds: str) -> DataFrame:
    return auction.transition_events(m.transitions).filter(F.col("event_type").isin(*kinds)).select(*KEY, "event_id", "event_type", "direction", "parent_event_id")


def _typed(m: Measurement) -> DataFrame:
    return m.events.join(m.finals.select("root", "contract_symbol", "session_id", "session_type"), ["root", "contract_symbol", "session_id"], "left")


def _tape_mappings(s, d):
    """Mapping changes as the tape shows them: the first trade of each contract of a root."""
    from pyspark.sql import Window

    first = tape.events_tape(s, d).groupBy("root", "contract_symbol").agg(F.min("exchange_time").alias("observed_at"))
    last = F.lag("contract_symbol").over(Window.partitionBy("root").orderBy("observed_at"))
    return first.select("root", last.alias("old_mapped_symbol"), F.col("contract_symbol").alias("new_mapped_symbol"), "observed_at", F.col("observed_at").alias("effective_at"))


def _windows_of_roots(s, d):
    """The windows of the roots on the tape; those of 6E are stretched so that the audit has faults to find."""
    roots = tape.events_tape(s, d).select("root").distinct()
    w = dims.session_windows(s).join(roots, "root")
    return w.withColumn("end_sec", F.when((F.col("root") == "6E") & (F.col("session_type") == "london"), F.col("end_sec") + 60).otherwise(F.col("end_sec")))


def _closures_of_roots(s, d):
    """An evening closure on each of the tape's trading days of a root that runs past midnight, and an early one on days with many trades, so that some overlap."""
    days = tape.events_tape(s, d).groupBy("root", F.to_date("exchange_time").alias("local_date")).agg(F.count("*").alias("n"))
    made = days.withColumn("c", F.explode(F.array(F.struct(F.lit("evening").alias("k"), F.lit(79_200).alias("a"), F.lit(3_600).alias("b")), F.struct(F.lit("early").alias("k"), (F.col("n") % 7 * 1_200).cast("int").alias("a"), F.lit(30_000).alias("b")))))
    name = F.concat(F.col("c.k"), F.lit("_"), F.date_format("local_date", "yyyy_MM_dd"))
    return made.select("root", name.alias("exception_name"), "local_date", F.col("c.k").alias("closure_name"), F.col("c.a").alias("start_sec"), F.col("c.b").alias("end_sec"), F.lit(False).alias("all_day"))


def _windows_used(s, d):
    """Session windows with the tape's rows in each."""
    n = with_session(tape.events_tape(s, d)).groupBy("root", "session_name").agg(F.count("*").alias("n_rows"))
    return F.broadcast(dims.session_windows(s)).join(n, ["root", "session_name"], "right").select("root", "session_name", "session_type", "zone", "start_sec", "end_sec", "crosses_midnight", "n_rows")


def _utc(s, d):
    """Naive local clocks and their zone back to UTC; a row without a zone stays null."""
    e = tape.events_tape(s, d)
    zone = F.when(F.col("root") == "ES", dims.NEW_YORK).otherwise(dims.CHICAGO)
    zone = F.when(F.col("arrival") % 10 != 0, zone)
    return e.select("root", "arrival", to_utc(to_local(F.col("exchange_time"), zone), zone).alias("utc"))


def _bad_tape(s, d):
    """The tape with some rows known before they happened and some without a price or a contract."""
    t = tape.events_tape(s, d)
    early = F.when(F.col("arrival") % 53 == 0, F.col("exchange_time") - F.expr("interval 1 second")).otherwise(F.col("available_at"))
    price = F.when(F.col("arrival") % 59 != 0, F.col("price"))
    return t.withColumns({"available_at": early, "price": price, "contract_symbol": F.when(F.col("arrival") % 61 != 0, F.col("contract_symbol"))})


def _hostile(s, d):
    """The tape with a twentieth of its rows a minute early, so that admission meets disorder."""
    early = F.when(F.col("arrival") % 20 == 2, F.col("exchange_time") - F.expr("interval 20 minutes")).otherwise(F.col("exchange_time"))
    return tape.events_tape(s, d).withColumn("exchange_time", early)


def _probe(s, d):
    t = tape.events_tape(s, d)
    out = reports.probe_coverage(t, reports.minute_gaps(t), dims.markets(s))
    return out.withColumn("flags", _flags("flags"))


def _open_interest(s, d):
    t = with_session(tape.events_tape(s, d))
    oi = F.when(F.col("arrival") % 3 == 0, F.col("quantity") * 100)
    return t.select("root", "contract_symbol", F.to_date("exchange_time").alias("day"), oi.alias("open_interest"), F.when(F.col("contract_symbol").endswith("H24"), "2024-03-15").otherwise("2024-06-21").alias("expiry"))


def _market_evidence(s, d):
    t = contracts.roll_state(with_session(tape.events_tape(s, d)), mappings_of(s))
    out = reports.market_evidence(t, mappings_of(s), _open_interest(s, d), reports.minute_gaps(t))
    return out.withColumns({c: _flags(c) for c in ("contracts", "session_types", "roll_states", "expiries", "flags")}).select(
        "root", "first_time", "last_time", "n_rows", "contracts", "session_types", "roll_states", "mapping_events", "first_mapping_time", "last_mapping_time", "contract_days_with_oi", "expiries", "gaps", "flags"
    )


def _contract_rows(s, d):
    """Contract snapshots as the tape shows them; 6E changes its continuous id once, so the audit has a fault."""
    t = tape.events_tape(s, d).groupBy("root", "contract_symbol").agg(F.min("exchange_time").alias("as_of"))
    name = F.when((F.col("root") == "6E") & F.col("contract_symbol").endswith("M24"), "6E-OTHER").otherwise(F.concat("root", F.lit("-CONT")))
    return t.select("root", name.alias("continuous_symbol"), F.col("contract_symbol").alias("mapped_symbol"), "as_of")
