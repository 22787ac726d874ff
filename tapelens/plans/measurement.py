"""From a trade tape to candidate events: the lazily built tables of one run."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import list_id
from ..functions.clocks import utc_text
from ..operators import align, auction, bars, features, gaps, identities, imsi, integrity, profiles, windows
from ..operators.admission import admit, admit_ordered, arrival_flags
from ..operators.contracts import roll_state
from ..operators.sessions import with_session
from ..policy import PRODUCTION, Policy
from ..sinks import publish, write_report
from ..sources.tape import front_contract, split_ticks
from ..storage import store

SESSION = ["root", "contract_symbol", "session_id"]


class Measurement:
    """Tables over tape(root, contract_symbol, exchange_time, available_at, price, quantity, tick_type, ...), built when asked for.

    Trades alone are measured, and with mappings only those of the contract that
    is mapped at their time. Each contract's own minimum_tick is its price grid.
    ordered: the tape is known to arrive in order, so admission needs no look for
    sessions that do not. stored: tables that several others read (admitted
    trades, bars, minute bins) are written once and read back; drop_stored()
    deletes them when the results are written.
    """

    def __init__(self, tape: DataFrame, mappings: DataFrame | None = None, policy: Policy = PRODUCTION, ordered: bool = False, stored: bool = False) -> None:
        self.tape, self.mappings, self.policy, self.ordered, self.stored = tape, mappings, policy, ordered, stored

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return store(df, name) if self.stored else df

    @cached_property
    def sessions(self) -> DataFrame:
        trades = split_ticks(self.tape)[0]
        return with_session(trades if self.mappings is None else front_contract(trades, self.mappings))

    @cached_property
    def trades(self) -> DataFrame:
        return self._kept((admit_ordered if self.ordered else admit)(self.sessions), "trades")

    @cached_property
    def fast(self) -> DataFrame:
        return self._kept(bars.bars(self.trades, self.policy.fast), "fast")

    @cached_property
    def medium(self) -> DataFrame:
        return self._kept(bars.bars(self.trades, self.policy.medium), "medium")

    @cached_property
    def bins(self) -> DataFrame:
        return self._kept(profiles.minute_bins(self.trades), "bins")

    @cached_property
    def finals(self) -> DataFrame:
        return self._kept(profiles.final_profiles(self.trades, self.bins, self.policy.value_area), "finals")

    @cached_property
    def developing(self) -> DataFrame:
        return self._kept(profiles.profiles(profiles.developing(self.bins, self.fast, self.policy.fast), [*SESSION, "end"], self.policy.value_area), "developing")

    def rolling(self, minutes: int) -> DataFrame:
        return profiles.profiles(profiles.rolling(self.bins, self.fast, minutes, self.policy.fast), [*SESSION, "end"], self.policy.value_area)

    @cached_property
    def references(self) -> DataFrame:
        return auction.references(self.finals)

    @cached_property
    def scaled(self) -> DataFrame:
        """Fast bars with their true range and local scale."""
        return self._kept(windows.atr(self.fast, self.policy), "scaled")

    @cached_property
    def located(self) -> DataFrame:
        return self._kept(auction.located(self.scaled, self.references), "located")

    @cached_property
    def transitions(self) -> DataFrame:
        poc = self.developing.select(*SESSION, "end", "poc_tick")
        return auction.transitions(self.located.join(poc, [*SESSION, "end"]), self.policy)

    @cached_property
    def features(self) -> DataFrame:
        shape = self.developing.select(*SESSION, "end", "histogram", "total_volume", "poc_tick", "val_tick", "vah_tick", "profile_entropy", "profile_skew", "profile_kurtosis", "degenerate")
        rows = self.located.join(shape, [*SESSION, "end"])
        return auction.features(rows.withColumn("price_tick", F.col("close_tick")))

    @cached_property
    def first_flags(self) -> DataFrame:
        """(session, flag, since): each flag that a session's trades leave, with the arrival that brought it first."""
        rows = self.trades.select(*SESSION, "arrival", F.explode(arrival_flags()).alias("flag"))
        return self._kept(rows.groupBy(*SESSION, "flag").agg(F.min("arrival").alias("since")), "flags")

    @cached_property
    def data_flags(self) -> DataFrame:
        """(session, end, data_flags): the flags of each fast bar's session that had arrived when the bar was closed."""
        known = self.fast.select(*SESSION, "end", "closed_by").join(self.first_flags, SESSION).filter(F.col("since") < F.col("closed_by"))
        return known.groupBy(*SESSION, "end").agg(F.collect_set("flag").alias("data_flags"))

    @cached_property
    def prior_flags(self) -> DataFrame:
        """(session, prior_flags): the flags of the whole session that is a session's prior profile, and of that profile."""
        all_flags = self.first_flags.groupBy(*SESSION).agg(F.collect_set("flag").alias("flags"))
        shape = self.finals.select(*SESSION, "degenerate").join(all_flags, SESSION, "left")
        marks = F.array_compact(F.array(F.when(F.col("degenerate"), "DEGENERATE_PROFILE")))
        shape = shape.select("root", "contract_symbol", F.col("session_id").alias("prior_session_id"), F.array_union(marks, F.coalesce("flags", F.array().cast("array<string>"))).alias("prior_flags"))
        return self.references.select(*SESSION, "prior_session_id").join(shape, ["root", "contract_symbol", "prior_session_id"]).drop("prior_session_id")

    @cached_property
    def auction_state(self) -> DataFrame:
        """One row per fast bar: location, readiness and flags, as they were known when the bar was closed.

        The roll state is that of the bar's last admitted trade. Flags are those of
        the developing profile so far and of the prior profile.
        """
        rows = self.features.join(self.data_flags, [*SESSION, "end"], "left").join(self.prior_flags, SESSION, "left")
        if self.mappings is None:
            rows = rows.withColumn("roll_state", F.lit("normal"))
        else:
            rows = roll_state(rows, self.mappings, "last_trade_at")
        none = F.array().cast("array<string>")
        flags = F.array_compact(
            F.array(
                F.when(F.col("degenerate"), "DEGENERATE_PROFILE"),
                F.when(F.col("prior_vah_tick").isNull(), "NO_PRIOR_SAME_SESSION_TYPE_PROFILE"),
                F.concat(F.lit("ROLL:"), F.upper("roll_state")),
            )
        )
        flags = F.array_union(F.array_union(flags, F.coalesce("data_flags", none)), F.coalesce("prior_flags", none))
        rows = rows.withColumn("quality_flags", F.array_sort(flags))
        clean = ~F.exists("quality_flags", lambda f: f.startswith("DATA:"))
        ready = F.col("prior_vah_tick").isNotNull() & F.col("atr_ready") & clean & (F.col("roll_state") == "normal")
        identity = [F.col("root"), F.col("contract_symbol"), F.col("session_id"), utc_text(F.col("end")), F.col("location"), F.col("prior_session_id"), F.col("poc_tick").cast("string"), ready.cast("string")]
        return self._kept(rows.withColumn("measurement_ready", ready).withColumn("auction_id", list_id("auction", identity)), "auction")

    @cached_property
    def segmented(self) -> DataFrame:
        return self._kept(gaps.segments(windows.tod_volume_z(self.scaled, self.policy)), "segmented")

    @cached_property
    def gaps(self) -> DataFrame:
        return gaps.formations(self.segmented, self.policy)

    @cached_property
    def gap_bars(self) -> DataFrame:
        return self._kept(gaps.gap_bars(self.gaps, self.segmented, self.policy), "gap_bars")

    @cached_property
    def gap_states(self) -> DataFrame:
        return gaps.bar_states(self.gap_bars, self.gaps, self.segmented)

    @cached_property
    def icm(self) -> DataFrame:
        return windows.icm(self.medium, self.scaled, self.policy)

    @cached_property
    def imsi(self) -> DataFrame:
        return imsi.imsi(self.medium, self.policy)

    def _states(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        columns = [*SESSION, "end", "available_at", "measurement_ready", "quality_flags"]
        iae = self.gap_states.join(self.fast.select("root", "contract_symbol", "end", "available_at"), ["root", "contract_symbol", "end"])
        iae = iae.withColumn("measurement_ready", F.col("atr_ready") & F.col("gap_idx").isNotNull())
        return self.auction_state.select(*columns, "auction_id"), self.imsi.select(columns), self.icm.select(columns), iae.select(columns)

    @cached_property
    def synergy(self) -> DataFrame:
        return self._kept(align.align(*self._states(), self.policy), "synergy")

    @cached_property
    def retest_synergy(self) -> DataFrame:
        """The alignment of each first retest's bar with the retest's own gap in place of the bar's latest gap state."""
        own = self.retests.select(*SESSION, "end", F.col("parent_event_id").alias("gap_id"), "quality_flags", F.col("atr_ready").alias("measurement_ready"))
        return align.align_exact(self.synergy, own, self.policy)

    @cached_property
    def retests(self) -> DataFrame:
        """First retests as events; the parent is the gap."""
        known = self.segmented.select("root", "contract_symbol", "idx", "reset", "tod_flag", "atr_ready")
        rows = gaps.first_retests(self.gap_bars).join(known, ["root", "contract_symbol", "idx"]).withColumn("quality_flags", F.array_sort(F.array_union(gaps.bar_flags(), F.col("guards"))))
        gap = list_id("gap", [F.col("root"), F.col("contract_symbol"), F.col("direction"), utc_text(F.col("created_at")), F.lit(None).cast("string")])
        rows = rows.withColumn("parent_event_id", gap).withColumn("event_type", F.when(F.col("direction") == "bullish", "iae_retest_bull").otherwise("iae_retest_bear"))
        rows = rows.withColumn("direction", F.when(F.col("direction") == "bullish", 1).otherwise(-1))
        return rows.withColumn("event_id", auction.event_id(F.col("event_type"), F.col("parent_event_id")))

    @cached_property
    def events(self) -> DataFrame:
        return align.candidate_events(auction.transition_events(self.transitions), self.retests, self.synergy, self.retest_synergy)

    def summary(self) -> DataFrame:
        """Counters of the run by root: (root, counter, n). Quotes are those that were ignored; rolls are changes of contract."""
        t = self.trades.groupBy("root").agg(
            F.count("*").alias("ticks"), F.count_if("admitted").alias("admitted"), F.count_distinct("contract_symbol").alias("contracts"), F.count_distinct("session_id").alias("sessions"),
            (F.count_distinct("contract_symbol") - 1).alias("rolls"),
        )
        parts = [t.unpivot("root", [c for c in t.columns if c != "root"], "counter", "n")]
        tables = {"quotes": split_ticks(self.tape)[1], "fast_bars": self.fast, "medium_bars": self.medium, "final_profiles": self.finals, "gaps": self.gaps.filter("formed"), "auction_snapshots": self.located, "icm_snapshots": self.icm,
                  "imsi_snapshots": self.imsi, "synergy_snapshots": self.synergy, "candidate_events": self.events, "research_ready_events": self.events.filter("research_ready")}
        parts += [df.groupBy("root").agg(F.count("*").alias("n")).select("root", F.lit(k).alias("counter"), "n") for k, df in tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def ids(self) -> DataFrame:
        """(root, contract_symbol, table_name, at, id): the content ids of final profiles, states, alignments and events."""
        made = {
            "profile": identities.with_last_tick(self.finals, self.trades).withColumn("at", F.col("as_of")).withColumn("id", identities.profile_id("final_session")),
            "imsi": self.imsi.withColumn("at", F.col("end")).withColumn("id", identities.imsi_id()),
            "icm": self.icm.withColumn("at", F.col("end")).withColumn("id", identities.icm_id()),
            "auction": self.auction_state.withColumn("at", F.col("end")).withColumn("id", F.col("auction_id")),
            "synergy": self.synergy.withColumn("at", F.col("end")).withColumn("id", F.col("synergy_id")),
            "event": self.events.withColumn("at", F.col("end")).withColumn("id", F.col("event_id")),
        }
        parts = [rows.select("root", "contract_symbol", F.lit(name).alias("table_name"), "at", "id") for name, rows in made.items()]
        return self._kept(reduce(DataFrame.unionByName, parts), "ids")

    @cached_property
    def retest_measures(self) -> DataFrame:
        """Each retest of a gap with the measures of the gap and of the retest."""
        made = self.gaps.filter("formed").select("root", "contract_symbol", F.col("idx").alias("gap_idx"), "z_displacement", "z_gap", "efficiency")
        rows = self.gap_bars.filter("retest").join(made, ["root", "contract_symbol", "gap_idx"])
        score_input = F.greatest("volume_z", F.lit(self.policy.volume_z_floor))
        return rows.select(
            *SESSION, "end", "z_displacement", "z_gap", "efficiency", "quality", "age", "depth", "wick", "close_position", "decay", "volume_z", "score", (F.col("happened") == "absorbed").alias("absorbed"),
            F.when(F.col("volume_z").isNotNull(), score_input).alias("tod_volume_score_input"), F.least(F.greatest("close_position", F.lit(0.0)), F.lit(1.0)).alias("close_position_score"),
            F.when(F.col("guard").isNull(), F.col("score")).alias("score_effective"), F.array_compact(F.array("guard")).alias("quality_flags"),
        )

    def melted(self) -> list[DataFrame]:
        """The measurement tables in long form."""
        counters = self.transitions.select(*SESSION, "end", "reentry_count", "consecutive_minutes_outside")
        why = F.array_compact(F.array(F.when(~F.col("atr_ready"), "ATR_WARMUP"), F.when(F.col("prior_vah_tick").isNull(), "NO_PRIOR_SAME_SESSION_TYPE_PROFILE"), F.when(F.col("degenerate"), "DEGENERATE_PROFILE")))
        return [
            features.melt(self.auction_state.join(counters, [*SESSION, "end"]).withColumn("quality_flags", why).drop("data_flags", "prior_flags", "histogram"), "auction"),
            # the state's own flag says what is missing; the other flags hold for every row
            features.melt(self.imsi.withColumn("quality_flags", F.array_compact(F.array("state_flag"))), "imsi"), features.melt(self.icm.drop("atr"), "icm"), features.melt(self.retest_measures, "iae"),
        ]

    def registry(self, mode: str) -> DataFrame:
        """(mode, root, contract_symbol, table_name, n_rows, fingerprint): what this run says of each contract, for a registry of runs."""
        return integrity.run_fingerprint(self.ids, ["root", "contract_symbol", "table_name"], ["at"], ["id"]).select(F.lit(mode).alias("mode"), "root", "contract_symbol", "table_name", "n_rows", "fingerprint")

    TABLES = ("fast", "medium", "bins", "finals", "auction_state", "imsi", "icm", "gap_states", "synergy", "events")

    def write(self, path: str, tables: tuple[str, ...] = TABLES) -> list[tuple[str, str, int, int]]:
        """Publish measurement tables below path by root and contract, with JSON reports of the run and of what breaks the tables' rules.

        Ticks stay in the private store; partitions that this run does not touch stay
        as they are. Returns the report of the rules: (table_name, rule, violations, n_rows).
        """
        report = publish({name: getattr(self, name) for name in tables}, path)
        write_report(self.summary(), path, "summary", ("root", "counter"))
        return report


__all__ = ["Measurement"]
