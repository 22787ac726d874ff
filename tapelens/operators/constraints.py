"""What every published row must satisfy, declared per table and checked in the scan or the write that touches the rows anyway.

A rule is a name and a SQL condition that marks a faulty row; a condition that cannot
be decided (null) marks it too. RULES has those of each table of a run. check() counts
the violations of a table in one aggregate; observed() takes the same counts from a
table while it is written, so publishing and checking read the rows once.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

class Rule(NamedTuple):
    """SQL that marks a faulty row, and by column SQL that makes a sound row faulty in this way."""

    broken: str
    fault: dict[str, str]


Rules = dict[str, Rule]

#: The domains of the tables' words.
ROLL_STATES = ("normal", "pre_roll", "roll_transition", "post_roll", "blackout")
SESSION_TYPES = ("eth", "rth", "asia", "london", "new_york", "us_cash_hours", "maintenance", "closed", "unknown")
LOCATIONS = ("inside_value", "above_value", "below_value", "no_reference")
GAP_DIRECTIONS = ("bullish", "bearish")
GAP_EVENTS = ("open", "tested", "absorbed", "invalidated", "expired")
EVENT_TYPES = (
    "value_exit_up", "value_exit_down", "value_reentry_from_above", "value_reentry_from_below", "poc_migration_above_prior_vah", "poc_migration_below_prior_val", "iae_retest_bull", "iae_retest_bear",
)
QUALITY = ("VALID", "PARTIAL", "STALE", "WITHHELD", "REJECTED")


def text(*names: str) -> Rules:
    """Present and not blank."""
    return {f"{n}_is_text": Rule(f"trim({n}) = ''", {n: "' '"}) for n in names}


def finite(*names: str, optional: bool = False) -> Rules:
    """A number, neither infinite nor NaN; if optional, or null."""
    return {f"{n}_is_finite": Rule(f"coalesce(isnan({n}) OR abs({n}) = double('Infinity'), {not optional})", {n: "double('NaN')"}) for n in names}


def above(low: float, *names: str, equal: bool = False, optional: bool = False) -> Rules:
    sign, word = (">=", "at_least") if equal else (">", "above")
    return {f"{n}_is_{word}_{low:g}": Rule(f"NOT coalesce({n} {sign} {low}, {optional})", {n: f"{low - 1 if equal else low}"}) for n in names}


def between(low: float, high: float, *names: str, optional: bool = True) -> Rules:
    return {f"{n}_in_{low:g}_{high:g}": Rule(f"NOT coalesce({n} BETWEEN {low} AND {high}, {optional})", {n: f"{high} + 1"}) for n in names}


def one_of(name: str, domain: tuple[str, ...], optional: bool = False) -> Rules:
    words = ", ".join(f"'{w}'" for w in domain)
    return {f"{name}_in_domain": Rule(f"NOT coalesce({name} IN ({words}), {optional})", {name: "'no such word'"})}


def flags(*names: str) -> Rules:
    """Sorted, without repeats, null or blank entries."""
    wrong = "{0} <> array_sort(array_distinct({0})) OR exists({0}, f -> f IS NULL OR trim(f) = '')"
    return {f"{n}_is_a_sorted_set": Rule(wrong.format(n), {n: "array('B', 'A')"}) for n in names}


def in_order(*clocks: str) -> Rules:
    """Each clock at or after the one before."""
    return {f"{a}_by_{b}".replace("`", ""): Rule(f"{a} > {b}", {b: f"{a} - INTERVAL 1 SECOND"}) for a, b in zip(clocks, clocks[1:])}


def together(name: str, first: str, *names: str) -> Rules:
    """All null or none."""
    fault = {first: f"CASE WHEN {first} IS NULL THEN '1' END", names[0]: f"CASE WHEN {first} IS NOT NULL THEN {names[0]} END"}
    return {f"{name}_together": Rule(" OR ".join(f"({n} IS NULL) <> ({first} IS NULL)" for n in names), fault)}


def agree(name: str, a: str, b: str, **fault: str) -> Rules:
    """Two conditions that are both true or both false."""
    return {name: Rule(f"({a}) <> ({b})", fault)}


def implies(name: str, a: str, b: str, **fault: str) -> Rules:
    return {name: Rule(f"coalesce({a}, false) AND NOT coalesce({b}, false)", fault)}


def never(name: str, broken: str, **fault: str) -> Rules:
    return {name: Rule(broken, fault)}


def merged(*parts: Rules) -> Rules:
    out: Rules = {}
    for p in parts:
        if shared := out.keys() & p.keys():
            raise ValueError(f"rules of one name: {sorted(shared)}")
        out |= p
    return out


CONTRACT = text("root", "contract_symbol", "session_id")
KNOWN = in_order("`end`", "available_at")
TICKS = "transform(histogram, x -> x.tick)"
BARS = merged(
    CONTRACT, KNOWN, above(0, "open", "high", "low", "close", "volume", "n_trades"), one_of("session_type", SESSION_TYPES),
    never("start_before_end", "start >= `end`", start="`end`"),
    never("duration_is_period", "timestampdiff(MICROSECOND, start, `end`) <> period_minutes * 60000000L", period_minutes="1"),
    never("open_in_range", "NOT open BETWEEN low AND high", open="high + 1"),
    never("close_in_range", "NOT close BETWEEN low AND high", close="low - 1"),
    never("inside_session", "start < session_start OR `end` > session_end", session_end="start"),
)
PROFILES = merged(
    CONTRACT, above(0, "total_volume"), between(0, 1, "profile_entropy", optional=False), finite("profile_skew", "profile_kurtosis", optional=True), one_of("session_type", SESSION_TYPES),
    never("ticks_rise", f"coalesce({TICKS} <> array_sort(array_distinct({TICKS})), true)", histogram="concat(histogram, histogram)"),
    never("bins_are_positive", "exists(histogram, x -> NOT x.volume > 0)", histogram="array(named_struct('tick', poc_tick, 'volume', -1D))"),
    never("volume_is_conserved", "abs(aggregate(histogram, 0D, (s, x) -> s + x.volume) - total_volume) > 1e-12 * greatest(abs(total_volume), 1D)", total_volume="total_volume + 1"),
    never("poc_is_occupied", f"NOT array_contains({TICKS}, poc_tick)", poc_tick="-1"),
    never("area_holds_poc", "NOT poc_tick BETWEEN val_tick AND vah_tick", vah_tick="val_tick - 1"),
    never("as_of_is_not_before_the_end", "session_end > as_of", as_of="session_start"),
    agree("moments_unless_degenerate", "profile_skew IS NOT NULL", "NOT degenerate", degenerate="profile_skew IS NOT NULL"),
)
AUCTION = merged(
    CONTRACT, text("auction_id"), KNOWN, flags("quality_flags"), one_of("location", (*LOCATIONS, "off_grid")), one_of("roll_state", ROLL_STATES),
    between(0, 1, "volume_above_poc_ratio", "profile_entropy", optional=False), between(0, 1, "volume_outside_value_ratio", "bar_close_outside_value_ratio", "profile_overlap_ratio"),
    finite("distance_to_current_poc_ticks"),
    finite("distance_to_current_poc_vol", "distance_to_prior_poc_vol", "distance_to_vah_vol", "distance_to_val_vol", "value_area_width_vol", "poc_migration_vol", "value_mid_migration_vol", optional=True),
    above(0, "atr", optional=True),
    agree("location_fits_reference", "location = 'no_reference'", "prior_session_id IS NULL", location="CASE WHEN location <> 'no_reference' THEN 'no_reference' ELSE 'inside_value' END"),
    implies("ready_has_reference_and_scale", "measurement_ready", "prior_session_id IS NOT NULL AND atr_ready", measurement_ready="true", atr_ready="false"),
)
IMSI = merged(
    CONTRACT, KNOWN, flags("quality_flags"), between(0, 100, "vwrsi", optional=False), above(0, "session_vwap"), finite("vwap_distance"), finite("adjusted", "distance", optional=True),
    between(0, 1, "rarity", "delta"), above(0, "effective_size", optional=True), between(0, 15, "neighbour_support", optional=False),
    together("covariance", "delta", "effective_size", "condition"), together("neighbours", "neighbour_mean", "neighbour_p90"),
    agree("support_fits_neighbours", "neighbour_support = 0", "neighbour_mean IS NULL", neighbour_support="CASE WHEN neighbour_support = 0 THEN 1 ELSE 0 END"),
    implies("distance_has_covariance", "distance IS NOT NULL", "delta IS NOT NULL", distance="1D", delta="null"),
    agree("ready_is_warm", "measurement_ready", "distance IS NOT NULL AND rarity IS NOT NULL", measurement_ready="NOT measurement_ready"),
)
ICM = merged(
    CONTRACT, KNOWN, flags("quality_flags"), finite("fair_value", "slope_per_bar", "curvature_per_bar2", "r_ratio"), above(0, "sigma_ols", "sigma_mad", "sigma_blend", equal=True),
    finite("z_raw", "slope_normalized", "curvature_normalized", "fair_value_distance_vol", optional=True), between(-4.5, 4.5, "z_capped"), between(-1, 1, "residual_autocorrelation"), above(3, "window_size"),
    together("z", "z_raw", "z_capped"), implies("effective_is_capped", "z_effective IS NOT NULL", "z_effective = z_capped", z_effective="9D"),
    agree("geometry_fits_scale", "sigma_blend > 0", "slope_normalized IS NOT NULL AND curvature_normalized IS NOT NULL", sigma_blend="0D", slope_normalized="1D", curvature_normalized="1D"),
    agree("ready_has_z", "measurement_ready", "z_effective IS NOT NULL", measurement_ready="NOT measurement_ready"),
)
GAP_STATES = merged(
    CONTRACT, flags("quality_flags"), one_of("direction", GAP_DIRECTIONS, optional=True), one_of("gap_event", GAP_EVENTS, optional=True), together("gap", "gap_idx", "gap_event", "direction"),
    above(0, "active_gaps", equal=True), implies("gap_is_not_ahead", "gap_idx IS NOT NULL", "gap_idx <= idx", gap_idx="idx + 1"),
)
_STATE = "named_struct('state_end', `end` + INTERVAL 1 SECOND, 'measurement_ready', true, 'quality_flags', cast(array() AS array<string>))"
SYNERGY = merged(
    CONTRACT, text("auction_id", "synergy_id"), KNOWN, flags("component_quality_flags", "blocking_quality_flags", "all_quality_flags"),
    agree("present_fits_references", "present", "imsi IS NOT NULL AND icm IS NOT NULL AND iae IS NOT NULL", present="NOT present"),
    implies("ready_is_present_and_fresh", "ready", "present AND fresh", ready="true", fresh="false"),
    *[never(f"{s}_is_not_ahead", f"coalesce({s}.state_end > `end`, false)", **{s: _STATE}) for s in ("imsi", "icm", "iae")],
    never("flags_are_the_union", "all_quality_flags <> array_sort(array_union(component_quality_flags, blocking_quality_flags))", all_quality_flags="array('A', 'B')"),
)
EVENTS = merged(
    CONTRACT, text("event_id", "auction_id", "synergy_id", "data_hash"), KNOWN, one_of("event_type", EVENT_TYPES), never("direction_is_a_sign", "NOT direction IN (-1, 1)", direction="0"),
    never("parent_is_text", "coalesce(trim(parent_event_id) = '', false)", parent_event_id="' '"),
    agree("exits_alone_have_no_parent", "parent_event_id IS NULL", "startswith(event_type, 'value_exit')", parent_event_id="CASE WHEN parent_event_id IS NULL THEN 'x' END"),
    implies("research_needs_inputs", "research_ready", "has_imsi AND has_icm AND has_iae", research_ready="true", has_icm="false"),
)
TRADES = merged(
    CONTRACT, in_order("exchange_time", "available_at"), finite("price", "quantity"), above(0, "minimum_tick"), above(0, "source_sequence", equal=True, optional=True),
    never("source_event_id_is_text", "coalesce(trim(source_event_id) = '', false)", source_event_id="' '"),
    agree("rejected_has_reason", "admitted", "reject_flag IS NULL", admitted="NOT admitted"),
)
PIT = merged(
    text("dataset_id", "series_id", "source_version", "lineage_hash"), flags("quality_flags"), one_of("quality_status", QUALITY), in_order("observation_time", "usable_from"),
    *[never(f"{c}_by_usable_from", f"coalesce({c} > usable_from, false)", **{c: "usable_from + INTERVAL 1 SECOND"}) for c in ("release_time", "vendor_time", "delivery_time")],
    agree("withheld_has_reason", "value IS NULL", "missing_reason IS NOT NULL", missing_reason="CASE WHEN missing_reason IS NULL THEN 'x' END"),
)

RULES: dict[str, Rules] = {
    "fast": BARS, "medium": BARS, "finals": PROFILES, "auction_state": AUCTION, "imsi": IMSI, "icm": ICM, "gap_states": GAP_STATES, "synergy": SYNERGY, "events": EVENTS, "trades": TRADES, "pit": PIT,
}


def _broken(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.broken), F.lit(True))


def _counts(rules: Rules) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(_broken(r)).alias(k) for k, r in rules.items()]]


def check(rows: DataFrame, name: str, rules: Rules | None = None) -> DataFrame:
    """(table_name, rule, violations, n_rows): the table's rules, counted in one scan."""
    rules = RULES[name] if rules is None else rules
    counted = rows.select(*_counts(rules))
    pairs = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(k).alias("rule"), F.col(k).alias("violations"), F.col("n_rows")) for k in rules])
    return counted.select(F.inline(pairs))


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(rows, name) for name, rows in tables.items()])


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows that count their own violations while an action reads them; the observation then holds n_rows and each rule's count."""
    seen = Observation(f"constraints of {name}")
    return rows.observe(seen, *_counts(RULES[name])), seen


def faulty(rows: DataFrame, name: str) -> DataFrame:
    """The rows that break rules, with their names in `broken`: what goes to a reject table."""
    broken = F.array_compact(F.array(*[F.when(_broken(r), k) for k, r in RULES[name].items()]))
    return rows.withColumn("broken", broken).filter(F.size("broken") > 0)


def prove(rows: DataFrame, name: str, at: str) -> DataFrame:
    """(table_name, rule, planted, caught, violations): the rules of a table on its rows and on copies with one planted fault each.

    Rule i's copies are the rows whose day of month is i mod 5. violations are those
    of the rows themselves, caught the copies of a rule's fault that it marks. One scan.
    """
    rules = RULES[name]
    copies = F.array_compact(F.array(F.lit(-1), *[F.when(F.dayofmonth(at) % 5 == i % 5, F.lit(i)) for i in range(len(rules))]))
    out = rows.withColumn("__fault", F.explode(copies))
    new: dict[str, Column] = {}
    for i, rule in enumerate(rules.values()):
        for c, value in rule.fault.items():
            c = c.strip("`")
            new[c] = F.when(F.col("__fault") == i, F.expr(value).cast(rows.schema[c].dataType)).otherwise(new.get(c, F.col(c)))
    out = out.withColumns(new)
    fault = F.col("__fault")
    # a copy meets the rule of its own fault alone, and only the rows themselves meet all rules
    hits = [F.when((fault == -1) | (fault == i), _broken(r)).alias(f"__hit_{i}") for i, r in enumerate(rules.values())]
    counted = out.select(fault, *hits).select(
        *[F.count_if(fault == i).alias(f"planted_{i}") for i in range(len(rules))],
        *[F.count_if(F.col(f"__hit_{i}") & (fault == i)).alias(f"caught_{i}") for i in range(len(rules))],
        *[F.count_if(F.col(f"__hit_{i}") & (fault == -1)).alias(f"real_{i}") for i in range(len(rules))],
    )
    row = lambda i, k: F.struct(F.lit(name).alias("table_name"), F.lit(k).alias("rule"), F.col(f"planted_{i}").alias("planted"), F.col(f"caught_{i}").alias("caught"), F.col(f"real_{i}").alias("violations"))
    return counted.select(F.inline(F.array(*[row(i, k) for i, k in enumerate(rules)])))
