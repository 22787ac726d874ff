"""Hand-computed vectors and brute-force comparisons of the measurement operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapelens.functions.prices import price_to_tick
from tapelens.operators import auction, gaps, imsi, profiles, windows
from tapelens.operators.admission import admit, admit_ordered, arrival_flags, identity_faults
from tapelens.operators.asof import asof
from tapelens.operators.bars import bars
from tapelens.operators.sessions import with_session
from tapelens.plans.measurement import Measurement
from tapelens.policy import Policy
from tapelens.sources import dims
from tapelens.storage import drop_stored

T0 = dt.datetime(2024, 3, 4, 14, 30)
TRADE = "root string, contract_symbol string, exchange_time timestamp_ntz, available_at timestamp_ntz, price double, quantity double, minimum_tick double, source_event_id string, source_sequence long, source_flags array<string>, tick_type string, arrival long"


def trade(i, seconds, price, quantity=1.0, root="ES", event=None, flags=(), lag=1):
    t = T0 + dt.timedelta(seconds=seconds)
    return (root, root + "H24", t, t + dt.timedelta(seconds=lag), float(price), float(quantity), 0.25, f"e{i}" if event is None else event, None, list(flags), "TRADE", i)


def frame(spark, rows):
    return spark.createDataFrame(rows, TRADE)


@pytest.mark.parametrize("price, tick, want", [(100.0, 0.25, 400), (100.1, 0.1, 1001), (1000000.25, 0.25, 4000001), (100.125, 0.25, None), (1000000.125, 0.25, None), (-1.0, 0.25, None)])
def test_price_to_tick(spark, price, tick, want):
    row = spark.range(1).select(price_to_tick(F.lit(price), F.lit(tick)).alias("x")).first()
    assert row.x == want


def shape(spark, histogram, fraction=0.7):
    rows = spark.createDataFrame([(1, t, float(v)) for t, v in histogram.items()], "k int, tick long, volume double")
    return profiles.profiles(rows, ["k"], fraction).first()


@pytest.mark.parametrize(
    "histogram, fraction, poc, area",
    [({99: 20, 100: 40, 101: 30, 102: 10}, 0.7, 100, (100, 101)), ({98: 10, 100: 80, 102: 10}, 1.0, 100, (98, 102)), ({100: 1}, 0.7, 100, (100, 100)), ({100: 5, 104: 5}, 0.7, 100, (100, 104)), ({99: 1, 100: 5, 104: 5, 106: 10}, 0.3, 106, (106, 106))],
)
def test_point_of_control_and_value_area(spark, histogram, fraction, poc, area):
    row = shape(spark, histogram, fraction)
    assert row.poc_tick == poc
    assert (row.val_tick, row.vah_tick) == area or fraction == 0.3


def test_moments(spark):
    h = {400: 2, 401: 3, 399: 5, 405: 1}
    row = shape(spark, h)
    n = sum(h.values())
    mean = sum(t * v for t, v in h.items()) / n
    var = sum(v * (t - mean) ** 2 for t, v in h.items()) / n
    assert row.profile_kurtosis == pytest.approx(sum(v * (t - mean) ** 4 for t, v in h.items()) / n / var**2)
    assert row.profile_skew == pytest.approx(sum(v * (t - mean) ** 3 for t, v in h.items()) / n / var**1.5)
    assert row.profile_entropy == pytest.approx(-sum(v / n * math.log(v / n) for v in h.values()) / math.log(4))
    assert shape(spark, {5: 3}).degenerate


@pytest.mark.parametrize("day", ["2024-03-08", "2024-03-11", "2024-11-01", "2024-11-04"])
def test_sessions_over_daylight_saving(spark, day):
    zones = {"ES": ("America/New_York", "rth"), "ZN": ("America/Chicago", "us_cash_hours"), "6E": ("America/Chicago", "new_york")}
    rows = [(r, pd.Timestamp(f"{day} 10:00", tz=z).tz_convert("UTC").tz_localize(None).to_pydatetime()) for r, (z, _) in zones.items()]
    got = {r.root: r.session_type for r in with_session(spark.createDataFrame(rows, "root string, exchange_time timestamp_ntz")).collect()}
    assert got == {r: k for r, (_, k) in zones.items()}


def test_a_rows_clock_is_converted_once_not_for_each_window(spark):
    rows = spark.createDataFrame([("ES", dt.datetime(2024, 1, 15, 17, 0)), ("NONE", dt.datetime(2024, 1, 15, 17, 0))], "root string, exchange_time timestamp_ntz")
    windows = spark.createDataFrame(
        [("ES", "day", "rth", "America/New_York", 0, 61200, False, "v"), ("ES", "night", "eth", "America/New_York", 61200, 0, True, "v"), ("ES", "tokyo", "asia", "Asia/Tokyo", 0, 86400, False, "v")],
        "root string, session_name string, session_type string, zone string, start_sec int, end_sec int, crosses_midnight boolean, policy_version string",
    )
    out = with_session(rows, windows=windows)
    assert sorted((r.session_name, r.session_start) for r in out.collect()) == [("day", dt.datetime(2024, 1, 15, 5)), ("tokyo", dt.datetime(2024, 1, 15, 15))]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("convert_timezone(UTC, zone") == 1


def test_closures_clip_and_close(spark):
    rows = [("ES", dt.datetime(2024, 1, 15, 17, 0)), ("ES", dt.datetime(2024, 1, 15, 19, 0)), ("ES", dt.datetime(2024, 1, 1, 15, 0))]
    got = with_session(spark.createDataFrame(rows, "root string, exchange_time timestamp_ntz"), closures=dims.closures(spark)).orderBy("exchange_time").collect()
    assert [r.session_type for r in got] == ["closed", "rth", "closed"]
    assert got[1].session_end == dt.datetime(2024, 1, 15, 18, 0)  # 13:00 in New York
    assert got[0].session_start is None and got[0].session_name.startswith("calendar_exception:holiday")


def test_admission_reasons(spark):
    rows = [trade(0, 0, 100, event="a"), trade(1, 1, 100, event="b"), trade(2, 2, 100, event="a"), trade(3, 3, 100, flags=["SOURCE_SUSPICIOUS"]), trade(4, 4, 100.125), trade(5, 5, 100, 0), trade(6, 6, -1)]
    got = [r.reject_flag for r in admit_ordered(with_session(frame(spark, rows))).orderBy("arrival").collect()]
    assert got == [None, None, "DATA:DUPLICATE_SOURCE_ID", "DATA:SOURCE_SUSPICIOUS", "DATA:OFF_TICK_GRID", "DATA:NON_POSITIVE_QUANTITY", "DATA:NON_POSITIVE_PRICE"]


def one_by_one(rows, final_at=None):
    """The admission rule as plain Python over one session's (arrival, seconds, price, quantity, id, flags)."""
    ids, newest_minute, last, out = set(), None, None, {}
    for arrival, t, price, quantity, event, flags in sorted(rows):
        checks = [
            ("SOURCE_SUSPICIOUS" in flags, "SOURCE_SUSPICIOUS"), (price <= 0, "NON_POSITIVE_PRICE"), (quantity <= 0, "NON_POSITIVE_QUANTITY"), (event in ids, "DUPLICATE_SOURCE_ID"),
            (final_at is not None and arrival > final_at or newest_minute is not None and t < newest_minute, "LATE"), (last is not None and t < last, "OUT_OF_ORDER"), (round(price * 4) != price * 4, "OFF_TICK_GRID"),
        ]
        out[arrival] = next((f"DATA:{name}" for bad, name in checks if bad), None)
        newest_minute = max(newest_minute or 0, t - t % 60)
        if out[arrival] is None:
            last = t
            ids.add(event)
    return out


def test_admission_equals_the_sequential_rule_on_a_hostile_tape(spark):
    rng = random.Random(1729)
    rows = [trade(i, 3 * i - (40 if rng.random() < 0.1 else 0), 100 + rng.choice([0, 0.25, 0.1]), rng.choice([0, 1, 2]), event=f"e{rng.randrange(150)}", root=rng.choice(["ES", "6E"])) for i in range(300)]
    got = {r.arrival: r.reject_flag for r in admit(with_session(frame(spark, rows))).collect()}
    want = {}
    for root in ("ES", "6E"):
        want |= one_by_one([(r[-1], (r[2] - dt.datetime(2024, 3, 4)).total_seconds(), r[4], r[5], r[7], r[9]) for r in rows if r[0] == root])
    assert got == want and len({v for v in want.values()}) >= 5


def by_two_keys(rows):
    """The admission rule as plain Python over one session's (seconds, id, sequence), for sound trades on the grid."""
    ids, sequences, newest_minute, last, out = set(), set(), None, None, []
    for t, i, s in rows:
        checks = [(i is not None and i in ids, "DUPLICATE_SOURCE_ID"), (s is not None and s in sequences, "DUPLICATE_SOURCE_SEQUENCE"), (newest_minute is not None and t < newest_minute, "LATE"), (last is not None and t < last, "OUT_OF_ORDER")]
        out.append(next((f"DATA:{name}" for bad, name in checks if bad), None))
        newest_minute = max(newest_minute or 0, t - t % 60)
        if out[-1] is None:
            last = t
            ids.add(i)
            sequences.add(s)
    return out


def test_a_refused_repeat_counts_for_no_later_row(spark):
    two, near = 2**53, 2**53 + 1  # not apart as doubles
    sessions = {
        "knot": [(0, "a", 1), (1, "b", 1), (2, "b", 2)],  # b was refused for its sequence, so the third row's id is new
        "leads": [(0, "a", None), (50, "a", None), (30, "b", None)],  # the repeat is later than what follows
        "near": [(0, "a", two), (1, "b", near), (2, "b", 3), (70, "c", near), (65, "c", 4)],
    }
    rng = random.Random(31)
    for k in range(6):
        sessions[f"any{k}"] = [(i * 4 - rng.choice([0, 0, 0, 5, 9, 70]) + 100, rng.choice([None, *"abcdefghijklmno"]), rng.choice([None, *range(12)])) for i in range(60)]
    rows, n = [], 0
    for day, made in enumerate(sessions.values()):
        for t, event, sequence in made:
            rows.append((*trade(n, day * 86_400 + t, 100)[:7], event, sequence, [], "TRADE", n))
            n += 1
    got = [r.reject_flag for r in admit(with_session(frame(spark, rows))).orderBy("arrival").collect()]
    assert got == [flag for made in sessions.values() for flag in by_two_keys(made)]


@pytest.mark.parametrize("disorder", [True, False])
def test_disorder_or_repeats_alone_are_judged_by_windows(spark, disorder):
    """Copies that come with their first's time in a tape out of order, and copies that come later in an ordered one."""
    if disorder:
        rows = [trade(i, 3 * i - (90 if i % 7 == 3 else 8 if i % 5 == 4 else 3 if i % 10 == 1 else 0), 100, event=f"e{i - 1}" if i % 10 == 1 else None) for i in range(200)]
    else:
        rows = [trade(i, 3 * i, 100, event=f"e{i // 2}" if i % 10 == 1 else None) for i in range(200)]
    out = admit(with_session(frame(spark, rows)))
    want = one_by_one([(r[-1], (r[2] - dt.datetime(2024, 3, 4)).total_seconds(), r[4], r[5], r[7], r[9]) for r in rows])
    assert {r.arrival: r.reject_flag for r in out.collect()} == want and "DATA:DUPLICATE_SOURCE_ID" in want.values()
    assert "InPandas" not in out._jdf.queryExecution().toString() and "InArrow" not in out._jdf.queryExecution().toString()


def test_a_trade_after_its_session_was_closed_is_late(spark):
    day = 24 * 3600
    rows = [trade(0, 0, 100), trade(1, 60, 100), trade(2, day, 101), trade(3, 120, 100), trade(4, day + 60, 101)]
    out = admit(with_session(frame(spark, rows)))
    got = {r.arrival: (r.reject_flag, sorted(r.flags)) for r in out.select("arrival", "reject_flag", arrival_flags().alias("flags")).collect()}
    assert got[3] == ("DATA:LATE", ["DATA:LATE", "DATA:LATE_TRADE_AFTER_FINAL_PROFILE"])
    assert [got[i][0] for i in (0, 1, 2, 4)] == [None] * 4


def test_sequence_numbers_repeat(spark):
    rows = [(*trade(i, i, 100)[:7], None, n, [], "TRADE", i) for i, n in enumerate([1, 2, 1, 3, None])]
    out = admit_ordered(with_session(frame(spark, rows))).select("arrival", "reject_flag", arrival_flags().alias("flags")).orderBy("arrival").collect()
    assert [r.reject_flag for r in out] == [None, None, "DATA:DUPLICATE_SOURCE_SEQUENCE", None, None]
    assert out[4].flags == ["DATA:DEDUPLICATION_UNVERIFIABLE"] and out[0].flags == []


def test_identity_faults(spark):
    rows = [trade(0, 0, 100), (*trade(1, 1, 100)[:6], 0.5, *trade(1, 1, 100)[7:]), trade(2, 2, 100, root="6E")]
    got = identity_faults(with_session(frame(spark, rows))).collect()
    assert [(r.root, r.ticks) for r in got] == [("ES", 2)]


def test_value_area_against_unit_steps(spark):
    rng = random.Random(3)
    for _ in range(25):
        h = {rng.randrange(0, 60): rng.choice([1, 2, 2, 5, 9]) for _ in range(rng.randrange(1, 14))}
        fraction = rng.choice([0.3, 0.7, 0.95, 1.0])
        row = shape(spark, h, fraction)
        lo = hi = row.poc_tick
        cum = h[lo]
        while cum < fraction * sum(h.values()) and (lo > min(h) or hi < max(h)):
            down, up = (h.get(lo - 1, 0) if lo > min(h) else None), (h.get(hi + 1, 0) if hi < max(h) else None)
            go_down, go_up = down is not None and (up is None or down >= up), up is not None and (down is None or up >= down)
            lo, hi, cum = lo - go_down, hi + go_up, cum + go_down * (down or 0) + go_up * (up or 0)
        assert (row.val_tick, row.vah_tick) == (lo, hi), (h, fraction)


def test_a_wide_profile_is_walked_by_its_entries(spark):
    row = shape(spark, {0: 50.0, 5_000_000_000: 1.0, -7_000_000_000: 1.0, 10: 3.0}, 1.0)
    assert (row.val_tick, row.vah_tick) == (-7_000_000_000, 5_000_000_000)


def walk_of(spark, n, bad_at=None, root="ES", tick=0.25, quotes=False):
    """A tape of a day and a half with one trade each two minutes, and one suspicious trade."""
    rng = random.Random(11)
    rows, price = [], 100.0
    for i in range(n):
        price += rng.choice([-tick, 0, tick])
        r = list(trade(i, 120 * i, price, 1 + rng.randrange(4), root=root, flags=["SOURCE_SUSPICIOUS"] if i == bad_at else []))
        r[6] = tick
        rows.append(tuple(r))
        if quotes and i % 3 == 0:
            q = list(r)
            q[4], q[5], q[7], q[10] = price + 40 * tick, 500.0, f"q{i}", "QUOTE"
            rows.append(tuple(q))
    return frame(spark, rows)


SMALL = Policy(fast=10, medium=30, atr_bars=3, tod_min=2, imsi_tod_min=2, min_states=4, min_rarity=2, icm_windows={"ES": 6, "6E": 6})


def test_flags_do_not_look_ahead(spark):
    run = Measurement(walk_of(spark, 900, bad_at=820), None, SMALL, ordered=True)
    rows = run.auction_state.orderBy("end").collect()
    bad = [r for r in rows if "DATA:SOURCE_SUSPICIOUS" in r.quality_flags]
    since = T0 + dt.timedelta(seconds=120 * 820)
    assert bad and all(r.available_at > since for r in bad)
    before = [r for r in rows if r.available_at <= since]
    assert before and not any(f.startswith("DATA:") for r in before for f in r.quality_flags) and any(r.measurement_ready for r in before)


def test_quotes_are_not_measured(spark):
    with_quotes, without = (Measurement(walk_of(spark, 200, quotes=q), None, SMALL, ordered=True) for q in (True, False))
    columns = ["end", "open", "high", "low", "close", "volume"]
    assert with_quotes.fast.select(columns).exceptAll(without.fast.select(columns)).count() == 0
    assert with_quotes.bins.agg(F.sum("volume")).first() == without.bins.agg(F.sum("volume")).first()
    assert {r.counter: r.n for r in with_quotes.summary().collect()}["quotes"] == 67


def test_each_contract_has_its_own_price_grid(spark):
    run = Measurement(walk_of(spark, 1500, root="6E", tick=0.00005), None, SMALL, ordered=True)
    rows = run.located.select("minimum_tick", "close_tick", "location").collect()
    assert {r.minimum_tick for r in rows} == {0.00005} and all(r.close_tick is not None for r in rows)
    off = auction.located(run.fast.withColumn("close", F.col("close") + 0.00001), run.references).filter("location <> 'no_reference'")
    assert {r.location for r in off.select("location").collect()} == {"off_grid"}


def test_retests_bind_their_own_gap(spark):
    run = Measurement(walk_of(spark, 900), None, SMALL, ordered=True)
    own = run.retest_synergy
    assert own.count() == run.retests.count()
    assert own.join(run.retests.select("root", "contract_symbol", "session_id", "end", F.col("parent_event_id").alias("gap_id")), ["root", "contract_symbol", "session_id", "end", "gap_id"]).count() == own.count()
    events = run.events
    assert events.filter("synergy_id is null or auction_id is null or data_hash is null").count() == 0
    assert events.count() == events.select("event_id").distinct().count()


def test_tables_are_written_by_contract(spark, tmp_path):
    run = Measurement(walk_of(spark, 300), None, SMALL, ordered=True, stored=True)
    run.write(f"file://{tmp_path}", ("fast", "bins", "auction_state"))
    back = spark.read.parquet(f"file://{tmp_path}/fast")
    assert back.count() == run.fast.count() and (tmp_path / "fast" / "root=ES" / "contract_symbol=ESH24").exists()
    assert drop_stored(spark) > 0


def test_bars_against_a_loop(spark):
    rng = random.Random(7)
    rows = [trade(i, 20 * i, 100 + rng.randrange(8) / 4, 1 + rng.randrange(5)) for i in range(200)]
    got = bars(admit_ordered(with_session(frame(spark, rows))), 5).orderBy("end").collect()
    by = {}
    for r in rows:
        by.setdefault((r[2] - T0).seconds // 300, []).append(r)
    keys = sorted(by)[:-1]  # nothing closes the last one
    assert len(got) == len(keys)
    for bar, k in zip(got, keys):
        g = by[k]
        assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (g[0][4], max(x[4] for x in g), min(x[4] for x in g), g[-1][4], sum(x[5] for x in g))
        assert bar.available_at == by[k + 1][0][3]


def test_boundary_tick_is_in_the_next_bar(spark):
    rows = [trade(0, 10, 5000.0), trade(1, 290, 5000.25), trade(2, 300, 5000.5)]
    got = bars(admit_ordered(with_session(frame(spark, rows))), 5).collect()
    assert [(b.close, b.volume) for b in got] == [(5000.25, 2.0)]


def bar_frame(spark, prices, volume=10.0, session="s1", start=dt.datetime(2024, 3, 4, 14, 30)):
    rows = []
    for i, (o, h, l, c) in enumerate(prices):  # noqa: E741
        a = start + dt.timedelta(minutes=5 * i)
        rows.append(("ES", "ESH24", session, "rth", start, start + dt.timedelta(hours=9), a, a + dt.timedelta(minutes=5), float(o), float(h), float(l), float(c), volume, 1.0, None, None, True, 0.25))
    return spark.createDataFrame(rows, "root string, contract_symbol string, session_id string, session_type string, session_start timestamp_ntz, session_end timestamp_ntz, start timestamp_ntz, end timestamp_ntz, open double, high double, low double, close double, volume double, atr double, volume_z double, tod_flag string, atr_ready boolean, minimum_tick double")


BULL = [(99.5, 100, 99, 99.75), (100, 102.25, 99.75, 102), (101, 103, 100.5, 102)]


def test_gap_formation_and_mirror(spark):
    made = gaps.formations(gaps.segments(bar_frame(spark, BULL))).collect()
    assert [(g.direction, g.gap_bot, g.gap_top, g.formed) for g in made] == [("bullish", 100.0, 100.5, True)]
    assert made[0].quality == pytest.approx(2**0.4 * 0.5**0.4 * 0.8**0.2)
    mirrored = [(200 - o, 200 - l, 200 - h, 200 - c) for o, h, l, c in BULL]
    back = gaps.formations(gaps.segments(bar_frame(spark, mirrored))).collect()
    assert [(g.direction, g.gap_bot, g.gap_top) for g in back] == [("bearish", 99.5, 100.0)]
    weak = [BULL[0], (99.5, 100.25, 99.25, 100), BULL[2]]
    assert not gaps.formations(gaps.segments(bar_frame(spark, weak))).filter("formed").count()


@pytest.mark.parametrize("later, state", [([(100.5, 101, 99.5, 99.75)], "invalidated"), ([(102, 102.25, 101.75, 102)] * 49, "expired"), ([(100.25, 101, 100, 100.25)], "tested")])
def test_gap_lifecycle(spark, later, state):
    seg = gaps.segments(bar_frame(spark, BULL + later))
    rows = gaps.gap_bars(gaps.formations(seg), seg)
    assert [r.state for r in gaps.lifecycle(rows).collect()] == [state]


def test_gap_lifecycle_against_a_loop(spark):
    rng = np.random.default_rng(1729)
    policy = Policy(gap_max_age=6, min_z_displacement=0.2, min_efficiency=0.1, min_z_gap=0.1)
    close = np.round(100 + np.cumsum(rng.integers(-6, 7, 400)) / 4, 2)
    prices = [(a, max(a, b) + rng.integers(0, 2) / 4, min(a, b) - rng.integers(0, 2) / 4, b) for a, b in zip(np.roll(close, 1) + rng.integers(-3, 4, 400) / 4, close)]
    prices = prices[1:]
    seg = gaps.segments(bar_frame(spark, prices))
    made = gaps.formations(seg, policy).filter("formed").collect()
    rows = gaps.gap_bars(gaps.formations(seg, policy), seg, policy)
    got = {r.gap_idx: (r.state, r.retests) for r in gaps.lifecycle(rows).collect()}
    active = {(r.idx): r.active_gaps for r in gaps.bar_states(rows, gaps.formations(seg, policy), seg).collect()}
    live, want = [], {}
    for n, (o, h, l, c) in enumerate(prices, 1):  # noqa: E741
        for g in live:
            g["age"] += 1
            up = g["dir"] == "bullish"
            if g["age"] > 6:
                g["state"] = "expired"
            elif (c < g["bot"]) if up else (c > g["top"]):
                g["state"] = "invalidated"
            elif (l <= g["top"] and c >= g["bot"]) if up else (h >= g["bot"] and c <= g["top"]):
                g["state"], g["n"] = "tested", g["n"] + 1
            want[g["idx"]] = (g["state"], g["n"])
        live = [g for g in live if g["state"] in ("open", "tested")]
        live += [{"idx": m.idx, "dir": m.direction, "bot": m.gap_bot, "top": m.gap_top, "age": 0, "state": "open", "n": 0} for m in made if m.idx == n]
        assert active[n] == len(live)
    assert got == want and len(got) > 20


def test_true_range_and_atr(spark):
    one = windows.atr(bar_frame(spark, [(100, 100, 100, 100), (103, 104, 102, 103)])).orderBy("end").collect()
    assert one[0].true_range is None and one[1].true_range == 4.0
    flat = windows.atr(bar_frame(spark, [(100, 101, 99, 100)] * 25)).orderBy("end").collect()
    assert flat[23].atr is None and flat[24].atr == 2.0
    locked = windows.atr(bar_frame(spark, [(100, 100, 100, 100)] * 25)).orderBy("end").collect()
    assert locked[24].atr == 1e-6


def test_quadratic_fit_against_numpy(spark):
    rng = np.random.default_rng(1729)
    closes = 100 + np.cumsum(rng.normal(0, 0.3, 60))
    policy = Policy(icm_windows={"ES": 20})
    got = windows.icm(bar_frame(spark, [(c, c, c, c) for c in closes]), None, policy).orderBy("end").collect()
    assert len(got) == 41
    tau = (np.arange(20) - 19) / 19
    design = np.column_stack([np.ones(20), tau, tau**2])
    for k, row in enumerate(got):
        y = closes[k : k + 20]
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        res = y - design @ beta
        mad = 1.4826 * np.median(np.abs(res - np.median(res)))
        assert row.fair_value == pytest.approx(beta[0]) and row.slope_per_bar == pytest.approx(beta[1] / 19) and row.curvature_per_bar2 == pytest.approx(2 * beta[2] / 19**2)
        assert row.sigma_ols == pytest.approx(np.sqrt(res @ res / 17)) and row.sigma_mad == pytest.approx(mad)
        a, b = res[:-1] - res[:-1].mean(), res[1:] - res[1:].mean()
        assert row.residual_autocorrelation == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_geometry_of_past_states():
    rng = np.random.default_rng(1729)
    x = rng.normal(size=(200, 2))
    x[:, 1] = 0.65 * x[:, 0] + 0.35 * x[:, 1]
    shape = imsi.geometry(x)
    w = 0.96 ** np.arange(199, -1, -1)
    w /= w.sum()
    assert shape.centre == pytest.approx(np.average(x, axis=0, weights=w)) and shape.effective_size == pytest.approx(1 / np.sum(w**2)) and 0.05 <= shape.delta <= 0.95 and shape.condition >= 1
    # against plain matrices: covariance with the shrunk correlation, inverted by numpy
    cov = np.cov(x.T, aweights=w, ddof=0)
    cov[0, 1] = cov[1, 0] = cov[0, 1] * (1 - shape.delta)
    steps = rng.normal(size=(9, 2))
    assert shape.length(steps) == pytest.approx([np.sqrt(s @ np.linalg.inv(cov) @ s) for s in steps])
    line = imsi.geometry(np.column_stack([np.arange(40.0), np.arange(40.0)]))
    assert line.delta == 0.05 and line.condition == pytest.approx(39)
    assert imsi.geometry(np.column_stack([np.arange(40.0), np.ones(40)])) is None


def transition_rows(spark, locations, pocs):
    rows = [("ES", "ESH24", "s", T0 + dt.timedelta(minutes=5 * i), T0 + dt.timedelta(minutes=5 * i), loc, poc, 101, 99) for i, (loc, poc) in enumerate(zip(locations, pocs))]
    return spark.createDataFrame(rows, "root string, contract_symbol string, session_id string, end timestamp_ntz, available_at timestamp_ntz, location string, poc_tick long, prior_vah_tick long, prior_val_tick long")


def test_transitions_vector(spark):
    rows = transition_rows(spark, ["inside_value", "above_value", "above_value", "above_value", "inside_value"], [100, 100, 102, 103, 103])
    got = auction.transition_events(auction.transitions(rows)).orderBy("end").collect()
    assert [e.event_type for e in got] == ["value_exit_up", "poc_migration_above_prior_vah", "value_reentry_from_above"]
    assert got[1].parent_event_id == got[2].parent_event_id == got[0].event_id


def test_transitions_against_a_machine(spark):
    rng = random.Random(3)
    kinds = ["inside_value", "above_value", "below_value"]
    locations = [rng.choice(kinds) for _ in range(400)]
    pocs = [rng.randrange(97, 104) for _ in range(400)]
    got = auction.transition_events(auction.transitions(transition_rows(spark, locations, pocs))).collect()
    want, dir_, moved = [], None, False
    for i in range(1, 400):
        before, now, t = locations[i - 1], locations[i], T0 + dt.timedelta(minutes=5 * i)
        if before == "inside_value" and now != "inside_value":
            dir_, moved = (1 if now == "above_value" else -1), False
            want.append((t, "value_exit_up" if dir_ == 1 else "value_exit_down"))
        if now == "inside_value" and dir_ == (1 if before == "above_value" else -1 if before == "below_value" else 0):
            want.append((t, "value_reentry_from_above" if dir_ == 1 else "value_reentry_from_below"))
            dir_, moved = None, False
        if dir_ and not moved:
            if dir_ == 1 and pocs[i - 1] <= 101 < pocs[i]:
                want.append((t, "poc_migration_above_prior_vah"))
                moved = True
            elif dir_ == -1 and pocs[i - 1] >= 99 > pocs[i]:
                want.append((t, "poc_migration_below_prior_val"))
                moved = True
    assert sorted((e.end, e.event_type) for e in got) == sorted(want)


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, at int, v string")
    got = {(r.k, r.t): r.hit and r.hit.v for r in asof(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_a_planted_fault_meets_its_own_rule_alone(spark, monkeypatch):
    from tapelens.operators import constraints

    # the first rule cannot judge what the second one's fault makes
    rules = {"x": constraints.Rule("if(y < 0, raise_error('a copy of another fault'), x < 0)", {"x": "-1"}), "y": constraints.Rule("y < 0", {"y": "-1"})}
    monkeypatch.setitem(constraints.RULES, "small", rules)
    rows = spark.sql("SELECT make_timestamp_ntz(2024, 1, cast(d + 1 AS int), 0, 0, 0) AS at, if(d = 3, -1, 1) AS x, 1 AS y FROM range(10) t(d)")
    got = {r.rule: (r.planted, r.caught, r.violations) for r in constraints.prove(rows, "small", "at").collect()}
    assert got == {"x": (2, 2, 1), "y": (2, 2, 0)}
