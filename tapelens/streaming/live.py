"""Live bars, side rows, profiles, measures and gate: typed state per contract, equal to the batch forms.

Each operator is a transformWithState processor. State is values, lists and maps of
columns: a micro-batch reads and writes what its own rows touch, so its cost does not
grow with what a session has brought before. Bounds: one open bar a period; ids and
ticks of one session; KEPT_MINUTES of minute bins; one prior profile a session type;
rings of policy.atr_bars true ranges and policy.tod_sessions volumes a slot; gaps up to
policy.gap_max_age bars old. A new session clears what belongs to the old one.

Typed state needs the RocksDB state store; the functions here select it for the session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.prices import price_to_tick
from ..operators.admission import FLAG
from ..operators.contracts import roll_state
from ..operators.sessions import slot, with_session
from ..policy import PRODUCTION, Policy
from ..shipping import ship
from ..sources.tape import front_contract, split_ticks

KEY = "root string, contract_symbol string, "
BAR_SCHEMA = (
    KEY + "session_id string, period_minutes int, start timestamp_ntz, end timestamp_ntz, available_at timestamp_ntz, "
    "open double, high double, low double, close double, volume double, n_trades long"
)
REJECT_SCHEMA = KEY + "session_id string, arrival long, exchange_time timestamp_ntz, available_at timestamp_ntz, reject_flag string"
ROLLING_SCHEMA = KEY + "session_id string, end timestamp_ntz, minutes int, tick long, volume double"
PROFILED_SCHEMA = (
    BAR_SCHEMA + ", session_type string, session_start timestamp_ntz, last_trade_at timestamp_ntz, minimum_tick double, poc_tick long, val_tick long, vah_tick long, degenerate boolean, "
    "prior_session_id string, prior_poc_tick long, prior_val_tick long, prior_vah_tick long, data_flags array<string>, prior_flags array<string>"
)
MEASURE_SCHEMA = (
    KEY + "session_id string, end timestamp_ntz, available_at timestamp_ntz, location string, atr double, measurement_ready boolean, quality_flags array<string>, "
    "gap_idx long, gap_event string, direction string, active_gaps long, gap_flags array<string>"
)
#: Minutes of admitted volume that the state of a contract holds.
KEPT_MINUTES = 120
MINUTE = 60_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _frame(schema: str, key: tuple, rows: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame([dict(zip(("root", "contract_symbol"), key)) | x for x in rows], columns=_columns(schema))
    kinds = {"int": "Int32", "long": "Int64", "double": "float64"}
    return made.astype({c: kinds[k] for c, k in (f.split() for f in schema.split(", ")) if k in kinds})


def profile(volumes: dict[int, float], fraction: float) -> tuple[int, int, int, bool]:
    """(point of control, low and high edge of the value area, whether all volume is at one tick) of volume by tick."""
    ticks = sorted(volumes)
    total = sum(volumes.values())
    mean = sum(t * volumes[t] for t in ticks) / total
    poc = min(ticks, key=lambda t: (-volumes[t], abs(t - mean), t))
    lo = hi = poc
    below = ticks.index(poc) - 1
    above, held = below + 2, volumes[poc]
    while held < total * fraction and (below >= 0 or above < len(ticks)):
        down = lo - ticks[below] if below >= 0 else math.inf
        up = ticks[above] - hi if above < len(ticks) else math.inf
        if 1 < down < math.inf and 1 < up < math.inf:  # nothing on either side: on to the nearer entry
            lo, hi = lo - (min(down, up) - 1), hi + (min(down, up) - 1)
            continue
        under = volumes[ticks[below]] if down == 1 or up == math.inf else 0.0 if down < math.inf else -1.0
        over = volumes[ticks[above]] if up == 1 or down == math.inf else 0.0 if up < math.inf else -1.0
        if under >= over:
            lo, held, below = ticks[below], held + under, below - 1
        if over >= under:
            hi, held, above = ticks[above], held + over, above + 1
    return poc, lo, hi, len(ticks) == 1


class TradeProcessor(StatefulProcessor):
    """A contract's trades to bars (emit: bars, profiled), side rows (rejects) or rolling profiles (rolling).

    A bar is given out when a row at or after its end arrives. With timers (event
    time), bars that no row closes are given out when the watermark has passed their end.
    """

    def __init__(self, emit: str, periods: tuple[int, ...], minutes: tuple[int, ...] = (), fraction: float = 0.70, timers: bool = False) -> None:
        self.emit, self.periods, self.minutes, self.fraction, self.timers = emit, periods, minutes, fraction, timers
        self.schema = {"bars": BAR_SCHEMA, "profiled": PROFILED_SCHEMA, "rejects": REJECT_SCHEMA, "rolling": ROLLING_SCHEMA}[emit]

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "session_id string, session_type string, session_start long, session_end long, minute long, last long")
        self.bars = handle.getMapState("bars", "period int", "start long, open double, high double, low double, close double, volume double, n_trades long, last_trade long, minimum_tick double")
        self.ids = handle.getMapState("ids", "id string", "arrival long")
        self.sequences = handle.getMapState("sequences", "sequence long", "arrival long")
        if self.emit == "rolling":
            self.bins = handle.getMapState("bins", "minute long, tick long", "volume double")
        if self.emit == "profiled":
            self.ticks = handle.getMapState("ticks", "tick long", "volume double")
            self.flags = handle.getMapState("flags", "flag string", "arrival long")
            self.finals = handle.getMapState("finals", "session_type string", "session_id string, poc long, val long, vah long, flags array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.found: list[dict] = []
        names = ("session_id", "session_type", "session_start", "session_end", "minute", "last")
        self.now = dict(zip(names, self.clock.get())) if self.clock.exists() else dict.fromkeys(names)
        self.open = {p: list(b) for p in self.periods if (b := self.bars.getValue((p,)) if self.bars.containsKey((p,)) else None)}
        self.new_ids, self.new_sequences, self.volumes, self.brought = {}, {}, {}, {}
        for r in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples(index=False):
            self._take(r)
        self._flush()
        self.clock.update(tuple(self.now.values()))
        for p in self.periods:
            if p in self.open:
                self.bars.updateValue((p,), tuple(self.open[p]))
            elif self.bars.containsKey((p,)):
                self.bars.removeKey((p,))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if self.open:
                end = max(b[0] + p * MINUTE for p, b in self.open.items())
                self.handle.registerTimer(max(end // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame(self.schema, key, self.found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The open bars that are due without a later row; then the contract's state goes."""
        self.found = []
        at = timerValues.getCurrentWatermarkInMs() * 1000
        _, _, _, session_end, *_ = self.clock.get()
        for p in self.periods:
            if self.bars.containsKey((p,)):
                b = self.bars.getValue((p,))
                if b[0] + p * MINUTE <= min(at, session_end):
                    self.found.append(self._bar(p, b, at, self.clock.get()[0]))
        for state in (self.clock, self.bars, self.ids, self.sequences):
            state.clear()
        yield _frame(self.schema, key, self.found)

    def close(self) -> None:
        pass

    @staticmethod
    def _bar(p: int, b: list, available: int, session: str) -> dict:
        end = b[0] + p * MINUTE
        return {"session_id": session, "period_minutes": p, "start": _time(b[0]), "end": _time(end), "available_at": _time(max(available, end))} | dict(zip(("open", "high", "low", "close", "volume", "n_trades"), b[1:7]))

    def _take(self, r) -> None:
        now, t = self.now, _micros(r.exchange_time)
        for p in list(self.open):
            if t >= self.open[p][0] + p * MINUTE:
                b = self.open.pop(p)
                if b[0] + p * MINUTE <= now["session_end"]:
                    self._closed(p, b, r)
        start = _micros(r.session_start)
        old = now["session_start"] is not None and start < now["session_start"]
        if now["session_id"] != r.session_id and not old:
            self._next_session()
            now |= {"session_id": r.session_id, "session_type": r.session_type, "session_start": start, "session_end": _micros(r.session_end), "minute": None, "last": None}
        reason = self._reason(r, t, old)
        if not old:
            here = t - t % MINUTE
            now["minute"] = here if now["minute"] is None else max(now["minute"], here)
        if self.emit == "profiled":
            for f in self._row_flags(r, reason, old):
                self.brought.setdefault(f, r.arrival)
        if reason is None:
            self._admit(r, t)
        elif self.emit == "rejects":
            self.found.append({"session_id": r.session_id, "arrival": r.arrival, "exchange_time": r.exchange_time, "available_at": r.available_at, "reject_flag": reason})

    def _reason(self, r, t: int, old: bool) -> str | None:
        """The first check that a row fails; a row of a session that is over is late."""
        if "SOURCE_SUSPICIOUS" in list(r.source_flags):
            return FLAG["suspicious"]
        if not r.price > 0:
            return FLAG["price"]
        if not r.quantity > 0:
            return FLAG["quantity"]
        if r.source_event_id is not None and (r.source_event_id in self.new_ids or self.ids.containsKey((r.source_event_id,))):
            return FLAG["id"]
        if not pd.isna(r.source_sequence) and (int(r.source_sequence) in self.new_sequences or self.sequences.containsKey((int(r.source_sequence),))):
            return FLAG["sequence"]
        if old or self.now["minute"] is not None and t < self.now["minute"]:
            return FLAG["late"]
        if self.now["last"] is not None and t < self.now["last"]:
            return FLAG["order"]
        return FLAG["grid"] if pd.isna(r.tick) else None

    @staticmethod
    def _row_flags(r, reason: str | None, old: bool) -> list[str]:
        unsound = reason in [FLAG[k] for k in ("suspicious", "price", "quantity", "id", "sequence")]
        unverifiable = r.source_event_id is None and pd.isna(r.source_sequence)
        return [
            *([reason] if reason else []), *(["DATA:DEDUPLICATION_UNVERIFIABLE"] if unverifiable and not unsound else []),
            *({FLAG["late"]: ["DATA:LATE_TRADE_AFTER_FINAL_PROFILE" if old else "DATA:LATE_TRADE_IGNORED"], FLAG["order"]: ["DATA:OUT_OF_ORDER_TRADE_IGNORED"]}.get(reason, [])),
            *(f"DATA:{f}" for f in r.source_flags),
        ]

    def _admit(self, r, t: int) -> None:
        self.now["last"] = t
        if r.source_event_id is not None:
            self.new_ids[r.source_event_id] = r.arrival
        if not pd.isna(r.source_sequence):
            self.new_sequences[int(r.source_sequence)] = r.arrival
        place = (t - t % MINUTE + MINUTE, int(r.tick)) if self.emit == "rolling" else (int(r.tick),)
        if self.emit in ("rolling", "profiled"):
            self.volumes[place] = self.volumes.get(place, 0.0) + r.quantity
        start = self.now["session_start"]
        for p in self.periods:
            if p not in self.open:
                begin = start + (t - start) // (p * MINUTE) * p * MINUTE
                self.open[p] = [begin, r.price, r.price, r.price, r.price, 0.0, 0, t, r.minimum_tick]
            b = self.open[p]
            b[2], b[3], b[4], b[5], b[6], b[7], b[8] = max(b[2], r.price), min(b[3], r.price), r.price, b[5] + r.quantity, b[6] + 1, t, min(b[8], r.minimum_tick)

    def _closed(self, p: int, b: list, r) -> None:
        """A bar that row r closes."""
        bar = self._bar(p, b, _micros(r.available_at), self.now["session_id"])
        if self.emit == "bars":
            self.found.append(bar)
        elif self.emit == "rolling":
            self._flush()
            end = b[0] + p * MINUTE
            held: dict[int, list[tuple[int, float]]] = {}
            for (minute, tick), (volume,) in list(self.bins.iterator()):
                if minute <= end - KEPT_MINUTES * MINUTE:
                    self.bins.removeKey((minute, tick))
                elif minute <= end:
                    held.setdefault(minute, []).append((tick, volume))
            for n in self.minutes:
                total: dict[int, float] = {}
                for minute in held:
                    if minute > end - n * MINUTE:
                        for tick, volume in held[minute]:
                            total[tick] = total.get(tick, 0.0) + volume
                self.found += [{"session_id": bar["session_id"], "end": bar["end"], "minutes": n, "tick": k, "volume": v} for k, v in total.items()]
        elif self.emit == "profiled":
            self._flush()
            poc, low, high, degenerate = profile({t: v for (t,), (v,) in self.ticks.iterator()}, self.fraction)
            kind = self.now["session_type"]
            prior = self.finals.getValue((kind,)) if self.finals.containsKey((kind,)) else (None, None, None, None, None)
            bar |= {"session_type": kind, "session_start": _time(self.now["session_start"]), "last_trade_at": _time(b[7]), "minimum_tick": b[8], "poc_tick": poc, "val_tick": low, "vah_tick": high, "degenerate": degenerate}
            bar |= dict(zip(("prior_session_id", "prior_poc_tick", "prior_val_tick", "prior_vah_tick", "prior_flags"), prior))
            self.found.append(bar | {"data_flags": sorted(f for (f,) in self.flags.keys())})

    def _next_session(self) -> None:
        """The old session becomes the prior one of its type, and its state goes."""
        if self.now["session_id"] is None:
            return
        self._flush()
        if self.emit == "profiled":
            volumes = {t: v for (t,), (v,) in self.ticks.iterator()}
            if volumes:
                poc, low, high, degenerate = profile(volumes, self.fraction)
                flags = ["DEGENERATE_PROFILE"] * degenerate + sorted(f for (f,) in self.flags.keys())
                self.finals.updateValue((self.now["session_type"],), (self.now["session_id"], poc, low, high, flags))
            self.ticks.clear()
            self.flags.clear()
        elif self.emit == "rolling":
            self.bins.clear()
        self.ids.clear()
        self.sequences.clear()

    def _flush(self) -> None:
        """What the rows so far have added goes to the state: entries that they touched alone."""
        for held, state in ((self.new_ids, self.ids), (self.new_sequences, self.sequences)):
            for k, arrival in held.items():
                state.updateValue((k,), (int(arrival),))
            held.clear()
        if self.volumes:
            state = self.bins if self.emit == "rolling" else self.ticks
            for k, v in self.volumes.items():
                state.updateValue(k, (v + (state.getValue(k)[0] if state.containsKey(k) else 0.0),))
            self.volumes.clear()
        for f, arrival in self.brought.items():
            if not self.flags.containsKey((f,)):
                self.flags.updateValue((f,), (int(arrival),))
        self.brought.clear()


class MeasureProcessor(StatefulProcessor):
    """A contract's profiled bars to auction measures and gap states; rings and open gaps are its state."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "session_id string, end long, close double, idx long")
        self.ranges = handle.getListState("ranges", "true_range double")
        self.recent = handle.getListState("recent", "open double, high double, low double, close double")
        self.slots = handle.getMapState("slots", "session_type string, slot int", "volumes array<double>")
        self.gaps = handle.getListState("gaps", "gap_idx long, direction string, bot double, top double, quality double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, end, self.close_, self.idx = self.last.get() if self.last.exists() else (None, None, None, 0)
        ranges, recent, gaps = ([tuple(x) for x in s.get()] for s in (self.ranges, self.recent, self.gaps))
        found = []
        for r in pd.concat(list(rows)).sort_values("end", kind="stable").itertuples(index=False):
            missing = session == r.session_id and end != _micros(r.start)
            if session != r.session_id or missing:
                recent, gaps = [], []  # a new segment
            if self.close_ is not None:
                ranges = [*ranges, (max(r.high - r.low, abs(r.high - self.close_), abs(r.low - self.close_)),)][-self.policy.atr_bars :]
            atr = max(sum(x for (x,) in ranges) / len(ranges), self.policy.atr_floor) if len(ranges) == self.policy.atr_bars else None
            z, tod_flag = self._volume_z(r)
            session, end, self.close_, self.idx = r.session_id, _micros(r.end), r.close, self.idx + 1
            recent = [*recent, (r.open, r.high, r.low, r.close)][-3:]
            shown, gaps, guards = self._gaps(r, gaps, recent, atr, z)
            own = [f for f in ("IAE_BAR_GAP_RESET" if missing else None, tod_flag, "IAE_ATR_WARMUP" if atr is None else None) if f]
            found.append(
                {"session_id": r.session_id, "end": r.end, "available_at": r.available_at, "atr": atr} | self._auction(r, atr)
                | dict(zip(("gap_idx", "gap_event", "direction"), shown or (None, None, None))) | {"active_gaps": len(gaps), "gap_flags": sorted({*own, *guards})}
            )
        self.last.update((session, end, self.close_, self.idx))
        for state, held in ((self.ranges, ranges), (self.recent, recent), (self.gaps, gaps)):
            state.put(held) if held else state.clear()
        yield _frame(MEASURE_SCHEMA, key, found)

    def close(self) -> None:
        pass

    @staticmethod
    def _auction(r, atr: float | None) -> dict:
        known, on_grid = not pd.isna(r.prior_vah_tick), not pd.isna(r.close_tick)
        where = "no_reference" if not known else "off_grid" if not on_grid else "above_value" if r.close_tick > r.prior_vah_tick else "below_value" if r.close_tick < r.prior_val_tick else "inside_value"
        flags = {*(["DEGENERATE_PROFILE"] if r.degenerate else []), *([] if known else ["NO_PRIOR_SAME_SESSION_TYPE_PROFILE"]), f"ROLL:{r.roll_state.upper()}", *r.data_flags}
        flags |= set(r.prior_flags if r.prior_flags is not None else ())
        ready = known and atr is not None and r.roll_state == "normal" and not any(f.startswith("DATA:") for f in flags)
        return {"location": where, "measurement_ready": ready, "quality_flags": sorted(flags)}

    def _volume_z(self, r) -> tuple[float | None, str | None]:
        """The bar's volume against the last sessions' at its slot, by running moments."""
        place = (r.session_type, int(r.slot))
        held = list(self.slots.getValue(place)[0]) if self.slots.containsKey(place) else []
        self.slots.updateValue(place, ([*held, float(r.volume)][-self.policy.tod_sessions :],))
        if len(held) < self.policy.tod_min:
            return None, "IAE_TOD_WARMUP"
        mean = square = 0.0
        for n, x in enumerate(held, 1):
            step = x - mean
            mean += step / n
            square += step * (step - step / n)
        spread = math.sqrt(square / len(held))
        if spread * spread <= self.policy.epsilon:
            return None, "IAE_TOD_DEGENERATE"
        return (r.volume - mean) / (spread + self.policy.epsilon), None

    def _gaps(self, r, gaps: list[tuple], recent: list[tuple], atr: float | None, z: float | None):
        """(what the bar shows of its gaps, the gaps that live on, guards)."""
        p, shown, alive, guards = self.policy, [], [], set()
        for gap in gaps:
            idx, direction, bot, top, quality = gap
            age, up = self.idx - idx, direction == "bullish"
            what = None
            if age == p.gap_max_age + 1:
                what = "expired"
            elif r.close < bot if up else r.close > top:
                what = "invalidated"
            elif (r.low <= top and r.close >= bot) if up else (r.high >= bot and r.close <= top):
                body = abs(r.close - r.open)
                wick = (min(r.open, r.close) - r.low if up else r.high - max(r.open, r.close)) / (body + p.epsilon) if body > 0 else None
                guards |= {"IAE_DEGENERATE_BODY"} if body <= 0 else {"IAE_SCORE_TOD_UNAVAILABLE"} if z is None else set()
                what = "tested"
                if wick is not None and z is not None:
                    place = (r.close - bot if up else top - r.close) / (top - bot + p.epsilon)
                    score = (math.log1p(quality) + math.log1p(wick) + math.log1p(max(z, p.volume_z_floor)) + 0.5 * min(max(place, 0.0), 1.0)) * math.exp(-p.decay * age)
                    if score > p.score_threshold and wick > p.min_wick and (r.close > r.open if up else r.close < r.open):
                        what = "absorbed"
            if what in (None, "tested"):
                alive.append(gap)
            shown.append((3 if what else 1, idx, what or "open", direction))
        made = self._formation(r, recent, atr)
        if made and made[0]:
            guards.add(made[0])
        elif made:
            shown.append((2, self.idx, "open", made[1][0]))
            alive.append((self.idx, *made[1]))
        best = max(shown)[1:] if shown else None
        return best, alive, guards

    def _formation(self, r, recent: list[tuple], atr: float | None):
        """(guard or None, gap) of the three bars up to r; None if they make none."""
        if len(recent) < 3 or atr is None:
            return None
        (_, first_high, first_low, _), (o, h, low, c), _ = recent
        if r.low > first_high and c > first_high and r.low - first_high >= r.minimum_tick:
            direction, bot, top = "bullish", first_high, r.low
        elif r.high < first_low and c < first_low and first_low - r.high >= r.minimum_tick:
            direction, bot, top = "bearish", r.high, first_low
        else:
            return None
        p, span, body, scale = self.policy, h - low, abs(c - o), atr + self.policy.epsilon
        move, size, share = body / scale, (top - bot) / scale, body / (span + self.policy.epsilon)
        if span <= 0:
            return "IAE_FORMATION_DEGENERATE", None
        if not (move > p.min_z_displacement and share > p.min_efficiency and size > p.min_z_gap):
            return "IAE_FORMATION_GATED", None
        return None, (direction, bot, top, move**0.4 * size**0.4 * share**0.2)


class GateProcessor(StatefulProcessor):
    """A lineage hash: held until the watermark reaches usable_from, given out once, then remembered for a while."""

    def __init__(self, remember_ms: int) -> None:
        self.remember_ms = remember_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "usable_from timestamp, released boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        usable = min((f.usable_from.min() for f in rows if len(f)), default=None)
        if usable is not None and not self.held.exists():
            self.held.update((usable, False))
            self.handle.registerTimer(max(int(usable.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        usable, released = self.held.get()
        if released:
            self.held.clear()
            return
        self.held.update((usable, True))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.remember_ms)
        yield pd.DataFrame({"lineage_hash": [key[0]], "usable_from": [usable]})

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", time_mode)


def _prepared(trades: DataFrame) -> DataFrame:
    ship(trades.sparkSession)
    return with_session(split_ticks(trades)[0]).withColumn("tick", price_to_tick(F.col("price"), F.col("minimum_tick")))


CONTRACT = ("root", "contract_symbol")


def live_bars(trades: DataFrame, periods: tuple[int, ...] = (5, 30), finalize_after: str | None = None) -> DataFrame:
    """Bars of a stream of trades, each given out when a trade at or after its end arrives.

    The state of a contract is one open bar a period, its session's clocks and the
    source ids and sequences admitted in the session; a new session or contract
    starts afresh. With finalize_after (a delay such as "10 minutes"), bars that no
    trade closes are given out when the stream's exchange time is that far beyond
    the last trade of the contract, and their state goes; without, they wait.
    """
    rows = _prepared(trades)
    if finalize_after is None:
        return _stateful(rows, CONTRACT, TradeProcessor("bars", periods), BAR_SCHEMA)
    rows = rows.withColumn("clock", F.col("exchange_time").cast("timestamp")).withWatermark("clock", finalize_after)
    return _stateful(rows, CONTRACT, TradeProcessor("bars", periods, timers=True), BAR_SCHEMA, "EventTime")


def live_rejects(trades: DataFrame) -> DataFrame:
    """The trades of a stream that are not admitted, late ones among them, with the reason: the side rows of live_bars()."""
    return _stateful(_prepared(trades), CONTRACT, TradeProcessor("rejects", ()), REJECT_SCHEMA)


def live_rolling(trades: DataFrame, minutes: tuple[int, ...] = (30, 60, 120), period: int = 5) -> DataFrame:
    """Rolling profiles of a stream: at each bar's close the volume by tick of the session's last minutes; the state holds KEPT_MINUTES of bins."""
    if max(minutes) > KEPT_MINUTES:
        raise ValueError(f"at most {KEPT_MINUTES} minutes are held")
    return _stateful(_prepared(trades), CONTRACT, TradeProcessor("rolling", (period,), minutes), ROLLING_SCHEMA)


def live_profiles(trades: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Fast bars of a stream with the developing profile at their close, the prior profile of their session type, and the flags known then."""
    return _stateful(_prepared(trades), CONTRACT, TradeProcessor("profiled", (policy.fast,), fraction=policy.value_area), PROFILED_SCHEMA)


def live_measures(trades: DataFrame, mappings: DataFrame | None = None, policy: Policy = PRODUCTION) -> DataFrame:
    """Auction state and gap state of each fast bar of a stream, as Measurement.auction_state and gap_states give them in batch.

    Two stateful steps in a row: trades to profiled bars, these to measures. With
    mappings, trades of the mapped contract alone count, and roll states are joined.
    """
    rows = live_profiles(trades if mappings is None else front_contract(trades, mappings), policy)
    rows = rows.withColumn("roll_state", F.lit("normal")) if mappings is None else roll_state(rows, mappings, "last_trade_at")
    rows = rows.withColumn("close_tick", price_to_tick(F.col("close"), F.col("minimum_tick"))).withColumn("slot", slot(F.col("start"), F.col("session_start"), policy.fast))
    return _stateful(rows, CONTRACT, MeasureProcessor(policy), MEASURE_SCHEMA)


def live_gate(pit: DataFrame, clock: str = "event_clock", delay: str = "0 seconds", remember: str = "7 days") -> DataFrame:
    """Each row of a point-in-time stream once the stream's clock has reached its usable_from; a lineage hash is released once.

    pit(lineage_hash, usable_from timestamp, clock timestamp): the clock column
    drives the watermark. A released hash is remembered for `remember` of event
    time, in which repeats are dropped; then its state goes.
    """
    ship(pit.sparkSession)
    processor = GateProcessor(int(pd.Timedelta(remember).total_seconds() * 1000))
    return _stateful(pit.withWatermark(clock, delay), ("lineage_hash",), processor, "lineage_hash string, usable_from timestamp", "EventTime")
