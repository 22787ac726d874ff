"""The registered queries as SQL over the same tables. Shared steps are named once and put before each query that needs them."""

from __future__ import annotations

import re

import numpy as np

from .operators.constraints import RULES
from .policy import SPARSE
from .sources.dims import CLOSURE_ROWS, market_rows, session_rows
from .sources.features import feature_rows


def _values(rows) -> str:
    def one(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def _bars(minutes: int) -> str:
    return f"""
SELECT root, contract_symbol, session_id, session_name, session_type, session_start, session_end, start, start + INTERVAL {minutes} MINUTE AS "end",
       greatest(next_at, start + INTERVAL {minutes} MINUTE) AS available_at, open, high, low, close, volume, n_trades, closed_by, last_trade_at
FROM (SELECT root, contract_symbol, session_id, session_name, session_type, session_start, session_end, start,
             arg_min(price, arrival) FILTER (admitted) AS open, max(price) FILTER (admitted) AS high, min(price) FILTER (admitted) AS low, arg_max(price, arrival) FILTER (admitted) AS close,
             sum(quantity) FILTER (admitted) AS volume, count(*) FILTER (admitted) AS n_trades, arg_max(next_at, arrival) AS next_at, arg_max(next_arrival, arrival) AS closed_by, arg_max(exchange_time, arrival) FILTER (admitted) AS last_trade_at, bool_or(is_last) AS has_last
      FROM (SELECT *, time_bucket(INTERVAL {minutes} MINUTE, exchange_time, session_start) AS start, lead(available_at) OVER (PARTITION BY root, contract_symbol ORDER BY arrival) AS next_at,
                   lead(arrival) OVER (PARTITION BY root, contract_symbol ORDER BY arrival) AS next_arrival, lead(available_at) OVER (PARTITION BY root, contract_symbol ORDER BY arrival) IS NULL AS is_last FROM adm)
      WHERE start + INTERVAL {minutes} MINUTE <= session_end GROUP BY ALL)
WHERE n_trades > 0 AND NOT has_last"""


def _poc(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, tick AS poc_tick, total_volume FROM (
  SELECT h.*, total_volume, row_number() OVER (PARTITION BY {keys} ORDER BY volume DESC, abs(tick - mean), tick) AS n
  FROM (SELECT *, sum(volume) OVER (PARTITION BY {keys}) AS total_volume, sum(tick * volume) OVER (PARTITION BY {keys}) / sum(volume) OVER (PARTITION BY {keys}) AS mean FROM {source}) h) WHERE n = 1"""


def _area(source: str, poc: str, keys: list[str]) -> str:
    """The value area of each profile, grown step by step."""
    k = ", ".join(keys)
    on = lambda x: " AND ".join(f"{x}.{c} = s.{c}" for c in keys)
    ks = ", ".join(f"s.{c}" for c in keys)
    return f"""
SELECT {k}, lo AS val_tick, hi AS vah_tick FROM (
WITH RECURSIVE grow AS (
  SELECT {k}, poc_tick AS lo, poc_tick AS hi, volume AS cum, {SPARSE.value_area} * total_volume AS target, tmin, tmax, 0 AS step
  FROM {poc} JOIN (SELECT {k}, min(tick) AS tmin, max(tick) AS tmax FROM {source} GROUP BY ALL) USING ({k}) JOIN (SELECT {k}, tick AS poc_tick, volume FROM {source}) USING ({k}, poc_tick)
  UNION ALL
  SELECT {ks}, CASE WHEN go_down THEN s.lo - 1 ELSE s.lo END, CASE WHEN go_up THEN s.hi + 1 ELSE s.hi END, s.cum + CASE WHEN go_down THEN s.down ELSE 0 END + CASE WHEN go_up THEN s.up ELSE 0 END, target, tmin, tmax, step + 1
  FROM (SELECT s.*, (s.lo > s.tmin) AND (s.hi >= s.tmax OR s.down >= s.up) AS go_down, (s.hi < s.tmax) AND (s.lo <= s.tmin OR s.up >= s.down) AS go_up
        FROM (SELECT s.*, coalesce(d.volume, 0) AS down, coalesce(u.volume, 0) AS up FROM grow s
              LEFT JOIN {source} d ON {on("d")} AND d.tick = s.lo - 1 LEFT JOIN {source} u ON {on("u")} AND u.tick = s.hi + 1
              WHERE s.cum < s.target AND (s.lo > s.tmin OR s.hi < s.tmax)) s) s)
SELECT {k}, lo, hi, row_number() OVER (PARTITION BY {k} ORDER BY step DESC) AS n FROM grow) WHERE n = 1"""


_S = "root, contract_symbol, session_id"
_W = f"PARTITION BY {_S} ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_JSON = """'session_' || sha256('{"anchor_date":"' || strftime(anchor, '%Y-%m-%d') || '","policy_version":"' || policy_version || '","root":"' || root || '","session_name":"' || session_name || '","session_type":"' || session_type || '"}')"""
_ID = """'event_' || sha256('["' || root || '","' || contract_symbol || '","' || {kind} || '","' || strftime({at}, '%Y-%m-%dT%H:%M:%S.%fZ') || '",' || coalesce('"' || {parent} || '"', 'null') || ']')"""

_GAP_ID = """'gap_' || sha256('["' || root || '","' || contract_symbol || '","' || direction || '","' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '",null]')"""
_N = SPARSE.icm_windows["ES"]
_TAU = (np.arange(_N) - (_N - 1)) / (_N - 1)
_ROWS = ["[" + ", ".join(repr(float(x)) for x in row) + "]" for row in np.linalg.pinv(np.column_stack([np.ones(_N), _TAU, _TAU**2]))]
_TAUS = "[" + ", ".join(repr(float(x)) for x in _TAU) + "]"
_E = SPARSE.epsilon

STEPS = {
    "win": f"SELECT * FROM (VALUES {_values(session_rows())}) w(root, session_name, session_type, zone, start_sec, end_sec, crosses_midnight, policy_version)",
    "maps": "SELECT root, old_mapped_symbol, new_mapped_symbol, CAST(observed_at AS TIMESTAMP) AS observed_at, CAST(effective_at AS TIMESTAMP) AS effective_at FROM (VALUES ('ES', NULL, 'ESH24', '2023-12-15 12:00:00', '2023-12-15 12:00:00'), ('ES', 'ESH24', 'ESM24', '2024-01-10 00:00:00', '2024-01-16 00:00:00'), ('6E', NULL, '6EH24', '2023-12-15 12:00:00', '2023-12-15 12:00:00'), ('6E', '6EH24', '6EM24', '2024-01-10 00:00:00', '2024-01-16 00:00:00')) m(root, old_mapped_symbol, new_mapped_symbol, observed_at, effective_at)",
    "tape": """SELECT root, root || CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'H24' ELSE 'M24' END AS contract_symbol, ts AS exchange_time, ts + INTERVAL 1 SECOND AS available_at,
  100 + floor(value * 4) / 4.0 + CASE WHEN event_id % 101 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS price, CAST(CASE WHEN event_id % 89 = 0 THEN 0 ELSE 1 + event_id % 5 END AS DOUBLE) AS quantity,
  CAST(event_id AS VARCHAR) AS source_event_id, event_id % 97 = 0 AS suspicious, CASE WHEN event_type = 'error' THEN 'QUOTE' ELSE 'TRADE' END AS tick_type, event_id * 2 + copy AS arrival
FROM (SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ES' ELSE '6E' END AS root FROM events), (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 83 = 0""",
    "ticked": "SELECT *, CASE WHEN abs(round(price * 4) * 0.25 - price) <= 1e-9 THEN CAST(round(price * 4) AS BIGINT) END AS tick FROM tape",
    "local": """SELECT t.*, session_name, session_type, zone, start_sec, end_sec, crosses_midnight, policy_version, (exchange_time AT TIME ZONE 'UTC') AT TIME ZONE zone AS loc FROM ticked t JOIN win USING (root)""",
    "sess": f"""SELECT *, {_JSON} AS session_id,
  ((anchor + to_seconds(start_sec)) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS session_start,
  ((anchor + to_days(CAST(crosses_midnight AS INTEGER)) + to_seconds(end_sec)) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS session_end
FROM (SELECT *, CAST(CAST(loc AS DATE) - CASE WHEN crosses_midnight AND sod < end_sec THEN 1 ELSE 0 END AS TIMESTAMP) AS anchor
  FROM (SELECT *, hour(loc) * 3600 + minute(loc) * 60 + second(loc) AS sod FROM local)
  WHERE CASE WHEN crosses_midnight THEN sod >= start_sec OR sod < end_sec ELSE sod >= start_sec AND sod < end_sec END)""",
    "adm": f"""SELECT *, reject_flag IS NULL AS admitted FROM (SELECT *, CASE WHEN suspicious THEN 'DATA:SOURCE_SUSPICIOUS' WHEN price <= 0 THEN 'DATA:NON_POSITIVE_PRICE' WHEN quantity <= 0 THEN 'DATA:NON_POSITIVE_QUANTITY'
    WHEN same_id THEN 'DATA:DUPLICATE_SOURCE_ID' WHEN late THEN 'DATA:LATE' WHEN behind THEN 'DATA:OUT_OF_ORDER' WHEN tick IS NULL THEN 'DATA:OFF_TICK_GRID' END AS reject_flag
  FROM (SELECT *, coalesce(max(CAST(fit AND NOT behind AS INTEGER)) OVER (PARTITION BY {_S}, source_event_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS same_id
    FROM (SELECT *, coalesce(exchange_time < max(CASE WHEN fit THEN exchange_time END) OVER ({_W}), false) AS behind
      FROM (SELECT *, NOT suspicious AND price > 0 AND quantity > 0 AND tick IS NOT NULL AND NOT late AS fit
        FROM (SELECT *, coalesce(exchange_time < date_trunc('minute', max(exchange_time) OVER ({_W})), false) AS late FROM sess WHERE tick_type = 'TRADE')))))""",
    "fast": _bars(SPARSE.fast),
    "medium": _bars(SPARSE.medium),
    "bins": f"SELECT {_S}, session_type, date_trunc('minute', exchange_time) + INTERVAL 1 MINUTE AS minute_end, tick, sum(quantity) AS volume FROM adm WHERE admitted GROUP BY ALL",
    "fin": f"SELECT {_S}, tick, sum(volume) AS volume FROM bins GROUP BY ALL",
    "finpoc": _poc("fin", _S),
    "finarea": _area("fin", "finpoc", ["root", "contract_symbol", "session_id"]),
    "ends": f"""SELECT *, greatest(last_trade, session_end) AS as_of, lead(first_at) OVER (PARTITION BY root, contract_symbol ORDER BY session_start) AS available_at
FROM (SELECT {_S}, session_type, session_start, session_end, min(available_at) AS first_at, max(exchange_time) FILTER (admitted) AS last_trade FROM adm GROUP BY ALL)""",
    "finals": f"SELECT * FROM finpoc JOIN finarea USING ({_S}) JOIN ends USING ({_S})",
    "refs": f"""SELECT {_S}, lag(session_id) OVER t AS prior_session_id, lag(poc_tick) OVER t AS prior_poc_tick, lag(val_tick) OVER t AS prior_val_tick, lag(vah_tick) OVER t AS prior_vah_tick,
  last_value(CASE WHEN session_type = 'rth' THEN session_id END IGNORE NULLS) OVER b AS prior_rth_id, last_value(CASE WHEN session_type = 'eth' THEN session_id END IGNORE NULLS) OVER b AS prior_eth_id
FROM finals WINDOW t AS (PARTITION BY root, contract_symbol, session_type ORDER BY session_start), b AS (PARTITION BY root, contract_symbol ORDER BY session_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "atr": f"""SELECT *, CASE WHEN n = {SPARSE.atr_bars} THEN greatest(mean_range, {SPARSE.atr_floor}) END AS atr
FROM (SELECT *, count(true_range) OVER w AS n, avg(true_range) OVER w AS mean_range
  FROM (SELECT *, CASE WHEN last_close IS NOT NULL THEN greatest(high - low, abs(high - last_close), abs(low - last_close)) END AS true_range
    FROM (SELECT *, lag(close) OVER (PARTITION BY root, contract_symbol ORDER BY "end") AS last_close FROM fast))
  WINDOW w AS (PARTITION BY root, contract_symbol ORDER BY "end" ROWS BETWEEN {SPARSE.atr_bars - 1} PRECEDING AND CURRENT ROW))""",
    "located": f"""SELECT *, CASE WHEN prior_vah_tick IS NULL THEN 'no_reference' WHEN close_tick > prior_vah_tick THEN 'above_value' WHEN close_tick < prior_val_tick THEN 'below_value' ELSE 'inside_value' END AS location
FROM (SELECT *, CAST(round(close * 4) AS BIGINT) AS close_tick FROM atr LEFT JOIN refs USING ({_S}))""",
    "dev": f'SELECT {_S}, "end", tick, sum(volume) AS volume FROM bins JOIN (SELECT {_S}, "end" FROM fast) USING ({_S}) WHERE minute_end <= "end" GROUP BY ALL',
    "devpoc": _poc("dev", f'{_S}, "end"'),
    "devarea": _area("dev", "devpoc", ["root", "contract_symbol", "session_id", '"end"']),
    "moved": f"""SELECT *, CASE WHEN last_location = 'inside_value' AND location = 'above_value' THEN 1 WHEN last_location = 'inside_value' AND location = 'below_value' THEN -1 END AS exit
FROM (SELECT *, lag(location) OVER w AS last_location, lag(poc_tick) OVER w AS last_poc FROM located JOIN devpoc USING ({_S}, "end") WINDOW w AS (PARTITION BY {_S} ORDER BY "end"))""",
    "trips": f"""SELECT *, count(exit) OVER w AS excursion, last_value(exit IGNORE NULLS) OVER w AS dir,
  last_value(CASE WHEN exit IS NOT NULL THEN {_ID.format(kind="CASE WHEN exit = 1 THEN 'value_exit_up' ELSE 'value_exit_down' END", at='"end"', parent="NULL::VARCHAR")} END IGNORE NULLS) OVER w AS exit_id
FROM moved WINDOW w AS (PARTITION BY {_S} ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "trans": f"""SELECT *, back = 1 AND backs = 1 AND excursion > 0 AS reentry, cross_now = 1 AND sum(cross_now) OVER e = 1 AS migration
FROM (SELECT *, CAST(excursion > 0 AND backs = 0 AND CASE WHEN dir = 1 THEN last_poc <= prior_vah_tick AND poc_tick > prior_vah_tick ELSE last_poc >= prior_val_tick AND poc_tick < prior_val_tick END AS INTEGER) AS cross_now
  FROM (SELECT *, sum(back) OVER e AS backs FROM (SELECT *, CAST(coalesce(location = 'inside_value' AND (last_location = 'above_value' AND dir = 1 OR last_location = 'below_value' AND dir = -1), false) AS INTEGER) AS back FROM trips)
    WINDOW e AS (PARTITION BY {_S}, excursion ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
WINDOW e AS (PARTITION BY {_S}, excursion ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "sflags": f"""SELECT {_S}, flag, min(arrival) AS since FROM (SELECT {_S}, arrival, unnest([reject_flag, CASE WHEN suspicious THEN 'DATA:SOURCE_SUSPICIOUS' END]) AS flag FROM adm) WHERE flag IS NOT NULL GROUP BY ALL""",
    "rolls": "SELECT root, greatest(observed_at, effective_at) AS visible_at, row_number() OVER (PARTITION BY root ORDER BY greatest(observed_at, effective_at)) AS n_map FROM maps",
    "auc": f"""SELECT *, prior_vah_tick IS NOT NULL AND atr IS NOT NULL AND NOT list_contains(list_transform(flags, lambda f: starts_with(f, 'DATA:')), true) AND roll_state = 'normal' AS measurement_ready
FROM (SELECT *, list_sort(list_distinct(list_filter(list_concat([CASE WHEN degenerate THEN 'DEGENERATE_PROFILE' END, CASE WHEN prior_vah_tick IS NULL THEN 'NO_PRIOR_SAME_SESSION_TYPE_PROFILE' END, CASE WHEN prior_degenerate THEN 'DEGENERATE_PROFILE' END, 'ROLL:' || upper(roll_state)],
    coalesce(own_flags, []), coalesce(prior_flags, [])), lambda f: f IS NOT NULL))) AS flags
  FROM (SELECT l.*, degenerate, own_flags, prior_flags, prior_degenerate, CASE WHEN coalesce(n_map, 0) <= 1 THEN 'normal' WHEN last_trade_at = visible_at THEN 'roll_transition' ELSE 'post_roll' END AS roll_state
    FROM located l ASOF LEFT JOIN rolls r ON l.root = r.root AND l.last_trade_at >= r.visible_at
    JOIN (SELECT {_S}, "end", count(*) = 1 AS degenerate FROM dev GROUP BY ALL) d ON d.root = l.root AND d.contract_symbol = l.contract_symbol AND d.session_id = l.session_id AND d."end" = l."end"
    LEFT JOIN (SELECT {_S}, "end", list(flag) AS own_flags FROM fast JOIN sflags USING ({_S}) WHERE since < closed_by GROUP BY ALL) o ON o.root = l.root AND o.contract_symbol = l.contract_symbol AND o.session_id = l.session_id AND o."end" = l."end"
    LEFT JOIN (SELECT {_S}, list(flag) AS prior_flags FROM sflags GROUP BY ALL) p ON p.root = l.root AND p.contract_symbol = l.contract_symbol AND p.session_id = l.prior_session_id
    LEFT JOIN (SELECT {_S}, count(*) = 1 AS prior_degenerate FROM fin GROUP BY ALL) g ON g.root = l.root AND g.contract_symbol = l.contract_symbol AND g.session_id = l.prior_session_id))""",
    "tod": f"""SELECT *, CASE WHEN tod_n < {SPARSE.tod_min} THEN 'IAE_TOD_WARMUP' WHEN sd * sd <= {SPARSE.epsilon} THEN 'IAE_TOD_DEGENERATE' END AS tod_flag,
  CASE WHEN tod_n >= {SPARSE.tod_min} AND sd * sd > {SPARSE.epsilon} THEN (volume - mean) / (sd + {SPARSE.epsilon}) END AS volume_z
FROM (SELECT *, count(*) OVER w AS tod_n, avg(volume) OVER w AS mean, stddev_pop(volume) OVER w AS sd
  FROM (SELECT *, CAST(floor(epoch(start - session_start) / {SPARSE.fast * 60}) AS INTEGER) AS slot FROM atr)
  WINDOW w AS (PARTITION BY root, contract_symbol, session_type, slot ORDER BY "end" ROWS BETWEEN {SPARSE.tod_sessions} PRECEDING AND 1 PRECEDING))""",
    "seg": """SELECT *, sum(new) OVER w AS segment FROM (SELECT *, CAST(last_session IS NULL OR last_session <> session_id OR reset AS INTEGER) AS new
  FROM (SELECT *, coalesce(last_session = session_id AND last_end <> start, false) AS reset FROM (SELECT *, lag(session_id) OVER w AS last_session, lag("end") OVER w AS last_end, row_number() OVER w AS idx FROM tod WINDOW w AS (PARTITION BY root, contract_symbol ORDER BY "end"))))
WINDOW w AS (PARTITION BY root, contract_symbol ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "gap": f"""SELECT *, "end" AS created_at, CASE WHEN guard IS NULL THEN pow(z_displacement, 0.4) * pow(z_gap, 0.4) * pow(efficiency, 0.2) END AS quality
FROM (SELECT *, CASE WHEN ih - il <= 0 THEN 'IAE_FORMATION_DEGENERATE' WHEN NOT (z_displacement > {SPARSE.min_z_displacement} AND efficiency > {SPARSE.min_efficiency} AND z_gap > {SPARSE.min_z_gap}) THEN 'IAE_FORMATION_GATED' END AS guard
  FROM (SELECT *, abs(ic - io) / (atr + {SPARSE.epsilon}) AS z_displacement, (gap_top - gap_bot) / (atr + {SPARSE.epsilon}) AS z_gap, abs(ic - io) / (ih - il + {SPARSE.epsilon}) AS efficiency
    FROM (SELECT *, CASE WHEN direction = 'bullish' THEN fh ELSE high END AS gap_bot, CASE WHEN direction = 'bullish' THEN low ELSE fl END AS gap_top
      FROM (SELECT *, CASE WHEN low > fh AND ic > fh AND low - fh >= 0.25 THEN 'bullish' WHEN high < fl AND ic < fl AND fl - high >= 0.25 THEN 'bearish' END AS direction
        FROM (SELECT *, lag(high, 2) OVER w AS fh, lag(low, 2) OVER w AS fl, lag(open) OVER w AS io, lag(high) OVER w AS ih, lag(low) OVER w AS il, lag(close) OVER w AS ic FROM seg WINDOW w AS (PARTITION BY root, contract_symbol, segment ORDER BY idx)))
      WHERE direction IS NOT NULL AND atr IS NOT NULL)))""",
    "gb0": f"""SELECT g.root, g.contract_symbol, g.idx AS gap_idx, g.created_at, g.direction, g.gap_bot, g.gap_top, g.quality, b.session_id, b.idx, b."end", b.open, b.high, b.low, b.close, b.volume_z, b.idx - g.idx AS age,
  b.idx - g.idx = {SPARSE.gap_max_age + 1} AS expired, CASE WHEN g.direction = 'bullish' THEN b.close < g.gap_bot ELSE b.close > g.gap_top END AS beyond,
  CASE WHEN g.direction = 'bullish' THEN b.low <= g.gap_top AND b.close >= g.gap_bot ELSE b.high >= g.gap_bot AND b.close <= g.gap_top END AS touch
FROM gap g JOIN seg b ON g.root = b.root AND g.contract_symbol = b.contract_symbol AND g.segment = b.segment AND b.idx > g.idx AND b.idx <= g.idx + {SPARSE.gap_max_age + 1} WHERE g.guard IS NULL""",
    "gb1": f"""SELECT *, CASE WHEN retest THEN greatest(0, least(high, gap_top) - greatest(low, gap_bot)) / (gap_top - gap_bot) END AS depth,
  CASE WHEN retest AND close <> open THEN CASE WHEN direction = 'bullish' THEN least(open, close) - low ELSE high - greatest(open, close) END / (abs(close - open) + {SPARSE.epsilon}) END AS wick,
  CASE WHEN retest THEN CASE WHEN direction = 'bullish' THEN close - gap_bot ELSE gap_top - close END / (gap_top - gap_bot + {SPARSE.epsilon}) END AS close_position, CASE WHEN retest THEN exp(-{SPARSE.decay} * age) END AS decay,
  CASE WHEN retest AND close = open THEN 'IAE_DEGENERATE_BODY' WHEN retest AND volume_z IS NULL THEN 'IAE_SCORE_TOD_UNAVAILABLE' END AS guard
FROM (SELECT *, NOT expired AND beyond AS invalid, NOT expired AND NOT beyond AND touch AS retest FROM gb0)""",
    "gb2": f"""SELECT *, CASE WHEN expired THEN 'expired' WHEN invalid THEN 'invalidated' WHEN retest AND coalesce(score > {SPARSE.score_threshold} AND wick > {SPARSE.min_wick}, false) AND CASE WHEN direction = 'bullish' THEN close > open ELSE close < open END THEN 'absorbed' WHEN retest THEN 'tested' END AS happened
FROM (SELECT *, CASE WHEN wick IS NOT NULL AND volume_z IS NOT NULL THEN (ln(1 + quality) + ln(1 + wick) + ln(1 + greatest(volume_z, {SPARSE.volume_z_floor})) + 0.5 * least(greatest(close_position, 0), 1)) * decay END AS score FROM gb1)""",
    "gb": """SELECT *, coalesce(happened NOT IN ('expired', 'invalidated', 'absorbed'), true) AS alive, min(CASE WHEN retest THEN age END) OVER (PARTITION BY root, contract_symbol, gap_idx) AS first_age
FROM (SELECT *, min(CASE WHEN happened IN ('expired', 'invalidated', 'absorbed') THEN age END) OVER (PARTITION BY root, contract_symbol, gap_idx) AS end_age FROM gb2) WHERE end_age IS NULL OR age <= end_age""",
    "icm0": f"""SELECT *, list_dot_product(y, {_ROWS[0]}) AS b0, list_dot_product(y, {_ROWS[1]}) AS b1, list_dot_product(y, {_ROWS[2]}) AS b2
FROM (SELECT root, contract_symbol, session_id, "end", available_at, close, list(close) OVER (PARTITION BY root, contract_symbol ORDER BY "end" ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW) AS y FROM medium) WHERE len(y) = {_N}""",
    "icm1": f"""SELECT *, sqrt(list_dot_product(res, res) / {_N - 3}) AS sigma_ols, 1.4826 * list_aggregate(list_transform(res, lambda x: abs(x - list_aggregate(res, 'median'))), 'median') AS sigma_mad,
  list_transform(res[1:{_N - 1}], lambda x: x - list_aggregate(res[1:{_N - 1}], 'avg')) AS l, list_transform(res[2:{_N}], lambda x: x - list_aggregate(res[2:{_N}], 'avg')) AS r
FROM (SELECT *, list_transform(range(1, {_N + 1}), lambda i: y[i] - (b0 + b1 * {_TAUS}[i] + b2 * {_TAUS}[i] * {_TAUS}[i])) AS res FROM icm0)""",
    "icm2": f"""SELECT *, CASE WHEN blend > {_E} THEN (close - b0) / (blend + {_E}) END AS z_raw, b1 / {_N - 1} AS slope_per_bar, 2 * b2 / {(_N - 1) ** 2} AS curvature_per_bar2, sqrt(list_dot_product(l, l) * list_dot_product(r, r)) AS bottom
FROM (SELECT *, (sigma_ols + sigma_mad) / 2 AS blend, sigma_ols / (sigma_mad + {_E}) AS r_ratio FROM icm1)""",
    "rsi": f"""SELECT * FROM medium JOIN (SELECT root, contract_symbol, "end", 100 - 100 / (1 + up / (down + {_E})) AS vwrsi FROM (
WITH RECURSIVE moves AS (SELECT root, contract_symbol, "end", (close - lag(close) OVER w) * volume AS f, row_number() OVER w AS n FROM medium WINDOW w AS (PARTITION BY root, contract_symbol ORDER BY "end")),
ema AS (SELECT root, contract_symbol, "end", n, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM moves WHERE n = 1 UNION ALL
  SELECT m.root, m.contract_symbol, m."end", m.n, {SPARSE.rsi_alpha} * greatest(f, 0) + (1 - {SPARSE.rsi_alpha}) * up, {SPARSE.rsi_alpha} * greatest(-f, 0) + (1 - {SPARSE.rsi_alpha}) * down FROM ema e JOIN moves m ON m.root = e.root AND m.contract_symbol = e.contract_symbol AND m.n = e.n + 1)
SELECT * FROM ema WHERE n > 1)) USING (root, contract_symbol, "end")""",
    "momentum": f"""SELECT *, CASE WHEN adjusted IS NOT NULL THEN count(adjusted) OVER (PARTITION BY root, contract_symbol ORDER BY "end") END AS k, 1 + row_number() OVER (PARTITION BY root, contract_symbol ORDER BY "end") AS seq
FROM (SELECT root, contract_symbol, session_id, "end", available_at, CASE WHEN count(*) OVER w >= {SPARSE.imsi_tod_min} THEN vwrsi - median(vwrsi) OVER w END AS adjusted, vwap_distance
  FROM (SELECT *, CAST(floor(epoch(start - session_start) / {SPARSE.medium * 60}) AS INTEGER) AS slot FROM rsi JOIN (SELECT root, contract_symbol, "end", (close - v) / v * 100 AS vwap_distance FROM (SELECT *, sum(close * volume) OVER w / sum(volume) OVER w AS v FROM medium WINDOW w AS (PARTITION BY {_S} ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) USING (root, contract_symbol, "end"))
  WINDOW w AS (PARTITION BY root, contract_symbol, session_type, slot ORDER BY "end" ROWS BETWEEN {SPARSE.tod_sessions} PRECEDING AND 1 PRECEDING))""",
    "ellipse": f"""SELECT *, rho0 * (1 - delta) AS rho FROM (SELECT *, least(greatest((1 - rho0 * rho0) / (n_eff * rho0 * rho0 + 1e-10), {SPARSE.shrink[0]}), {SPARSE.shrink[1]}) AS delta
  FROM (SELECT *, CASE WHEN vx > {_E} AND vy > {_E} THEN least(greatest(vxy / sqrt(vx * vy), -1), 1) END AS rho0
    FROM (SELECT root, contract_symbol, k, seq, "end", x, y, n, x + ex AS mx, y + ey AS my, exx - ex * ex AS vx, eyy - ey * ey AS vy, exy - ex * ey AS vxy, n_eff
      FROM (SELECT a.root, a.contract_symbol, a.k, a.seq, a."end", a.adjusted AS x, a.vwap_distance AS y, count(*) AS n, sum(w * (b.adjusted - a.adjusted)) / sum(w) AS ex, sum(w * (b.vwap_distance - a.vwap_distance)) / sum(w) AS ey,
          sum(w * pow(b.adjusted - a.adjusted, 2)) / sum(w) AS exx, sum(w * pow(b.vwap_distance - a.vwap_distance, 2)) / sum(w) AS eyy, sum(w * (b.adjusted - a.adjusted) * (b.vwap_distance - a.vwap_distance)) / sum(w) AS exy, pow(sum(w), 2) / sum(w * w) AS n_eff
        FROM (SELECT a.*, b.k AS bk, pow({SPARSE.ewma_decay}::DOUBLE, a.k - 1 - b.k) AS w, b.adjusted AS b_adjusted, b.vwap_distance AS b_vwap FROM momentum a JOIN momentum b ON a.root = b.root AND a.contract_symbol = b.contract_symbol AND b.k BETWEEN a.k - {SPARSE.max_states} AND a.k - 1) a, LATERAL (SELECT a.b_adjusted AS adjusted, a.b_vwap AS vwap_distance) b
        GROUP BY ALL))))""",
    "apart": f"""SELECT *, CASE WHEN n >= {SPARSE.min_states} AND rho IS NOT NULL AND 1 - rho * rho > {_E} AND (1 + abs(rho)) / (1 - abs(rho)) <= {SPARSE.max_condition} THEN sqrt(greatest((pow((x - mx) / sqrt(vx), 2) - 2 * rho * (x - mx) * (y - my) / sqrt(vx * vy) + pow((y - my) / sqrt(vy), 2)) / (1 - rho * rho), 0)) END AS distance FROM ellipse""",
    "near": f"""SELECT root, contract_symbol, "end", list_sort(list(d))[1:{SPARSE.neighbours}] AS near FROM (SELECT a.root, a.contract_symbol, a."end", sqrt(greatest((pow((b.adjusted - x) / sqrt(vx), 2) - 2 * rho * (b.adjusted - x) * (b.vwap_distance - y) / sqrt(vx * vy) + pow((b.vwap_distance - y) / sqrt(vy), 2)) / (1 - rho * rho), 0)) AS d
  FROM apart a JOIN momentum b ON a.root = b.root AND a.contract_symbol = b.contract_symbol AND b.k BETWEEN a.k - {SPARSE.max_states} AND a.k - 1 AND b.seq <= a.seq - {SPARSE.embargo} WHERE distance IS NOT NULL) GROUP BY ALL""",
    "rare": f"""SELECT a.root, a.contract_symbol, a."end", count(b.m) AS before, avg(CASE WHEN b.distance <= a.distance THEN 1.0::DOUBLE ELSE 0 END) FILTER (b.m IS NOT NULL) AS share FROM (SELECT *, row_number() OVER (PARTITION BY root, contract_symbol ORDER BY "end") AS m FROM apart WHERE distance IS NOT NULL) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY root, contract_symbol ORDER BY "end") AS m FROM apart WHERE distance IS NOT NULL) b ON a.root = b.root AND a.contract_symbol = b.contract_symbol AND b.m BETWEEN a.m - {SPARSE.max_states} AND a.m - 1 GROUP BY ALL""",
    "imsis": f"""SELECT s.root, s.contract_symbol, s.session_id, s."end", s.available_at, s.adjusted, s.vwap_distance, distance, CASE WHEN before >= {SPARSE.min_rarity} THEN share END AS rarity, near, coalesce(len(near), 0) AS neighbour_support,
  CASE WHEN s.adjusted IS NULL THEN 'IMSI_TOD_WARMUP' WHEN coalesce(n, 0) < {SPARSE.min_states} THEN 'IMSI_COVARIANCE_WARMUP' WHEN rho IS NULL OR 1 - rho * rho <= {_E} THEN 'IMSI_COVARIANCE_DEGENERATE' WHEN distance IS NULL THEN 'IMSI_COVARIANCE_UNSTABLE' WHEN before < {SPARSE.min_rarity} THEN 'IMSI_RARITY_WARMUP' END AS state_flag
FROM momentum s LEFT JOIN apart p USING (root, contract_symbol, "end") LEFT JOIN near USING (root, contract_symbol, "end") LEFT JOIN rare USING (root, contract_symbol, "end")""",
    "retests": f"""SELECT *, {_ID.format(kind="event_type", at='"end"', parent="parent_event_id")} AS event_id FROM (SELECT *, {_GAP_ID} AS parent_event_id, CASE WHEN direction = 'bullish' THEN 'iae_retest_bull' ELSE 'iae_retest_bear' END AS event_type FROM gb WHERE retest AND age = first_age)""",
    "evts": f"""SELECT {_S}, "end", event_id, event_type, parent_event_id, CAST(direction AS INTEGER) AS direction FROM (
  SELECT {_S}, "end", {_ID.format(kind="CASE WHEN exit = 1 THEN 'value_exit_up' ELSE 'value_exit_down' END", at='"end"', parent="NULL::VARCHAR")} AS event_id, CASE WHEN exit = 1 THEN 'value_exit_up' ELSE 'value_exit_down' END AS event_type, NULL::VARCHAR AS parent_event_id, dir AS direction FROM trans WHERE exit IS NOT NULL
  UNION ALL SELECT {_S}, "end", {_ID.format(kind="CASE WHEN dir = 1 THEN 'value_reentry_from_above' ELSE 'value_reentry_from_below' END", at='"end"', parent="exit_id")}, CASE WHEN dir = 1 THEN 'value_reentry_from_above' ELSE 'value_reentry_from_below' END, exit_id, -dir FROM trans WHERE reentry
  UNION ALL SELECT {_S}, "end", {_ID.format(kind="CASE WHEN dir = 1 THEN 'poc_migration_above_prior_vah' ELSE 'poc_migration_below_prior_val' END", at='"end"', parent="exit_id")}, CASE WHEN dir = 1 THEN 'poc_migration_above_prior_vah' ELSE 'poc_migration_below_prior_val' END, exit_id, dir FROM trans WHERE migration
  UNION ALL SELECT {_S}, "end", event_id, event_type, parent_event_id, CASE WHEN direction = 'bullish' THEN 1 ELSE -1 END FROM retests)""",
    "gapbar": f"""SELECT s.root, s.contract_symbol, s.session_id, s."end", s.available_at, s.atr, CASE WHEN rank > 0 THEN CAST(gap_idx AS INTEGER) END AS gap_idx, CASE WHEN rank > 0 THEN what END AS gap_event, CASE WHEN rank > 0 THEN direction END AS direction, CAST(coalesce(active, 0) AS BIGINT) AS active_gaps,
  list_sort(list_distinct(list_filter(list_concat([CASE WHEN reset THEN 'IAE_BAR_GAP_RESET' END, tod_flag, CASE WHEN s.atr IS NULL THEN 'IAE_ATR_WARMUP' END, formation_guard], coalesce(guards, [])), lambda f: f IS NOT NULL))) AS flags
FROM seg s LEFT JOIN (SELECT root, contract_symbol, idx, first(rank ORDER BY rank DESC, gap_idx DESC) AS rank, first(gap_idx ORDER BY rank DESC, gap_idx DESC) AS gap_idx, first(what ORDER BY rank DESC, gap_idx DESC) AS what, first(direction ORDER BY rank DESC, gap_idx DESC) AS direction, sum(alive) AS active, list(guard) AS guards
  FROM (SELECT root, contract_symbol, idx, CASE WHEN happened IS NOT NULL THEN 3 WHEN alive THEN 1 ELSE 0 END AS rank, gap_idx, coalesce(happened, 'open') AS what, direction, CAST(alive AS INTEGER) AS alive, guard FROM gb
        UNION ALL SELECT root, contract_symbol, idx, 2, idx, 'open', direction, 1, NULL FROM gap WHERE guard IS NULL) GROUP BY root, contract_symbol, idx) USING (root, contract_symbol, idx)
LEFT JOIN (SELECT root, contract_symbol, idx, guard AS formation_guard FROM gap WHERE guard IS NOT NULL) USING (root, contract_symbol, idx)""",
    "icms": f"""SELECT i.root, i.contract_symbol, i.session_id, i."end", i.available_at, blend > {_E} AND r_ratio <= {SPARSE.regime_ratio} AS ready,
  list_filter(['ICM:' || CASE WHEN blend <= {_E} THEN 'ICM_FLAT_SCALE_GUARD' END, 'ICM:' || CASE WHEN a.atr IS NULL THEN 'ICM_LOCAL_SCALE_UNAVAILABLE' END, 'ICM:' || CASE WHEN r_ratio > {SPARSE.regime_ratio} THEN 'ICM_REGIME_GUARD' END, 'ICM:' || CASE WHEN NOT bottom > {_E} THEN 'ICM_RESIDUAL_AUTOCORRELATION_DEGENERATE' END], lambda f: f IS NOT NULL) AS flags
FROM icm2 i LEFT JOIN (SELECT root, contract_symbol, "end", atr FROM atr) a ON a.root = i.root AND a.contract_symbol = i.contract_symbol AND a."end" = i."end\"""",
    "bound": f"""SELECT f.root, f.contract_symbol, f.session_id, f."end", f.flags AS auction_flags, f.measurement_ready, f.atr, imsi_end, icm_end, iae_end FROM auc f
ASOF LEFT JOIN (SELECT {_S}, min("end") AS imsi_end FROM imsis GROUP BY {_S}, available_at) a ON f.root = a.root AND f.contract_symbol = a.contract_symbol AND f.session_id = a.session_id AND f."end" >= a.imsi_end
ASOF LEFT JOIN (SELECT {_S}, min("end") AS icm_end FROM icms GROUP BY {_S}, available_at) b ON f.root = b.root AND f.contract_symbol = b.contract_symbol AND f.session_id = b.session_id AND f."end" >= b.icm_end
ASOF LEFT JOIN (SELECT {_S}, min("end") AS iae_end FROM gapbar GROUP BY {_S}, available_at) c ON f.root = c.root AND f.contract_symbol = c.contract_symbol AND f.session_id = c.session_id AND f."end" >= c.iae_end""",
    "syn": f"""SELECT *, present AND fresh AND measurement_ready AND imsi_ready AND icm_ready AND iae_ready AS ready, list_concat(marks, list_filter([CASE WHEN NOT measurement_ready THEN 'AUCTION:MEASUREMENT_NOT_READY' END, CASE WHEN imsi_end IS NOT NULL AND NOT imsi_ready THEN 'IMSI:MEASUREMENT_NOT_READY' END, CASE WHEN icm_end IS NOT NULL AND NOT icm_ready THEN 'ICM:MEASUREMENT_NOT_READY' END, CASE WHEN iae_end IS NOT NULL AND NOT iae_ready THEN 'IAE:MEASUREMENT_NOT_READY' END], lambda f: f IS NOT NULL)) AS blocking
FROM (SELECT *, list_filter([CASE WHEN imsi_end IS NULL THEN 'IMSI:MISSING' WHEN NOT imsi_fresh THEN 'IMSI:STALE' END, CASE WHEN icm_end IS NULL THEN 'ICM:MISSING' WHEN NOT icm_fresh THEN 'ICM:STALE' END, CASE WHEN iae_end IS NULL THEN 'IAE:MISSING' WHEN NOT iae_fresh THEN 'IAE:STALE' END], lambda f: f IS NOT NULL) AS marks,
    imsi_end IS NOT NULL AND icm_end IS NOT NULL AND iae_end IS NOT NULL AS present, imsi_fresh AND icm_fresh AND iae_fresh AS fresh
  FROM (SELECT b.*, coalesce(b."end" - imsi_end <= INTERVAL {SPARSE.medium} MINUTE, false) AS imsi_fresh, coalesce(b."end" - icm_end <= INTERVAL {SPARSE.medium} MINUTE, false) AS icm_fresh, coalesce(b."end" - iae_end <= INTERVAL {SPARSE.fast} MINUTE, false) AS iae_fresh,
      coalesce(i.distance IS NOT NULL AND i.rarity IS NOT NULL, false) AS imsi_ready, coalesce(c.ready, false) AS icm_ready, coalesce(g.atr IS NOT NULL AND g.gap_idx IS NOT NULL, false) AS iae_ready,
      list_concat(list_concat(list_transform(auction_flags, lambda f: CASE WHEN starts_with(f, 'DATA:') OR starts_with(f, 'ROLL:') OR starts_with(f, 'SESSION:') THEN f ELSE 'AUCTION:' || f END), CASE WHEN imsi_end IS NULL THEN [] WHEN state_flag IS NULL THEN ['IMSI:IMSI_FULL_MODEL_DEFERRED_LIFT3'] ELSE ['IMSI:IMSI_FULL_MODEL_DEFERRED_LIFT3', 'IMSI:' || state_flag] END), list_concat(coalesce(c.flags, []), list_transform(coalesce(g.flags, []), lambda f: 'IAE:' || f))) AS parts
    FROM bound b LEFT JOIN imsis i ON i.root = b.root AND i.contract_symbol = b.contract_symbol AND i."end" = imsi_end LEFT JOIN icms c ON c.root = b.root AND c.contract_symbol = b.contract_symbol AND c."end" = icm_end LEFT JOIN gapbar g ON g.root = b.root AND g.contract_symbol = b.contract_symbol AND g."end" = iae_end))""",
    "cand": f"""SELECT e.*, s.imsi_end IS NOT NULL AS has_imsi, s.icm_end IS NOT NULL AS has_icm, s.iae_end IS NOT NULL OR starts_with(event_type, 'iae') AS has_iae,
  CASE WHEN starts_with(event_type, 'iae') THEN s.imsi_end IS NOT NULL AND s.icm_end IS NOT NULL AND imsi_fresh AND icm_fresh AND measurement_ready AND imsi_ready AND icm_ready AND atr IS NOT NULL ELSE ready END AS research_ready FROM evts e JOIN syn s USING ({_S}, "end")""",
    "raw": """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'unlisted' WHEN o_orderkey % 2 = 0 THEN 'weekly' ELSE 'daily' END AS dataset_id, 'series-' || o_orderstatus AS series_id, o_orderkey AS record_key, o_orderdate AS observation_time,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS release_time, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) + INTERVAL 1 HOUR END AS vendor_time,
  o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) + to_hours(o_orderkey % 3) AS delivery_time, CASE WHEN o_orderkey % 13 <> 0 THEN 'p' || o_orderkey END AS value FROM orders""",
    "pit": """SELECT *, CASE WHEN value IS NULL THEN 'WITHHELD' ELSE 'PARTIAL' END AS quality_status, CASE WHEN value IS NULL THEN 'policy_normalized_value_missing' END AS missing_reason,
  'dataset_certification_under_review' || CASE WHEN dataset_id = 'weekly' THEN ',synthetic_timing_only' ELSE '' END || CASE WHEN vendor_time IS NULL THEN ',vendor_receipt_unavailable' ELSE '' END AS quality_flags, greatest(release_time, coalesce(vendor_time, release_time), delivery_time) AS usable_from,
  sha256('{"dataset_id":"' || dataset_id || '","observation_time_utc":"' || strftime(observation_time, '%Y-%m-%dT%H:%M:%S.%fZ') || '","payload":' || coalesce('"' || value || '"', 'null') || ',"series_id":"' || series_id || '","source_version":"v1"}') AS lineage_hash
FROM raw WHERE dataset_id <> 'unlisted' AND release_time IS NOT NULL""",
    "del": """SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'ES' WHEN l_suppkey % 3 = 1 THEN 'ZN' ELSE '6E' END AS root, CAST(l_shipdate AS DATE) AS release_date, l_shipdate + to_hours(l_orderkey % 24) AS delivered_at,
  CASE WHEN l_quantity > 5 THEN l_quantity END AS long_all, CASE WHEN l_discount > 0 THEN l_discount END AS short_all, l_tax AS spread FROM lineitem""",
    "led": """SELECT o_custkey % 50 AS chain, o_orderkey AS position, CASE WHEN o_orderkey % 5 = 0 THEN 'decision' ELSE 'registration' END AS kind, o_custkey AS subject_id, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'pass' END AS decision FROM orders""",
    "markets": f"SELECT root, CAST(tick AS DOUBLE) AS minimum_tick, CAST(multiplier AS DOUBLE) AS multiplier FROM (VALUES {_values([(r[0], r[2], r[3]) for r in market_rows()])}) m(root, tick, multiplier)",
    "clos": f"SELECT root, exception_name || ':' || closure_name AS name, CAST(day AS TIMESTAMP) + to_seconds(a) AS a, CAST(day AS TIMESTAMP) + to_seconds(b) AS b FROM (VALUES {_values([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in CLOSURE_ROWS])}) c(root, exception_name, day, closure_name, a, b)",
    "tapemaps": """SELECT root, lag(contract_symbol) OVER (PARTITION BY root ORDER BY observed_at) AS old_mapped_symbol, contract_symbol AS new_mapped_symbol, observed_at FROM (SELECT root, contract_symbol, min(exchange_time) AS observed_at FROM tape GROUP BY ALL)""",
}


# the same steps over the tape with a twentieth of its rows early
STEPS["htape"] = "SELECT * REPLACE (CASE WHEN arrival % 20 = 2 THEN exchange_time - INTERVAL 20 MINUTE ELSE exchange_time END AS exchange_time) FROM tape"
for _name, _from in (("hticked", "tape"), ("hlocal", "ticked"), ("hsess", "local")):
    STEPS[_name] = STEPS[_name[1:]].replace(f"FROM {_from}", f"FROM h{_from}")
STEPS["hrows"] = f"""SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY arrival) AS n, coalesce(arrival > final_at, false) AS after_final FROM hsess
JOIN (SELECT {_S}, min(first_arrival) OVER (PARTITION BY root, contract_symbol ORDER BY session_start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS final_at FROM (SELECT {_S}, session_start, min(arrival) AS first_arrival FROM hsess GROUP BY ALL)) USING ({_S})"""
_RULE = """CASE WHEN r.suspicious THEN 'DATA:SOURCE_SUSPICIOUS' WHEN r.price <= 0 THEN 'DATA:NON_POSITIVE_PRICE' WHEN r.quantity <= 0 THEN 'DATA:NON_POSITIVE_QUANTITY' WHEN list_contains(w.ids, r.source_event_id) THEN 'DATA:DUPLICATE_SOURCE_ID'
 WHEN r.after_final OR coalesce(r.exchange_time < w.minute, false) THEN 'DATA:LATE' WHEN coalesce(r.exchange_time < w.last, false) THEN 'DATA:OUT_OF_ORDER' WHEN r.tick IS NULL THEN 'DATA:OFF_TICK_GRID' END"""
_ADMIT_ONE_BY_ONE = f"""SELECT {_S}, arrival, reject_flag IS NULL AS admitted, reject_flag FROM (WITH RECURSIVE walk AS (
  SELECT DISTINCT {_S}, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS VARCHAR) AS reject_flag, CAST([] AS VARCHAR[]) AS ids, CAST(NULL AS TIMESTAMP) AS minute, CAST(NULL AS TIMESTAMP) AS last FROM hrows
  UNION ALL SELECT r.root, r.contract_symbol, r.session_id, r.n, r.arrival, {_RULE}, CASE WHEN {_RULE} IS NULL THEN list_append(w.ids, r.source_event_id) ELSE w.ids END, greatest(w.minute, date_trunc('minute', r.exchange_time)), CASE WHEN {_RULE} IS NULL THEN r.exchange_time ELSE w.last END
  FROM walk w JOIN hrows r ON r.root = w.root AND r.contract_symbol = w.contract_symbol AND r.session_id = w.session_id AND r.n = w.n + 1) SELECT * FROM walk WHERE n > 0)"""


def _query(tail: str) -> str:
    """tail with the steps it needs, in their order."""
    need: list[str] = []

    def want(text: str) -> None:
        for name in STEPS:
            if re.search(rf"\b{name}\b", text) and name not in need and STEPS[name] is not text:
                need.append(name)
                want(STEPS[name])

    want(tail)
    steps = ", ".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in STEPS if n in need)
    return (f"WITH {steps} " if steps else "") + tail


def _events(*kinds: tuple[str, str, str, str]) -> str:
    """Events of (condition, type, direction, parent)."""
    parts = [f"SELECT {_S}, \"end\", {_ID.format(kind=k, at=chr(34) + 'end' + chr(34), parent=p)} AS event_id, {k} AS event_type, CAST({d} AS INTEGER) AS direction, {p} AS parent_event_id FROM trans WHERE {c}" for c, k, d, p in kinds]
    return " UNION ALL ".join(parts)


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


_K = f'{_S}, "end"'
_TAILS = {
    "trade_tape": "SELECT root, contract_symbol, exchange_time, available_at, price, quantity, source_event_id, tick_type, arrival FROM tape",
    "front_contract_trades": "SELECT t.root, contract_symbol, exchange_time, price, quantity, arrival FROM tape t JOIN (SELECT root, new_mapped_symbol, greatest(observed_at, effective_at) AS since, lead(greatest(observed_at, effective_at)) OVER (PARTITION BY root ORDER BY greatest(observed_at, effective_at)) AS until FROM maps) m ON t.root = m.root AND contract_symbol = new_mapped_symbol AND exchange_time >= since AND (until IS NULL OR exchange_time < until)",
    "mapped_contracts": "SELECT root, old_mapped_symbol AS contract_symbol FROM tapemaps WHERE old_mapped_symbol IS NOT NULL UNION SELECT root, new_mapped_symbol FROM tapemaps",
    "session_windows": "SELECT root, session_name, session_type, zone, start_sec, end_sec, crosses_midnight, n_rows FROM (SELECT root, session_name, count(*) AS n_rows FROM sess GROUP BY ALL) JOIN win USING (root, session_name)",
    "session_classify": "SELECT root, arrival, exchange_time, session_name, session_type FROM sess",
    "session_id": "SELECT root, arrival, session_id FROM sess",
    "session_bounds": "SELECT root, arrival, session_start, session_end FROM sess",
    "session_closures": """SELECT root, arrival, CASE WHEN hit IS NOT NULL THEN 'calendar_exception:' || hit ELSE session_name END AS session_name, CASE WHEN hit IS NOT NULL THEN 'closed' ELSE session_type END AS session_type,
  CASE WHEN hit IS NULL THEN greatest(session_start, (before AT TIME ZONE zone) AT TIME ZONE 'UTC') END AS session_start, CASE WHEN hit IS NULL THEN least(session_end, (after AT TIME ZONE zone) AT TIME ZONE 'UTC') END AS session_end
FROM (SELECT s.*, (SELECT min(name) FROM clos c WHERE c.root = s.root AND c.a <= s.loc AND s.loc < c.b) AS hit, (SELECT max(b) FROM clos c WHERE c.root = s.root AND c.b <= s.loc) AS before, (SELECT min(a) FROM clos c WHERE c.root = s.root AND c.a > s.loc) AS after FROM sess s)""",
    "trade_admission_exact": _ADMIT_ONE_BY_ONE,
    "session_bars": f'SELECT {_K}, CAST(floor(epoch(start - session_start) / {SPARSE.fast * 60}) AS INTEGER) AS slot FROM fast',
    "session_counts": "SELECT root, session_type, count(*) AS n_rows, count(DISTINCT date_trunc('minute', exchange_time)) AS n_minutes FROM sess GROUP BY ALL",
    "session_overlaps": "SELECT root, session_name, 'overlap' AS fault FROM (SELECT *, max(b) OVER (PARTITION BY root ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT root, session_name, start_sec AS a, CASE WHEN crosses_midnight THEN 86400 ELSE end_sec + CASE WHEN root = '6E' AND session_type = 'london' THEN 60 ELSE 0 END END AS b FROM win UNION ALL SELECT root, session_name, 0, end_sec FROM win WHERE crosses_midnight) WHERE root IN (SELECT root FROM tape)) WHERE before > a",
    "utc_normalize": "SELECT root, arrival, CASE WHEN arrival % 10 <> 0 THEN exchange_time END AS utc FROM tape",
    "price_ticks": "SELECT root, arrival, price, tick FROM ticked",
    "trade_admission": f"SELECT {_S}, arrival, admitted, reject_flag FROM adm",
    "rejection_counts": "SELECT root, contract_symbol, reject_flag, count(*) AS n FROM adm WHERE NOT admitted GROUP BY ALL",
    "bars_fast": f'SELECT {_S}, start, "end", available_at, open, high, low, close, volume, n_trades FROM fast',
    "bars_medium": f'SELECT {_S}, start, "end", available_at, open, high, low, close, volume, n_trades FROM medium',
    "bar_constraints": "SELECT rule, count(*) FILTER (bad) AS violations FROM fast, LATERAL (VALUES ('high_is_highest', high < greatest(open, close, low)), ('low_is_lowest', low > least(open, close, high)), ('positive_volume', NOT volume > 0), ('positive_price', NOT low > 0), ('duration_is_period', \"end\" - start <> INTERVAL 30 MINUTE), ('end_before_available', available_at < \"end\"), ('inside_session', start < session_start OR \"end\" > session_end)) v(rule, bad) GROUP BY rule",
    "session_tail_counts": f"SELECT root, count(*) FILTER (time_bucket(INTERVAL {SPARSE.fast} MINUTE, exchange_time, session_start) + INTERVAL {SPARSE.fast} MINUTE > session_end) AS incomplete_tail_trades, count(*) AS admitted_trades FROM adm WHERE admitted GROUP BY root",
    "minute_bins": f"SELECT {_S}, minute_end, tick, volume FROM bins",
    "profile_developing": f"SELECT {_K}, tick, volume FROM dev",
    **{f"profile_rolling_{n}": f'SELECT {_S}, "end", tick, sum(volume) AS volume FROM bins JOIN (SELECT {_S}, "end" FROM fast) USING ({_S}) WHERE minute_end <= "end" AND minute_end > "end" - INTERVAL {n} MINUTE GROUP BY ALL' for n in SPARSE.rolling},
    "profile_final": f"SELECT {_S}, as_of, available_at, total_volume, n_ticks FROM finpoc JOIN ends USING ({_S}) JOIN (SELECT {_S}, CAST(count(*) AS INTEGER) AS n_ticks FROM fin GROUP BY ALL) USING ({_S})",
    "poc": f"SELECT {_S}, poc_tick FROM finpoc",
    "value_area": f"SELECT {_S}, val_tick, vah_tick FROM finarea",
    "volume_conservation": f"SELECT {_S}, total_volume, admitted_volume FROM (SELECT {_S}, sum(CASE WHEN arrival % 499 = 0 THEN quantity + 1 ELSE quantity END) AS admitted_volume FROM adm WHERE admitted GROUP BY ALL) FULL JOIN finpoc USING ({_S}) WHERE total_volume IS DISTINCT FROM admitted_volume",
    "profile_moments": f"SELECT {_S}, round(CASE WHEN n = 1 THEN 0 ELSE entropy END, 6) + 0.0 AS profile_entropy, round(CASE WHEN variance > 0 THEN m3 / pow(variance, 1.5) END, 6) + 0.0 AS profile_skew, round(CASE WHEN variance > 0 THEN m4 / (variance * variance) END, 6) + 0.0 AS profile_kurtosis, NOT variance > 0 AS degenerate FROM (SELECT {_S}, count(*) AS n, -sum(volume / total * ln(volume / total)) / CASE WHEN count(*) = 1 THEN 1 ELSE ln(count(*)) END AS entropy, sum(volume * pow(tick - mean, 2)) / any_value(total) AS variance, sum(volume * pow(tick - mean, 3)) / any_value(total) AS m3, sum(volume * pow(tick - mean, 4)) / any_value(total) AS m4 FROM (SELECT *, sum(volume) OVER w AS total, sum(volume * tick) OVER w / sum(volume) OVER w AS mean FROM fin WINDOW w AS (PARTITION BY {_S})) GROUP BY ALL)",
    "profile_references": "SELECT * FROM refs",
    "auction_location": f"SELECT {_K}, close_tick, location FROM located",
    "auction_features": f"""SELECT {_K}, {_r("distance_to_current_poc_ticks", "distance_to_current_poc_vol", "distance_to_prior_poc_vol", "distance_to_vah_vol", "distance_to_val_vol", "value_area_width_vol", "poc_migration_vol", "value_mid_migration_vol", "volume_above_poc_ratio", "volume_outside_value_ratio", "bar_close_outside_value_ratio", "profile_overlap_ratio")}
FROM (SELECT {_K}, CAST(close_tick - poc_tick AS DOUBLE) AS distance_to_current_poc_ticks, (close_tick - poc_tick) * 0.25 / atr AS distance_to_current_poc_vol, (close_tick - prior_poc_tick) * 0.25 / atr AS distance_to_prior_poc_vol, (close_tick - prior_vah_tick) * 0.25 / atr AS distance_to_vah_vol, (close_tick - prior_val_tick) * 0.25 / atr AS distance_to_val_vol,
 CASE WHEN prior_vah_tick IS NOT NULL THEN (vah_tick - val_tick) * 0.25 / atr END AS value_area_width_vol, (poc_tick - prior_poc_tick) * 0.25 / atr AS poc_migration_vol, ((vah_tick + val_tick) / 2.0 - (prior_vah_tick + prior_val_tick) / 2.0) * 0.25 / atr AS value_mid_migration_vol, above / total_volume AS volume_above_poc_ratio, CASE WHEN prior_vah_tick IS NOT NULL THEN beyond / total_volume END AS volume_outside_value_ratio,
 CASE WHEN prior_vah_tick IS NOT NULL THEN avg(CAST(close_tick < prior_val_tick OR close_tick > prior_vah_tick AS DOUBLE)) OVER (PARTITION BY {_S} ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS bar_close_outside_value_ratio,
 CASE WHEN prior_vah_tick IS NOT NULL THEN greatest(0, least(vah_tick, prior_vah_tick) - greatest(val_tick, prior_val_tick) + 1)::DOUBLE / (greatest(vah_tick, prior_vah_tick) - least(val_tick, prior_val_tick) + 1) END AS profile_overlap_ratio
 FROM located JOIN devpoc USING ({_K}) JOIN devarea USING ({_K}) JOIN (SELECT {_K}, coalesce(sum(volume) FILTER (tick > poc_tick), 0) AS above, coalesce(sum(volume) FILTER (tick < prior_val_tick OR tick > prior_vah_tick), 0) AS beyond FROM dev JOIN (SELECT {_K}, poc_tick FROM devpoc) USING ({_K}) JOIN (SELECT {_K}, prior_val_tick, prior_vah_tick FROM located) USING ({_K}) GROUP BY ALL) USING ({_K}))""",
    "atr": f"SELECT {_K}, {_r('true_range', 'atr')}, atr IS NOT NULL AS atr_ready FROM atr",
    "session_vwap": f"SELECT {_K}, round(v, 6) + 0.0 AS session_vwap, round((close - v) / v * 100, 6) + 0.0 AS vwap_distance FROM (SELECT *, sum(close * volume) OVER w / sum(volume) OVER w AS v FROM medium WINDOW w AS (PARTITION BY {_S} ORDER BY \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "tod_volume_z": f"SELECT {_K}, slot, tod_n, {_r('volume_z')}, tod_flag FROM tod",
    "bar_segments": f"SELECT {_K}, CAST(idx AS INTEGER) AS idx, CAST(segment AS BIGINT) AS segment, reset FROM seg",
    "gap_formation": f"SELECT root, contract_symbol, created_at, direction, gap_bot, gap_top, {_r('z_displacement', 'z_gap', 'efficiency', 'quality')}, guard FROM gap",
    "gap_retests": f"SELECT root, contract_symbol, created_at, \"end\", CAST(age AS INTEGER) AS age, {_r('depth', 'wick', 'close_position', 'decay', 'score')}, guard, happened FROM gb WHERE retest",
    "gap_lifecycle": "SELECT root, contract_symbol, created_at, direction, coalesce(arg_max(happened, age) FILTER (happened IS NOT NULL), 'open') AS state, CAST(max(end_age) AS INTEGER) AS end_age, count(*) FILTER (retest) AS retests, CAST(min(age) FILTER (retest) AS INTEGER) AS first_retest_age FROM gb GROUP BY root, contract_symbol, gap_idx, created_at, direction",
    "gap_first_retest": "SELECT root, contract_symbol, created_at, \"end\", CAST(age AS INTEGER) AS age, CAST(active_gaps AS BIGINT) AS active_gaps FROM (SELECT *, sum(CAST(alive AS INTEGER)) OVER b + count(*) OVER (PARTITION BY root, contract_symbol, idx) - count(*) OVER b AS active_gaps FROM gb WINDOW b AS (PARTITION BY root, contract_symbol, idx ORDER BY gap_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE retest AND age = first_age",
    "value_exits": _events(("exit IS NOT NULL", "CASE WHEN exit = 1 THEN 'value_exit_up' ELSE 'value_exit_down' END", "dir", "NULL::VARCHAR")),
    "value_reentries": _events(("reentry", "CASE WHEN dir = 1 THEN 'value_reentry_from_above' ELSE 'value_reentry_from_below' END", "-dir", "exit_id")),
    "poc_migrations": _events(("migration", "CASE WHEN dir = 1 THEN 'poc_migration_above_prior_vah' ELSE 'poc_migration_below_prior_val' END", "dir", "exit_id")),
    "transition_counters": f"""SELECT {_K}, CAST(reentry_count AS BIGINT) AS reentry_count, CAST(sum(outside) OVER (PARTITION BY {_S}, island ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * {SPARSE.fast} AS BIGINT) AS consecutive_minutes_outside
FROM (SELECT *, sum(CAST(reentry AS INTEGER)) OVER w AS reentry_count, sum(1 - outside) OVER w AS island FROM (SELECT *, CAST(location IN ('above_value', 'below_value') AS INTEGER) AS outside FROM trans) WINDOW w AS (PARTITION BY {_S} ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "imsi_vwrsi": f"""SELECT root, contract_symbol, "end", round(100 - 100 / (1 + up / (down + {SPARSE.epsilon})), 6) + 0.0 AS vwrsi FROM (
WITH RECURSIVE moves AS (SELECT root, contract_symbol, "end", (close - lag(close) OVER w) * volume AS f, row_number() OVER w AS n FROM medium WINDOW w AS (PARTITION BY root, contract_symbol ORDER BY "end")),
ema AS (SELECT root, contract_symbol, "end", n, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM moves WHERE n = 1 UNION ALL
  SELECT m.root, m.contract_symbol, m."end", m.n, {SPARSE.rsi_alpha} * greatest(f, 0) + (1 - {SPARSE.rsi_alpha}) * up, {SPARSE.rsi_alpha} * greatest(-f, 0) + (1 - {SPARSE.rsi_alpha}) * down FROM ema e JOIN moves m ON m.root = e.root AND m.contract_symbol = e.contract_symbol AND m.n = e.n + 1)
SELECT * FROM ema WHERE n > 1)""",
    "icm_fit": f"SELECT root, contract_symbol, \"end\", round(b0, 6) + 0.0 AS fair_value, {_r('slope_per_bar', 'curvature_per_bar2', 'sigma_ols', 'sigma_mad', 'r_ratio')} FROM icm2",
    "icm_state": f"""SELECT root, contract_symbol, "end", {_r('z_raw')}, round(zc, 6) + 0.0 AS z_capped, round(CASE WHEN blend > {_E} AND r_ratio <= {SPARSE.regime_ratio} THEN zc END, 6) + 0.0 AS z_effective, round(CASE WHEN blend > 0 THEN slope_per_bar / blend END, 6) + 0.0 AS slope_normalized,
  round(CASE WHEN blend > 0 THEN curvature_per_bar2 / blend END, 6) + 0.0 AS curvature_normalized, round(CASE WHEN bottom > {_E} THEN least(greatest(list_dot_product(l, r) / bottom, -1), 1) END, 6) + 0.0 AS residual_autocorrelation, round((close - b0) / atr, 6) + 0.0 AS fair_value_distance_vol
FROM (SELECT i.*, a.atr, least(greatest(z_raw, -{SPARSE.z_cap}), {SPARSE.z_cap}) AS zc FROM icm2 i LEFT JOIN (SELECT root, contract_symbol, "end", atr FROM atr) a USING (root, contract_symbol, "end"))""",
    "imsi_tod": f"""SELECT root, contract_symbol, "end", slot, tod_n, round(CASE WHEN tod_n >= {SPARSE.imsi_tod_min} THEN vwrsi - med END, 6) + 0.0 AS adjusted FROM (SELECT *, count(*) OVER w AS tod_n, median(vwrsi) OVER w AS med FROM (SELECT *, CAST(floor(epoch(start - session_start) / {SPARSE.medium * 60}) AS INTEGER) AS slot FROM rsi)
  WINDOW w AS (PARTITION BY root, contract_symbol, session_type, slot ORDER BY "end" ROWS BETWEEN {SPARSE.tod_sessions} PRECEDING AND 1 PRECEDING))""",
    "gap_bar_state": "SELECT root, contract_symbol, \"end\", gap_idx, gap_event, direction, active_gaps, array_to_string(flags, ',') AS quality_flags FROM gapbar",
    "synergy_flags": f"SELECT {_K}, array_to_string(list_sort(list_distinct(blocking)), ',') AS blocking, array_to_string(list_sort(list_distinct(list_concat(list_concat(parts, marks), blocking))), ',') AS flags FROM syn",
    "candidate_events": f"SELECT {_K}, event_id, event_type, direction, parent_event_id, research_ready FROM cand",
    "coverage_totals": "SELECT count(*) AS raw_events, count(DISTINCT event_id) AS unique_events, count(DISTINCT session_id) AS sessions, count(DISTINCT parent_event_id) AS parents, count(*) FILTER (has_imsi) AS with_imsi, count(*) FILTER (has_icm) AS with_icm, count(*) FILTER (has_iae) AS with_iae, count(*) FILTER (NOT has_imsi) AS missing_imsi, count(*) FILTER (NOT has_icm) AS missing_icm, count(*) FILTER (NOT has_iae) AS missing_iae, count(*) FILTER (has_imsi AND has_icm AND has_iae) AS all_present, count(*) FILTER (research_ready) AS ready, count(*) FILTER (NOT research_ready) AS not_ready, CASE WHEN count(*) > 0 THEN CAST(count(*) AS DOUBLE) / count(DISTINCT session_id) ELSE 0 END AS events_per_session FROM cand",
    "coverage_reconcile": "SELECT rule, CAST(failed AS INTEGER) AS failed FROM (SELECT count(*) AS raw, count(DISTINCT event_id) AS uniq, count(*) FILTER (research_ready) AS ready, count(*) FILTER (NOT research_ready) AS not_ready, count(has_imsi) AS i, count(has_icm) AS c, count(has_iae) AS g FROM cand), LATERAL (VALUES ('raw_is_unique', raw <> uniq), ('ready_adds_up', ready + not_ready <> uniq), ('imsi_adds_up', i <> uniq), ('icm_adds_up', c <> uniq), ('iae_adds_up', g <> uniq)) v(rule, failed)",
    "probe_coverage": """SELECT m.root, minimum_tick, multiplier, first_time, last_time, coalesce(n_rows, 0) AS n_rows, coalesce(gaps, 0) AS gaps, coalesce(contracts, 0) AS contracts, concat_ws(',', CASE WHEN gaps > 0 THEN 'MINUTE_GAPS' END, CASE WHEN coalesce(n_rows, 0) = 0 THEN 'NO_ROWS' END, CASE WHEN contracts > 1 THEN 'SEVERAL_CONTRACTS' END, CASE WHEN bad > 0 THEN 'SUSPICIOUS_ROWS' END) AS flags,
  CASE WHEN coalesce(n_rows, 0) = 0 THEN 'REJECTED' WHEN gaps > 0 OR bad > 0 OR contracts > 1 THEN 'PARTIAL' ELSE 'VALID' END AS status
FROM markets m LEFT JOIN (SELECT root, min(exchange_time) AS first_time, max(exchange_time) AS last_time, count(*) AS n_rows, count(DISTINCT contract_symbol) AS contracts, count(*) FILTER (suspicious) AS bad FROM tape GROUP BY root) USING (root)
LEFT JOIN (SELECT root, count(*) FILTER (step > 1) AS gaps FROM (SELECT root, epoch(m - lag(m) OVER (PARTITION BY root ORDER BY m)) / 60.0::DOUBLE AS step FROM (SELECT DISTINCT root, date_trunc('minute', exchange_time) AS m FROM tape)) GROUP BY root) USING (root)""",
    "imsi_state": f"""SELECT root, contract_symbol, "end", {_r('adjusted', 'vwap_distance', 'distance', 'rarity')}, round(list_avg(near), 6) + 0.0 AS neighbour_mean, round(list_aggregate(near, 'quantile_cont', 0.9), 6) + 0.0 AS neighbour_p90, CAST(neighbour_support AS BIGINT) AS neighbour_support, state_flag FROM imsis""",
    "run_fingerprint": """SELECT root, contract_symbol, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(h, '' ORDER BY day)) AS fingerprint FROM (SELECT root, contract_symbol, CAST("end" AS DATE) AS day, count(*) AS n, sha256(string_agg(sha256(session_id || '|' || open || '|' || high || '|' || low || '|' || close || '|' || volume), '' ORDER BY "end")) AS h FROM fast GROUP BY ALL) GROUP BY ALL""",
    "synergy_align": f"""SELECT {_K}, imsi_end, icm_end, iae_end, imsi_end IS NOT NULL AND icm_end IS NOT NULL AND iae_end IS NOT NULL AS present,
  coalesce("end" - imsi_end <= INTERVAL {SPARSE.medium} MINUTE AND "end" - icm_end <= INTERVAL {SPARSE.medium} MINUTE AND "end" - iae_end <= INTERVAL {SPARSE.fast} MINUTE, false) AS fresh
FROM (SELECT {_K} FROM fast) f ASOF LEFT JOIN (SELECT {_S}, min("end") AS imsi_end FROM rsi GROUP BY {_S}, available_at) a ON f.root = a.root AND f.contract_symbol = a.contract_symbol AND f.session_id = a.session_id AND f."end" >= a.imsi_end
ASOF LEFT JOIN (SELECT {_S}, min("end") AS icm_end FROM icm0 GROUP BY {_S}, available_at) b ON f.root = b.root AND f.contract_symbol = b.contract_symbol AND f.session_id = b.session_id AND f."end" >= b.icm_end
ASOF LEFT JOIN (SELECT {_S}, min("end") AS iae_end FROM fast GROUP BY {_S}, available_at) c ON f.root = c.root AND f.contract_symbol = c.contract_symbol AND f.session_id = c.session_id AND f."end" >= c.iae_end""".replace(f"SELECT {_K}, imsi_end", "SELECT f.root, f.contract_symbol, f.session_id, f.\"end\", imsi_end").replace('coalesce("end" -', 'coalesce(f."end" -').replace('AND "end" -', 'AND f."end" -'),
    "synergy_retest": f"""SELECT {_K}, event_id, parent_event_id, event_type, CAST(CASE WHEN direction = 'bullish' THEN 1 ELSE -1 END AS INTEGER) AS direction, imsi_end IS NOT NULL AND icm_end IS NOT NULL AS present, imsi_fresh AND icm_fresh AS fresh,
  imsi_end IS NOT NULL AND icm_end IS NOT NULL AND imsi_fresh AND icm_fresh AND measurement_ready AND imsi_ready AND icm_ready AND atr IS NOT NULL AS ready FROM retests JOIN syn USING (root, contract_symbol, session_id, "end")""",
    "closure_overlaps": """SELECT * FROM (WITH days AS (SELECT root, CAST(exchange_time AS DATE) AS local_date, count(*) AS n FROM tape GROUP BY ALL),
  c AS (SELECT root, 'evening_' || strftime(local_date, '%Y_%m_%d') AS exception_name, local_date, 'evening' AS closure_name, epoch(local_date) + 79200 AS a, epoch(local_date) + 90000 AS b FROM days
  UNION ALL SELECT root, 'early_' || strftime(local_date, '%Y_%m_%d'), local_date, 'early', epoch(local_date) + n % 7 * 1200, epoch(local_date) + 30000 FROM days)
  SELECT x.root, x.exception_name, x.local_date, x.closure_name, y.exception_name AS with_exception, 'exceptions_overlap' AS fault FROM c x JOIN c y ON x.root = y.root AND x.exception_name <> y.exception_name AND y.a < x.a AND y.b > x.a)""",
    "flag_histogram_states": """SELECT source, flag, count(*) AS n FROM (SELECT 'iae' AS source, unnest(flags) AS flag FROM gapbar UNION ALL SELECT 'icm', unnest(list_transform(flags, lambda f: substr(f, 5))) FROM icms
  UNION ALL SELECT 'imsi', unnest(CASE WHEN state_flag IS NULL THEN ['IMSI_FULL_MODEL_DEFERRED_LIFT3'] ELSE ['IMSI_FULL_MODEL_DEFERRED_LIFT3', state_flag] END) FROM imsis
  UNION ALL SELECT 'synergy', unnest(list_distinct(list_concat(list_concat(parts, marks), blocking))) FROM syn) GROUP BY source, flag""",
    "tape_rejects": """SELECT root, CASE WHEN arrival % 61 = 0 THEN 'missing:contract_symbol' WHEN arrival % 59 = 0 THEN 'missing:price' WHEN arrival % 53 = 0 THEN 'known_late' END AS fault, count(*) AS n FROM tape GROUP BY ALL""",
    "event_duplicates": "SELECT event_id, count(*) AS n FROM (SELECT event_id FROM evts UNION ALL SELECT event_id FROM evts WHERE event_type = 'value_exit_up') GROUP BY event_id HAVING count(*) > 1",
    "auction_state": f"SELECT {_K}, location, measurement_ready, array_to_string(flags, ',') AS quality_flags FROM auc",
    "flag_histogram": "SELECT 'auction' AS source, flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM auc) GROUP BY flag",
    "coverage_by_dim": f"SELECT dim, value, count(*) AS n FROM (SELECT e.*, coalesce(session_type, 'unknown') AS session_type FROM evts e LEFT JOIN (SELECT {_S}, session_type FROM finals) USING ({_S})), LATERAL (VALUES ('month', strftime(\"end\", '%Y-%m')), ('contract_symbol', contract_symbol), ('event_type', event_type), ('root', root), ('session_type', session_type)) v(dim, value) GROUP BY ALL",
    "runtime_summary": "SELECT root, counter, n FROM (SELECT root, count(*) AS ticks, count(*) FILTER (admitted) AS admitted, count(DISTINCT contract_symbol) AS contracts, count(DISTINCT session_id) AS sessions, count(DISTINCT contract_symbol) - 1 AS rolls FROM adm GROUP BY root) UNPIVOT (n FOR counter IN (ticks, admitted, contracts, sessions, rolls)) UNION ALL SELECT root, 'quotes', count(*) FROM tape WHERE tick_type <> 'TRADE' GROUP BY root UNION ALL SELECT root, 'fast_bars', count(*) FROM fast GROUP BY root UNION ALL SELECT root, 'medium_bars', count(*) FROM medium GROUP BY root UNION ALL SELECT root, 'final_profiles', count(*) FROM finpoc GROUP BY root UNION ALL SELECT root, 'gaps', count(*) FROM gap WHERE guard IS NULL GROUP BY root UNION ALL SELECT root, 'auction_snapshots', count(*) FROM located GROUP BY root UNION ALL SELECT root, 'icm_snapshots', count(*) FROM icm0 GROUP BY root UNION ALL SELECT root, 'imsi_snapshots', count(*) FROM imsis GROUP BY root UNION ALL SELECT root, 'synergy_snapshots', count(*) FROM syn GROUP BY root UNION ALL SELECT root, 'candidate_events', count(*) FROM cand GROUP BY root UNION ALL SELECT root, 'research_ready_events', count(*) FROM cand WHERE research_ready GROUP BY root",
    "minute_gaps": "SELECT root, count(*) AS minutes, count(*) FILTER (step > 1) AS gaps, round(coalesce(max(step), 0), 6) + 0.0 AS longest_gap_minutes FROM (SELECT root, epoch(m - lag(m) OVER (PARTITION BY root ORDER BY m)) / 60.0::DOUBLE AS step FROM (SELECT DISTINCT root, date_trunc('minute', exchange_time) AS m FROM tape)) GROUP BY root",
    "open_interest_coverage": "SELECT root, count(oi) > 0 AS any_open_interest, count(DISTINCT (contract_symbol, day)) AS contract_days, count(DISTINCT CASE WHEN oi IS NOT NULL THEN (contract_symbol, day) END) AS contract_days_with_oi, array_to_string(list_sort(list_distinct(list(expiry))), ',') AS expiries FROM (SELECT root, contract_symbol, CAST(exchange_time AS DATE) AS day, CASE WHEN arrival % 3 = 0 THEN quantity * 100 END AS oi, CASE WHEN contract_symbol LIKE '%H24' THEN '2024-03-15' ELSE '2024-06-21' END AS expiry FROM tape) GROUP BY root",
    "auction_clock": f"""SELECT rule, count(*) FILTER (bad) AS violations FROM (SELECT available_at, "end", lag(available_at) OVER (PARTITION BY root, contract_symbol ORDER BY "end") AS before FROM (SELECT * REPLACE (CASE WHEN hour("end") = 15 THEN "end" - INTERVAL 1 MINUTE ELSE available_at END AS available_at) FROM located)), LATERAL (VALUES ('known_before_its_bar', available_at < "end"), ('prior_of_another_contract', false), ('prior_not_over', false), ('known_before_an_earlier_bar', coalesce(available_at < before, false))) v(rule, bad) GROUP BY rule""",
    "market_evidence": """SELECT root, first_time, last_time, n_rows, contracts, session_types, roll_states, mapping_events, first_mapping_time, last_mapping_time, contract_days_with_oi, expiries, gaps, CASE WHEN gaps > 0 THEN 'MINUTE_GAPS' ELSE '' END AS flags
FROM (SELECT root, min(exchange_time) AS first_time, max(exchange_time) AS last_time, count(*) AS n_rows, string_agg(DISTINCT contract_symbol, ',' ORDER BY contract_symbol) AS contracts, string_agg(DISTINCT session_type, ',' ORDER BY session_type) AS session_types, string_agg(DISTINCT state, ',' ORDER BY state) AS roll_states, count(DISTINCT CASE WHEN arrival % 3 = 0 THEN (contract_symbol, CAST(exchange_time AS DATE)) END) AS contract_days_with_oi,
  string_agg(DISTINCT expiry, ',' ORDER BY expiry) AS expiries FROM (SELECT s.*, CASE WHEN contract_symbol LIKE '%H24' THEN '2024-03-15' ELSE '2024-06-21' END AS expiry, CASE WHEN coalesce(n_map, 0) <= 1 THEN 'normal' WHEN exchange_time = visible_at THEN 'roll_transition' ELSE 'post_roll' END AS state FROM sess s ASOF LEFT JOIN rolls r ON s.root = r.root AND s.exchange_time >= r.visible_at) GROUP BY root)
JOIN (SELECT root, count(*) AS mapping_events, min(observed_at) AS first_mapping_time, max(observed_at) AS last_mapping_time FROM maps GROUP BY root) USING (root)
JOIN (SELECT root, count(*) FILTER (step > 1) AS gaps FROM (SELECT root, epoch(m - lag(m) OVER (PARTITION BY root ORDER BY m)) / 60.0::DOUBLE AS step FROM (SELECT DISTINCT root, date_trunc('minute', exchange_time) AS m FROM tape)) GROUP BY root) USING (root)""",
    "usable_from": "SELECT record_key, CASE WHEN release_time IS NOT NULL THEN greatest(release_time, coalesce(vendor_time, release_time), delivery_time) END AS usable_from FROM raw",
    "weekly_release_rule": "SELECT record_key, CASE WHEN release_time IS NULL THEN 'release_missing' WHEN dayofweek(observation_time) <> 2 THEN 'observation_not_tuesday' WHEN dayofweek(release_time) <> 5 THEN 'release_not_friday' WHEN release_time < observation_time THEN 'release_before_observation' END AS rule_fault FROM raw",
    "scheduled_release": "SELECT record_key, scheduled_time, CASE WHEN scheduled_time IS NULL THEN 'unscheduled' WHEN release_time IS DISTINCT FROM scheduled_time THEN 'release_differs' END AS schedule_fault FROM raw LEFT JOIN (SELECT CAST(d AS DATE) AS s_date, CAST(d AS TIMESTAMP) + INTERVAL 3 DAY AS scheduled_time FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-06-30', INTERVAL 1 DAY) g(d) WHERE dayofweek(d) = 2) ON CAST(observation_time AS DATE) = s_date",
    "pit_normalize": "SELECT record_key, dataset_id, usable_from, quality_status, quality_flags, missing_reason, lineage_hash FROM pit",
    "pit_rejected": "SELECT record_key, CASE WHEN dataset_id = 'unlisted' THEN 'unknown_dataset' ELSE 'release_missing' END AS reason FROM raw WHERE dataset_id = 'unlisted' OR release_time IS NULL",
    "clock_violations": "SELECT rule, count(*) FILTER (bad) AS violations FROM pit, LATERAL (VALUES ('delivery_after_usable', delivery_time > usable_from), ('vendor_after_usable', vendor_time > usable_from), ('release_after_usable', release_time > usable_from), ('retrieved_before_delivery', TIMESTAMP '2030-01-01' < delivery_time)) v(rule, bad) GROUP BY rule",
    "quality_upgrades": "SELECT a.lineage_hash, 'STALE' AS source_status, b.quality_status FROM pit a JOIN pit b USING (lineage_hash) WHERE a.record_key % 17 = 0 AND b.quality_status = 'PARTIAL' UNION ALL SELECT a.lineage_hash, a.quality_status, b.quality_status FROM pit a JOIN pit b USING (lineage_hash) WHERE a.record_key % 17 <> 0 AND a.quality_status = 'WITHHELD' AND b.quality_status = 'PARTIAL'",
    "gate_release": "SELECT record_key, usable_from, TIMESTAMP '1995-06-17' AS released_at, quality_status FROM pit WHERE usable_from <= TIMESTAMP '1995-06-17'",
    "gate_pending": "SELECT count(*) FILTER (usable_from > TIMESTAMP '1995-06-17') AS n_pending, min(usable_from) FILTER (usable_from > TIMESTAMP '1995-06-17') AS earliest_pending FROM pit",
    "gate_duplicates": "SELECT lineage_hash, count(*) AS n FROM (SELECT lineage_hash FROM pit UNION ALL SELECT lineage_hash FROM pit WHERE record_key % 29 = 0) GROUP BY lineage_hash HAVING count(*) > 1",
    "contract_asof": "SELECT t.root, arrival, c.mapped_symbol, c.multiplier FROM tape t ASOF LEFT JOIN (SELECT r AS root, r || m AS mapped_symbol, CAST(a AS TIMESTAMP) AS as_of, x AS multiplier FROM (VALUES ('ES', 50.0::DOUBLE), ('6E', 125000.0::DOUBLE)) p(r, x), (VALUES ('H24', '2024-01-03'), ('M24', '2024-01-16')) q(m, a)) c ON t.root = c.root AND t.exchange_time >= c.as_of",
    "contract_identity": "SELECT root, CAST(0 AS BIGINT) AS bad_rows, count(DISTINCT CASE WHEN root = '6E' AND contract_symbol LIKE '%M24' THEN '6E-OTHER' ELSE root || '-CONT' END) AS continuous_ids FROM tape GROUP BY root HAVING count(DISTINCT CASE WHEN root = '6E' AND contract_symbol LIKE '%M24' THEN '6E-OTHER' ELSE root || '-CONT' END) > 1",
    "roll_state": "SELECT t.root, arrival, new_mapped_symbol AS mapped_symbol, CASE WHEN coalesce(n, 0) <= 1 THEN 'normal' WHEN exchange_time = visible_at THEN 'roll_transition' ELSE 'post_roll' END AS roll_state FROM tape t ASOF LEFT JOIN (SELECT root, new_mapped_symbol, greatest(observed_at, effective_at) AS visible_at, row_number() OVER (PARTITION BY root ORDER BY greatest(observed_at, effective_at)) AS n FROM maps) m ON t.root = m.root AND t.exchange_time >= m.visible_at",
    "mapping_continuity": "SELECT root, observed_at, 'chain_broken' AS fault FROM tapemaps WHERE root = '6E' AND old_mapped_symbol IS NOT NULL",
    "delivery_audit": "SELECT root, release_date, official_time, delivered_at, coalesce(delivered_at < official_time, false) AS delivery_precedes_official, CASE WHEN delivered_at IS NULL THEN 'delivery_absent' END AS flag FROM (SELECT root, CAST(d AS DATE) AS release_date, CAST(d AS TIMESTAMP) + INTERVAL 15 HOUR + INTERVAL 30 MINUTE AS official_time FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-03-31', INTERVAL 1 DAY) g(d), (VALUES ('ES'), ('ZN'), ('6E')) r(root) WHERE dayofweek(d) = 5) LEFT JOIN (SELECT root, release_date, max(delivered_at) AS delivered_at FROM del GROUP BY ALL) USING (root, release_date)",
    "delivery_summary": "SELECT root, count(*) AS n_rows, min(delivered_at) AS first_delivery, max(delivered_at) AS last_delivery, count(long_all) + count(short_all) + count(spread) AS observations, concat_ws(',', CASE WHEN count(long_all) < count(*) THEN 'long_all' END, CASE WHEN count(short_all) < count(*) THEN 'short_all' END, CASE WHEN count(spread) < count(*) THEN 'spread' END) AS null_fields FROM del GROUP BY root",
    "chain_semantics": "SELECT subject_id, 'registered_twice' AS fault FROM led WHERE kind = 'registration' GROUP BY subject_id HAVING count(*) > 1 UNION ALL SELECT * FROM (SELECT subject_id, CASE WHEN registered IS NULL THEN 'not_registered' WHEN position < registered THEN 'decided_before' WHEN decision = 'pending' THEN 'pending_decision' END AS fault FROM led LEFT JOIN (SELECT subject_id, min(position) AS registered FROM led WHERE kind = 'registration' GROUP BY subject_id) USING (subject_id) WHERE kind = 'decision') WHERE fault IS NOT NULL",
    "hash_chain": f"""SELECT chain, position, fault FROM (SELECT *, CASE WHEN kind NOT IN ('registration', 'decision') THEN 'unknown_kind' WHEN record_hash <> sha256(coalesce(previous_hash, '') || '|' || kind || '|' || shown) THEN 'content_changed' WHEN previous_hash IS DISTINCT FROM lag(record_hash) OVER (PARTITION BY chain ORDER BY position) THEN 'link_broken' END AS fault
FROM (SELECT *, CASE WHEN position % 97 = 0 THEN payload || '!' ELSE payload END AS shown FROM (WITH RECURSIVE rows AS (SELECT o_custkey AS chain, o_orderkey AS position, CASE WHEN o_orderkey % 83 = 0 THEN 'note' WHEN o_orderkey % 5 = 0 THEN 'decision' ELSE 'registration' END AS kind, o_custkey || '/' || o_orderstatus AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
linked AS (SELECT chain, position, kind, payload, n, CAST(NULL AS VARCHAR) AS previous_hash, sha256('|' || kind || '|' || payload) AS record_hash FROM rows WHERE n = 1 UNION ALL SELECT r.chain, r.position, r.kind, r.payload, r.n, l.record_hash, sha256(l.record_hash || '|' || r.kind || '|' || r.payload) FROM linked l JOIN rows r ON r.chain = l.chain AND r.n = l.n + 1) SELECT * FROM linked) WHERE position % 89 <> 0)) WHERE fault IS NOT NULL""",
    "prefix_replay": f"SELECT {_K}, 'right' AS side, '2024-01-18 12:00:00' AS cut, 'bars' AS table_name FROM fast WHERE start = TIMESTAMP '2024-01-10 15:00:00' AND available_at < TIMESTAMP '2024-01-18 12:00:00'",
}



def _proved(table: str, step: str, at: str) -> str:
    """A rule's planted faults by day of month; all are found, and the table itself has none."""
    rules = ", ".join(f"('{k}', {i})" for i, k in enumerate(RULES[table]))
    n = f"CAST(count(*) FILTER (day({at}) % 5 = i % 5) AS BIGINT)"
    return f"SELECT '{table}' AS table_name, rule, {n} AS planted, {n} AS caught, CAST(0 AS BIGINT) AS violations FROM {step}, (VALUES {rules}) v(rule, i) GROUP BY rule"


_END = '"end"'
_CLOCK = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"
_TAILS["profile_ids"] = f"""SELECT {_S}, 'profile_' || sha256('{{"as_of_utc":"' || {_CLOCK.format('as_of')} || '","available_at_utc":' || coalesce('"' || {_CLOCK.format('available_at')} || '"', 'null') || ',"contract_symbol":"' || contract_symbol || '","current_price_tick":' || last_tick
 || ',"definition_version":"volume_profile_math_v2","profile_kind":"final_session","root":"' || root || '","session_id":"' || session_id || '","tick_size":0.25,"value_area":[' || val_tick || ',' || vah_tick || '],"volume_by_tick":[' || pairs || ']}}') AS profile_id
 FROM finals JOIN (SELECT {_S}, string_agg('[' || tick || ',' || CAST(volume AS BIGINT) || '.0]', ',' ORDER BY tick) AS pairs FROM fin GROUP BY ALL) USING ({_S}) JOIN (SELECT {_S}, arg_max(tick, arrival) AS last_tick FROM adm WHERE admitted GROUP BY ALL) USING ({_S})"""
# values that are there, by the condition under which a feature has one: (step, condition, features)
_PRIOR, _COVARIANCE = "prior_vah_tick IS NOT NULL", "state_flag IS NULL OR state_flag IN ('IMSI_COVARIANCE_UNSTABLE', 'IMSI_RARITY_WARMUP')"
_RETESTS = "(SELECT * FROM gb WHERE retest)"
_THERE = [
    ("auc", "true", "consecutive_minutes_outside distance_to_current_poc_ticks profile_entropy reentry_count volume_above_poc_ratio"),
    ("auc", "atr IS NOT NULL", "atr_5m_24 distance_to_current_poc_vol"),
    ("auc", f"{_PRIOR} AND atr IS NOT NULL", "distance_to_prior_poc_vol distance_to_vah_vol distance_to_val_vol poc_migration_vol value_area_width_vol value_mid_migration_vol"),
    ("auc", _PRIOR, "bar_close_outside_value_ratio profile_overlap_ratio volume_outside_value_ratio"),
    ("auc", "NOT degenerate", "profile_kurtosis profile_skew"),
    ("imsis", "true", "imsi_dist_vwap_pct imsi_neighbor_support imsi_vwrsi_raw"),
    ("imsis", "adjusted IS NOT NULL", "imsi_vwrsi_tod_adjusted"),
    ("imsis", _COVARIANCE, "imsi_covariance_condition_number imsi_covariance_effective_sample_size imsi_covariance_shrinkage_delta"),
    ("imsis", "distance IS NOT NULL", "imsi_mahalanobis_distance"),
    ("imsis", "neighbour_support > 0", "imsi_neighbor_distance_mean imsi_neighbor_distance_p90"),
    ("imsis", "rarity IS NOT NULL", "imsi_state_rarity_percentile"),
    ("icm2", "true", "icm_curvature_per_bar2 icm_fair_value icm_r_ratio icm_sigma_blend icm_sigma_mad icm_sigma_ols icm_slope_per_bar"),
    ("icm2", "blend > 0", "icm_curvature_normalized icm_slope_normalized"),
    ("icm2", f"blend > {_E}", "icm_z_capped icm_z_raw"),
    ("icms", "ready", "icm_z_effective"),
    ("icm2", f"bottom > {_E}", "icm_residual_autocorrelation"),
    ("icms", "NOT list_contains(flags, 'ICM:ICM_LOCAL_SCALE_UNAVAILABLE')", "icm_fair_value_distance_vol"),
    (_RETESTS, "true", "iae_absorption_confirmed iae_close_position_raw iae_close_position_score iae_displacement_efficiency iae_formation_quality iae_gap_age_bars iae_gap_width_atr iae_impulse_body_atr iae_retest_depth_ratio iae_time_decay"),
    (_RETESTS, "score IS NOT NULL", "iae_score_effective iae_score_raw"),
    (_RETESTS, "volume_z IS NOT NULL", "iae_tod_volume_score_input iae_tod_volume_z_raw"),
    (_RETESTS, "wick IS NOT NULL", "iae_wick_rejection_ratio"),
]
_KNOWN = {r[0]: r for r in feature_rows()}
_TAILS["feature_coverage"] = " UNION ALL ".join(
    f"SELECT feature, unit, normalization_family, source_family, n_rows, n_present, 'measured' AS standing FROM (SELECT count(*) AS n_rows, count(*) FILTER ({condition}) AS n_present FROM {step}), (VALUES {_values([_KNOWN[n] for n in names.split()])}) f(feature, unit, normalization_family, source_family)"
    for step, condition, names in _THERE
)
# what the declaration was changed in, by contract where a table is named
_TAILS["run_reconcile"] = """SELECT 'other' AS mode, '6E' AS root, NULL::VARCHAR AS contract_symbol, NULL::VARCHAR AS table_name, 'missing_run' AS fault UNION ALL SELECT 'sparse', '6E', NULL, NULL, 'extra_run' UNION ALL SELECT DISTINCT 'sparse', root, contract_symbol, 'event', 'row_count' FROM cand WHERE root = 'ES'
 UNION ALL SELECT DISTINCT 'sparse', root, contract_symbol, 'icm', 'extra_table' FROM icms WHERE root = 'ES' UNION ALL SELECT DISTINCT 'sparse', root, contract_symbol, 'profile', 'content' FROM finals WHERE root = 'ES'"""
_TAILS["table_constraints"] = " UNION ALL ".join(
    _proved(*x)
    for x in (
        ("fast", "fast", _END), ("medium", "medium", _END), ("finals", "finals", "session_start"), ("auction_state", "auc", _END), ("imsi", "imsis", _END), ("icm", "icms", _END), ("gap_states", "gapbar", _END),
        ("synergy", "syn", _END), ("events", "cand", _END), ("trades", "adm", "exchange_time"), ("pit", "pit", "observation_time"),
    )
)

ORACLE_SQL = {name: _query(tail) for name, tail in _TAILS.items()}
