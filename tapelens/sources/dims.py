"""Small dimensions: session windows, closures, markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK, CHICAGO = "America/New_York", "America/Chicago"
POLICY_VERSION = "lift1-semantic-v1"
#: Roots, zone and windows as (name, type, start, end) in hours of the exchange's day; a window that ends first crosses midnight.
_WINDOWS = (
    (("ES", "NQ", "RTY"), NEW_YORK, (("eth_overnight", "eth", 18, 9.5), ("rth", "rth", 9.5, 16), ("eth_afternoon", "eth", 16, 17), ("maintenance", "maintenance", 17, 18))),
    (("ZT", "ZN"), CHICAGO, (("eth_overnight", "eth", 17, 22 / 3), ("us_cash_hours", "us_cash_hours", 22 / 3, 14), ("eth_afternoon", "eth", 14, 16), ("maintenance", "maintenance", 16, 17))),
    (("6E", "6J", "6B"), CHICAGO, (("asia", "asia", 17, 2), ("london", "london", 2, 7), ("new_york", "new_york", 7, 16), ("maintenance", "maintenance", 16, 17))),
)
#: Asset class, tick size and multiplier by root.
_MARKETS = {
    "ES": ("equity_index", 0.25, 50.0), "NQ": ("equity_index", 0.25, 20.0), "RTY": ("equity_index", 0.1, 50.0), "ZT": ("treasury", 0.00390625, 2000.0),
    "ZN": ("treasury", 0.015625, 1000.0), "6E": ("currency", 0.00005, 125000.0), "6J": ("currency", 0.0000005, 12500000.0), "6B": ("currency", 0.0001, 62500.0),
}


def session_rows() -> list[tuple]:
    """(root, session_name, session_type, zone, start_sec, end_sec, crosses_midnight, policy_version) of all roots."""
    return [
        (root, f"{root.lower()}_{name}", kind, zone, round(start * 3600), round(end * 3600), end < start, POLICY_VERSION)
        for roots, zone, windows in _WINDOWS
        for root in roots
        for name, kind, start, end in windows
    ]


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table that lives in the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(r, kinds, names, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def session_windows(spark: SparkSession) -> DataFrame:
    return _values(spark, session_rows(), "root string, session_name string, session_type string, zone string, start_sec int, end_sec int, crosses_midnight boolean, policy_version string")


def market_rows() -> list[tuple]:
    """(root, asset_class, minimum_tick, multiplier, zone) of all roots."""
    return [(root, *x, NEW_YORK if x[0] == "equity_index" else CHICAGO) for root, x in _MARKETS.items()]


def markets(spark: SparkSession) -> DataFrame:
    return _values(spark, market_rows(), "root string, asset_class string, minimum_tick double, multiplier double, zone string")


#: Closures of the test calendar: an early close on 15 January 2024 and a full holiday on 1 January 2024.
CLOSURE_ROWS = [
    ("ES", "holiday_2024_01_01", "2024-01-01", "all_day", 0, 86400, True, "calendar-v1"),
    ("ES", "early_2024_01_15", "2024-01-15", "early_close", 46800, 64800, False, "calendar-v1"),
    ("6E", "early_2024_01_15", "2024-01-15", "early_close", 57600, 61200, False, "calendar-v1"),
]


def closures(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(root, exception_name, local_date, closure_name, start_sec, end_sec, all_day, calendar_version)."""
    return _values(spark, CLOSURE_ROWS if rows is None else rows, "root string, exception_name string, local_date date, closure_name string, start_sec int, end_sec int, all_day boolean, calendar_version string")
