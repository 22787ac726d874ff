"""Readers of side sources: good rows pass, faults are named."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tapelens.sources import evidence


def test_roll_evidence(spark, tmp_path):
    rows = [
        {"position": 0, "root": "ES", "old_mapped_symbol": None, "new_mapped_symbol": "ESH24", "observed_at_utc": "2023-12-15T12:00:00Z", "effective_at_utc": "2023-12-15T07:00:00-05:00"},
        {"position": 1, "root": "ES", "old_mapped_symbol": "ESH24", "new_mapped_symbol": "ESM24", "observed_at_utc": "2024-03-10T00:00:00", "effective_at_utc": "2024-03-10T00:00:00Z"},
        {"position": 2, "root": "ES", "old_mapped_symbol": "ESH24", "new_mapped_symbol": " ", "observed_at_utc": "2024-03-11T00:00:00Z", "effective_at_utc": "2024-03-11T00:00:00Z"},
        {"position": 3, "root": "ES", "old_mapped_symbol": "ESH24", "new_mapped_symbol": "ESM24", "observed_at_utc": "2022-01-01T00:00:00.5Z", "effective_at_utc": "2024-03-11T00:00:00Z"},
        {"position": 4, "root": "6E", "old_mapped_symbol": "6EH24", "new_mapped_symbol": "6EH24", "observed_at_utc": "2024-03-11T00:00:00Z", "effective_at_utc": "2024-03-11T00:00:00Z"},
    ]
    path = tmp_path / "rolls.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    good, faults = evidence.read_roll_evidence(spark, f"file://{path}")
    assert [(r.new_mapped_symbol, r.observed_at, r.effective_at) for r in good.collect()] == [("ESH24", dt.datetime(2023, 12, 15, 12), dt.datetime(2023, 12, 15, 12))]
    assert sorted(r.fault for r in faults.collect()) == ["blank_field", "clock_not_iso_8601_with_offset", "out_of_order", "symbol_unchanged"]


def test_positions(spark, tmp_path):
    at = dt.datetime(2024, 1, 9, 0, 0)
    rows = spark.createDataFrame([("ES", at, dt.datetime(2024, 7, 12, 15, 30), dt.datetime(2024, 7, 12, 19, 31), 5.0)], "root string, data_time timestamp_ntz, data_end_time timestamp_ntz, delivered_at timestamp_ntz, dealer_long double")
    path = f"file://{tmp_path}/positions"
    rows.write.parquet(path)
    r = evidence.read_positions(spark, path).first()
    assert (r.data_time, r.data_end_time, r.release_date) == (dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 7, 12, 19, 30), dt.date(2024, 7, 12))
    assert r.dealer_long == 5.0 and r.open_interest is None and len(evidence.POSITION_FIELDS) == 15


def test_release_schedule(spark, tmp_path):
    path = tmp_path / "schedule.json"
    path.write_text(json.dumps({"releases": {"2026-01": [5, 9, 16]}, "holiday_delayed_release_dates": ["2026-01-05"]}))
    good, faults = evidence.read_release_schedule(spark, f"file://{path}")
    got = [(r.observation_date, r.release_time, r.holiday_delayed) for r in good.orderBy("release_time").collect()]
    assert got == [(dt.date(2025, 12, 30), dt.datetime(2026, 1, 5, 20, 30), True), (dt.date(2026, 1, 6), dt.datetime(2026, 1, 9, 20, 30), False), (dt.date(2026, 1, 13), dt.datetime(2026, 1, 16, 20, 30), False)]
    assert faults.count() == 0
    rows = [(dt.date(2024, 7, 9), dt.date(2024, 7, 12), None), (dt.date(2024, 7, 9), dt.date(2024, 7, 15), None), (dt.date(2024, 7, 16), dt.date(2024, 7, 12), None), (dt.date(2024, 7, 23), dt.date(2024, 7, 26), dt.datetime(2024, 7, 26, 1))]
    df = spark.createDataFrame(rows, "observation_date date, release_date date, manual_exception timestamp_ntz").withColumn("delayed_dates", F.array().cast("array<date>"))
    assert sorted(r.fault for r in evidence.release_schedule(df)[1].collect()) == ["exception_before_release", "release_before_observation", "two_rows_of_a_date", "two_rows_of_a_date"]
