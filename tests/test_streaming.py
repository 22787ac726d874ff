"""The streaming forms give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from tapelens.operators.admission import admit_ordered
from tapelens.operators.bars import bars
from tapelens.operators.sessions import with_session
from tapelens.operators import profiles
from tapelens.streaming.live import live_bars, live_gate, live_rejects, live_rolling
from tests.test_measurement import frame, trade


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_live_bars_equal_batch_bars(spark, tmp_path):
    rows = [trade(i, 47 * i, 100 + (i * 7 % 9) / 4, i % 4, event=f"e{i // 2 if i % 10 == 1 else i + 500}", root="ES" if i % 3 else "6E") for i in range(240)]
    path = str(tmp_path / "tape")
    for part in range(3):  # files arrive in order
        frame(spark, rows[part * 80 : part * 80 + 80]).coalesce(1).write.mode("append").parquet(path)
        __import__("time").sleep(1.1)
    stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = run(live_bars(stream, (5,)), "live_bars", tmp_path)
    columns = ["root", "session_id", "start", "end", "available_at", "open", "high", "low", "close", "volume", "n_trades"]
    want = bars(admit_ordered(with_session(frame(spark, rows))), 5).select(columns)
    got = live.filter("period_minutes = 5").select(columns)
    assert want.count() > 20
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def streamed(spark, rows, path, parts=3):
    n = -(-len(rows) // parts)
    for part in range(parts):  # files arrive in order
        frame(spark, rows[part * n : part * n + n]).coalesce(1).write.mode("append").parquet(path)
        __import__("time").sleep(1.1)
    return spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_side_rows_and_rolling_profiles_equal_batch(spark, tmp_path):
    rows = [(*trade(i, 47 * i, 100 + (i * 7 % 9) / 4, i % 4, event=f"e{i // 2 if i % 10 == 1 else i + 500}")[:8], i if i % 13 else i - 1, [], "TRADE", i) for i in range(1, 240)]
    trades = admit_ordered(with_session(frame(spark, rows)))
    got = run(live_rejects(streamed(spark, rows, str(tmp_path / "a"))), "live_rejects", tmp_path).select("arrival", "reject_flag")
    want = trades.filter("not admitted").select("arrival", "reject_flag")
    assert {r.reject_flag for r in want.collect()} >= {"DATA:NON_POSITIVE_QUANTITY", "DATA:DUPLICATE_SOURCE_SEQUENCE"}
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    live = run(live_rolling(streamed(spark, rows, str(tmp_path / "b")), (30, 60), 5), "live_rolling", tmp_path)
    whole = bars(trades, 5)
    for n in (30, 60):
        want = profiles.rolling(profiles.minute_bins(trades), whole, n, 5).select("session_id", "end", "tick", "volume")
        got = live.filter(F.col("minutes") == n).select("session_id", "end", "tick", "volume")
        assert want.count() > 50 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_bars_end_with_the_stream(spark, tmp_path):
    first = [trade(i, 60 * i, 100) for i in range(8)]
    later = [trade(100 + i, 7200 + 600 * i, 50, root="6E") for i in range(3)]
    stream = streamed(spark, [*first, *later], str(tmp_path / "c"), 4)
    got = run(live_bars(stream, (5,), finalize_after="1 minute"), "live_ends", tmp_path).filter("root = 'ES'").orderBy("end").collect()
    assert [(b.end - dt.datetime(2024, 3, 4, 14, 30)).seconds // 60 for b in got] == [5, 10]
    assert got[1].n_trades == 3 and got[1].available_at >= got[1].end


def test_live_gate_holds_until_the_clock(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 12, m)
    schema = "lineage_hash string, usable_from timestamp, event_clock timestamp"
    path = str(tmp_path / "pit")
    batches = [[("a", t(5), t(0)), ("b", t(20), t(0))], [("c", t(30), t(10))], [("d", t(40), t(15))], [("e", t(50), t(16))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        __import__("time").sleep(1.1)
    stream = spark.readStream.schema(spark.createDataFrame(batches[0], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = [r.lineage_hash for r in run(live_gate(stream), "live_gate", tmp_path).select(F.col("lineage_hash")).collect()]
    assert got == ["a"]


def long_tape(days, seed=5):
    """Trades of two roots over several sessions, with repeats, bad quantities, odd prices and breaks; the mapping of ES changes once."""
    import random

    rng, rows, n = random.Random(seed), [], 0
    for root in ("ES", "6E"):
        price = 100.0
        for day in days:
            at = 0
            while at < 6 * 3600:
                at += rng.choice([40, 90, 200, 1500 if rng.random() < 0.05 else 60])
                price = max(50.0, price + rng.choice([-1, -0.5, -0.25, 0, 0.25, 0.5, 1]) * (4 if rng.random() < 0.08 else 1))
                odd = rng.random()
                event = f"{root}-{n - 1}" if odd < 0.01 and day == days[-1] else f"{root}-{n}"
                rows.append((root, day * 86400 + at, price + (0.1 if odd > 0.995 else 0), 0 if 0.98 < odd < 0.985 else rng.randint(1, 5), event))
                n += 1
    rows.sort(key=lambda r: r[1])
    return [trade(i, at, price, quantity, event=event, root=root) for i, (root, at, price, quantity, event) in enumerate(rows)]


def test_live_measures_equal_batch_and_state_stays_small(spark, tmp_path):
    import dataclasses

    from tapelens.plans.measurement import Measurement
    from tapelens.policy import SPARSE
    from tapelens.streaming.live import live_measures

    policy = dataclasses.replace(SPARSE, fast=15, tod_min=3, tod_sessions=4)
    rows = long_tape([0, 1, 2, 3, 4, 7, 8, 9, 10, 11])
    tape = frame(spark, rows)
    mappings = spark.createDataFrame(
        [("ES", None, "ESH24", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), ("6E", None, "6EH24", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))],
        "root string, old_mapped_symbol string, new_mapped_symbol string, observed_at timestamp_ntz, effective_at timestamp_ntz",
    )
    symbols = {r.contract_symbol for r in tape.select("contract_symbol").distinct().collect()}
    assert symbols <= {"ESH24", "6EH24"}
    stream = streamed(spark, rows, str(tmp_path / "m"), 5)
    q = live_measures(stream, mappings, policy).writeStream.format("memory").queryName("live_measures").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    got = spark.table("live_measures")
    batch = Measurement(tape, mappings, policy, ordered=True, stored=True)
    flat = lambda c: F.array_join(c, ",").alias(c)
    auction = ["root", "session_id", "end", "available_at", "location", "measurement_ready", flat("quality_flags")]
    want = batch.auction_state.select(auction)
    assert want.filter("measurement_ready").count() > 20 and want.select("location").distinct().count() >= 4
    live = got.select(auction)
    assert live.exceptAll(want).count() == 0 and want.exceptAll(live).count() == 0
    gap = ["root", "session_id", "end", F.col("gap_idx").cast("long").alias("gap_idx"), "gap_event", "direction", F.col("active_gaps").cast("long").alias("active_gaps")]
    want = batch.gap_states.join(batch.fast.select("root", "end"), ["root", "end"], "left_semi").select(*gap, flat("quality_flags"))
    assert {"tested", "invalidated", "expired"} & {r.gap_event for r in want.collect()}
    live = got.select(*gap, F.array_join("gap_flags", ",").alias("quality_flags"))
    assert live.exceptAll(want).count() == 0 and want.exceptAll(live).count() == 0
    assert len(sizes) == 5 and sizes[-1] < 2 * sizes[0], sizes


def test_the_value_area_in_plain_python_is_that_of_the_batch(spark):
    import random

    from tapelens.streaming.live import profile

    rng = random.Random(2)
    made = [{rng.choice([rng.randint(0, 12), rng.randint(0, 400)]): float(rng.randint(1, 6)) for _ in range(rng.randint(1, 14))} for _ in range(60)]
    rows = spark.createDataFrame([(i, t, v) for i, h in enumerate(made) for t, v in h.items()], "n int, tick long, volume double")
    for r in profiles.profiles(rows, ["n"]).collect():
        assert profile(made[r.n], 0.70) == (r.poc_tick, r.val_tick, r.vah_tick, r.degenerate)
