"""Readers of tapes with bad rows: every row in is kept or rejected, batch and stream."""

import json

from pyspark.sql import functions as F

from tapelens.sources import tape
from tests.test_measurement import frame, trade

GOOD = {"root": "ES", "contract_symbol": "ESH24", "exchange_time": "2024-03-04T14:30:00", "available_at": "2024-03-04T14:30:01", "price": 100.25, "quantity": 2.0, "minimum_tick": 0.25, "tick_type": "TRADE", "source_flags": []}


def lines(start):
    rows = [json.dumps(GOOD | {"arrival": start + i}) for i in range(3)]
    late = json.dumps(GOOD | {"arrival": start + 3, "available_at": "2024-03-04T14:29:59"})
    bare = json.dumps({k: v for k, v in GOOD.items() if k != "price"} | {"arrival": start + 4})
    odd = json.dumps(GOOD | {"arrival": start + 5, "price": "a word"})
    return [*rows, late, bare, '{"root": "ES", "contract', odd]


def test_json_tape_with_bad_rows(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(lines(0)))
    rows = tape.read_tape(spark, str(tmp_path / "t.json"), "json")
    assert [r.arrival for r in tape.kept(rows).orderBy("arrival").collect()] == [0, 1, 2]
    assert set(tape.kept(rows).columns) == {c.split()[0] for c in tape.SCHEMA.split(", ")}
    assert sorted(r.fault for r in tape.rejects(rows).collect()) == ["corrupt", "corrupt", "known_late", "missing:price"]
    assert {r.corrupt_record for r in tape.rejects(rows).filter("fault = 'corrupt'").collect()} >= {'{"root": "ES", "contract'}
    assert sum(r.n for r in tape.reject_counts(rows).collect()) == 7


def test_parquet_tape(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = frame(spark, [trade(i, i, 100, lag=-1 if i == 2 else 1) for i in range(5)]).withColumn("quantity", F.when(F.col("arrival") != 3, F.col("quantity")))
    rows.drop("source_sequence").write.parquet(path)  # a file that lacks a column which may be null
    judged = tape.read_tape(spark, path)
    assert {r.arrival: r.fault for r in judged.collect()} == {0: None, 1: None, 2: "known_late", 3: "missing:quantity", 4: None}
    assert tape.read_trades(spark, path).count() == 3 and tape.rejects(judged).count() == 2


def test_stream_divides_its_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(2):
        (source / f"{n}.json").write_text("\n".join(lines(10 * n)))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for _ in range(2):
        stream = tape.read_tape_stream(spark, str(source), "json", 1)
        stream.writeStream.foreachBatch(tape.dividing_sink(good, bad)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.arrival for r in spark.read.parquet(good).collect()) == [0, 1, 2, 10, 11, 12]
    assert spark.read.parquet(bad).groupBy("fault").count().count() == 3 and spark.read.parquet(bad).count() == 8
