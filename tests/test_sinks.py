"""Sinks: partitions that stay, batches that come twice or are killed, rules counted while rows are written."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tapelens.operators import constraints
from tapelens.sinks import batch_sink, publish, write_table

BAR = (
    "root string, contract_symbol string, session_id string, session_type string, session_start timestamp_ntz, session_end timestamp_ntz, start timestamp_ntz, end timestamp_ntz, available_at timestamp_ntz, "
    "open double, high double, low double, close double, volume double, n_trades long, period_minutes int"
)


def bar(root, minute, high=11.0):
    t = dt.datetime(2024, 3, 4, 10, minute)
    five = dt.timedelta(minutes=5)
    return (root, root + "H24", "s", "rth", dt.datetime(2024, 3, 4, 9, 30), dt.datetime(2024, 3, 4, 16), t, t + five, t + five, 10.0, high, 9.0, 10.5, 3.0, 2, 5)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.createDataFrame([bar("ES", 0), bar("6E", 0)], BAR), path)
    before = files(path)
    write_table(spark.createDataFrame([bar("ES", 5), bar("ES", 10)], BAR), path)
    after = files(path)
    assert {f for f in before if "root=6E" in f} == {f for f in after if "root=6E" in f} and all(after[f] == t for f, t in before.items() if "root=6E" in f)
    assert sorted((r.root, r.start.minute) for r in spark.read.parquet(path).collect()) == [("6E", 0), ("ES", 5), ("ES", 10)]


def test_publishing_counts_what_breaks_the_rules(spark, tmp_path):
    rows = spark.createDataFrame([bar("ES", 0), bar("ES", 5, high=10.2), bar("6E", 0)], BAR)
    report = {(t, rule): (n, of) for t, rule, n, of in publish({"fast": rows}, str(tmp_path))}
    assert report[("fast", "close_in_range")] == (1, 3) and sum(n for n, _ in report.values()) == 1
    assert {r.rule: r.violations for r in constraints.check(rows, "fast").collect()} == {rule: n for (_, rule), (n, _) in report.items()}
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/reports/constraints/*.json") for x in open(f)]
    assert {(x["table_name"], x["rule"]): (x["violations"], x["n_rows"]) for x in lines} == report
    assert [(r.start.minute, r.broken) for r in constraints.faulty(rows, "fast").collect()] == [(5, ["close_in_range"])]


def test_every_rule_of_bars_finds_its_planted_fault(spark):
    rows = spark.createDataFrame([bar(r, m) for r in ("ES", "6E") for m in (0, 5)], BAR)
    rows = rows.unionByName(rows.withColumns({c: F.col(c) + F.expr("interval 1 day") for c in ("session_start", "session_end", "start", "end", "available_at")}))
    proof = constraints.prove(rows, "fast", "end").collect()
    assert len(proof) == len(constraints.RULES["fast"]) and all(r.planted == r.caught and r.violations == 0 for r in proof) and sum(r.planted for r in proof) > 0


def test_a_rule_that_cannot_be_decided_is_broken(spark):
    rows = spark.createDataFrame([bar("ES", 0)], BAR).withColumn("available_at", F.lit(None).cast("timestamp_ntz"))
    assert {r.rule for r in constraints.check(rows, "fast").collect() if r.violations} == {"end_by_available_at"}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path, sink = str(tmp_path / "b"), batch_sink(str(tmp_path / "b"))
    first, second = (spark.createDataFrame([bar(r, m) for r in ("ES", "6E")], BAR) for m in (0, 5))
    sink(first, 0)
    sink(second, 1)
    before = files(path)
    whole = sorted(map(str, spark.read.parquet(path).collect()))
    sink(second, 1)
    assert sorted(map(str, spark.read.parquet(path).collect())) == whole
    assert all(f in files(path) for f in before if "batch_id=0" in f)

    # a batch that is killed half way leaves nothing to be read
    dying = second.repartition(2, "root").withColumn("volume", F.when(F.col("root") == "6E", F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("volume")))
    with pytest.raises(Exception, match="killed"):
        sink(dying, 2)
    assert sorted(map(str, spark.read.parquet(path).collect())) == whole
    sink(first, 2)
    assert spark.read.parquet(path).count() == 6


def test_a_stream_into_the_batch_sink(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [bar("ES", m) for m in range(0, 20, 5)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, BAR).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start finds the checkpoint and writes nothing new
        q = stream.writeStream.foreachBatch(batch_sink(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.start.minute for r in spark.read.parquet(path).collect()) == [0, 5, 10, 15]
