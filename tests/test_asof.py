"""As-of joins: both forms against a plain search, on dimensions of any density."""

import bisect
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tapelens.operators.asof import asof, asof_dimension

T0 = dt.datetime(2024, 1, 1)


def searched(left, right):
    out = {}
    for i, k, t in left:
        times = sorted((a, v) for key, a, v in right if key == k)
        place = bisect.bisect_right([a for a, _ in times], t) if t is not None else 0
        out[i] = times[place - 1][1] if place else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_both_forms_equal_a_search(spark, seed):
    rng = random.Random(seed)
    # a few rows far apart, many close together, and keys with one row or none
    times = {"a": [rng.randint(0, 10_000) for _ in range(60)], "b": [0, 5, 9_000_000], "c": [77]}
    right = [(k, T0 + dt.timedelta(seconds=s), f"{k}{n}") for k, ss in times.items() for n, s in enumerate(sorted(set(ss)))]
    left = [(i, rng.choice(["a", "a", "b", "c", "d", None]), rng.choice([None, *[T0 + dt.timedelta(seconds=rng.choice([rng.randint(-50, 11_000), rng.randint(0, 10_000_000), 5, 77]))] * 9])) for i in range(400)]
    a = spark.createDataFrame(left, "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame(right, "k string, since timestamp_ntz, v string")
    want = searched(left, right)
    got = asof_dimension(a, b, ["k"], "t", "since", ["v"])
    assert set(got.columns) == {"i", "k", "t", "hit"} and {r.i: r.hit and r.hit.v for r in got.collect()} == want
    known = a.filter("t is not null")
    assert {r.i: r.hit and r.hit.v for r in asof(known, b, ["k"], "t", "since", ["v"]).collect()} == {i: v for i, v in want.items() if left[i][2] is not None}


def test_an_empty_dimension(spark):
    a = spark.createDataFrame([(1, "a", T0)], "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame([], "k string, since timestamp_ntz, v string")
    assert [r.hit for r in asof_dimension(a, b, ["k"], "t", "since", ["v"]).collect()] == [None]


def test_many_snapshots_cost_no_more_than_few(spark):
    ticks = spark.range(200_000).select(F.lit("ES").alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 86400)").alias("t"))

    def took(n):
        rows = spark.range(n).select(F.lit("ES").alias("k"), F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 86400 / {n})").alias("since"), F.col("id").alias("v"))
        best = 1e9
        for _ in range(3):
            t = time.time()
            asof_dimension(ticks, rows, ["k"], "t", "since", ["v"]).agg(F.sum("hit.v")).collect()
            best = min(best, time.time() - t)
        return best

    # a scan of all snapshots for each tick would be a thousand times as much work
    assert took(50_000) < 10 * took(50) + 2
