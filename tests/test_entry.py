"""The driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tapelens import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["trade_admission", "bars_fast", "value_area", "transition_counters", "gap_lifecycle", "pit_normalize", "roll_state"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in ("events", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"}).to_numpy()))
    assert [tuple(x.replace(".0", "") for x in r) for r in key(got)] == [tuple(x.replace(".0", "") for x in r) for r in key(want)]
