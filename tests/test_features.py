"""The feature dictionary and the long form of snapshot tables."""

import datetime as dt

from pyspark.sql import functions as F

from tapelens.operators import features
from tapelens.sources.features import feature_dictionary, feature_rows


def test_dictionary_is_sorted_and_unique(spark):
    names = [r[0] for r in feature_rows()]
    assert names == sorted(set(names)) and all(len(r) == 4 for r in feature_rows())
    assert feature_dictionary(spark).count() == len(names)


def test_melt_and_coverage(spark):
    t = dt.datetime(2024, 3, 4, 15)
    schema = "root string, contract_symbol string, session_id string, end timestamp_ntz, open double, distance double, rarity double, own struct<width:double,seen:boolean,name:string>, measurement_ready boolean, quality_flags array<string>"
    rows = [("ES", "ESH24", "s", t, 1.0, 2.0, None, (0.5, True, "x"), True, ["ROLL:NORMAL", "WARMUP"]), ("ES", "ESH24", "s", t, 1.0, float("nan"), None, (None, None, "x"), False, ["ROLL:NORMAL"])]
    long = features.melt(spark.createDataFrame(rows, schema), "imsi")
    got = {(r.feature, r.value, r.missing_reason) for r in long.collect()}
    assert got == {
        ("imsi_mahalanobis_distance", 2.0, None), ("imsi_state_rarity_percentile", None, "WARMUP"), ("imsi_own_width", 0.5, None), ("imsi_own_seen", 1.0, None),
        ("imsi_mahalanobis_distance", None, "unexplained"), ("imsi_state_rarity_percentile", None, "unexplained"), ("imsi_own_width", None, "unexplained"), ("imsi_own_seen", None, "unexplained"),
    }
    found = {r.feature: r for r in features.coverage([long], feature_dictionary(spark)).collect()}
    assert (found["imsi_mahalanobis_distance"].n_rows, found["imsi_mahalanobis_distance"].n_present, found["imsi_mahalanobis_distance"].standing) == (2, 1, "measured")
    assert found["imsi_own_width"].standing == "unknown" and found["icm_z_raw"].standing == "unmeasured" and found["icm_z_raw"].n_rows == 0
    assert len(found) == len(feature_rows()) + 2 and long.filter(F.col("feature") == "open").count() == 0
