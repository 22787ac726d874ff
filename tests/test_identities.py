"""Content ids against plain Python's canonical JSON, and the registry of runs."""

import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

from tapelens.functions.ids import number_text
from tapelens.operators import identities, integrity


def canonical(prefix, fields):
    text = json.dumps(fields, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()}"


def clock(t):
    return t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def test_numbers_are_written_as_the_shortest_decimal(spark):
    rng = random.Random(4)
    xs = [0.0, -0.0, 1.0, -1.5, 1e15, 1e16, 9999999999999998.0, 1e-4, 9.999e-5, 1e-5, 2**-44, 1e22, 1e23, 0.1, 123.0, 12345678.9, 9.823471798901492e17, 1.7976931348623157e308, None]
    xs += [rng.uniform(-1e3, 1e3) for _ in range(500)] + [rng.uniform(0, 1) * 10 ** rng.randint(-25, 25) for _ in range(500)]
    rows = spark.createDataFrame([(x, None if x is None else repr(x)) for x in xs], "x double, want string")
    assert rows.filter(~number_text(F.col("x")).eqNullSafe(F.col("want"))).collect() == []


def test_ids_of_states_and_profiles(spark):
    t, rng = dt.datetime(2024, 3, 4, 14, 30, 0, 250), random.Random(6)
    some = lambda: None if rng.random() < 0.3 else rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9)
    names = ["condition", "effective_size", "delta", "vwap_distance", "distance", "neighbour_mean", "neighbour_p90", "session_vwap", "rarity", "vwrsi", "adjusted"]
    named = ["covariance_condition_number", "covariance_effective_sample_size", "covariance_shrinkage_delta", "dist_vwap_pct", "mahalanobis_distance", "neighbor_distance_mean", "neighbor_distance_p90", "session_vwap", "state_rarity_percentile", "vwrsi_raw", "vwrsi_tod_adjusted"]
    rows = [("ES", "ESH24", f"s{i}", t, i % 16, *(some() for _ in names)) for i in range(40)]
    got = spark.createDataFrame(rows, "root string, contract_symbol string, session_id string, end timestamp_ntz, neighbour_support long, " + ", ".join(f"{n} double" for n in names))
    want = {r[2]: canonical("imsi", {"root": r[0], "contract_symbol": r[1], "session_id": r[2], "as_of_utc": clock(t), "neighbor_support": r[4], "version": identities.IMSI_VERSION} | dict(zip(named, r[5:]))) for r in rows}
    assert {r.session_id: r.id for r in got.select("session_id", identities.imsi_id().alias("id")).collect()} == want

    plain = ["curvature_per_bar2", "fair_value_distance_vol", "residual_autocorrelation", "sigma_blend", "slope_per_bar", "z_capped", "z_effective", "z_raw"]
    rows = [("6E", "6EH24", f'a "{i}" \\ é', t, 12, ["B", "A"][: i % 3], *(some() for _ in range(11))) for i in range(20)]
    got = spark.createDataFrame(rows, "root string, contract_symbol string, session_id string, end timestamp_ntz, window_size int, quality_flags array<string>, beta0 double, beta1 double, beta2 double, " + ", ".join(f"{n} double" for n in plain))
    want = {r[2]: canonical("icm", {"root": r[0], "contract_symbol": r[1], "session_id": r[2], "as_of_utc": clock(t), "window_size": 12, "quality_flags": r[5], "coefficients": list(r[6:9]), "version": identities.ICM_VERSION} | dict(zip(plain, r[9:]))) for r in rows}
    assert {r.session_id: r.id for r in got.select("session_id", identities.icm_id().alias("id")).collect()} == want

    rows = [("ES", "ESH24", "s", t, None, 401, 0.25, 399, 402, [(399, 2.0), (400, 10.5), (402, 1e-5)])]
    got = spark.createDataFrame(rows, "root string, contract_symbol string, session_id string, as_of timestamp_ntz, available_at timestamp_ntz, current_price_tick long, minimum_tick double, val_tick long, vah_tick long, histogram array<struct<tick:long,volume:double>>")
    fields = {"root": "ES", "contract_symbol": "ESH24", "session_id": "s", "as_of_utc": clock(t), "available_at_utc": None, "current_price_tick": 401, "definition_version": identities.PROFILE_VERSION, "profile_kind": "final_session", "tick_size": 0.25, "value_area": [399, 402], "volume_by_tick": [[399, 2.0], [400, 10.5], [402, 1e-05]]}
    assert got.select(identities.profile_id("final_session")).first()[0] == canonical("profile", fields)


REGISTRY = "mode string, root string, contract_symbol string, table_name string, n_rows long, fingerprint string"


def test_runs_are_reconciled(spark):
    run = [("deep", "ES", "ESH24", "event", 5, "a"), ("deep", "ES", "ESH24", "imsi", 9, "b"), ("deep", "ZN", "ZNH24", "event", 1, "c"), ("smoke", "ES", "ESH24", "event", 2, "d"), ("deep", "6E", "6EH24", "event", 3, "e")]
    declared = [("deep", "ES", "ESH24", "event", 5, "x"), ("deep", "ES", "ESH24", "imsi", 8, "b"), ("deep", "ES", "ESH24", "icm", 8, "b"), ("smoke", "ES", "ESH24", "event", 2, "d"), ("deep", "NQ", "NQH24", "event", 1, "f"), ("deep", "6E", "6EH24", "event", 3, "e")]
    a, b = (spark.createDataFrame(x, REGISTRY) for x in (run, declared))
    got = {(r.mode, r.root, r.table_name, r.fault) for r in integrity.reconcile_runs(a, b).collect()}
    assert got == {("deep", "NQ", None, "missing_run"), ("deep", "ZN", None, "extra_run"), ("deep", "ES", "event", "content"), ("deep", "ES", "imsi", "row_count"), ("deep", "ES", "icm", "missing_table")}
    assert integrity.reconcile_runs(a, a).count() == 0
    whole = {r.root: r.fingerprint for r in integrity.root_fingerprints(a.filter("mode = 'deep'")).collect()}
    other = {r.root: r.fingerprint for r in integrity.root_fingerprints(spark.createDataFrame(reversed(declared), REGISTRY).filter("mode = 'deep'")).collect()}
    assert whole["6E"] == other["6E"] and whole["ES"] != other["ES"]
