"""Sites of many vehicles at once against vehicle by vehicle, and without working the sessions out twice."""

import time

import numpy as np
import pyarrow as pa

from tripspark.operators import charging
from tripspark.operators.helpers import whole_tables

SCHEMA = "vehicle_id string, session_no bigint, session_id string, start_s double, lat double, lng double, tags array<string>"


def test_groups_equal_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [1, 700, 3, 40, 0, 40, 2, 90, 1]
    starts = np.cumsum([0, *sizes[:-1]])
    keep = np.array(sizes) > 0
    n = sum(sizes)
    lat, lng = 37 + 1e-2 * rng.random(n), -122 + 1e-2 * rng.random(n)
    lat[rng.random(n) < 0.1], lng[rng.random(n) < 0.1] = np.nan, np.nan
    lat[:1] = np.nan
    want = np.concatenate([charging.greedy_clusters(lat[a : a + k], lng[a : a + k], 150.0) for a, k in zip(starts, sizes)])
    for cells in (1, 300, 10**6):
        monkeypatch.setattr(charging, "CENTRES", cells)
        assert (charging.greedy_groups(lat, lng, starts[keep], 150.0) == want).all()
    assert want.max() > 20


def test_small_vehicles_cost_no_call_each():
    """Session by session this took some 20 s."""
    n = 200_000
    rng = np.random.default_rng(4)
    began = time.time()
    c = charging.greedy_groups(37 + 1e-2 * rng.integers(0, 7, n), np.full(n, -122.0), np.arange(0, n, 10), 150.0)
    assert c.max() == 6 and time.time() - began < 4


def test_groups_span_batches_and_null_keys():
    keys = [None, None, "a", "a", "a", "b", "c", "c", "c", "c"]
    for width in (1, 2, 3, 10):
        rows = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + width], pa.string()), "i": list(range(i, min(len(keys), i + width)))}) for i in range(0, len(keys), width)]
        got = [(t["k"].to_pylist()[a:b], t["i"].to_pylist()[a:b]) for t, at in whole_tables(iter(rows), "k") for a, b in zip(at, [*at[1:], t.num_rows])]
        assert got == [([None] * 2, [0, 1]), (["a"] * 3, [2, 3, 4]), (["b"], [5]), (["c"] * 4, [6, 7, 8, 9])]


def test_sessions_pass_through_once(spark):
    rows = [("v", 1, "one", 1.0, 37.0, -122.0, ["x"]), ("v", 2, "two", 2.0, None, -122.0, []), ("v", 3, "three", 3.0, 37.0001, -122.0, None), ("w", 1, "one", 0.0, 37.0, -122.0, ["y", None])]
    out = charging.charging_sites(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.vehicle_id, r.session_no, r.site_id, r.tags) for r in out.collect()) == [
        ("v", 1, "site-one", ["x"]), ("v", 2, "unknown", []), ("v", 3, "site-one", None), ("w", 1, "site-one", ["y", None])]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
