"""Helpers that take many short drives at once give what they give one by one."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tripspark.operators import charging, endpoints, helpers
from tripspark.operators import points as P
from tripspark.plans.import_queries import fine_points
from helpers import SF


def test_groups_are_whole_whatever_the_batches():
    rng = np.random.default_rng(1)
    keys = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    pdf = pd.DataFrame({"a": keys // 7, "b": keys, "x": np.arange(len(keys))})
    for size in (1, 2, 5, 50, 500):
        batches = [pdf.iloc[k : k + size] for k in range(0, len(pdf), size)] + [pdf.iloc[:0]]
        got = []
        for cols, starts in helpers.whole_groups(iter(batches), ["a", "b"]):
            rows = [at for at in helpers.by_length(starts, len(cols["x"]))]
            assert sorted(np.concatenate([at.ravel() for at in rows])) == list(range(len(cols["x"])))
            got += [cols["x"][r].tolist() for at in rows for r in at]
        assert sorted(got) == [g["x"].tolist() for _, g in pdf.groupby("b")]


def test_headings_of_many_drives_equal_those_of_each():
    rng = np.random.default_rng(2)
    for n in (2, 3, 9, 80):
        lat, lng = 50 + np.cumsum(rng.normal(0, 2e-5, (30, n)), axis=1), 8 + np.cumsum(rng.normal(0, 2e-5, (30, n)), axis=1)
        speed = np.where(rng.random((30, n)) < 0.3, np.nan, rng.choice([0.0, 0.2, 9.0], (30, n)))
        gear = np.where(np.arange(30)[:, None] % 3 == 0, np.nan, np.cumsum(rng.random((30, n)) < 0.1, axis=1) % 3.0)
        told = endpoints.local_headings(lat, lng, speed, gear, 6)
        one = [endpoints.local_headings(lat[k], lng[k], speed[k], None if k % 3 == 0 else gear[k], 6) for k in range(30)]
        np.testing.assert_array_equal(told, one)
        np.testing.assert_array_equal(endpoints.carried_headings(told, 6), [endpoints.carried_headings(x, 6) for x in told])


def test_ends_of_drives_need_one_shuffle(spark):
    points = fine_points(spark, SF).where("(vehicle_id + idx) % 9 <> 0")
    snapped = endpoints.endpoint_snap(points)
    assert snapped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    through = endpoints.snap_ends(endpoints.endpoint_window(points))
    rows = [sorted(map(repr, df.collect())) for df in (snapped, through)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 * points.select("vehicle_id", "drive_id").distinct().count()
    assert snapped.where("stationary").count() > 100


def test_windows_of_ends(spark):
    """30 s from the first and from the last point, up to the first point that is not."""
    rows = [(1, d, i, float(i), 0.0, 1000 * t, 1, 1.0) for d, times in ((0, [0, 10, 20, 50, 25, 60]), (1, [5])) for i, t in enumerate(times)]
    points = spark.createDataFrame(rows, "vehicle_id bigint, drive_id bigint, idx bigint, lat double, lng double, t_ms bigint, gear int, speed double")
    got = endpoints.endpoint_window(points).groupBy("drive_id", "which").agg(F.sort_array(F.collect_list(F.struct("k", "idx"))).alias("p")).collect()
    assert {(r.drive_id, r.which): [x.idx for x in r.p] for r in got} == {(0, "start"): [0, 1, 2], (0, "end"): [5], (1, "start"): [0], (1, "end"): [0]}


def test_jumps_of_many_drives_equal_those_of_each(spark):
    """Against the pass point by point."""
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for d in range(120):
        n = int(rng.integers(1, 9))
        lat = 50 + np.where(rng.random(n) < 0.4, rng.integers(1, 4, n) * 0.1, 0.0)
        keep, after = [], None
        for i in range(n - 1, -1, -1):
            before = abs(lat[i] - lat[i - 1]) > 0.05 if i else None
            ahead = abs(lat[i] - lat[after]) > 0.05 if after is not None else None
            if not ((before and ahead) or (i == 0 and ahead) or (after is None and before)):
                keep.append(i)
                after = i
        want |= {(d % 7, d, i) for i in keep}
        rows += [(d % 7, d, i, float(x), 8.0, f"p{i}") for i, x in enumerate(lat)]
    points = spark.createDataFrame(rows, "vehicle_id bigint, drive_id bigint, idx bigint, lat double, lng double, name string")
    kept = P.jump_filter(points)
    got = [(r.vehicle_id, r.drive_id, r.idx) for r in kept.collect()]
    assert set(got) == want and len(got) == len(want) < len(rows) and all(r.name == f"p{r.idx}" for r in kept.collect())
    assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().executedPlan().toString()  # a call for each drive


def test_sites_take_no_call_for_each_vehicle(spark):
    rows = [(v, k, f"v{v}s{k}", float(k), None if k == 2 else 50.0 + (k % 2) * 0.01, 8.0) for v in range(30) for k in range(5)]
    sessions = spark.createDataFrame(rows, "vehicle_id bigint, session_no bigint, session_id string, start_s double, lat double, lng double")
    out = charging.charging_sites(sessions)
    assert {(r.vehicle_id, r.session_no): r.site_id for r in out.collect()} == {(v, k): "unknown" if k == 2 else f"site-v{v}s{k % 2}" for v in range(30) for k in range(5)}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
