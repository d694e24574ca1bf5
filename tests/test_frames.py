"""Clips from frames, frame by frame, with gaps, missing values and clips of any length."""

import math
import random

import pyarrow as pa

from tripspark.operators import points
from tripspark.operators.helpers import changes

SCHEMA = "vehicle_id string, seq bigint, i bigint, lat double, lng double, gear bigint, ap bigint, speed double, accel double, flags bigint"


def rounded(x, k):
    return None if x is None else (math.floor(x * k) + (x * k - math.floor(x * k) >= 0.5)) / k


def loop(frames):
    """frames of one clip: (i, lat, lng, gear, ap, speed, accel, flags)."""
    pts, gears, aps, flags, n, park, last = [], [], [], [], 0, 0, None
    for _, lat, lng, gear, ap, speed, accel, flag in sorted(frames, key=lambda f: f[0]):
        if lat is None or lng is None or lat != lat or lng != lng or (lat == 0 and lng == 0) or abs(lat) > 90 or abs(lng) > 180:
            continue
        n, park, speed = n + 1, park + (gear == 0), rounded(speed, 10.0)
        at = (rounded(lat, 1e6), rounded(lng, 1e6))
        if at != last:
            pts.append((list(at), gear, ap, speed, rounded(accel, 100.0)))
            last = at
        for runs, value in ((gears, gear), (aps, ap), (flags, flag)):
            if runs and runs[-1][0] == value:
                runs[-1][1] += 1.0
            else:
                runs.append([value, 1.0, None])
        flags[-1][2] = flags[-1][2] if speed is None else max(flags[-1][2] or 0.0, abs(speed))
    lists = [list(x) for x in zip(*pts)]
    return (n, park, *lists, [tuple(r[:2]) for r in gears], [tuple(r[:2]) for r in aps], [(*r[:2], rounded(r[2], 10.0)) for r in flags])


def clips(rng, vehicles):
    out = {}
    for v in vehicles:
        for seq in range(rng.randint(1, 4)):
            n, lat, gear, ap, flag = rng.choice([1, 2, 40, 300]), 37.0, 1, 0, 0
            own = []
            for i in range(n):
                lat += rng.choice([0, 0, 1e-5, 3e-7])
                gear, ap, flag = (rng.choice([x, x, x, 0, 1, 2, None]) for x in (gear, ap, flag))
                bad = rng.choice([None] * 8 + [(None, 1.0), (math.nan, 1.0), (0.0, 0.0), (91.0, 1.0)])
                own.append((i, *(bad or (lat, -122.0)), gear, ap, rng.choice([None, -3.26, 4.04, 7.25]), rng.choice([None, 0.0, 0.125, 0.5]), flag))
            out[v, seq] = own
    return out


def test_clips_equal_a_loop(spark):
    rng = random.Random(5)
    want = clips(rng, [f"v{k}" for k in range(30)])
    rows = [(v, s, *f) for (v, s), own in want.items() for f in own]
    rng.shuffle(rows)
    expected = {k: loop(own) for k, own in want.items()}
    expected = {k: c for k, c in expected.items() if c[0]}
    for width in ("10000", "7"):  # clips that span batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", width)
        try:
            got = points.frames_to_clips(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.vehicle_id, r.seq): (r.frame_count, r.park_count, r.points, r.gear_states, r.ap_states, r.speeds, r.accel_positions, *([tuple(x) for x in c] for c in (r.gear_runs, r.ap_runs, r.flag_runs))) for r in got} == expected


def test_frames_are_shuffled_once_as_lists(spark):
    plan = points.frames_to_clips(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_collect_list" in plan and "Window" not in plan


def test_changes_take_nulls_and_nans_as_equal():
    of = lambda x, t: changes(pa.array(x, t)).tolist()
    assert of([1, 1, None, None, 2, 0], pa.int64()) == [True, False, True, False, True, True]
    assert of([math.nan, math.nan, 1.0, None, 1.0], pa.float64()) == [True, False, True, True, True]
    assert of(["a", None, None, "a"], pa.string()) == [True, True, False, True]
    assert of([None, None], pa.int32()) == [True, False]
