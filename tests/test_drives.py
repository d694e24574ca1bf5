import json

import numpy as np
from pyspark.sql import functions as F

from tripspark.operators import drives, endpoints, spatial
from tripspark.sources import drive_data

SCHEMA = (
    "vehicle_id string, seq bigint, path string, is_event boolean, t_ms bigint, source string, external_signature string, points array<array<double>>, gear_states array<int>, ap_states array<int>, speeds array<double>,"
    " accel_positions array<double>, gear_runs array<struct<gear:bigint,frames:double>>, raw_park_count double, raw_frame_count double"
)
MINUTE = 60_000


def clip(seq, minute, n=4, gears=None, runs=None, path=None, event=False, source="sei", sign=None, parked=None, car="v"):
    points = [[48.0 + (minute + i / n) * 1e-3, 11.0] for i in range(n)]
    return (car, seq, path or f"RecentClips/{seq}", event, None if minute is None else int(minute * MINUTE), source, sign, points, gears if gears is not None else [1] * n, [1] * n, [10.0] * n, [0.0] * n, runs, parked, 100.0 if parked is not None else None)


def drives_of(spark, rows):
    out = drives.clips_to_drives(spark.createDataFrame(rows, SCHEMA))
    return {(r.vehicle_id, r.drive_id): r for k in ("drives", "hidden") for r in out[k].withColumn("listed", F.lit(k)).collect()}, sorted((r.vehicle_id, r.drive_id, r.seq, r.start_idx, r.end_idx) for r in out["parts"].collect())


def test_pauses_copies_and_event_clips(spark):
    rows = [clip(0, 0), clip(1, 1), clip(2, 1, path="RecentClips/1"), clip(3, 7.5), clip(4, 8.5), clip(5, 3, event=True), clip(6, 3.2, event=True, gears=[0] * 4), clip(7, 300), clip(8, 0, car="w", n=0)]
    rows[6] = (*rows[6][:10], [0.0] * 4, *rows[6][11:])  # stands
    got, parts = drives_of(spark, rows)
    # the event clip at minute 3 fills the hole and so joins both sides; the copy and the standing one are left out
    assert parts == [("v", 1, 0, 0, 4), ("v", 1, 1, 0, 4), ("v", 1, 3, 0, 4), ("v", 1, 4, 0, 4), ("v", 1, 5, 0, 4), ("v", 2, 7, 0, 4), ("w", 1, 8, 0, 0)]
    one = got["v", 1]
    assert (one.start_ms, one.end_ms, one.clip_count, one.point_count) == (0, int(9.5 * MINUTE), 5, 20) and one.assisted_percent == 100 and abs(one.avg_speed_kmh - 36) < 1e-9
    assert 0.9 < one.distance_km < 1.1 and got["w", 1].point_count == 0 and got["w", 1].distance_km == 0 and got["w", 1].duration_ms == MINUTE


def test_park_cuts_by_runs_and_by_states(spark):
    run = lambda *x: [(g, float(f)) for g, f in x]
    got, parts = drives_of(spark, [clip(0, 0, n=10, runs=run((1, 30), (0, 30), (1, 40))), clip(1, 1, n=10, runs=run((1, 99), (0, 1)))])
    # 30 of 100 frames are 18 s of Park: a gap; one frame is none
    assert parts == [("v", 1, 0, 0, 3), ("v", 2, 0, 6, 10), ("v", 2, 1, 0, 10)]
    assert (got["v", 1].start_ms, got["v", 1].end_ms, got["v", 2].start_ms, got["v", 2].end_ms) == (0, 18_000, 36_000, 2 * MINUTE)
    _, parts = drives_of(spark, [clip(0, 0), clip(1, 1, parked=80.0), clip(2, 2), clip(3, 3, gears=[0, 0, 0, 1]), clip(4, 4)])
    assert [(d, s) for _, d, s, *_ in parts] == [(1, 0), (2, 2), (3, 4)]


def test_signatures_split_and_outliers_go(spark):
    rows = [clip(0, 0), clip(1, 1, source="svc", sign="b"), clip(2, 2, source="svc", sign="a"), clip(3, 3, source="svc", sign="b"), clip(4, 4)]
    rows[0][7][2][:] = [0.0, 0.1]  # no place
    rows[4][7][1][:] = [49.0, 12.0]  # far from the one before and the one after
    got, parts = drives_of(spark, rows)
    assert [(d, s) for _, d, s, *_ in parts] == [(1, 0), (1, 4), (2, 1), (2, 3), (3, 2)]
    assert got["v", 1].point_count == 6 and got["v", 2].point_count == 8
    # the imports overlap the recorded drive
    assert [got["v", d].listed for d in (1, 2, 3)] == ["drives", "hidden", "hidden"]


def test_carried_headings_are_those_of_the_nearest_step_that_tells():
    rng = np.random.default_rng(3)
    for _ in range(60):
        told = np.where(rng.random(40) < 0.3, rng.random(40) * 360, np.nan)
        for window in (1, 4, 6, 9):
            step, got = max(1, window // 2), endpoints.carried_headings(told, window)
            for i in range(len(told)):
                tried = [*range(i, 0, -step), 0, *range(i + step, len(told), step)]
                want = next((told[k] for k in tried if np.isfinite(told[k])), np.nan)
                assert got[i] == want or np.isnan(got[i]) and np.isnan(want)


def test_headings_of_straight_ways():
    n = np.arange(30.0)
    for lat, lng, want in ((48 + n * 1e-4, 0 * n + 11, 0), (0 * n, n * 1e-4, 90), (48 - n * 1e-4, 0 * n + 11, 180), (0 * n, -n * 1e-4, 270)):
        for gear, turn in ((None, 0), (n * 0 + 1, 0), (n * 0 + 2, 180)):
            got = endpoints.local_headings(lat, lng, n * 0 + 8, gear, 6)
            assert np.allclose((got - want - turn + 180) % 360, 180, atol=1e-6)
    assert np.isnan(endpoints.local_headings(0 * n, n * 1e-7, n * 0, n * 0 + 1, 6)).all()  # standing


def test_places_have_radii_within_limits(spark):
    rows = [(1, "a", "zone", 1.0, 2.0, 5000.0), (2, "a", "manual", 1.0, 2.0, None), (3, "a", "tesla", 1.0, 2.0, 0.0), (4, "a", "tesla", 1.0, 2.0, 2.0), (5, " ", "tesla", 1.0, 2.0, 9.0), (6, "a", "other", 1.0, 2.0, 9.0), (7, "a", "zone", None, 2.0, 9.0), (8, "a", "manual", 1.0, 2.0, 400.0), (9, "a", "zone", 1.0, 2.0, float("nan"))]
    got = spatial.clean_places(spark.createDataFrame(rows, "place_id int, label string, source string, lat double, lng double, radius_m double"))
    assert {r.place_id: r.radius_m for r in got.collect()} == {1: 1000.0, 2: 40.0, 3: 25.0, 4: 5.0, 8: 100.0, 9: 150.0}


def test_documents_come_back_with_all_sections(spark, tmp_path):
    doc = {
        "processedFiles": ["a/b.mp4"], "routes": [], "driveTags": {"2024-01-01": ["x"]}, "telemetrySamples": [{"ts": 5.0, "batteryPct": 50.0, "lat": 1.5, "lng": 2.5, "locationName": "home", "chargingState": "Charging"}, {"ts": 6.5, "chargerPowerKw": 11.0}],
        "chargeCosts": {"k": {"amount": 3.5, "currency": "EUR"}}, "chargeTags": {"k": ["a", "b\"c"], "l": "plain"}, "settings": {"unit": "km", "n": [1, 2]}, "version": 7, "note": "x y",
    }
    (tmp_path / "in" / "car").mkdir(parents=True)
    (tmp_path / "in" / "car" / "drive-data.json").write_text(json.dumps(doc))
    path = f"{tmp_path}/in/*/drive-data.json"
    sections = drive_data.read_drive_data(spark, path)
    drive_data.write_drive_data({**sections, "other": drive_data.read_other_sections(spark, path)}, f"{tmp_path}/out")
    text = spark.read.text(f"{tmp_path}/out").first().value
    assert {**json.loads(text), "routes": []} == doc, text


def test_steps_lag_once_and_measure_in_windows_of_one_order(spark):
    from tripspark.operators import measure, points

    rows = spark.createDataFrame([("v", 1, 0, 1, 48.0, 11.0, 0.0, 1, 1, 5.0, 0.0)], "vehicle_id string, drive_id bigint, idx bigint, seq bigint, lat double, lng double, t_ms double, gear int, ap int, speed double, accel double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(points.with_steps(rows)).count("lag(") == 3
    physical = measure.drive_measures(measure.measured_points(rows))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and physical.count("Window [") == 3


def test_circles_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    points = [("v", k, float(a), float(b)) for k, (a, b) in enumerate(np.column_stack([48 + rng.random(400), 11 + rng.random(400)]))]
    zones = [(k, points[k][2] + 1e-5, points[k][3], float(r)) for k, r in enumerate([5, 25, 249, 250, 251, 1000, 4000, 4001, 20_000, 50_000, 64_000, 90_000])]
    got = spatial.drives_in_zones(spark.createDataFrame(points, "vehicle_id string, drive_id int, lat double, lng double"), spark.createDataFrame(zones, "zone_id int, lat double, lng double, radius_m double")).collect()
    from tripspark.operators.points import geodesic_np

    want = {(p[1], z[0]) for p in points for z in zones if geodesic_np(p[2], p[3], z[1], z[2]) <= z[3]}
    assert {(r.drive_id, r.zone_id) for r in got} == want and len(want) > 800
