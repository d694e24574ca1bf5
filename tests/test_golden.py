"""Known values of the calculation contract."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.functions import paths, provider, runs, scalars
from tripspark.functions.fixed import to_fixed
from tripspark.operators import assist, charging, clips, endpoints, holes, imports, labels, listing, points, repair, sessions, spatial, stats, summon
from tripspark.sources.csv_imports import zone_offset_ms

T0 = 1_735_734_000_000
CLIP = "vehicle_id string, seq bigint, t_ms bigint, n_points bigint, gear_runs array<struct<gear:bigint,frames:double>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("args, want, tolerance", [
    ((0, 0, 0, 1), 111319.49, 1), ((40.7128, -74.0060, 34.0522, -118.2437), 3944422.179, 1), ((37.7749, -122.4194, 40.7128, -74.0060), 4139145.867, 1), ((37.77, -122.41, 37.77027, -122.41), 29.968, 0.01), ((1, 2, 1, 2), 0, 0),
])
def test_geodesic(spark, args, want, tolerance):
    assert abs(one(spark, scalars.geodesic_m(*map(F.lit, map(float, args)))) - want) <= tolerance
    assert abs(float(points.geodesic_np(*map(np.float64, args))) - want) <= tolerance


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (-2.6, -3), (0.49999, 0)])
def test_js_round(spark, x, want):
    assert one(spark, scalars.js_round(F.lit(x))) == want


def test_round2_and_fixed(spark):
    assert one(spark, scalars.round2(F.lit(1.005))) == 1.0
    assert one(spark, to_fixed(F.lit(12345.675))) == "12345.67"
    sig = paths.external_signature(F.lit("svc"), F.lit(1_721_052_000_000), to_fixed(F.lit(12345.675)))
    assert one(spark, sig) == "svc:28684200:12345.67"
    assert one(spark, paths.clip_file_name(F.lit("svc"), F.lit(1_721_052_000_000), sig)) == "svc/2024-07-15/2024-07-15_14-00-00-front-svc-286842001234567.mp4"


@pytest.mark.parametrize("file, want", [
    ("a/2025-01-01_12-00-00-front.mp4", T0 - 0), ("2025-01-01_24-00-00-front.mp4", T0 + 12 * 3_600_000), ("2025-02-30_10-00-00-front.mp4", None), ("2025-01-01_12-00-00/x.mp4", None), ("none", None),
])
def test_clip_timestamp(spark, file, want):
    got = one(spark, paths.clip_timestamp_ms(F.lit(file)))
    assert got == (want if want is None else want - T0 + 1_735_732_800_000)


def test_clip_timestamp_daylight_saving(spark):
    tz = "America/New_York"
    at = lambda s: one(spark, paths.clip_timestamp_ms(F.lit(s), tz))
    assert at("2025-11-02_01-30-00-front.mp4") == 1_762_061_400_000  # occurs twice: the earlier one
    assert at("2025-03-09_02-30-00-front.mp4") == 1_741_505_400_000  # does not occur: offset before the gap


def test_repair_timestamp(spark):
    """Days run on into the next month, folders count, and only the first match does."""
    want = {
        "a/2024-02-30_10-00-00-front.mp4": "2024-03-01 10:00:00", "2024-02-31_24-00-00/2024-01-01_00-00-00": "2024-03-03 00:00:00", "x2024-04-31_23-59-59": "2024-05-01 23:59:59", "2023-12-31_24-00-00": "2024-01-01 00:00:00",
        "2023-13-01_00-00-00/2024-01-01_00-00-00": None, "2024-01-01_24-00-01": None, "2024-00-10_00-00-00": None, "2024-01-32_00-00-00": None, "2024-01-01_10-60-00": None, "none": None, "": None, None: None,
    }
    rows = repair.repair_times(spark.createDataFrame([(f,) for f in want], "file string"))
    assert {r.file: r.t for r in rows.select("file", F.timestamp_millis("t_ms").cast("string").alias("t")).collect()} == want
    # summer time begins: the offset before the gap
    assert one(spark, F.timestamp_millis(paths.repair_timestamp_ms(F.lit("2024-03-31_02-30-00"), "Europe/Berlin")).cast("string")) == "2024-03-31 01:30:00"


def test_response_bodies(spark):
    bodies = [
        '{"results":[[{"latitude":1,"x":1.5}],{"path":[1,2]},{"points":[[3,4]],"path":"[9]"},{"path":null,"points":[5]},7,null,{"q":1}]}',
        '{"results":[{"latitude":1.25},{"latitude":2}]}', '{"results":[{"latitude":null},{"latitude":2}]}', '{"results":[{"latitude":1,"path":[]},{"latitude":3}]}', '{"results":{}}', '{"results":[]}', "[]", "bad", "", None,
    ]
    r = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = sorted(map(tuple, provider.response_paths(r).collect()))
    assert got == [(0, 0, '[{"latitude":1,"x":1.5}]'), (0, 1, "[1,2]"), (0, 2, "[[3,4]]"), (0, 3, "[5]"), (1, 0, '[{"latitude":1.25},{"latitude":2}]'), (3, 0, "[]")]
    assert [(x.n, x.record_no) for x in provider.response_records(r).orderBy("n", "record_no").collect()] == [(0, k) for k in range(7)] + [(n, k) for n in (1, 2, 3) for k in range(2)]


@pytest.mark.parametrize("path, want", [("RecentClips\\a.mp4", "a.mp4"), ("RecentClips/", "RecentClips/"), ("RecentClips/RecentClips/a", "RecentClips/a"), ("SavedClips/a", "SavedClips/a")])
def test_normalize(spark, path, want):
    assert one(spark, paths.normalize_clip_path(F.lit(path))) == want


def test_park_runs_cut_a_clip_into_three_drives(spark):
    df = spark.createDataFrame([("v", 1, T0, 60, [(1, 20.0), (0, 5.0), (1, 15.0), (0, 5.0), (1, 15.0)])], CLIP)
    out = sessions.park_splits(sessions.sessionize_drives(df)).orderBy("cut_drive").collect()
    assert [(r.cut_drive, r.start_idx, r.end_idx) for r in out] == [(1, 0, 20), (2, 25, 40), (3, 45, 60)]
    assert [r.seg_t_ms - T0 for r in out] == [0, 25000, 45000]


def test_parked_parts_without_points_vanish(spark):
    df = spark.createDataFrame([("v", 1, T0, 0, [(1, 20.0), (0, 40.0)]), ("v", 2, T0 + 60000, 5, [(0, 60.0)]), ("v", 3, T0 + 120000, 4, None)], CLIP)
    out = sessions.park_splits(sessions.sessionize_drives(df)).collect()
    assert [(r.seq, r.cut_drive, r.start_idx, r.end_idx) for r in out] == [(3, 1, 0, 4)]


@pytest.mark.parametrize("gap, drives", [(60 * 60_000, 2), (60_000, 1), (300_000, 1), (300_001, 2)])
def test_drive_gap(spark, gap, drives):
    df = spark.createDataFrame([("v", 1, T0), ("v", 2, T0 + gap)], "vehicle_id string, seq bigint, t_ms bigint")
    assert sessions.sessionize_drives(df).select("drive_id").distinct().count() == drives


def loop_events(pts):
    """Plain loop over one drive: (disengagements, pushes) as indices."""
    dis, push, pending, press, since = [], [], None, None, 0
    for i in range(1, len(pts)):
        (pt, pap, _, _), (t, ap, gear, acc) = pts[i - 1], pts[i]
        if pending is not None:
            if gear == 0 and t - pending[1] <= 2000:
                pending = None
            elif t - pending[1] > 2000 or ap == 1:
                dis.append(pending[0])
                pending = None
        if pap != 1 and ap == 1:
            press, since = None, t
        if pap == 1 and ap != 1:
            pending, press = (i, t), None
        pct = acc * 100 if acc <= 1 else acc
        if ap == 1 and press is None and pct > 1 and t - since >= 3000:
            press = i
        if press is not None and pct <= 0:
            push.append(press)
            press = None
    if pending is not None and pts[-1][2] != 0:
        dis.append(pending[0])
    return dis, push


def test_assist_events_equal_a_loop(spark):
    rnd, rows, want_d, want_p = random.Random(5), [], set(), set()
    for d in range(300):
        t, pts = 100_000, []
        for _ in range(rnd.randint(1, 25)):
            t += rnd.choice([500, 1000, 2500, -300])
            pts.append((t, rnd.choice([0, 1, 1, 2]), rnd.choice([0, 1, 1, 1]), rnd.choice([0.0, 0.0, 0.005, 0.3, 20.0])))
        rows += [("v", d, i, float(t), 1.0, 2.0, ap, g, a) for i, (t, ap, g, a) in enumerate(pts)]
        dis, push = loop_events(pts)
        want_d |= {(d, i) for i in dis}
        want_p |= {(d, i) for i in push}
    df = spark.createDataFrame(rows, "vehicle_id string, drive_id bigint, idx bigint, t_ms double, lat double, lng double, ap bigint, gear bigint, accel double")
    assert {(r.drive_id, r.idx) for r in assist.disengagement_events(df).collect()} == want_d
    assert {(r.drive_id, r.idx) for r in assist.accel_push_events(df).collect()} == want_p and want_p


def loop_sessions(rows):
    """Plain state machine over one vehicle's samples."""
    out, last, seq, cur, batt = [], None, 0, None, None

    def close(end, why):
        nonlocal cur
        if (cur["e"] or 0) > 0 or cur["held"] >= 60:
            out.append((cur["n"], cur["s"], end, cur["e"], cur["peak"], cur["b0"], cur["b1"], why))
        cur = None

    for s, state, power, energy, b in rows:
        if cur and s - last > 1800:
            close(last, "data-gap")
        batt = b if b is not None else batt
        if cur is None and state in ("starting", "charging"):
            seq += 1
            cur = dict(n=seq, s=s, e=None, peak=None, held=0, streak=None, b0=batt, b1=batt)
        if cur:
            cur["b1"] = batt if batt is not None else cur["b1"]
            if energy is not None:
                cur["e"] = max(cur["e"] or 0.0, energy)
            if power is not None:
                cur["peak"] = power if cur["peak"] is None else max(cur["peak"], power)
                cur["streak"] = (cur["streak"] if cur["streak"] is not None else s) if power > 0 else None
                if cur["streak"] is not None:
                    cur["held"] = max(cur["held"], s - cur["streak"])
            if state in ("complete", "stopped", "disconnected", "nopower"):
                close(s, state)
        last = s
    if cur:
        close(last, "end-of-file")
    return out


def test_charging_sessions_equal_a_loop(spark):
    rnd, rows, want = random.Random(9), [], set()
    for v in range(120):
        s, own = 1000.0, []
        for _ in range(rnd.randint(1, 30)):
            s += rnd.choice([10, 30, 70, 900, 1800, 1801, -20])
            own.append((s, rnd.choice([None, None, "starting", "charging", "complete", "nopower"]), rnd.choice([None, 0.0, -1.0, 7.0, 11.0]), rnd.choice([None, None, None, 0.0, 1.5]), rnd.choice([None, 50.0, 51.0])))
        rows += [(v, p, s, st, pw, en, b, None, None, None, str(s)) for p, (s, st, pw, en, b) in enumerate(own)]
        want |= {(v, *x) for x in loop_sessions(own)}
    df = spark.createDataFrame(rows, "vehicle_id bigint, pos bigint, ts double, charging_state string, power_kw double, energy_kwh double, battery_pct double, lat double, lng double, location_name string, raw_ts string")
    got = charging.charging_sessions(df).collect()
    assert {(r.vehicle_id, r.session_no, r.start_s, r.end_s, r.energy_kwh, r.peak_kw, r.start_battery, r.end_battery, r.end_reason) for r in got} == want and want


def test_session_ids_and_sites(spark):
    rows = [(1, p, ts, st, 7.0, e, 50.0, la, -122.0, None, str(ts)) for p, (ts, st, e, la) in enumerate([
        (1010.0, "charging", 1.0, 37.0), (1100.0, "complete", 2.0, 37.0), (2010.0, "charging", 1.0, 37.0005), (2100.0, "complete", 2.0, 37.0005), (9010.0, "charging", 3.0, None), (9100.0, "stopped", 3.0, None)])]
    df = spark.createDataFrame(rows, "vehicle_id bigint, pos bigint, ts double, charging_state string, power_kw double, energy_kwh double, battery_pct double, lat double, lng double, location_name string, raw_ts string")
    out = charging.charging_sites(charging.charging_sessions(df)).orderBy("session_no").collect()
    assert [(r.session_id, r.site_id) for r in out] == [("charge-1010-1", "site-charge-1010-1"), ("charge-2010-2", "site-charge-1010-1"), ("charge-9010-3", "unknown")]


def test_hole_of_eleven_saved_clips_is_filled(spark):
    rows = [("v", 0, T0, "RecentClips/a", False, True), ("v", 1, T0 + 12 * 60_000, "RecentClips/b", False, True)]
    rows += [("v", 2 + i, T0 + (i + 1) * 60_000, f"SavedClips/{i:02}", True, True) for i in range(11)]
    rows += [("v", 20, T0 + 400 * 60_000, "SavedClips/far", True, True), ("v", 21, T0 + 30_000, "SavedClips/parked", True, False)]
    df = spark.createDataFrame(rows, "vehicle_id string, seq bigint, t_ms bigint, path string, is_event boolean, driving boolean")
    out = holes.fill_holes(df)
    assert out.count() == 13 and out.where("filled").count() == 11
    assert sessions.sessionize_drives(out).select("drive_id").distinct().count() == 1


def test_polygon_with_hole_and_many():
    square = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    hole = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
    at = lambda g, x, y: bool(spatial.geometry_contains(g, np.array([x]), np.array([y]))[0])
    assert not at({"type": "Polygon", "coordinates": [square, hole]}, 5.0, 5.0)
    assert at({"type": "Polygon", "coordinates": [square, hole]}, 2.0, 2.0) and at({"type": "Polygon", "coordinates": [square, hole]}, 0.0, 5.0)
    assert at({"type": "MultiPolygon", "coordinates": [[square], [[[20, 20], [30, 20], [30, 30], [20, 20]]]]}, 28.0, 22.0)
    assert at({"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [square]}]}, 1.0, 1.0) and not at(None, 1.0, 1.0)


def test_station_tags(spark):
    rows = [({"amenity": "charging_station", "brand": "Tesla Supercharger", "socket:x:output": "150 kW;250 kW; 9999"},), ({"amenity": "charging_station", "brand": "Tesla Supercharger", "name": "Destination charger"},), ({"amenity": "charging_station", "socket:tesla_supercharger": "8"},), ({"amenity": "fuel", "brand": "Tesla Supercharger"},)]
    df = spark.createDataFrame(rows, "tags map<string,string>").select(spatial.is_supercharger(F.col("tags")).alias("s"), spatial.station_power_kw(F.col("tags")).alias("kw")).collect()
    assert [r.s for r in df] == [True, False, True, False] and df[0].kw == 250.0 and df[2].kw is None


def test_nearest_station_at_the_date_line_and_in_the_north(spark):
    sites = spark.createDataFrame([("v", "a", 10.0, 179.9995), ("v", "b", 78.0, 15.0), ("v", "c", 10.0, 50.0), ("v", "d", None, None)], "vehicle_id string, site_id string, lat double, lng double")
    stations = spark.createDataFrame([(1, "x", 10.0, -179.9995, 250.0), (2, "y", 78.0, 15.008, 150.0)], "station_id bigint, name string, lat double, lng double, power_kw double")
    out = {r.site_id: (r.station_id, r.tier) for r in spatial.match_stations(sites, stations).collect()}
    assert out == {"a": (1, 3), "b": (2, 2), "c": (None, 0), "d": (None, 0)}


def test_gear_lookups(spark):
    arr = F.array(*(F.struct(F.lit(g).alias("gear"), F.lit(f).alias("frames")) for g, f in ((1, 20.0), (0, 10.0))))
    sp = runs.spans(arr, "gear")
    assert [one(spark, runs.value_at_frame(sp, F.lit(x))) for x in (-1.0, 0.0, 19.0, 20.0, 29.0, 30.0)] == [None, 1.0, 1.0, 0.0, 0.0, None]
    assert one(spark, runs.runs_span_frames(arr, F.lit(30.0))) is True and one(spark, runs.runs_span_frames(arr, F.lit(31.0))) is False


EVIDENCE = "vehicle_id string, drive_id bigint, seq bigint, flag_runs array<struct<flags:bigint,frames:double,max_mps:double>>, ap_runs array<struct<ap:bigint,frames:double>>, gear_runs array<struct<gear:bigint,frames:double>>, start_frame double, end_frame double, total_frames double, start_ms double, end_ms double"


@pytest.mark.parametrize("flags, ap, gear, duration, speed, want", [
    ([(3, 100.0, 2.0)], None, None, 60_000, 2.0, True),  # hazards at both ends are enough
    ([(3, 50.0, 2.0), (4, 50.0, 2.0)], None, None, 60_000, 2.0, False),  # a pedal
    ([(0, 100.0, 2.0)], [(1, 100.0)], [(0, 10.0), (1, 80.0), (0, 10.0)], 60_000, 2.0, True),
    ([(0, 100.0, 2.0)], [(1, 40.0), (0, 60.0)], [(0, 10.0), (1, 80.0), (0, 10.0)], 60_000, 2.0, False),  # too little FSD
    ([(0, 100.0, 2.0)], [(1, 60.0), (2, 40.0)], [(0, 10.0), (1, 80.0), (0, 10.0)], 60_000, 2.0, False),  # another mode
    ([(0, 100.0, 2.0)], [(1, 100.0)], [(1, 90.0), (0, 10.0)], 60_000, 2.0, False),  # no Park before
    ([(3, 100.0, 5.0)], None, None, 60_000, 2.0, False),  # too fast
    ([(3, 100.0, None)], None, None, 60_000, 2.0, True),  # speed from the recorded ones
    ([(3, 100.0, 2.0)], None, None, 600_001, 2.0, False),  # too long
    ([(3, 100.0, 2.0)], None, None, 90_001, 2.0, False),  # 30 s and more not covered
    ([(3, 90.0, 2.0)], None, None, 60_000, 2.0, False),  # runs do not span the clip
    (None, None, None, 60_000, 2.0, False),
])
def test_summon_gates(spark, flags, ap, gear, duration, speed, want):
    ev = spark.createDataFrame([("v", 1, 1, flags, ap, gear, 0.0, 100.0, 100.0, 0.0, 60_000.0)], EVIDENCE)
    d = spark.createDataFrame([("v", 1, duration, speed, True)], "vehicle_id string, drive_id bigint, duration_ms bigint, max_speed_mps double, has_speeds boolean")
    assert summon.summon_drives(ev, d).first().summon is want


def test_endpoint_medoid_and_rolling_end(spark):
    rows = [("v", 1, i, T0 + i * 1000.0, 37.0 + x, -122.0, 0.0, None) for i, x in enumerate((0.0, 0.000009, 0.000009, 0.00002))]
    rows += [("v", 1, 4 + i, T0 + 60_000.0 + i * 1000, 37.01 + i * 0.001, -122.0, 20.0, None) for i in range(5)]
    df = spark.createDataFrame(rows, "vehicle_id string, drive_id bigint, idx bigint, t_ms double, lat double, lng double, speed double, gear double")
    out = {r.which: r for r in endpoints.endpoint_snap(df).collect()}
    assert (out["start"].lat, out["start"].samples, out["start"].stationary) == (37.000009, 4, True)
    assert (out["end"].accuracy_m, out["end"].samples, out["end"].stationary) == (35.0, 1, False)


def test_heading_holds_at_a_stop_and_turns_in_reverse(spark):
    rows = [("v", 1, i, 37.0 + min(i, 20) * 5e-5, -122.0, 5.0 if i < 20 else 0.0, 1.0) for i in range(40)]
    rows += [("v", 2, i, 37.0 + i * 5e-5, -122.0, 5.0, 2.0) for i in range(20)] + [("v", 3, i, 37.0, -122.0, 0.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "vehicle_id string, drive_id bigint, idx bigint, lat double, lng double, speed double, gear double")
    out = {(r.drive_id, r.idx): r.heading for r in endpoints.smooth_heading(df).collect()}
    assert abs(out[1, 10]) < 1e-6 and abs(out[1, 39]) < 1e-6 and abs(out[2, 10] - 180) < 1e-6 and out[3, 2] is None


def test_zone_offsets():
    assert zone_offset_ms("Started At (MDT)") == -6 * 3_600_000 and zone_offset_ms("Started At") == -4 * 3_600_000
    with pytest.raises(ValueError):
        zone_offset_ms("Started At (XYZ)")


def test_labels(spark):
    rows = [(37.0, -122.0, 5.0, '{"category":"amenity","type":"cafe","name":"Cafe","lat":"37.0","lon":"-122.0","osm_type":"node","osm_id":7}'), (37.0, -122.0, 20.0, '{"display_name":"Oak Street, 5, Town","address":{"road":"Oak Street","house_number":"5"},"lat":"37.0","lon":"-122.0"}'), (37.0, -122.0, 40.0, '{"address":{"road":"Oak Street"}}'), (37.0, -122.0, None, "{}"), (37.0, -122.0, None, "not json")]
    out = labels.label_match(spark.createDataFrame(rows, "lat double, lng double, accuracy_m double, json string")).collect()
    assert [(r.label, r.feature_type, r.confidence) for r in out] == [("Cafe", "poi", "high"), ("Oak Street 5", "address-point", "medium"), ("Oak Street", "road", "low"), (None, None, None), (None, None, None)]


def test_thin_points_keeps_both_ends(spark):
    df = spark.createDataFrame([("v", 1, i, i % 4) for i in range(101)] + [("v", 2, i, 0) for i in range(3)], "vehicle_id string, drive_id bigint, idx bigint, gear bigint")
    out = points.thin_points(df, 12).collect()
    long = sorted(r.idx for r in out if r.drive_id == 1)
    assert len(long) == 12 and long[0] == 0 and long[-1] == 100 and all(r.gear == r.idx % 4 for r in out if r.drive_id == 1) and sum(r.drive_id == 2 for r in out) == 3


def test_page_limits(spark):
    d = spark.range(2000).select("id", F.col("id").alias("start_ms"))
    assert listing.list_drives(d, 5000).count() == 1000 and listing.list_drives(d, 0).count() == 1
    assert listing.page_of_drive(d, 1000, 250).first().page_offset == 750


def test_overlap_is_half_open(spark):
    rows = [("v", 1, 0, 100, "sei", False), ("v", 2, 100, 200, "svc", False), ("v", 3, 99, 200, "svc", False), ("v", 4, 300, 400, "sei", True), ("v", 5, 300, 400, "svc", False), ("v", 6, 50, 50, "svc", False)]
    df = spark.createDataFrame(rows, "vehicle_id string, drive_id bigint, start_ms bigint, end_ms bigint, source string, summon boolean")
    assert sorted(r.drive_id for r in imports.hide_overlapping_imports(df).collect()) == [1, 2, 4, 5, 6]


def test_telemetry_takes_first_and_last_known(spark):
    cols = "battery_start battery_end interior_min interior_max exterior_avg hvac_s tire_fl tire_fr tire_rl tire_rr odometer_start odometer_end".split()
    schema = "vehicle_id string, drive_id bigint, t_ms bigint, seq bigint, path string, location_start string, location_end string, " + ", ".join(f"{c} double" for c in cols)
    rows = [("v", 1, 1, 1, "a", None, "X", None, 79.0, 20.0, 22.0, 10.0, 30.0, 41.0, None, 40.0, 40.0, 100.0, None), ("v", 1, 2, 2, "b", "H", None, 78.0, 75.5, 19.0, 25.0, 12.0, 31.0, None, 42.0, 40.0, 41.0, 105.0, 112.25), ("v", 1, 3, 3, "b", "Z", "Z", 1.0, 1.0, 1.0, 99.0, 99.0, 99.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    r = stats.telemetry_rollup(spark.createDataFrame(rows, schema)).first()
    assert (r.battery_start, r.battery_end, r.battery_used, r.interior_min, r.interior_max, r.exterior_avg, r.hvac_s) == (78.0, 75.5, 2.5, 19.0, 25.0, 11.0, 61.0)
    assert (r.tire_fl, r.tire_fr, r.odometer_driven, r.location_start, r.location_end) == (41.0, 42.0, 12.25, "H", "X")


def test_evidence_of_driving(spark):
    rows = [([(0, 5.0)], None, 5.0, 10.0, [0.0]), (None, None, 5.0, 10.0, None), (None, [0, 1], None, None, None), (None, None, None, None, [0.6]), (None, None, 10.0, 10.0, [0.5])]
    df = spark.createDataFrame(rows, "g array<struct<gear:bigint,frames:double>>, s array<int>, p double, f double, v array<double>")
    out = df.select(clips.clip_has_driving(*map(F.col, "gspfv")).alias("d")).collect()
    assert [r.d for r in out] == [False, True, True, True, False] and not math.isnan(1.0)


def test_learned_places_replace_their_like_and_are_capped(spark):
    schema = "vehicle_id string, place_id string, label string, source string, lat double, lng double, radius_m double, updated_at bigint"
    places = spark.createDataFrame([("v", "m", "Home", "manual", 37.0, -122.0, 50.0, 1), ("v", "t", "Gym", "tesla", 37.1, -122.0, 50.0, 2)], schema)
    learned = spark.createDataFrame([("v", "gym", 37.1002, -122.0, 30.0, 5), ("v", "Far", 38.0, -122.0, 30.0, 6), ("v", "Old", 39.0, -122.0, 30.0, 1)], "vehicle_id string, label string, lat double, lng double, radius_m double, updated_at bigint")
    out = {r.label: r for r in spatial.learn_places(places, learned, most=3).collect()}
    assert set(out) == {"Home", "gym", "Far"} and out["gym"].place_id == "t" and out["gym"].radius_m == 30.0
    zones = places.where("source = 'manual'").withColumn("source", F.lit("zone"))
    assert spatial.replace_zones(places, zones).count() == 3


def test_provider_keys_differ_in_case(spark):
    from tripspark.functions import provider

    df = spark.createDataFrame([('{"Start_Date": 1700000000, "duration": 60, "MILES": "3.5 mi"}',), ('{"started_at": "2024-01-01T00:00:00Z", "ended_at": 1704067260000}',), ("no json",)], "json string")
    a, b, c = provider.provider_drives_normalized(df).collect()
    assert (a.start_ms, a.end_ms, a.distance_mi) == (1.7e12, 1.70000006e12, 3.5) and (b.start_ms, b.end_ms) == (1704067200000.0, 1704067260000.0) and c.start_ms is None


def test_bridges_and_gaps(spark):
    from tripspark.operators import repair

    cols = "vehicle_id string, seq bigint, t_ms bigint, date string, first_lat double, first_lng double, last_lat double, last_lng double, first_gear bigint, last_gear bigint"
    row = lambda s, t, g=1, d="d", la=37.0: ("v", s, t, d, la, -122.0, la, -122.0, g, g)
    df = spark.createDataFrame([row(1, 0), row(2, 180_000, la=37.01), row(3, 300_000), row(4, 660_001), row(5, 840_001, 0), row(6, 1_020_001, 1, "e")], cols)
    gaps = repair.find_recording_gaps(df).collect()
    assert [(g.seq, g.gap_ms) for g in gaps] == [(1, 120_000)]
    b = repair.bridge_gaps(repair.find_recording_gaps(df)).first()
    assert len(b.points) == 119 and b.file == "d/d_00-01-00-front-bridge.mp4" and abs(b.points[59][0] - 37.005) < 1e-9
