"""Files in and out."""

import json

from pyspark.sql import functions as F

from tripspark.sources import csv_imports, drive_data

DOCUMENT = {
    "processedFiles": ["RecentClips\\2025-01-01_12-00-00-front.mp4"],
    "routes": [
        {"file": "RecentClips\\2025-01-01_12-00-00-front.mp4", "date": "2025-01-01", "points": [[37.0, -122.0], [37.1, None]], "gearStates": "AQI=", "autopilotStates": [0, 1], "speeds": [1.0, None], "rawFrameCount": "x", "gearRuns": [{"gear": 1, "frames": 2}], "batteryPctStart": 80},
        {"file": "SavedClips/e/2025-01-01_12-05-00-front.mp4", "points": [], "gearStates": "", "source": "svc", "externalSignature": "svc:1:x"},
    ],
    "driveTags": {"2025-01-01T12:00:00": ["home"]}, "meta": {"any": 1},
    "telemetrySamples": [{"ts": 1000, "chargingState": "Charging", "latitude": 1.5, "lng": 2.5}], "chargeCosts": {"1000": {"amount": 2.5, "currency": "EUR"}}, "chargeTags": {"1000": "home", "2000": ["a", "b"]},
}


def test_drive_document_both_ways(spark, tmp_path):
    (tmp_path / "in" / "car1").mkdir(parents=True)
    (tmp_path / "in" / "car1" / "data.json").write_text(json.dumps(DOCUMENT, indent=1))
    s = drive_data.read_drive_data(spark, f"{tmp_path}/in/*/*.json")
    a, b = s["clips"].orderBy("seq").collect()
    assert (a.vehicle_id, a.path, a.t_ms, a.gear_states, a.ap_states, a.speeds, a.raw_frame_count, a.source, a.is_event) == ("car1", "2025-01-01_12-00-00-front.mp4", 1_735_732_800_000, [1, 2], [0, 1], [1.0, 0.0], None, "sei", False)
    assert a.points[1][1] != a.points[1][1] and b.gear_states == [] and b.is_event and b.source == "svc" and a.telemetry.batteryPctStart == 80.0
    assert s["samples"].first().raw_ts == "1000" and s["charge_costs"].first().amount == 2.5
    tags = {r.cost_key: r.tag_json for r in s["charge_tags"].collect()}
    assert tags["1000"] == "home" and json.loads(tags["2000"]) == ["a", "b"]
    drive_data.write_drive_data(s, f"{tmp_path}/out")
    doc = json.loads(spark.read.text(f"{tmp_path}/out").first().value)
    assert [r["file"] for r in doc["routes"]] == [a.path, b.path] and doc["routes"][0]["gearStates"] == "AQI=" and doc["driveTags"] == DOCUMENT["driveTags"]
    drive_data.write_routes(s["clips"], f"{tmp_path}/lines")
    back = drive_data.read_routes(spark, f"{tmp_path}/lines").orderBy("seq").collect()
    assert [r.gear_states for r in back] == [[1, 2], []]


def test_write_clips_appends_only_new_paths(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select(F.lit("v").alias("vehicle_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.col("id").alias("t_ms"), F.lit("2025-01-01").alias("date"))
    drive_data.write_clips(rows(0, 5), f"{tmp_path}/store")
    drive_data.write_clips(rows(3, 8), f"{tmp_path}/store")
    got = spark.read.parquet(f"{tmp_path}/store")
    assert got.count() == 8 and got.select("path").distinct().count() == 8


def test_csv_drives_and_states(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "Started At (MDT),Ended At (MDT),Starting Location,Starting Latitude,Starting Longitude,Ending Latitude,Ending Longitude,Starting Odometer (mi),Distance (mi),Autopilot Distance (mi)\n"
        '2024-07-15 08:00,2024-07-15 08:30:30,"Home, ""Main"" St\nTown",40.5,-111.5,40.6,-111.6,12345.67,10.5,2\n\n'
        "N/A,2024-07-15 09:00,x,1,2,3,4,5,6,7\n2024-07-16 08:00,2024-07-16 09:00,y,,,40.6,-111.6,abc,abc,1.5 mi\n")
    a, b = csv_imports.read_import_drives(spark, f"{tmp_path}/d.csv").orderBy("start_ms").collect()
    assert (a.start_ms, a.end_ms - a.start_ms, a.distance_mi, a.start_lat) == (1_721_052_000_000, 1_830_000, 10.5, 40.5)
    assert (b.start_lat, b.odometer_start, b.distance_mi, b.assisted_mi) == (None, None, 0.0, 1.5)
    (tmp_path / "s.csv").write_text("Timestamp (UTC),Latitude,Longitude,Shift State,Speed (mph),Odometer (mi)\n2024-07-15 14:00:00,1,2,d ,30,5\nN/A,1,2,D,1,1\n2024-07-15 14:01:00,1,x,D,1,1\n")
    (r,) = csv_imports.read_import_states(spark, f"{tmp_path}/s.csv").collect()
    assert (r.t_ms, r.shift, r.speed_mph) == (1_721_052_000_000, "D", 30.0)


def test_geojson(spark):
    pts = spark.createDataFrame([("v", 1, 1, 2.0, 20.0), ("v", 1, 0, 1.0, 10.0), ("v", 2, 0, 1.0, 1.0)], "vehicle_id string, drive_id bigint, idx bigint, lat double, lng double")
    (f,) = drive_data.drives_geojson(pts).collect()
    assert json.loads(f.feature)["geometry"] == {"type": "LineString", "coordinates": [[10.0, 1.0], [20.0, 2.0]]}
    sites = spark.createDataFrame([("v", "a", 1.0, 2.0, 3), ("v", "b", None, None, 1)], "vehicle_id string, site_id string, lat double, lng double, visits bigint")
    (p,) = drive_data.sites_geojson(sites).collect()
    assert json.loads(p.feature)["geometry"]["coordinates"] == [2.0, 1.0]
