"""Points of provider drives in one pass."""

from tripspark.operators import imports


def test_points_or_ends_with_one_shuffle_of_points(spark):
    points = [("v", 1, 10.0, 1.0, 2.0, 10.0), ("v", 1, 20.0, 1.5, 2.0, None), ("v", 1, 30.0, None, 2.0, 1.0), ("v", 2, 10.0, 3.0, 4.0, 0.0), ("v", 4, 10.0, 3.0, 4.0, 0.0), ("v", 9, 2e12, 1.0, 1.0, 0.0), ("v", 9, 1.0, 1.0, 1.0, 0.0)]
    p = spark.createDataFrame(points, "vehicle_id string, drive_id bigint, t double, lat double, lng double, speed_mph double")
    drives = [("v", 1, 1, 2, 5.0, 5.0, 6.0, 6.0, "1.00"), ("v", 2, 60_000, 180_000, 5.0, 5.0, 6.0, 6.0, "2.00"), ("v", 3, 60_000, 180_000, 5.0, 5.0, 6.0, 6.0, "3.00"), ("v", 4, 1, 2, None, 5.0, 6.0, 6.0, "4.00"), ("v", 5, None, 2, 1.0, 5.0, 6.0, 6.0, "5.00")]
    d = spark.createDataFrame(drives, "vehicle_id string, drive_id bigint, start_ms bigint, end_ms bigint, start_lat double, start_lng double, end_lat double, end_lng double, odometer_text string")
    got = sorted((r.drive_id, r.t_ms, r.lat) for r in imports.api_points(p, d).collect())
    assert got == [(1, 10_000.0, 1.0), (1, 20_000.0, 1.5), (2, 10_000.0, 3.0), (2, 60_000.0, 5.0), (2, 180_000.0, 6.0), (3, 60_000.0, 5.0), (3, 180_000.0, 6.0), (9, 1000.0, 1.0), (9, 2e12, 1.0)]
    clips = imports.api_drive_clips(p, d, "svc")
    assert sorted((r.drive_id, r.frame_count) for r in clips.select("drive_id", "frame_count").collect()) == [(1, 2), (2, 1), (2, 1), (2, 1), (3, 1), (3, 1)]
    joins = clips._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Join ") == 1 and "Union" not in joins
