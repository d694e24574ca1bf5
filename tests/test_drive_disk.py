"""What the main flow writes and shuffles: drives and their parts, no points."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.operators import drives, endpoints, incremental
from tripspark.operators.points import DRIVE
from tripspark.plans import drive_queries
from helpers import SF


@pytest.fixture(scope="module")
def clips(spark):
    return drive_queries.point_clips(spark, SF).localCheckpoint()


def test_points_are_written_nowhere(spark, monkeypatch):
    kept, plain = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a: kept.append(df.columns) or plain(df, *a))
    out = drives.clips_to_drives(drive_queries.point_clips(spark, SF))
    assert isinstance(out["drives"], DataFrame) and len(kept) == 2
    assert not any({"idx", "points", "lat"} & set(c) for c in kept)


def test_arrays_are_shuffled_once(spark, clips):
    parts = drives.drive_parts(clips).localCheckpoint()
    even = drives._figures(drives._points(clips, parts, False)[0])._jdf.queryExecution().executedPlan().toString()
    assert even.count("Exchange hashpartitioning") == 1 and "Join" not in even


def test_ends_found_with_the_measures_are_those_of_the_points(spark, clips):
    parts = drives.drive_parts(clips).localCheckpoint()
    known = {c: F.when(F.col("evidence").bitwiseAND(F.lit(bit)) != 0, F.col(c)) for c, bit in (("gear", 1), ("speed", 2))}
    snapped = endpoints.endpoint_snap(drives.drive_points(clips, parts).withColumns(known))
    want = {(r.vehicle_id, r.drive_id, r.which): (r.lat, r.lng, r.accuracy_m, r.samples, r.stationary) for r in snapped.collect()}
    found = drives.drive_figures(clips, parts).select(*DRIVE, "start_place", "end_place").collect()
    assert {(r.vehicle_id, r.drive_id, w): tuple(r[f"{w}_place"]) for r in found for w in ("start", "end")} == want and len(want) > 500


def test_a_spread_run_has_the_same_figures(spark, clips):
    listed = [drives.clips_to_drives(clips, spread=s)["drives"].drop("drive_id") for s in (False, True)]
    rows = [sorted(map(repr, df.collect())) for df in listed]
    assert rows[0] == rows[1] and len(rows[0]) > 300


def test_batches_join_slim_rows_and_take_a_clip_once(spark, clips, tmp_path, monkeypatch):
    met, plain = [], incremental.points_in_spans
    monkeypatch.setattr(incremental, "points_in_spans", lambda points, *a: met.append(points.columns) or plain(points, *a))
    monkeypatch.setattr(incremental.clips_of, "__defaults__", (0,))  # the way of many clips
    own = clips.where("vehicle_id < 4 AND seq < 1000000000").localCheckpoint()
    # some clips come twice, under their numbers, then clips beside them
    for batch in (own.where("seq % 5 <> 2"), own.where("seq % 4 = 1 AND seq % 5 <> 2"), own.where("seq % 5 = 2")):
        incremental.add_clips(f"{tmp_path}/store", batch)
    now = incremental.current_drives(spark, f"{tmp_path}/store").drop("window_ms", "batch")
    want = drives.clips_to_drives(own)["drives"].drop("drive_id")
    rows = [sorted(map(repr, df.select(*sorted(want.columns)).collect())) for df in (now, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 20
    assert met and not any({"points", "gear_runs", "speeds"} & set(c) for c in met)
