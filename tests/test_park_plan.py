"""Cuts at parking take one shuffle and an order of the parts of clips, with nothing regrouped."""

from helpers import SF

from tripspark.plans import core
from tripspark.operators import sessions


def test_one_shuffle_and_two_sorts(spark):
    plan = core.park_splits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2 and "Aggregate" not in plan and "Join" not in plan


def test_parts_of_runs(spark):
    run = lambda *rs: [(g, float(n)) for g, n in rs]
    rows = [("v", 1, 0, 0, 10, run((0, 30), (1, 10), (2, 10), (0, 30), (0, 30), (0, 1), (1, 9))), ("v", 2, 0, 1, 10, run((None, 5), (0, 1), (4, 30))), ("v", 3, 0, 2, 10, []), ("v", 4, 0, 3, 10, None), ("v", 5, 0, 4, 10, run((0, 0), (1, 0)))]
    df = spark.createDataFrame(rows, "vehicle_id string, seq bigint, drive_id bigint, t_ms bigint, n_points int, gear_runs array<struct<gear:bigint,frames:double>>")
    got = sorted((r.seq, r.seg_no, r.parked, r.start_frame, r.end_frame) for r in sessions.park_segments(df).collect())
    assert got == [(1, 1, True, 0.0, 30.0), (1, 2, False, 30.0, 50.0), (1, 3, True, 50.0, 80.0), (1, 4, True, 80.0, 110.0), (1, 5, False, 110.0, 120.0), (2, 1, False, 0.0, 36.0)]
    assert sorted((r.seq, r.seg_no, r.cut_drive) for r in sessions.park_splits(df).collect()) == [(1, 2, 1), (1, 5, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]
