"""Dyadic interval joins, and a store that grows by batches."""

import random

from helpers import SF
from pyspark.sql import functions as F

from tripspark.operators import drives, incremental, intervals
from tripspark.plans import drive_queries

HOUR = intervals.HOUR


def test_cover_is_exact_and_short(spark):
    rnd = random.Random(5)
    spans = [(0, 0), (0, HOUR), (-HOUR, HOUR), (5 * HOUR, 4), (0, 87_660 * HOUR), (-10**18, 10**18)] + [(a, a + int(10 ** rnd.uniform(0, 11.5))) for a in (rnd.randrange(-(10**12), 2 * 10**12) for _ in range(300))]
    got = spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("c")).collect()
    half = 1 << (intervals.LEVELS - 1)
    for r in got:
        blocks = sorted((x._m << x._k, (x._m + 1) << x._k) for x in r.c)
        low, high = (min(max(t // HOUR, -half), half - 1) + half for t in (r.a, max(r.a, r.b)))
        assert blocks[0][0] == low and blocks[-1][1] == high + 1 and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:])), r
        assert len(blocks) <= 2 * intervals.LEVELS
    assert len(next(r for r in got if r.b == 87_660 * HOUR).c) < 60  # ten years


def test_each_overlap_once(spark):
    rnd = random.Random(8)
    some = lambda n, name: [(rnd.choice("xy"), f"{name}{k}", a, a + int(HOUR * 10 ** rnd.uniform(-2, 5))) for k, a in enumerate(rnd.randrange(0, 3000 * HOUR) for _ in range(n))]
    left, right = some(80, "l"), some(120, "r")
    l, r = spark.createDataFrame(left, "vehicle_id string, l string, ls bigint, le bigint"), spark.createDataFrame(right, "vehicle_id string, r string, rs bigint, re bigint")
    pairs = intervals.touching(l, r, ("ls", "le"), ("rs", "re")).where("ls < re AND rs < le").select("l", "r").collect()
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert sorted(map(tuple, pairs)) == want and len(want) > 500
    points = intervals.points_in_spans(r, "rs", l, ("ls", "le")).where("rs BETWEEN ls AND le").select("l", "r").collect()
    assert sorted(map(tuple, points)) == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[2] <= a[3])


COLUMNS = ("vehicle_id", "start_ms", "end_ms", "clip_count", "point_count", "distance_km", "disengagements", "accel_pushes", "source", "route_files", "assisted_percent")


def rows(df):
    return sorted(map(repr, df.select(*COLUMNS).collect()))


def test_batches_equal_one_run(spark, tmp_path):
    clips = drive_queries.point_clips(spark, SF)
    store, key = f"{tmp_path}/store", F.col("seq") % 1_000_000_000
    # most, then what follows for every second vehicle, then clips in between
    late = (F.col("t_ms") > clips.approxQuantile("t_ms", [0.7], 0.01)[0]) & (F.col("vehicle_id") % 2 == 0)
    parts = [clips.where(~late & (key % 400 != 0)), clips.where(late & (key % 400 != 0)), clips.where(key % 400 == 0)]
    for k, part in enumerate(parts):
        assert incremental.add_clips(store, part) == k + 1
    now = incremental.current_drives(spark, store)
    assert rows(now) == rows(drives.clips_to_drives(clips)["drives"])
    by = {r.batch: r.n for r in now.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(by) == {1, 2, 3} and by[1] > 5  # untouched windows keep the batch that wrote them
    # a clip that comes again replaces the one of its path
    again = parts[0].where("size(points) > 3 AND seq < 1000000000").limit(1).withColumn("speeds", F.transform("speeds", lambda x: x * 0 + 99.0))
    again = spark.createDataFrame(again.collect(), clips.schema)
    old = again.first()
    incremental.add_clips(store, again)
    merged = clips.where(~((F.col("vehicle_id") == old.vehicle_id) & (F.col("path") == old.path))).unionByName(again)
    assert rows(incremental.current_drives(spark, store)) == rows(drives.clips_to_drives(merged)["drives"])
    # a batch that failed before its commit is not seen, and its number is used again
    spark.range(3).write.parquet(f"{store}/windows/version=9/_temporary")
    assert incremental.latest_version(spark, store) == 4
