"""Scans that spread a key over tasks against windows, and drives of a heavy vehicle."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripspark.operators import drives, scans, sessions
from tripspark.plans import drive_queries
from helpers import SF


@pytest.fixture(scope="module")
def heavy(spark):
    """One vehicle of nine tenths of the rows, with nulls, ties and long stretches without a value."""
    rnd, rows, t = random.Random(3), [], 0
    for k in range(6000):
        t += rnd.choice([0, 1000, 60_000, 299_999, 300_000, 300_001, 2_000_000])
        rows.append(("heavy" if rnd.random() < 0.9 else f"v{rnd.randrange(40)}", k, t, rnd.random() if rnd.random() < 0.01 else None, rnd.choice([None, 0, 1, 2]), "x" * rnd.randrange(9)))
    return spark.createDataFrame(rows, "vehicle_id string, seq bigint, t_ms bigint, b double, n int, payload string").repartition(16)


@pytest.mark.parametrize("parts", [1, 7, 61])
def test_scan_equals_windows(spark, heavy, parts):
    conf, key = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(key, "false")
    try:
        what = scans.Scan(("vehicle_id",), lag=("payload", "b"), last=("b",), sums=("n",), gaps={"drive": ("t_ms", 300_000), "window": ("t_ms", 1_800_000)})
        got = scans.scan(heavy, ("t_ms", "seq"), what)
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == parts and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
        got = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        spark.conf.unset(key)
    w = Window.partitionBy("vehicle_id").orderBy("t_ms", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = lambda ms: F.sum(F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) > ms, F.lit(True)).cast("bigint")).over(w)
    one = heavy.withColumns({"g1": F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) > 300_000, F.lit(True)).cast("bigint"), "g2": F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) > 1_800_000, F.lit(True)).cast("bigint")})
    want = one.select(*heavy.columns, F.lag("payload").over(w), F.lag("b").over(w), F.last("b", ignorenulls=True).over(upto), F.coalesce(F.sum("n").over(upto), F.lit(0)), F.sum("g1").over(upto), F.sum("g2").over(upto))
    assert got == sorted(map(tuple, want.collect()), key=lambda r: r[1])


def test_empty_and_windows_by_scan(spark, heavy):
    assert scans.number_gaps(heavy.limit(0), 1000, "w").count() == 0
    for f, name in ((sessions.time_windows, "window_id"), (sessions.sessionize_drives, "drive_id")):
        rows = lambda df: sorted(map(tuple, df.select("seq", name).collect()))  # noqa: E731, B023
        assert rows(f(heavy, spread=True)) == rows(f(heavy))


def test_drives_of_a_heavy_vehicle(spark):
    clips = drive_queries.point_clips(spark, SF).withColumn("vehicle_id", F.when(F.col("vehicle_id") % 10 != 0, F.lit(1)).otherwise(F.col("vehicle_id")))
    plain, spread = drives.drive_parts(clips), drives.drive_parts(clips, spread=True)
    dense = F.dense_rank().over(Window.partitionBy("vehicle_id").orderBy("drive_id")).cast("bigint")
    rows = lambda df: sorted(map(tuple, df.withColumn("drive_id", dense).collect()), key=repr)
    assert rows(spread) == rows(plain) and plain.count() > 500
