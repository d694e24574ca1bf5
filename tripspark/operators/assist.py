"""Events of driver assist: disengagements and accelerator pushes, by windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.operators.points import DRIVE, by_point

FSD, PARK = 1, 0


def disengagement_events(points: DataFrame, park_ms: int = 2000) -> DataFrame:
    """Events (vehicle_id, drive_id, idx, lat, lng): FSD left, unless Park follows within 2 s before FSD is engaged again.

    At the end of the drive a pending one counts unless the last gear is Park. Each
    row carries the last pending one before it; per pending one the first row of
    each kind decides. Rows are compared by index: times may step back.
    """
    order = by_point()
    prev = F.lag("ap").over(order)
    left = (prev == FSD) & (F.col("ap") != FSD)
    rows = points.withColumn("left", F.coalesce(left, F.lit(False)))
    pend = F.last(F.when(F.col("left"), F.struct("idx", "t_ms", "lat", "lng")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last_gear = F.last("gear").over(Window.partitionBy(*DRIVE).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"p": pend, "last_gear": last_gear})
    own = rows.where("left").select(*DRIVE, "idx", "lat", "lng", "last_gear")
    after = rows.where("p IS NOT NULL")
    since = F.col("t_ms") - F.col("p.t_ms")
    marks = after.groupBy(*DRIVE, F.col("p.idx").alias("idx")).agg(
        F.min(F.when((F.col("gear") == PARK) & (since <= park_ms), F.col("idx"))).alias("parked"),
        F.min(F.when((since > park_ms) | (F.col("ap") == FSD), F.col("idx"))).alias("over"))
    out = own.join(marks, [*DRIVE, "idx"], "left")
    never = F.col("parked").isNull() & F.col("over").isNull()
    cancelled = F.col("parked").isNotNull() & (F.col("over").isNull() | (F.col("parked") <= F.col("over")))
    return out.where(F.when(never, F.col("last_gear") != PARK).otherwise(~cancelled)).select(*DRIVE, "idx", "lat", "lng")


def accel_push_events(points: DataFrame, wait_ms: int = 3000) -> DataFrame:
    """Events (vehicle_id, drive_id, idx, lat, lng): the pedal pressed above 1 % in FSD, 3 s after engaging, and let go.

    idx, lat and lng are of the press; fractions up to 1 are percent / 100. A run of
    FSD that begins with the drive does not wait. The first point marks nothing.
    """
    order = by_point()
    prev = F.lag("ap").over(order)
    engaged = (F.col("ap") == FSD) & (F.coalesce(prev, F.lit(FSD)) != FSD)
    pct = F.when(F.col("accel") <= 1, F.col("accel") * 100.0).otherwise(F.col("accel"))
    rows = points.withColumns({"eng": engaged, "pct": pct, "first": prev.isNull()})
    rows = rows.withColumns({
        "run": F.sum(F.col("eng").cast("int")).over(order),
        "since": F.coalesce(F.last(F.when(F.col("eng"), F.col("t_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
    })
    rows = rows.where((F.col("ap") == FSD) & ~F.col("first"))
    mark = F.when((F.col("pct") > 1) & (F.col("t_ms") - F.col("since") >= wait_ms), F.lit(1)).when(F.col("pct") <= 0, F.lit(0))
    run = Window.partitionBy(*DRIVE, "run").orderBy("idx")
    marks = rows.withColumn("mark", mark).where("mark IS NOT NULL")
    # the first press after the previous release is where the push is
    marks = marks.withColumn("before", F.lag("mark").over(run))
    opening = F.when((F.col("mark") == 1) & (F.coalesce(F.col("before"), F.lit(0)) == 0), F.struct("idx", "lat", "lng"))
    marks = marks.withColumn("open", F.last(opening, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return marks.where("mark = 0 AND before = 1").select(*DRIVE, "open.idx", "open.lat", "open.lng")


def event_counts(points: DataFrame) -> DataFrame:
    """Per drive: disengagements and accel_pushes (0 where there are none)."""
    part = lambda rows, d, a: rows.select(*DRIVE, F.lit(d).alias("d"), F.lit(a).alias("a"))
    rows = part(points, 0, 0).unionByName(part(disengagement_events(points), 1, 0)).unionByName(part(accel_push_events(points), 0, 1))
    return rows.groupBy(*DRIVE).agg(F.sum("d").alias("disengagements"), F.sum("a").alias("accel_pushes"))
