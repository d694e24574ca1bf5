"""All measures of drives in one pass over their points.

The steps, the runs of assist and the marks of the pedal come from windows of one
kind (a drive, by index), so points that lie by drive are sorted once and not
shuffled. Sums are taken in two aggregates: per stretch between two
disengagements, where it is settled whether the first of them counts, then per
drive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.scalars import M_PER_KM, M_PER_MILE, MPS_TO_KMH, MPS_TO_MPH, geodesic_m, js_round, percent_of, round2
from tripspark.operators.assist import FSD, PARK
from tripspark.operators.points import DRIVE, by_point, with_previous
from tripspark.operators.stats import MODES

MARKS = ("d_m", "dt_ms", "left", "stretch", "pending_ms", "push")


def measured_points(points: DataFrame, wait_ms: int = 3000) -> DataFrame:
    """``points`` with d_m and dt_ms of the step, left (FSD left here), stretch (of times left so far), pending_ms (time of the last) and push (the pedal let go after a press).

    Expects idx, t_ms, lat, lng, ap, accel.
    """
    order = by_point()
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = with_previous(points, "lat", "lng", "t_ms", "ap")
    on, was = F.col("ap") == FSD, F.col("_pap") == FSD
    rows = rows.select(
        *points.columns, geodesic_m(F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng")).alias("d_m"), (F.col("t_ms") - F.col("_pt_ms")).alias("dt_ms"),
        F.coalesce(was & ~on, F.lit(False)).alias("left"), (on & ~F.coalesce(was, F.lit(True))).alias("_engaged"), F.col("_pap").isNull().alias("_first"))
    rows = rows.withColumns({
        "stretch": F.sum(F.col("left").cast("int")).over(upto), "pending_ms": F.last(F.when(F.col("left"), F.col("t_ms")), ignorenulls=True).over(upto),
        "_run": F.sum(F.col("_engaged").cast("int")).over(upto), "_since": F.coalesce(F.last(F.when(F.col("_engaged"), F.col("t_ms")), ignorenulls=True).over(upto), F.lit(0)),
    })
    pct = F.when(F.col("accel") <= 1, F.col("accel") * 100.0).otherwise(F.col("accel"))
    mark = F.when((pct > 1) & (F.col("t_ms") - F.col("_since") >= wait_ms), F.lit(1)).when(pct <= 0, F.lit(0))
    rows = rows.withColumn("_mark", F.when((F.col("ap") == FSD) & ~F.col("_first"), mark))
    before = F.last(F.when(F.col("_mark").isNotNull(), F.struct("_run", "_mark")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before)
    push = (F.col("_mark") == 0) & (F.col("_b._mark") == 1) & (F.col("_b._run") == F.col("_run"))
    return rows.select(*points.columns, "d_m", "dt_ms", "left", "stretch", "pending_ms", F.coalesce(push, F.lit(False)).alias("push"))


def drive_measures(measured: DataFrame, park_ms: int = 2000, recorded_max: float = 100.0, derived_max: float = 70.0, gather: Column | None = None) -> DataFrame:
    """Per drive: first and last point time, points, distances, speeds, assist by mode, disengagements, accel_pushes, has_speeds, max_speed_mps.

    The rules are those of drive_stats, assist_distance_time, disengagement_events and accel_push_events.
    ``gather``: what of a row comes along in an array ``gathered``, in no order; null for most rows.
    """
    inner, recorded = F.col("d_m").isNotNull(), F.abs("speed")
    step = F.col("d_m") / (F.col("dt_ms") / 1000.0)
    rec = F.when(inner & (recorded < recorded_max), recorded)
    der = F.when(inner & (F.col("dt_ms") > 0), F.when(step < derived_max, step))
    since, after = F.col("t_ms") - F.col("pending_ms"), ~F.col("left") & (F.col("stretch") > 0)
    own = {name: F.col("ap") == mode for name, mode in MODES.items()}
    sums = {"m": F.col("d_m"), "am": F.when(F.col("ap") != 0, F.col("d_m")), "rec_s": F.col("_rec"), "rec_n": F.col("_rec").isNotNull().cast("bigint"), "der_s": F.col("_der"), "der_n": F.col("_der").isNotNull().cast("bigint"), "accel_pushes": F.col("push").cast("bigint")}
    for name, here in own.items():
        sums |= {f"{name}_t": F.when(here, F.col("dt_ms")), f"{name}_m": F.when(here, F.col("d_m"))}
    tops = {"rec_x": F.col("_rec"), "der_x": F.col("_der"), "any": (F.coalesce(F.col("speed"), F.lit(0.0)) != 0).cast("int"), "last": F.struct("idx", "gear"), "to_ms": F.col("t_ms")}
    lists = [] if gather is None else [F.collect_list(gather).alias("gathered")]
    part = measured.withColumns({"_rec": rec, "_der": der}).groupBy(*DRIVE, "stretch").agg(
        *lists,
        F.min("t_ms").alias("from_ms"), F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()), *(F.max(v).alias(k) for k, v in tops.items()),
        F.min(F.when(after & (F.col("gear") == PARK) & (since <= park_ms), F.col("idx"))).alias("parked"),
        F.min(F.when(after & ((since > park_ms) | (F.col("ap") == FSD)), F.col("idx"))).alias("over"))
    open_ = F.col("parked").isNull() & F.col("over").isNull()
    cancelled = F.col("parked").isNotNull() & (F.col("over").isNull() | (F.col("parked") <= F.col("over")))
    pending = F.col("stretch") > 0
    g = part.groupBy(*DRIVE).agg(
        *(F.flatten(F.collect_list("gathered")).alias("gathered") for _ in lists),
        F.min("from_ms").alias("from_ms"), F.sum("n").alias("point_count"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums), *(F.max(k).alias(k) for k in tops),
        F.count_if(pending & ~open_ & ~cancelled).alias("settled"), F.count_if(pending & open_).alias("open"))
    pick = lambda a, b: F.coalesce(F.when(F.col("any") == 1, a).otherwise(b), F.lit(0.0))
    mean = lambda k: F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_s") / F.col(f"{k}_n"))
    g = g.withColumns({"avg": pick(mean("rec"), mean("der")), "top": pick(F.col("rec_x"), F.col("der_x"))})
    out: list[Column] = [
        F.col("from_ms"), F.col("to_ms"), F.col("point_count"), round2(F.col("m") / M_PER_MILE).alias("distance_mi"), round2(F.col("m") / M_PER_KM).alias("distance_km"),
        round2(F.col("avg") * MPS_TO_MPH).alias("avg_speed_mph"), round2(F.col("top") * MPS_TO_MPH).alias("max_speed_mph"), round2(F.col("avg") * MPS_TO_KMH).alias("avg_speed_kmh"), round2(F.col("top") * MPS_TO_KMH).alias("max_speed_kmh"),
        (F.col("any") == 1).alias("has_speeds"), F.col("top").alias("max_speed_mps")]
    for name in MODES:
        out += [js_round(F.col(f"{name}_t").cast("double")).cast("bigint").alias(f"{name}_engaged_ms"), round2(F.col(f"{name}_m") / M_PER_KM).alias(f"{name}_distance_km"),
                round2(F.col(f"{name}_m") / M_PER_MILE).alias(f"{name}_distance_mi"), percent_of(F.col(f"{name}_m"), F.col("m")).alias(f"{name}_percent")]
    # the last disengagement may be open at the end of the drive
    disengaged = F.col("settled") + F.when(F.col("last.gear") != PARK, F.col("open")).otherwise(F.lit(0))
    return g.select(*DRIVE, *out, percent_of(F.col("am"), F.col("m")).alias("assisted_percent"), disengaged.alias("disengagements"), F.col("accel_pushes"), *("gathered" for _ in lists))
