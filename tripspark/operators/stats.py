"""Roll-ups: drive statistics, totals, scores, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.scalars import M_PER_KM, M_PER_MILE, MPS_TO_KMH, MPS_TO_MPH, js_round, percent_of, round2
from tripspark.operators.points import DRIVE, with_steps

MODES = {"fsd": 1, "autosteer": 2, "tacc": 3}


def drive_stats(points: DataFrame, recorded_max: float = 100.0, derived_max: float = 70.0) -> DataFrame:
    """Per drive: start_ms, end_ms, duration_ms, distances, average and top speeds, clip and point counts.

    Recorded speeds (below 100 m/s) count if the drive has any that is not zero,
    else each step's (below 70 m/s); the first point has no speed. Expects idx,
    t_ms, lat, lng, speed, seq and, if there, end_t_ms of a point's clip.
    """
    rows = with_steps(points)
    recorded, step = F.abs("speed"), F.col("d_m") / (F.col("dt_ms") / 1000.0)
    inner = F.col("d_m").isNotNull()
    rec = F.when(inner & (recorded < recorded_max), recorded)
    der = F.when(inner & (F.col("dt_ms") > 0), F.when(step < derived_max, step))
    end = "end_t_ms" if "end_t_ms" in points.columns else "t_ms"
    g = rows.withColumns({"_rec": rec, "_der": der}).groupBy(*DRIVE).agg(
        F.min("t_ms").alias("start_ms"), F.max(end).alias("end_ms"), F.coalesce(F.sum("d_m"), F.lit(0.0)).alias("m"),
        F.max((F.coalesce(F.col("speed"), F.lit(0.0)) != 0).cast("int")).alias("_any"),
        *(F.coalesce(f(c), F.lit(0.0)).alias(f"{c}{n}") for c in ("_rec", "_der") for f, n in ((F.avg, "_avg"), (F.max, "_max"))),
        F.count_distinct("seq").alias("clip_count"), F.count(F.lit(1)).alias("point_count"))
    pick = lambda n: F.when(F.col("_any") == 1, F.col(f"_rec{n}")).otherwise(F.col(f"_der{n}"))
    return g.select(
        *DRIVE, F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"), (F.col("end_ms") - F.col("start_ms")).cast("bigint").alias("duration_ms"),
        round2(F.col("m") / M_PER_MILE).alias("distance_mi"), round2(F.col("m") / M_PER_KM).alias("distance_km"),
        round2(pick("_avg") * MPS_TO_MPH).alias("avg_speed_mph"), round2(pick("_max") * MPS_TO_MPH).alias("max_speed_mph"),
        round2(pick("_avg") * MPS_TO_KMH).alias("avg_speed_kmh"), round2(pick("_max") * MPS_TO_KMH).alias("max_speed_kmh"), "clip_count", "point_count")


def assist_distance_time(points: DataFrame) -> DataFrame:
    """Per drive and mode: engaged ms, distance in km and mi, percent of the distance; and the assisted percent of all modes.

    A step belongs to the mode of the point where it ends.
    """
    rows = with_steps(points)
    aggs: list[Column] = [F.coalesce(F.sum("d_m"), F.lit(0.0)).alias("m"), F.coalesce(F.sum(F.when(F.col("ap") != 0, F.col("d_m"))), F.lit(0.0)).alias("assisted_m")]
    for name, mode in MODES.items():
        own = F.col("ap") == mode
        aggs += [F.coalesce(F.sum(F.when(own, F.col("dt_ms"))), F.lit(0)).alias(f"{name}_t"), F.coalesce(F.sum(F.when(own, F.col("d_m"))), F.lit(0.0)).alias(f"{name}_m")]
    g = rows.groupBy(*DRIVE).agg(*aggs)
    out = []
    for name in MODES:
        out += [js_round(F.col(f"{name}_t").cast("double")).cast("bigint").alias(f"{name}_engaged_ms"), round2(F.col(f"{name}_m") / M_PER_KM).alias(f"{name}_distance_km"),
                round2(F.col(f"{name}_m") / M_PER_MILE).alias(f"{name}_distance_mi"), percent_of(F.col(f"{name}_m"), F.col("m")).alias(f"{name}_percent")]
    return g.select(*DRIVE, *out, percent_of(F.col("assisted_m"), F.col("m")).alias("assisted_percent"))


def telemetry_rollup(clips: DataFrame) -> DataFrame:
    """Per drive, over distinct clips in time order: first start and last end values, ranges, means, sums.

    Expects drive_id, t_ms, seq, path and the telemetry columns.
    """
    once = clips.withColumn("_k", F.row_number().over(Window.partitionBy(*DRIVE, "path").orderBy("t_ms", "seq"))).where("_k = 1")
    return telemetry_figures(once.groupBy(*DRIVE).agg(*telemetry_aggs(F.struct("t_ms", "seq"))))


def telemetry_aggs(at: Column) -> list[Column]:
    """The roll-up's aggregates over clips in the order of ``at``, one row a clip."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    return [
        round2(first("battery_start")).alias("battery_start"), round2(last("battery_end")).alias("battery_end"),
        round2(F.min("interior_min")).alias("interior_min"), round2(F.max("interior_max")).alias("interior_max"),
        round2(F.avg("exterior_avg")).alias("exterior_avg"), js_round(F.sum("hvac_s")).alias("hvac_s"),
        *(round2(last(c)).alias(c) for c in ("tire_fl", "tire_fr", "tire_rl", "tire_rr")),
        round2(first("odometer_start")).alias("odometer_start"), round2(last("odometer_end")).alias("odometer_end"),
        first("location_start").alias("location_start"), last("location_end").alias("location_end")]


def telemetry_figures(g: DataFrame) -> DataFrame:
    """Adds battery_used and odometer_driven (of a way not below 0)."""
    driven = F.col("odometer_end") - F.col("odometer_start")
    return g.withColumn("battery_used", round2(F.col("battery_start") - F.col("battery_end"))).withColumn("odometer_driven", F.when(driven >= 0, round2(driven)))


def fleet_totals(drives: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over all drives (or per ``by``): sums of the drives' rounded values.

    Assist figures are of recorded (``sei``), not summoned drives only.
    """
    own = (F.col("source") == "sei") & ~F.col("summon")
    part = lambda c: round2(F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0.0)))
    whole = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast("bigint")
    aggs = [
        F.count(F.lit(1)).alias("drives"), round2(F.coalesce(F.sum("distance_mi"), F.lit(0.0))).alias("distance_mi"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("bigint").alias("duration_ms"),
        part("distance_km").alias("recorded_km"), part("fsd_distance_km").alias("fsd_km"), part("autosteer_distance_km").alias("autosteer_km"), part("tacc_distance_km").alias("tacc_km"),
        whole("disengagements").alias("disengagements"), whole("accel_pushes").alias("accel_pushes"), whole("fsd_engaged_ms").alias("fsd_engaged_ms"), part("fsd_percent").alias("fsd_percent_sum"),
        F.count_if(own).alias("recorded_drives"), F.count_if(F.col("source") != "sei").alias("imported_drives"), F.count_if(F.col("summon")).alias("summon_drives")]
    return drives.groupBy(*by).agg(*aggs)


def fsd_scores(totals: DataFrame) -> DataFrame:
    """Over fleet_totals: score (floor to 0.1 of the share driven by FSD), shares by mode, averages per drive, a label."""
    km = F.col("recorded_km")
    share = lambda c: F.when(km > 0, js_round(F.col(c) / km * 100.0)).otherwise(0.0)
    out = totals.withColumn("score", F.when(km > 0, F.floor(F.col("fsd_km") / km * 1000.0) / 10.0).otherwise(0.0))
    out = out.withColumns({"fsd_share": share("fsd_km"), "autosteer_share": share("autosteer_km"), "tacc_share": share("tacc_km")})
    per = lambda c: F.when(F.col("recorded_drives") > 0, js_round(F.col(c) / F.col("recorded_drives") * 10.0) / 10.0).otherwise(0.0)
    label = F.when(F.col("score") >= 90, "Great").when(F.col("score") >= 70, "Good").when(F.col("score") >= 40, "Okay").otherwise("Bad")
    return out.withColumns({
        "manual_share": F.greatest(F.lit(0.0), 100.0 - F.col("fsd_share") - F.col("autosteer_share") - F.col("tacc_share")),
        "disengagements_per_drive": per("disengagements"), "pushes_per_drive": per("accel_pushes"), "label": label,
    }).select(*[c for c in ("vehicle_id",) if c in totals.columns], "score", "fsd_share", "autosteer_share", "tacc_share", "manual_share", "disengagements_per_drive", "pushes_per_drive", "label")


def processing_summary(drives: DataFrame, routes: DataFrame) -> DataFrame:
    """What a run ends with: drives, routes, km, mi, hours, FSD hours, km and percent of the distance."""
    n = routes.agg(F.count(F.lit(1)).alias("routes"))
    g = drives.agg(F.count(F.lit(1)).alias("drives"), F.sum("distance_km").alias("k"), F.sum("distance_mi").alias("mi"), F.sum("duration_ms").alias("t"), F.sum("fsd_engaged_ms").alias("ft"), F.sum("fsd_distance_km").alias("fk"))
    return g.join(n, how="cross").select(  # one row each
        "drives", "routes", round2(F.col("k")).alias("distance_km"), round2(F.col("mi")).alias("distance_mi"), round2(F.col("t") / 3_600_000.0).alias("hours"),
        round2(F.col("ft") / 3_600_000.0).alias("fsd_hours"), round2(F.col("fk")).alias("fsd_km"), percent_of(F.col("fk"), F.col("k")).alias("fsd_percent"))
