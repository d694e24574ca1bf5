"""Repair: short recording gaps and clips whose evidence is to be refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.paths import repair_timestamp_ms
from tripspark.functions.scalars import geodesic_m, js_round


def repair_times(clips: DataFrame, tz: str = "UTC") -> DataFrame:
    """Clips with ``t_ms`` as the repair reads it from ``file`` (repair_timestamp_ms); those without stay, with null."""
    return clips.withColumn("t_ms", repair_timestamp_ms(F.col("file"), tz))


def find_recording_gaps(clips: DataFrame, clip_ms: int = 60_000, most_ms: int = 300_000) -> DataFrame:
    """Neighbours in time with more than a minute and up to five after the clip's end: cur_end, gap_ms, both points, gear, date.

    Both have points, the same date, and neither side is in Park. Expects t_ms, seq,
    date, first_lat, first_lng, last_lat, last_lng, first_gear, last_gear.
    """
    w = Window.partitionBy("vehicle_id").orderBy("t_ms", "seq")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("t_ms", "date", "first_lat", "first_lng", "first_gear")}
    rows = clips.where("t_ms IS NOT NULL").withColumns(nxt)
    rows = rows.withColumn("cur_end", F.col("t_ms") + clip_ms).withColumn("gap_ms", F.col("n_t_ms") - F.col("cur_end"))
    good = (F.col("gap_ms") > clip_ms) & (F.col("gap_ms") <= most_ms) & F.col("last_lat").isNotNull() & F.col("n_first_lat").isNotNull()
    good = good & ~F.coalesce(F.col("last_gear") == 0, F.lit(False)) & ~F.coalesce(F.col("n_first_gear") == 0, F.lit(False)) & F.col("date").eqNullSafe(F.col("n_date"))
    return rows.where(good).select("vehicle_id", "seq", "cur_end", "gap_ms", "date", "last_lat", "last_lng", F.col("n_first_lat").alias("next_lat"), F.col("n_first_lng").alias("next_lng"), F.col("last_gear").alias("gear"))


def bridge_gaps(gaps: DataFrame) -> DataFrame:
    """A bridge clip per gap: file, points (one a second on a straight line), speeds (the mean), gear_states, gear_runs."""
    steps = F.greatest(js_round(F.col("gap_ms") / 1000.0), F.lit(2.0)).cast("bigint")
    at = F.sequence(F.lit(1).cast("bigint"), steps - 1)
    n = (steps - 1).cast("int")
    speed = geodesic_m(F.col("last_lat"), F.col("last_lng"), F.col("next_lat"), F.col("next_lng")) / (F.col("gap_ms") / 1000.0)
    mix = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    point = lambda s: F.array(mix("last_lat", "next_lat", s / steps), mix("last_lng", "next_lng", s / steps))
    gear = F.coalesce("gear", F.lit(1))
    time = F.date_format(F.timestamp_millis("cur_end"), "HH-mm-ss")
    date = F.coalesce("date", F.lit("undefined"))
    return gaps.select(
        "vehicle_id", F.col("cur_end").alias("t_ms"), "date", F.concat(date, F.lit("/"), date, F.lit("_"), time, F.lit("-front-bridge.mp4")).alias("file"), F.transform(at, point).alias("points"),
        F.array_repeat(speed, n).alias("speeds"), F.array_repeat(gear, n).alias("gear_states"), F.array_repeat(F.lit(0), n).alias("ap_states"),
        F.array(F.struct(gear.alias("gear"), n.cast("double").alias("frames"))).alias("gear_runs"), F.lit("sei").alias("source"))


def without_bridges(clips: DataFrame) -> DataFrame:
    """Bridges are made anew: old ones go first. Expects path."""
    return clips.where(~F.col("path").contains("-front-bridge.mp4"))


def summon_candidates(clips: DataFrame, drives: DataFrame, max_mps: float = 4.5, max_ms: int = 600_000, edge: int = 10) -> DataFrame:
    """(vehicle_id, path) of clips whose evidence should be refreshed.

    All clips of slow, short recorded drives; of longer ones the slow clips at either
    end, up to ``edge``, with the first fast one after them. Bridges and clips with
    current evidence are left out. Expects clips: drive_id, t_ms, seq, path, slow, has_evidence; drives: source, summon, max_speed_mph, duration_ms.
    """
    d = drives.where("source = 'sei' AND NOT summon").select("vehicle_id", "drive_id", ((F.col("max_speed_mph") <= max_mps * 2.23694 + 0.01) & (F.col("duration_ms") <= max_ms)).alias("whole"))
    rows = clips.join(d, ["vehicle_id", "drive_id"])
    key = Window.partitionBy("vehicle_id", "drive_id")
    taken = F.lit(False)
    for w in (key.orderBy("t_ms", "seq"), key.orderBy(F.desc("t_ms"), F.desc("seq"))):
        n = F.row_number().over(w)
        fast = F.sum((~F.col("slow")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        # slow so far, or the first fast one after at least one slow
        taken = taken | ((n <= edge) & ((fast == 0) | ((fast == 1) & ~F.col("slow") & (n > 1))))
    rows = rows.withColumn("_t", F.col("whole") | taken)
    return rows.where("_t AND NOT has_evidence AND NOT contains(path, '-front-bridge.mp4')").select("vehicle_id", "path").distinct()
